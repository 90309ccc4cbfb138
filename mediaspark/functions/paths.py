"""Nested-path extraction from VARIANT values (E01), as column expressions within one row.

A path is a list of steps: ``"key"``, ``0`` (index), ``slice(a, b)``, ``...`` (all members),
a function ``(key, value) -> Column`` (members it accepts), ``of_type("STRING", ...)``,
``FIRST``/``LIST`` (end the branching), or a dict of sub-paths at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FIRST = "__first__"
LIST = "__list__"


class of_type(tuple):
    """Keep only values of the given VARIANT types, such as STRING, BIGINT, DOUBLE, BOOLEAN, ARRAY, OBJECT."""

    def __new__(cls, *names):
        return super().__new__(cls, names)


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _useful(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return v.isNotNull() & (kind != "VOID") & (v.cast("string") != "{}")


def _members(v: Column) -> Column:
    """array<struct<k, v>> of an array or object."""
    items = F.try_variant_get(v, "$", "array<variant>")
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    from_list = F.transform(items, lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v")))
    from_map = F.transform(pairs, lambda p: F.struct(p["key"].alias("k"), p["value"].alias("v")))
    return F.coalesce(from_list, from_map)


def _step(v: Column, key, casesense: bool) -> tuple[Column, bool]:
    """(value, branched) of one step on one value; a branched result is array<variant>."""
    if isinstance(key, str):
        if casesense:
            return _get(v, f"$['{key}']"), False
        same = F.filter(_members(v), lambda m: F.lower(m["k"]) == key.lower())
        return F.try_element_at(same, F.lit(1))["v"], False
    if isinstance(key, of_type):
        kind = F.regexp_extract(F.schema_of_variant(v), r"^(\w+)", 1)
        return F.when(kind.isin(list(key)), v), False
    if isinstance(key, int):
        items = F.try_variant_get(v, "$", "array<variant>")
        return F.try_element_at(items, F.lit(key + 1 if key >= 0 else key)), False
    if isinstance(key, slice):
        items = F.try_variant_get(v, "$", "array<variant>")
        n = F.size(items)
        at = lambda x, d: d if x is None else (F.lit(x) if x >= 0 else n + x)
        lo, hi = F.greatest(F.lit(0), at(key.start, F.lit(0))), F.least(n, at(key.stop, n))
        return F.when(hi > lo, F.slice(items, lo + 1, hi - lo)), True
    if key is ...:
        return F.transform(_members(v), lambda m: m["v"]), True
    if callable(key):
        return F.transform(F.filter(_members(v), lambda m: F.coalesce(key(m["k"], m["v"]), F.lit(False))), lambda m: m["v"]), True
    raise TypeError(f"bad step {key!r}")


def _bound(key, casesense):
    return lambda x: _step(x, key, casesense)[0]


def follow(v: Column, path, casesense: bool = True) -> tuple[Column, bool]:
    """Value of a path: a VARIANT, or array<variant> where it branched."""
    many = False
    for key in path:
        if key in (FIRST, LIST) and isinstance(key, str):
            if not many:
                v = F.array(v)
            kept = F.filter(v, _useful)
            if key == FIRST:
                v, many = F.try_element_at(kept, F.lit(1)), False
            else:
                v, many = kept, True
            continue
        if many:
            single, branched = _step(F.lit(None).cast("variant"), key, casesense)
            v = F.filter(v, _useful)
            v = F.transform(v, _bound(key, casesense))
            if branched:
                v = F.flatten(F.filter(v, lambda x: x.isNotNull()))
        else:
            v, many = _step(v, key, casesense)
    return (F.filter(v, _useful) if many else F.when(_useful(v), v)), many


def extract(v: Column, paths, kind: str = "string", get_all: bool = True, casesense: bool = True) -> Column:
    """First path with a result, cast to ``kind``; branching paths give arrays unless ``get_all`` is off."""
    outs, many_any = [], False
    for path in paths:
        if isinstance(path, dict):
            fields = [extract(v, sub, kind, get_all, casesense).alias(n) for n, sub in path.items()]
            outs.append((F.struct(*fields), False))
            continue
        value, many = follow(v, path, casesense)
        if many:
            cast = F.filter(F.transform(value, lambda x: F.try_variant_get(x, "$", kind)), lambda x: x.isNotNull())
            value = F.when(F.size(cast) > 0, cast)
            if not get_all:
                value, many = F.try_element_at(value, F.lit(1)), False
        else:
            value = F.try_variant_get(value, "$", kind)
        many_any |= many
        outs.append((value, many))
    same = [x if m or not many_any else F.when(x.isNotNull(), F.array(x)) for x, m in outs]
    return F.coalesce(*same)
