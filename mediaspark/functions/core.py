"""Small building blocks of column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def let(c: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return let(c, lambda x: F.when(x != "", x))


def hit(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``, null where it does not match (an empty group also gives null)."""
    return filled(F.regexp_extract(col, pattern, group))


def pack(**fields) -> Column:
    """Struct with the given field names (a plain struct of aliases loses them next to a generator)."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def once(c: Column) -> Column:
    """A generator that gives the value as it is: a costly expression in a select of its own is then
    computed once per row, and later filters on its parts cannot be pushed below it and repeat it."""
    return F.explode(F.array(c))


def scan(items: Column, kind: str, combine) -> Column:
    """Running values of an array: element ``i`` is ``combine`` of all elements up to ``i``, in order.

    ``combine(before, now)`` must be associative and give the type ``kind`` of the elements, which must not be null. The distance that
    elements look back doubles in each round, so n elements take n log n steps, and no array is copied per element.
    """
    typed = items.cast(f"array<{kind}>")

    def round_(a, step):
        behind = F.concat(F.array_repeat(F.lit(None).cast(kind), step), F.slice(a, F.lit(1), F.size(a) - step))
        return F.zip_with(behind, a, lambda x, y: F.when(x.isNull(), y).otherwise(combine(x, y))).cast(f"array<{kind}>")

    def rounds(a):
        steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1), lambda k: F.pow(F.lit(2.0), k).cast("int"))
        return F.when(F.size(a) < 2, a).otherwise(F.aggregate(steps, a, round_))
    return let(typed, rounds)
