"""Column expressions on display text."""

from __future__ import annotations

import html.entities
from decimal import Decimal

from pyspark.sql import Column, functions as F

SIZE_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"]


def human_bytes(n: Column) -> Column:
    """``12.34MiB`` style size, ``N/A`` for null."""
    # Powers beyond the range of bigint are decimals.
    power = sum((F.when(n >= (1024 ** k if k < 7 else Decimal(1024 ** k)), 1).otherwise(0) for k in range(1, len(SIZE_UNITS))), F.lit(0))
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), power + 1)
    # Quotients by powers of 1024 have short exact decimals wherever half-way rounding matters.
    value = F.bround((n.cast("double") / F.pow(F.lit(1024.0), power)).cast("decimal(30,12)"), 2)
    text = F.concat(value.cast("string"), unit)
    return F.coalesce(text, F.lit("N/A"))


def clock(secs: Column) -> Column:
    """``h:mm:ss``, ``m:ss`` or ``s``; exactly 3600 and 60 seconds stay in the shorter form."""
    s = F.floor(secs).cast("bigint")
    h, m, r = F.floor(s / 3600).cast("bigint"), F.floor((s % 3600) / 60).cast("bigint"), s % 60
    return (F.when(secs > 3600, F.concat(h.cast("string"), F.lit(":"), F.lpad(m.cast("string"), 2, "0"), F.lit(":"),
                                         F.lpad(r.cast("string"), 2, "0")))
            .when(secs > 60, F.concat(F.floor(s / 60).cast("bigint").cast("string"), F.lit(":"),
                                      F.lpad(r.cast("string"), 2, "0")))
            .otherwise(s.cast("string")))


def shorten(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)


_COMMON = ("amp;", "lt;", "gt;", "quot;", "apos;", "nbsp;")


def _entities(common: bool) -> Column:
    """Literal map from entity text (with ampersand and semicolon) to its character.

    A literal map is searched from front to back, so the frequent names have a small map of their own.
    """
    known = {f"&{k}": v for k, v in html.entities.html5.items()
             if k.endswith(";") and (k in _COMMON) == common}
    text = "\x01".join(f"{k}\x02{v}" for k, v in known.items())
    return F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02"))


def unescape(text: Column) -> Column:
    """Replace HTML entities; unknown ones stay as written."""
    ents = F.regexp_extract_all(text, F.lit(r"(&[^&;]+;)"), F.lit(1))
    between = F.split(text, r"&[^&;]+;")
    frequent, others = _entities(True), _entities(False)

    def decode(e):
        digits = F.regexp_extract(e, r"^&#([0-9]+)", 1)
        hexed = F.regexp_extract(e, r"^&#x([0-9a-fA-F]+)", 1)
        code = F.when(hexed != "", F.conv(hexed, 16, 10).try_cast("bigint")).when(digits != "", digits.try_cast("bigint"))
        sane = (code > 0) & (code < 1114112) & ~code.between(55296, 57343)
        char = F.when(sane, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        return F.coalesce(F.try_element_at(frequent, e), char, F.when(~e.startswith("&#"), F.try_element_at(others, e)), e)

    mixed = F.zip_with(between, F.concat(F.transform(ents, decode), F.array(F.lit(""))),
                       lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return F.when(text.contains("&"), F.array_join(mixed, "")).otherwise(text)


def clean_html(text: Column) -> Column:
    """Readable text of an HTML snippet."""
    t = F.replace(text, F.lit("\n"), F.lit(" "))
    t = F.regexp_replace(t, r"(?U)\s*<\s*br\s*/?\s*>\s*", "\n")
    t = F.regexp_replace(t, r"(?U)<\s*/\s*p\s*>\s*<\s*p[^>]*>", "\n")
    t = F.regexp_replace(t, "<.*?>", "")
    return F.regexp_replace(unescape(t), r"(?U)^\s+|\s+$", "")
