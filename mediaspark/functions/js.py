"""JavaScript literals as JSON, with column functions only.

A text is cut into tokens once; each token becomes JSON by its own kind and by the token behind it. The pattern has no repeated group that
could make the matcher recurse, so the length of a literal does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .core import let

# Fixed value: the tokens of a literal. Strings, comments, void 0, negated flags, names, numbers, then any sign or blanks.
_TOKEN = (r"""(?s)("(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`|/\*.*?\*/|//[^\n]*|void\s+0\b|![01]\b|[A-Za-z_$][\w$]*"""
          r"""|0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\S|\s+)""")


def _string(t: Column) -> Column:
    """A string token in double quotes, with the escapes that JSON knows."""
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    s = F.when(t.startswith('"'), inner).otherwise(F.regexp_replace(inner, r'(?<!\\)((?:\\\\)*+)"', r'$1\\"'))
    s = F.regexp_replace(s, r"(?<!\\)((?:\\\\)*+)\\\r?\n", "$1")
    s = F.regexp_replace(s, r"(?<!\\)((?:\\\\)*+)\\x", r"$1\\u00")
    s = F.regexp_replace(s, r'(?s)(\\["\\/bfnrtu])|\\(.)', "$1$2")
    s = F.replace(F.replace(F.replace(s, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), s, F.lit('"'))


def _json(t: Column, after: Column) -> Column:
    key = F.coalesce(after == ":", F.lit(False))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = (F.when(t.rlike("^0[xX]"), F.conv(F.substring(t, F.lit(3), F.length(t)), 16, 10)).when(t.rlike(r"^0[0-7]+$"), F.conv(t, 8, 10)).otherwise(t))
    return (F.when(t.rlike("^[\"'`]"), _string(t))
            .when((t == ",") & after.isin("}", "]"), F.lit(""))
            .when(t == "!0", F.lit("true")).when(t == "!1", F.lit("false"))
            .when(t.startswith("void") | (t.isin("undefined", "NaN") & ~key), F.lit("null"))
            .when(t.isin("true", "false", "null") & ~key, t)
            .when(t.rlike(r"^-?\d"), F.when(key, quoted(number)).otherwise(number))
            .when(t.rlike(r"^[A-Za-z_$]"), quoted(t)).otherwise(t))


def to_json(text: Column) -> Column:
    """JSON text of the literal at the start of ``text``: an object or a list up to the bracket that closes it; null without one."""
    def step(a, t):
        depth = a["depth"] + F.when(t.isin("{", "[", "("), 1).when(t.isin("}", "]", ")"), -1).otherwise(0)
        closed = (a["end"] == 0) & (depth <= 0) & t.isin("}", "]", ")")
        return F.struct(depth.alias("depth"), (a["n"] + 1).alias("n"), F.when(closed, a["n"] + 1).otherwise(a["end"]).alias("end"))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def whole(ts):
        end = F.aggregate(ts, start, step)["end"]
        return F.when(end > 0, F.slice(ts, F.lit(1), end))
    tokens = F.filter(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(1)), lambda t: ~t.rlike(r"^(?:\s|/\*|//)"))
    out = let(let(tokens, whole), lambda ts: F.array_join(F.transform(ts, lambda t, i: _json(t, F.get(ts, i + 1))), ""))
    return F.when(text.rlike(r"^\s*[\[{]"), out)
