"""Quality rules as a ledger of failure bits. DataFrame functions only.

Every rule is evaluated once per document; the ledger holds the measurements and one ``failure_bits`` number
(bit i set: rule i failed). A policy is a version with the names of the rules that count. Applying one, comparing
two, or asking what a rule alone rejects works on the bits and never reads a text again.

All work happens inside the document's row, so hot sources and groups of copies change nothing; the sort behind the
repeated windows is n log n in the document's length.

Defined results: a null, empty or blank text has no words and fails ``few_words`` alone. Repeated rows get equal
answers. Columns named like a measurement are replaced, all other columns stay. An empty table gives an empty ledger.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import words

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")


def _c(name: str) -> Column:
    return F.col(name)


#: Rules in the order of their bits; a rule's place never changes, new ones go to the end.
RULES: dict[str, Column] = {}


def _rules() -> dict[str, Column]:
    """Name to failure condition, on the measurements. Built late, because columns need a session."""
    if not RULES:
        RULES.update({
            "few_words": _c("n_words") < 50,
            "repeated_words": 100 * _c("n_repeat_words") > 50 * _c("n_words"),
            "symbols": 100 * _c("n_symbols") > 25 * _c("n_words"),
            "duplicate_lines": 100 * _c("n_dup_lines") > 50 * _c("n_lines"),
            "upper_case": 100 * _c("n_upper") > 50 * _c("n_letters"),
            "word_length": (_c("n_words") > 0) & ((_c("word_chars") < 2 * _c("n_words")) | (_c("word_chars") > 20 * _c("n_words"))),
        })
    return RULES


#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "duplicate_lines", "upper_case"),
    "v2": ("few_words", "repeated_words", "symbols", "duplicate_lines", "upper_case", "word_length"),
}
PRODUCTION = "v2"


def mask(rules) -> int:
    names = list(_rules())
    return sum(1 << names.index(r) for r in rules)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` plus the measurements and ``failure_bits``."""
    own = [F.col(f"`{c}`") for c in df.columns if c not in (*MEASURES, "failure_bits") or c == text]
    full = F.coalesce(F.col(text), F.lit(""))

    def removed(pattern: str) -> Column:
        return (F.length(full) - F.length(F.regexp_replace(full, pattern, ""))).cast("bigint")

    lines = F.filter(F.split(full, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select(*own, words(F.col(text)).alias("__w"), lines.alias("__l"),
                   F.length(F.translate(full, " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
                   (F.length(full) - F.length(F.translate(full, "#*$%&|<>", ""))).cast("bigint").alias("n_symbols"),
                   removed(r"\p{Lu}+").alias("n_upper"), removed(r"\p{L}+").alias("n_letters"))
    n = F.size("__w")
    # Windows as (hash, place) in order of the hash: equal windows are neighbours.
    wins = F.when(n >= 3, F.sort_array(F.transform(
        F.slice("__w", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get("__w", i + 1), F.get("__w", i + 2)).alias("k"), i.alias("i")))))
    df = df.withColumn("__s", wins)
    twice = F.filter("__s", lambda x, j: F.coalesce(x["k"] == F.get("__s", j - 1)["k"], F.lit(False))
                     | F.coalesce(x["k"] == F.get("__s", j + 1)["k"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    # A window covers three words; the next one adds at most three and at least its distance.
    covered = F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("at")),
                          lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["at"])).alias("n"), p.alias("at")))["n"]
    size = F.size("__l")
    df = df.withColumns({
        "n_words": n.cast("bigint"), "n_lines": size.cast("bigint"),
        "n_dup_lines": (size - F.size(F.array_distinct("__l"))).cast("bigint"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("bigint")}).drop("__w", "__l", "__s")
    bits = F.lit(0).cast("bigint")
    for i, failed in enumerate(_rules().values()):
        bits = bits.bitwiseOR(F.when(failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    # A row generator of one row: without it a filter on the result would be pushed below the measurements and repeat them.
    names = [*MEASURES, "failure_bits"]
    rest = [c for c in df.columns if c not in names]
    book = F.explode(F.array(F.struct(*names))).alias("__book")
    return df.withColumn("failure_bits", bits).select(*[F.col(f"`{c}`") for c in rest], book).select(*[F.col(f"`{c}`") for c in rest], "__book.*")


def rejected(rules) -> Column:
    """Whether any of the rules failed, read from the bits."""
    return F.col("failure_bits").bitwiseAND(F.lit(mask(rules)).cast("bigint")) != 0


def apply_policy(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    return book.withColumn("kept", ~rejected(POLICIES[policy]))


def ablation(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects (kept if it were dropped).

    One count per distinct bit pattern, combined before the shuffle; the rest works on at most 2^rules rows.
    """
    names = list(_rules())
    own = F.col("failure_bits").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("bigint"))
    seen = book.groupBy(own.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]]))
    each = seen.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only"))
