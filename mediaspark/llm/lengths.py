"""Exact token counts through a length histogram.

Documents are aggregated by their encoded length once (a count per length, combined before the shuffle). Everything
else is a suffix sum over the histogram: how many documents are longer than a context limit, how many tokens
remain when each document is cut there, and which length holds a quantile.

The histogram has one row per length that occurs. Its sums are taken in blocks of ``BLOCK`` lengths: totals per
block, a sum over the few blocks, then a window inside each block, so no task holds the whole histogram.

Defined results: null and empty texts have length 0 and count. Repeated rows count each time; equal
lengths are one row. An empty table gives no rows, and totals of an empty histogram are 0 for every limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .tokens import count_tokens

BLOCK = 1024


def histogram(df: DataFrame, path: str, text: str = "text", by=()) -> DataFrame:
    """``by``, ``length``, ``n_docs``: documents of each encoded length."""
    return count_tokens(df, path, text, keep=list(by)).groupBy(*by, F.col("n_tokens").alias("length")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per length L: documents and tokens at L, below and at least L, and the total if each document is cut to L tokens.

    ``docs_to`` counts documents of at most L tokens; ``truncated`` is the sum of min(length, L).
    """
    hist = hist.withColumn("__b", F.floor(F.col("length") / block)).withColumn("n_tokens", F.col("length") * F.col("n_docs"))
    sums = hist.groupBy("__b").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    later = W.orderBy(F.col("__b").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    base = sums.select("__b", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
                       F.sum("d").over(every).alias("d_all"), F.sum("t").over(every).alias("t_all"))
    own = W.partitionBy("__b").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = (hist.withColumns({"d_own": F.sum("n_docs").over(own), "t_own": F.sum("n_tokens").over(own)}).join(base, "__b")
           .withColumns({"docs_from": F.col("d_own") + F.col("d_later"), "tokens_from": F.col("t_own") + F.col("t_later")}))
    return out.select("length", "n_docs", "n_tokens", "docs_from", "tokens_from",
                      (F.col("d_all") - F.col("docs_from") + F.col("n_docs")).alias("docs_to"),
                      (F.col("t_all") - F.col("tokens_from") + F.col("length") * F.col("docs_from")).alias("truncated"), F.col("d_all").alias("docs_all"),
                      F.col("t_all").alias("tokens_all"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Total tokens when every document is cut to each context limit; any limit, also one that no document has."""
    spark = sums.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "context bigint")
    every = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in sorted(set(limits))]))
    # Rows beyond a limit hold what is cut there: the first of them has the suffix sums.
    over = (sums.select(every.alias("context"), "length", "docs_from", "tokens_from", "tokens_all").filter(F.col("length") > F.col("context"))
            .groupBy("context").agg(F.min_by(F.struct("docs_from", "tokens_from"), "length").alias("s")))
    total = sums.agg(F.coalesce(F.max("tokens_all"), F.lit(0)).alias("tokens_all"))
    total = total.select("tokens_all", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in sorted(set(limits))])).alias("context"))
    cut = F.coalesce(F.col("s.tokens_from") - F.col("context") * F.col("s.docs_from"), F.lit(0))
    return wanted.join(total, "context").join(over, "context", "left").select("context", (F.col("tokens_all") - cut).alias("tokens"))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """Smallest length that at least a share p of the documents does not exceed, for each p."""
    p = F.explode(F.array(*[F.lit(float(x)) for x in probabilities])).alias("p")
    return (sums.select(p, "length", "docs_to", "docs_all").filter(F.col("docs_to") >= F.col("p") * F.col("docs_all"))
            .groupBy("p").agg(F.min("length").alias("length")))
