"""Running sums over globally ordered rows without a window over the whole table.

Rows are range-sorted and written, one range per file; then the sums per file and group are small tables whose own
running sum gives each file its base. The window inside a file is bounded by one task's range, whatever the
group's size. The written table also fixes the ranges, so a repeated task sees the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import scratch_path


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` in global order over files, with the file's name in ``__file``."""
    out = saved(df.repartitionByRange(*order).sortWithinPartitions(*order), name)
    return out.withColumn("__file", F.col("_metadata.file_name"))


def running(rows: DataFrame, order: list[str], by: list[str], **sums: str) -> DataFrame:
    """Inclusive running sums of columns of a ``ranged`` table per ``by`` in ``order``; ``__file`` goes.

    ``by`` must be a prefix of ``order`` and not null. Rows equal in all of ``order`` get their sums in any order.
    """
    low = F.struct(*order)
    files = rows.groupBy("__file", *by).agg(F.min(low).alias("__low"), *[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    before = W.partitionBy(*by).orderBy("__low", "__file").rowsBetween(W.unboundedPreceding, -1)
    bases = files.select("__file", *by, *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    own = W.partitionBy("__file", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumns({n: F.sum(c).over(own) for n, c in sums.items()}).join(bases, ["__file", *by])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__file", *[f"__{n}" for n in sums])
