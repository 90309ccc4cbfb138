"""Ordered per-group work that survives groups holding a large share of all rows.

A plain ``row_number() over (partition by key order by ...)`` puts every row of a key into one
task. Here groups above ``hot_rows`` rows take another path: their rows are range-sorted by key and order into
slices of about ``hot_rows`` rows, each slice is numbered on its own, and the counts (or sums) of the
earlier slices are added. All other groups use the plain window. The answer is the same as that of
the plain window; only the spread over tasks differs.

There is no limit on the number of hot groups (at most rows / ``hot_rows``) or on their size. Their keys stay a table, which is broadcast
only if it is counted to be small; the slices are a written table, so that their bounds stay the same when a task is repeated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .session import cut, scratch_path

HOT_ROWS = 1_000_000
#: Hot keys that are broadcast; more are joined by a shuffle.
MAX_BROADCAST_KEYS = 10_000


def _names(cols):
    return [cols] if isinstance(cols, str) else list(cols)


def hot_groups(df: DataFrame, by, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Groups with more than ``hot_rows`` rows (one count, map-side combined)."""
    return df.groupBy(*_names(by)).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > hot_rows)


def _same_key(left: DataFrame, right: DataFrame, by) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"__k_{k}"]) for k in by])


def _keyed(small: DataFrame, by) -> DataFrame:
    """Rename key columns of a small side so that a null-safe join keeps only one set of them."""
    return small.select(*[F.col(k).alias(f"__k_{k}") for k in by],
                        *[c for c in small.columns if c not in by])


def _drop_keys(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__k_")])


def split_hot(df: DataFrame, by, hot_rows: int | None = None, sizes: DataFrame | None = None):
    """(rows of ordinary groups, rows of hot groups with their size ``__n``, or None if there are none).

    ``sizes`` may name a cheaper table with the same keys whose groups are at least as large. It is looked at once while the
    plan is built, so that without hot groups (the usual case) the plan stays one plain window. ``hot_rows=0`` skips it for
    groups that are bounded by their making, such as the parts of one stored document.
    """
    by = _names(by)
    if hot_rows == 0:
        return df, None
    counted = hot_groups(df if sizes is None else sizes, by, HOT_ROWS if hot_rows is None else hot_rows)
    if counted.isEmpty():
        return df, None
    counted = cut(counted)
    hot = _keyed(counted, by)
    if counted.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    cold = df.join(hot, _same_key(df, hot, by), "left_anti")
    warm = _drop_keys(df.join(hot, _same_key(df, hot, by), "inner"))
    return cold, warm


def _sliced(warm: DataFrame, by, order, hot_rows: int | None = None, total: int | None = None) -> DataFrame:
    """Rows of hot groups range-sorted into slices of about ``hot_rows`` rows, with the order's columns as ``__o0``, ``__o1``, ..."""
    keyed = warm.drop("__n").withColumns({f"__o{i}": c for i, c in enumerate(order)})
    keys = [*by, *[f"__o{i}" for i in range(len(order))]]
    slices = -(-(warm.count() if total is None else total) // (hot_rows or HOT_ROWS)) + 1
    path = scratch_path(warm.sparkSession, "slices")
    keyed.repartitionByRange(slices, *keys).sortWithinPartitions(*keys).write.parquet(path)
    return warm.sparkSession.read.schema(keyed.schema).parquet(path).withColumn("__slice", F.col("_metadata.file_name"))


def _places(sliced: DataFrame):
    return [c for c in sliced.columns if c.startswith("__o") and c[3:].isdigit()]


def _with_offsets(sliced: DataFrame, by, aggs: dict) -> DataFrame:
    """Join to each slice the totals of the earlier slices of its group: a table of one row per group and slice.

    ``aggs`` maps a name to ``("sum" | "max", aggregate)``.
    """
    per = sliced.groupBy(*by, "__slice").agg(F.min(F.struct(*_places(sliced))).alias("__low"), *[a.alias(f"__off_{n}") for n, (_, a) in aggs.items()])
    before = W.partitionBy(*by).orderBy("__low", "__slice").rowsBetween(W.unboundedPreceding, -1)
    offs = per.select(*by, "__slice", *[
        (F.coalesce(F.sum(f"__off_{n}").over(before), F.lit(0)) if kind == "sum" else F.max(f"__off_{n}").over(before)).alias(f"__off_{n}")
        for n, (kind, _) in aggs.items()])
    keys = [*by, "__slice"]
    offs = _keyed(offs, keys)
    return _drop_keys(sliced.join(offs, _same_key(sliced, offs, keys), "left"))


def numbered(df: DataFrame, by, order, out: str, hot_rows: int | None = None,
             sizes: DataFrame | None = None, upto: int | None = None) -> DataFrame:
    """1-based ``row_number`` per group; ``order`` is a list of ascending columns (nulls first).

    With ``upto`` only the rows up to that number come: Spark then keeps that many of a group in each task before the shuffle, and of hot groups
    only the slices that begin before it are numbered.
    """
    by = _names(by)
    cold, warm = split_hot(df, by, hot_rows, sizes)
    cold = cold.withColumn("__rn", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    # The bound is on the plain number, as the optimiser wants it.
    cold = cold if upto is None else cold.filter(F.col("__rn") <= min(upto, 2**31 - 1))
    cold = cold.withColumn(out, F.col("__rn").cast("bigint")).drop("__rn")
    if warm is None:
        return cold
    s = _with_offsets(_sliced(warm, by, order, hot_rows), by, {"n": ("sum", F.count(F.lit(1)))})
    s = s if upto is None else s.filter(F.col("__off_n") < upto)
    ws = W.partitionBy(*by, "__slice").orderBy(*_places(s))
    warm = s.withColumn(out, F.row_number().over(ws) + F.col("__off_n")).drop("__slice", "__off_n", *_places(s))
    return cold.unionByName(warm if upto is None else warm.filter(F.col(out) <= upto))


def numbered_all(df: DataFrame, order, out: str, hot_rows: int | None = None) -> DataFrame:
    """``numbered`` over all rows as one group: there are no other groups to look for, so many rows are read once for their number and once for the slices."""
    df = df.withColumn("__all", F.lit(0))
    total = df.count()
    if total <= (HOT_ROWS if hot_rows is None else hot_rows):
        return df.withColumn(out, F.row_number().over(W.partitionBy("__all").orderBy(*order)).cast("bigint")).drop("__all")
    s = _with_offsets(_sliced(df, ["__all"], order, hot_rows, total), ["__all"], {"n": ("sum", F.count(F.lit(1)))})
    ws = W.partitionBy("__all", "__slice").orderBy(*_places(s))
    return s.withColumn(out, F.row_number().over(ws) + F.col("__off_n")).drop("__all", "__slice", "__off_n", *_places(s))


def running(df: DataFrame, by, order, wanted: dict, hot_rows: int | None = None,
            sizes: DataFrame | None = None) -> DataFrame:
    """Running aggregates per group in the given ascending order.

    ``wanted`` maps a new name to ``(kind, column)`` with kind ``sum`` or ``max`` (up to and with the
    row), or ``max_before`` (up to the row before).
    """
    by = _names(by)
    cold, warm = split_hot(df, by, hot_rows, sizes)

    def add(d, order, *part):
        w = W.partitionBy(*by, *part).orderBy(*order)
        upto, before = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(W.unboundedPreceding, -1)
        out = {n: (F.sum(c).over(upto) if k == "sum" else F.max(c).over(before if k == "max_before" else upto))
               for n, (k, c) in wanted.items()}
        if part:
            out = {n: (F.coalesce(c, F.lit(0)) + F.col(f"__off_{n}")) if wanted[n][0] == "sum" else F.greatest(c, F.col(f"__off_{n}"))
                   for n, c in out.items()}
        return d.select("*", *[c.alias(n) for n, c in out.items()])
    cold = add(cold, order)
    if warm is None:
        return cold
    aggs = {n: ("sum", F.sum(c)) if k == "sum" else ("max", F.max(c)) for n, (k, c) in wanted.items()}
    s = _with_offsets(_sliced(warm, by, order, hot_rows), by, aggs)
    warm = add(s, _places(s), "__slice")
    return cold.unionByName(warm.drop("__slice", *_places(s), *[f"__off_{n}" for n in wanted]))


def first_per_group(df: DataFrame, by, order, keep=None) -> DataFrame:
    """The row with the smallest order key per group, as one map-side-combined aggregate."""
    by = _names(by)
    cols = [c for c in (keep or df.columns) if c not in by]
    best = F.min_by(F.struct(*cols), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*by).agg(best.alias("__b")).select(*by, *[F.col(f"__b.{c}").alias(c) for c in cols])


def with_totals(df: DataFrame, by, aggs: dict, sizes: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Attach group aggregates by aggregate-then-join, so that AQE can split a skewed key.

    With ``sizes`` (see ``split_hot``) only hot groups are treated so; all others take a window, which reads ``df`` once and needs no further shuffle
    where ``df`` is already spread by the group.
    """
    by = _names(by)
    if sizes is not None:
        cold, warm = split_hot(df, by, hot_rows, sizes)
        w = W.partitionBy(*by)
        cold = cold.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
        return cold if warm is None else cold.unionByName(with_totals(warm.drop("__n"), by, aggs))
    tot = _keyed(df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]), by)
    return _drop_keys(df.join(tot, _same_key(df, tot, by), "left"))
