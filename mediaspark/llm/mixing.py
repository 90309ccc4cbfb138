"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a hash and queued, up to ``repeats`` times around. A copy's virtual finish time is the number
of its source's words up to and with it, divided by the source's target: every source reaches its target at
time 1. All copies are range-sorted by finish time, and the mix is the longest start of that order within the budget.

Targets: the budget (``share`` of all words) is split by weight; a source cannot give more than ``repeats`` times its
size, and what is beyond that goes to the others by weight. Weights go round over the sources in code point order, null last.

The running sums are taken over range-sorted files, so a source with a third of all rows is spread over many tasks. Only
the table of sources (one row each) is ranked in one task.

Defined results: null texts have size 0, are never taken twice over and cost nothing; a source without words has target 0.
A null source is a source of its own. Rows with one id and size stand behind each other in the queue and each have their own finish time, so the
cut may fall between them; which of them are taken makes no difference to ids and sizes. Copies of different sources with
equal finish times are taken together or not at all. The total never exceeds the budget. Reruns agree, because the shuffle is a hash of the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import ranged, running, saved
from .text import words

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2


def shuffle_key(doc_id: str = "doc_id") -> Column:
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))


def sized_columns(doc_id: str = "doc_id", source: str = "source", text: str = "text") -> list[Column]:
    return [F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("bigint").alias("size"),
            shuffle_key(doc_id).alias("h")]


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``s`` (number of the source), ``source``, ``source_size``, ``target``, ``budget``: one row per source.

    Sources are filled up in order of cap / weight. The first one that gets less than its cap sets the level of all after it.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("s") - 1) % len(weights) + 1).cast("int"))
    by = (by.withColumn("s", rank).withColumn("w", w).withColumn("cap", F.col("source_size") * float(repeats))
          .withColumn("budget", F.sum("source_size").over(W.partitionBy()) * float(share)))
    level = W.orderBy(F.col("cap") / F.col("w"), "s")
    by = by.withColumns({
        "left": F.col("budget") - F.coalesce(F.sum("cap").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "w_left": F.sum("w").over(level.rowsBetween(0, W.unboundedFollowing))})
    short = F.col("left") * F.col("w") < F.col("cap") * F.col("w_left")
    first = F.min(F.when(short, F.struct("s_level", "left", "w_left"))).over(W.partitionBy())
    by = by.withColumn("s_level", F.row_number().over(level)).withColumn("f", first)
    target = F.when(F.col("s_level") >= F.col("f.s_level"), F.col("f.left") * F.col("w") / F.col("f.w_left")).otherwise(F.col("cap"))
    return by.select("s", "source", "source_size", target.alias("target"), "budget")


def schedule(rows: DataFrame, goals: DataFrame, repeats: int = REPEATS) -> tuple[DataFrame, float]:
    """Every copy with its ``finish`` in global order, and the time at which the budget is used up."""
    d = rows.join(goals, rows["source"].eqNullSafe(goals["source"])).select("s", "h", "doc_id", "size", "source_size", "target")
    # Ids may be null or repeat; the place within a source is the hash, then the id and the size.
    d = d.withColumn("one", F.lit(1).cast("bigint"))
    queue = running(ranged(d, ["s", "h", "doc_id", "size"], "mix-queue"), ["s", "h", "doc_id", "size"], ["s"], upto="size", no="one")
    lap = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("lap")
    finish = F.when(F.col("target") > 0, (F.col("upto") + F.col("lap") * F.col("source_size")).cast("double") / F.col("target"))
    copies = queue.select("*", lap).select("s", "h", "doc_id", "size", "no", "lap", finish.alias("finish")).filter("finish IS NOT NULL")
    order = ranged(copies, ["finish", "s", "lap", "no"], "mix-order").drop("__file")
    budget = goals.agg(F.max("budget")).first()[0] or 0.0
    return order, _end(order, budget)


#: Parts that a range of finish times is cut into in each round of counts.
PARTS = 1000


def _end(order: DataFrame, budget: float) -> float:
    """The latest finish time whose copies, with all earlier ones, fit into the budget.

    Each round counts the words in equal parts of a range of times and goes on with the part in which the budget ends, until that part is one time. The
    driver sees one sum a part; files outside the range are skipped by their statistics.
    """
    low, high, total = order.agg(F.min("finish"), F.max("finish"), F.sum("size")).first()
    if low is None:
        return -1.0
    if total <= budget:
        return high
    end, before = -1.0, 0
    while True:
        share = (F.col("finish") - low) / (high - low) if high > low else F.lit(0.0)
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).alias("part")
        rows = order.filter(F.col("finish").between(low, high)).groupBy(part).agg(F.sum("size").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")).collect()
        for r in sorted(rows):
            if before + r.n > budget:
                break
            before, end = before + r.n, r.high
        if r.low == r.high:
            return end
        low, high = r.low, r.high


def plan(df: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, **names):
    """Sizes, targets, the order of all copies and its end. The texts are read once, for their sizes."""
    rows = saved(df.select(*sized_columns(**names)), "mix-sizes")
    goals = saved(targets(rows, weights, share, repeats), "mix-targets")
    return rows, goals, *schedule(rows, goals, repeats)


def mix(df: DataFrame, **options) -> DataFrame:
    """Per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target`` of its source, ``copies`` and ``taken`` words."""
    return decided(*plan(df, **options))


def mixed(df: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every row of ``df`` as often as it is taken. No text is shuffled."""
    _, goals, order, end = plan(df, **options)
    names = {k: v for k, v in options.items() if k in ("doc_id", "source", "text")}
    own = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *sized_columns(**names))
    out = decided(own, goals, order, end).filter("copies > 0")
    return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")


def decided(rows: DataFrame, goals: DataFrame, order: DataFrame, end: float) -> DataFrame:
    """How many copies of each row are within the mix.

    Within a source the mix is a start of the queue, so its last taken place in each lap decides for all rows: one row per source and lap. Of rows
    at that very place as many are taken as copies of them are within the mix.
    """
    place = F.struct("h", "doc_id", "size")
    last = order.filter(F.col("finish") <= end).groupBy("s", "lap").agg(F.max("no").alias("upto"), F.max(place).alias("last"))
    last = saved(last, "mix-last")
    # Rows at the place: how many there are, and how many of them come before the cut.
    ties = order.filter(F.col("lap") == 0).drop("lap").join(last, "s").filter(place == F.col("last"))
    marks = ties.groupBy("s", "lap").agg(F.first("last").alias("last"), F.count(F.lit(1)).alias("all"), F.count_if(F.col("no") <= F.col("upto")).alias("n"))
    marks = saved(marks, "mix-marks")
    cut = marks.groupBy("s").agg(F.collect_list(F.struct("last", "all", "n")).alias("last"))
    g = goals.join(cut, "s", "left").withColumnRenamed("source", "g_source")
    d = rows.join(g, rows["source"].eqNullSafe(g["g_source"])).withColumn("last", F.coalesce("last", F.expr("CAST(array() AS " + dict(cut.dtypes)["last"] + ")")))
    sure = F.size(F.filter("last", lambda x: (place < x["last"]) | ((place == x["last"]) & (x["n"] == x["all"]))))

    def out(d, copies):
        return d.select(*rows.columns, "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
    if marks.filter(F.col("n") < F.col("all")).isEmpty():
        return out(d, sure)
    parted = F.exists("last", lambda x: (place == x["last"]) & (x["n"] < x["all"]))
    # Rows of one id and size that the cut parts: written once, so that their places in the files number them.
    part = saved(d.filter(parted).withColumn("one", F.lit(1).cast("bigint")), "mix-ties").select("*", F.col("_metadata.file_name").alias("in_file"), F.col("_metadata.row_index").alias("in_row"))
    order_ = ["s", "h", "size", "in_file", "in_row"]
    part = running(ranged(part, order_, "mix-numbered"), order_, ["s", "h", "size"], no="one")
    more = F.size(F.filter("last", lambda x: (place == x["last"]) & (x["n"] < x["all"]) & (F.col("no") <= x["n"])))
    return out(d.filter(~parted), sure).unionByName(out(part, sure + more))
