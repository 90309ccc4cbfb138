"""Sharding by a k-d tree over document metadata. DataFrame functions only.

Points are groups of equal texts with their bytes as weight. A node that holds more than one shard's bytes is split
at the weighted median (for an odd number of shards, the matching quantile) of its widest dimension: size in bytes,
source or language, each relative to its range in the whole table. Size is measured by its logarithm, source and language by their
number among the distinct values in code point order. Points with equal coordinates are ordered by a hash of the text, so that a split never depends on the order of rows.

Medians are exact to one point and fully distributed: each split value is a key of 63 bits, the coordinate (bytes or number) and the hash, found in four counts of
16 bits, for all nodes of a level at once. No task sorts a node, and only counts are moved.

Groups of equal texts stay in one shard up to a sixteenth of a shard's bytes; larger ones (there are at most 16 times the number of
shards) are first cut into parts by a hash of the id, because no single shard could hold them evenly.

Defined results: a null text counts as an empty one, of size 1; null sources and languages come first. Repeated rows each
get their own slot. With fewer points than shards some shards stay empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ordered import ranged, running, saved

GROUP = ["th", "size", "text_crc32"]
#: A group of equal texts above this part of a shard is cut into parts of a quarter of that.
WHOLE = 16


def _numbers(rows: DataFrame, col: str, out: str) -> DataFrame:
    """The distinct values of a column, numbered from 1 in code point order."""
    values = rows.select(col).filter(F.col(col).isNotNull()).distinct().withColumn("one", F.lit(1).cast("bigint"))
    return saved(running(ranged(values, [col], "kd-values"), [col], [], no="one").select(col, F.col("no").alias(out)), "kd-numbers")


def described(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    full = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(full) + 1).cast("bigint").alias("size"),
                     F.crc32(full).alias("text_crc32"), F.xxhash64(full).alias("th"),
                     F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"))


def _parts(rows: DataFrame, shard_bytes: float) -> DataFrame:
    """Rows with ``part``: 0, or one of several for groups too large to stay whole."""
    large = (rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes")).filter(F.col("bytes") > shard_bytes / WHOLE)
             .select(*GROUP, F.ceil(F.col("bytes") / (shard_bytes / WHOLE / 4)).alias("n_parts")))
    # At most WHOLE times the number of shards, by the filter on their bytes.
    rows = rows.join(F.broadcast(large), GROUP, "left")
    return rows.withColumn("part", F.when(F.col("n_parts").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("n_parts"))).otherwise(F.lit(0))).drop("n_parts")


def _crossing(counts: DataFrame, bits: str) -> DataFrame:
    """Per node the first value of ``bits`` at which the running weight reaches the goal, with the weight before and with it."""
    w = W.partitionBy("first").orderBy(bits).rowsBetween(W.unboundedPreceding, 0)
    c = counts.withColumn("upto", F.sum("n").over(w) + F.col("base"))
    hit = c.filter(F.col("upto") >= F.col("goal")).groupBy("first").agg(F.min(F.struct(bits, "n", "upto")).alias("x"))
    return hit.select("first", F.col(f"x.{bits}").alias(bits), (F.col("x.upto") - F.col("x.n")).alias("base"), F.col("x.upto").alias("upto"))


def _split(points: DataFrame, root: dict) -> DataFrame:
    """Split every node of more than one shard in two."""
    dims = ["x0", "x1", "x2"]
    open_ = points.filter("k > 1")
    s = open_.groupBy("first", "k").agg(F.sum("w").alias("all"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))],
                                       F.min("size").alias("lo_size"))
    width = {d: (F.col(f"hi_{d}") - F.col(f"lo_{d}")) / F.lit(root[d] or 1.0) for d in dims}
    widest = F.greatest(*width.values())
    pick = F.coalesce(*[F.when(width[d] == widest, F.lit(i)) for i, d in enumerate(dims)])
    left = F.floor(F.col("k") / 2)
    s = s.select("first", F.col("k").alias("sk"), left.alias("left"), (F.col("all") * left / F.col("k")).alias("goal"), pick.alias("dim"),
                 F.when(pick == 0, F.col("lo_size")).when(pick == 1, F.col("lo_x1")).otherwise(F.col("lo_x2")).alias("lo"))
    s = saved(s, "kd-nodes")
    # Whole coordinates below 2^31: bytes of a text, or numbers of values.
    x = F.when(F.col("dim") == 0, F.col("size")).when(F.col("dim") == 1, F.col("x1")).otherwise(F.col("x2"))
    tie = F.xxhash64("th", "part").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    keyed = points.join(s, "first", "left").withColumn("key", F.shiftleft(x - F.col("lo"), 32).bitwiseOR(tie))
    inner = keyed.filter("k > 1")
    # Four rounds of counts, each inside the value that the one before found.
    found = s.select("first", "goal", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("base"))
    for shift in (48, 32, 16, 0):
        own = F.shiftright("key", shift)
        d = inner.select("first", own.alias("bits"), "w").join(found, "first")
        if shift < 48:
            d = d.filter(F.shiftright("bits", 16) == F.col("prefix"))
        counts = d.groupBy("first", "bits").agg(F.sum("w").alias("n"), F.max("base").alias("base"), F.max("goal").alias("goal"))
        hit = _crossing(counts, "bits")
        found = saved(hit.join(s.select("first", "goal"), "first").select("first", "goal", F.col("bits").alias("prefix"), "base", "upto"), "kd-cuts")
    # The point at the goal goes to the side that it brings closer.
    near = F.col("upto") - F.col("goal") <= F.col("goal") - F.col("base")
    cut = found.select("first", F.when(near, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("cut"))
    right = (F.col("k") > 1) & (F.col("key") > F.col("cut"))
    return keyed.join(cut, "first", "left").select(
        *GROUP, "part", "w", *dims,
        F.when(right, F.col("first") + F.col("left")).otherwise(F.col("first")).cast("int").alias("first"),
        F.when(right, F.col("k") - F.col("left")).when(F.col("k") > 1, F.col("left")).otherwise(F.col("k")).cast("int").alias("k"))


def shard(df: DataFrame, shards: int | None = None, target_bytes: int | None = None, **names) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and a gapless ``slot`` in it, for each row.

    Give the number of shards, or the bytes that a shard should have.
    """
    rows = saved(described(df, **names), "kd-rows")
    total = rows.agg(F.sum("size")).first()[0] or 0
    shards = shards or max(1, -(-total // target_bytes))
    rows = _parts(rows, total / shards)
    known = rows.join(_numbers(rows, "source", "x1"), "source", "left").join(_numbers(rows, "lang", "x2"), "lang", "left")
    points = known.groupBy(*GROUP, "part").agg(F.sum("size").alias("w"), *[F.min(F.coalesce(x, F.lit(0).cast("bigint"))).alias(x) for x in ("x1", "x2")])
    points = saved(points.select(*GROUP, "part", "w", F.ln("size").alias("x0"), "x1", "x2", F.lit(0).alias("first"), F.lit(shards).alias("k")), "kd-points")
    span = points.agg(*[(F.max(d) - F.min(d)).alias(d) for d in ("x0", "x1", "x2")]).first().asDict()
    for _ in range((shards - 1).bit_length()):
        points = saved(_split(points, span), "kd-points")
    leaf = points.select(*GROUP, "part", F.col("first").alias("shard"))
    placed = rows.join(leaf, [*GROUP, "part"]).select("doc_id", "size", "text_crc32", "shard", F.xxhash64("doc_id").alias("h"), F.lit(1).cast("bigint").alias("one"))
    order = ["shard", "h", "doc_id", "text_crc32"]
    numbered = running(ranged(placed, order, "kd-slots"), order, ["shard"], slot="one")
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("slot") - 1).alias("slot"))
