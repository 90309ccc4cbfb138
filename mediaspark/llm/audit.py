"""How filters interact: what each removes in every order of application.

Every document gets a mask of the filters that it fails, whatever the order. All counts of all orders follow from how many documents have each
mask, so only these additive counts per part are shuffled: a filter at some place of an order removes the documents that fail it
and none of the filters before it, and of the orders of n filters, a document that fails m of them is removed by each of those in n! / m.

The filter for exact duplicates looks beyond the row. A prepass clears the texts that are unique for sure: every text sets ``PROBES`` places, given by
its hash, in a counting Bloom sketch whose counters stop at two. Tasks build sketches of their own rows, piece by piece; merged pieces add up, and only
the bit "two or more" of each place is kept. A text with a place that was set once has no equal. Texts that may repeat, and only those, are shuffled for
the smallest id of each full text. A hash that two different texts share is told apart by the texts.

The sketch has ``PLACES`` places for each document and at most ``MAX_PLACES`` (32 MB of bits), which is the bound on what is
broadcast; beyond it, it clears fewer texts, more are shuffled, and the answer is the same.

Defined results: a null text is empty and equal to other empty ones; a null part is the part ``''``. A row without an id is never the duplicate of
another one, nor one of rows with equal ids. A repeated row counts as often as it occurs. Labels that
repeat count as good or toxic if any row of the id says so; labels without an id count for nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .ordered import saved
from .text import extended, mix

FILTERS = "ABCDE"
#: The characters of filter D, and capitals of filter C.
SYMBOLS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))
#: Bits of the filters in a mask, in their order.
A, B, C, D, E = (1 << i for i in range(5))

PROBES, PLACES, MAX_PLACES = 3, 16, 1 << 28
#: Places in one piece of the sketch.
PIECE = 1 << 16


def text_mask(b: bytes, chars: int) -> int:
    """Bits of the filters that look at the text alone."""
    words = b.split()
    n = len(words)
    mask = A if n < 50 else 0
    if 100 * len(set(words)) < 65 * n:
        mask |= B
    if 100 * (len(b) - len(b.translate(None, CAPITALS))) > 5 * chars:
        mask |= C
    return mask | D if SYMBOLS.search(b) else mask


def text_hash(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def masked(docs: DataFrame, doc_id: str = "doc_id", part: str = "source", text: str = "text", hashed=text_hash,
           with_text: bool = False) -> DataFrame:
    """``doc_id``, ``part``, ``h`` (hash of the text) and ``mask`` of all filters but E; with ``with_text`` also ``text``, null as empty."""
    df = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`"), F.lit("")).alias("part"), hashed(text).alias("h"),
                     F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    kept = ["doc_id", "part", "h", *["text"] * with_text]
    schema = extended(df, kept, "mask int")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = []
            for t in b.column("text"):
                t = t.as_py()
                masks.append(text_mask(t.encode("utf-8", "surrogatepass"), len(t)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(masks, pa.int32())], [*kept, "mask"])

    return df.mapInArrow(scan, schema)


def places(h: np.ndarray, size: int) -> np.ndarray:
    """The places of each text, one row for each probe."""
    with np.errstate(over="ignore"):
        h = h.view(np.uint64)
        return np.stack([mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))) for k in range(1, PROBES + 1)]) % np.uint64(size)


def sketch_size(n: int) -> int:
    """Places for ``n`` documents: a power of two, from one piece up to the bound."""
    return min(max(PIECE, 1 << math.ceil(math.log2(max(1, n * PLACES)))), MAX_PLACES)


def repeated_places(rows: DataFrame, size: int) -> DataFrame:
    """``piece`` and ``bits`` of the merged sketch: one bit a place, set where two or more texts (or probes of one) fell."""

    def sketch(found: list[np.ndarray]) -> pa.RecordBatch:
        # Places in order, with counters that stop at two, cut into pieces.
        at, n = np.unique(np.concatenate(found), return_counts=True)
        piece = (at // PIECE).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(at)]])
        ends = pa.array(cuts, pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array(piece[cuts[:-1]]), pa.ListArray.from_arrays(ends, pa.array((at % PIECE).astype(np.int32))),
             pa.ListArray.from_arrays(ends, pa.array(np.minimum(n, 2).astype(np.int8)))], ["piece", "at", "n"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for b in batches:
            found.append(places(np.asarray(b.column("h")), size).ravel())
            if sum(map(len, found)) > 1 << 20:
                yield sketch(found)
                found = []
        if found:
            yield sketch(found)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sketches in order of the piece: one piece's counters are held at a time.
        now, counts = None, np.zeros(PIECE, np.int8)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(counts > 1).tobytes()], pa.binary())], ["piece", "bits"])
        for b in batches:
            for piece, at, n in zip(b.column("piece").to_pylist(), b.column("at"), b.column("n")):
                if piece != now:
                    if now is not None:
                        yield out()
                    now, counts = piece, np.zeros(PIECE, np.int8)
                at = np.asarray(at.values)
                counts[at] = np.minimum(counts[at] + np.asarray(n.values), 2)
        if now is not None:
            yield out()

    parts = rows.select("h").mapInArrow(build, "piece bigint, at array<int>, n array<tinyint>")
    return parts.repartition("piece").sortWithinPartitions("piece").mapInArrow(merge, "piece bigint, bits binary")


def may_repeat(rows: DataFrame, size: int):
    """A function that adds ``maybe`` to a table by its column ``h``: false only for texts that are unique for sure."""
    bits = np.zeros(size // 8, np.uint8)
    for r in repeated_places(rows, size).collect():  # size / 8 bytes, 32 MB at most
        bits[r.piece * PIECE // 8:(r.piece + 1) * PIECE // 8] = np.frombuffer(r.bits, np.uint8)
    table = rows.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        at = places(np.asarray(h), size)
        return pa.array((table.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1).all(axis=0))

    return maybe


def duplicate_masks(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", part: str = "source", text: str = "text", hashed=text_hash) -> DataFrame:
    """``rows`` (of ``masked``, written) with bit E for each row whose text a smaller id has."""
    maybe = may_repeat(rows, sketch_size(rows.count()))
    marked = saved(rows.withColumn("maybe", maybe("h")), "audit-marked")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), hashed(text).alias("h"))
    texts = texts.filter(maybe("h"))
    # Equal texts of one task meet before the shuffle, so a large group of copies sends one row a task.
    least = saved(texts.groupBy("text").agg(F.first("h").alias("h"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "audit-least")
    shared = saved(least.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "audit-shared")
    by_hash = least.filter("least < most").join(shared, "h", "left_anti").select("h", "least")
    late = F.when(F.col("least") < F.col("doc_id"), F.col("mask").bitwiseOR(F.lit(E))).otherwise(F.col("mask"))
    found = marked.filter("maybe").join(by_hash, "h", "left").withColumn("mask", late)
    sure = marked.filter(~F.col("maybe"))
    cols = ["doc_id", "part", "mask"]
    if shared.isEmpty():
        return sure.select(cols).unionByName(found.select(cols))
    # Different texts with one hash: their rows are looked at again, with their texts.
    found = found.join(shared, "h", "left_anti")
    own = docs.withColumn("__h", hashed(text)).join(shared.withColumnRenamed("h", "__h"), "__h", "left_semi").drop("__h")
    own = masked(own, doc_id, part, text, hashed, with_text=True).join(least.select("text", "least"), "text")
    return sure.select(cols).unionByName(found.select(cols)).unionByName(own.withColumn("mask", late).select(cols))


def steps(spark: SparkSession) -> DataFrame:
    """What a mask counts for at each step of each order: a fixed table of 120 orders, 5 steps and 32 masks."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            for mask in range(1 << len(FILTERS)):
                fails, gone = bool(mask & bit), bool(mask & before)
                share = math.factorial(len(FILTERS)) // mask.bit_count() if fails else 0
                rows.append((mask, name, step, not (mask & (before | bit)), fails and not gone, fails and gone, mask == bit, share))
            before |= bit
    return spark.createDataFrame(rows, "mask int, filter_order string, step int, stays boolean, goes boolean, late boolean, alone boolean, share bigint")


def interactions(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "source", text: str = "text", hashed=text_hash) -> DataFrame:
    """Per part, order and step: ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` and ``shapley``."""
    counts = saved(mask_counts(docs, labels, doc_id, part, text, hashed), "audit-counts")
    each = counts.join(F.broadcast(steps(docs.sparkSession)), "mask")

    def total(column: str, when: str) -> Column:
        return F.sum(F.when(F.col(when), F.col(column)).otherwise(F.lit(0))).cast("bigint")
    return each.groupBy("part", "filter_order", "step").agg(
        total("n", "stays").alias("kept"), total("n", "goes").alias("removed"), total("n", "late").alias("redundant"),
        total("n", "alone").alias("unique_fails"), total("good", "goes").alias("good_lost"), total("toxic", "goes").alias("toxic_lost"),
        F.sum(F.col("n") * F.col("share")).cast("bigint").alias("shapley"))


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", part: str = "source", text: str = "text", hashed=text_hash) -> DataFrame:
    """Additive counts: ``part``, ``mask``, ``n`` documents, and how many of them are ``good`` and ``toxic``."""
    rows = saved(masked(docs, doc_id, part, text, hashed), "audit-masks")
    rows = duplicate_masks(docs, rows, doc_id, part, text, hashed)
    said = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    said = said.filter("doc_id IS NOT NULL AND (good = 1 OR toxic = 1)")
    rows = rows.join(said, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in ("good", "toxic")])
