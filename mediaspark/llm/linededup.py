"""Lines that many documents share, removed from all but one of them.

Every line gets a key (its text without blanks at both ends, A-Z in lower case) and the key's 128-bit hash. Lines are range-partitioned by
hash and document and sorted by hash, document and position; each task streams over its range and sees the documents of a key one
after the other, the one that keeps its lines first. The key of a range's first or last row may go on in the ranges beside it; its lines stay
open until a table of at most two rows a range tells what all of them saw of it, so a line of a third of all documents is spread over as
many tasks as its rows need. Places of lines that go are gathered per document, and each document that loses lines gets a compressed bitmap with one bit a line.
No text is shuffled until a bitmap is applied to it.

Rows are known by id and a hash of the text, so an id may repeat. Memory in a task is bounded by the rows of ``min_docs`` documents of one key.

Defined results: null and empty texts have one empty line. Rows without an id are not counted as documents; they lose every line that others
lose. Rows with equal ids are one document: the lines of the largest id stay in all of its rows. Repeated rows get equal bitmaps. An empty table gives an
empty result. Lines shorter than ``min_chars`` code points always stay, also blank ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .ordered import saved
from .text import extended, lists

MIN_CHARS, MIN_DOCS = 40, 5
#: What is stripped from both ends of a line, and the letters that are folded.
BLANK = " \t\n\x0b\x0c\r"
FOLD = {c: c + 32 for c in range(65, 91)}


def key(line: str) -> str:
    return line.strip(BLANK).translate(FOLD) if not line.isascii() else line.strip(BLANK).lower()


def line_hashes(df: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per row of ``df`` (``doc_id``, ``text``): ``doc_id``, ``mark`` (a hash of the text) and, for lines of at least ``min_chars`` code
    points, ``at`` (their places) and the two halves of the hashes of their keys."""
    df = df.select("doc_id", F.xxhash64("text").alias("mark"), "text")
    schema = extended(df, ["doc_id", "mark"], "at array<int>, h1 array<bigint>, h2 array<bigint>")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in batches:
            places, hashes = [], []
            for t in b.column("text"):
                found = [(i, k) for i, x in enumerate((t.as_py() or "").split("\n")) if len(x) >= min_chars and len(k := key(x)) >= min_chars]
                places.append(np.array([i for i, _ in found], np.int32))
                hashes.append(np.frombuffer(b"".join(digest(k.encode("utf-8", "surrogatepass")) for _, k in found), np.int64).reshape(-1, 2))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("mark"), lists(places, pa.int32()),
                 lists([h[:, 0] for h in hashes], pa.int64()), lists([h[:, 1] for h in hashes], pa.int64())],
                ["doc_id", "mark", "at", "h1", "h2"])

    return df.mapInArrow(scan, schema)


#: Kinds of rows that a range gives: a line that goes, a line of a key that other ranges may share, what this range saw of such a key.
LOST, OPEN, SEEN = 0, 1, 2


class Range:
    """Streams over the lines of one range, sorted by key, document (largest first, missing ids last) and place.

    Keys inside the range are decided here. The first and the last key may go on beside the range: their lines are left open, save
    those of a last key that already has enough documents, and what was seen of them is told in one row each.
    """

    NAMES = ("kind", "h1", "h2", "doc_id", "mark", "at", "n")

    def __init__(self, min_docs: int):
        self.min_docs = min_docs
        self.first = None  # the range's first key
        self.key = None  # the last key so far: its documents, the first and the last of them, and lines that wait for a decision
        self.docs, self.keeper, self.doc = 0, None, None
        self.waiting: list[pa.RecordBatch] = []

    def rows(self, kind: int, batch: pa.RecordBatch, go: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        if go is not None:
            batch = batch.filter(pa.array(go))
        if batch.num_rows:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *[batch.column(c) for c in self.NAMES[1:6]], pa.nulls(n, pa.int64())], list(self.NAMES))

    def seen(self) -> Iterator[pa.RecordBatch]:
        h1, h2 = self.key
        row = {"kind": [SEEN], "h1": [h1], "h2": [h2], "doc_id": [self.keeper], "mark": [None], "at": [None], "n": [self.docs]}
        kinds = {"kind": pa.int32(), "at": pa.int32()}
        yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in row.items()], list(self.NAMES))

    def leave(self, last: bool) -> Iterator[pa.RecordBatch]:
        """The last key is over, or the range is."""
        if self.key == self.first or last:
            yield from self.seen()
            for b in self.waiting:
                yield from self.rows(OPEN, b)
        self.waiting = []

    def add(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column("doc_id")
        known, doc = ~np.asarray(ids.is_null()), np.asarray(ids.fill_null(0)).astype(np.int64)
        h1, h2 = np.asarray(batch.column("h1")), np.asarray(batch.column("h2"))
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        cuts = np.append(np.flatnonzero(new), len(doc))
        fresh = new.copy()
        fresh[1:] |= doc[1:] != doc[:-1]
        docs = np.add.reduceat((fresh & known).astype(np.int64), cuts[:-1])
        a, z = int(cuts[1]), int(cuts[-2])
        yield from self.part((int(h1[0]), int(h2[0])), batch.slice(0, a), doc[:a], known[:a], int(docs[0]))
        if z > a:  # keys that begin and end in this batch
            run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))[a:z]
            keeps = known[a:z] & (doc[a:z] == doc[cuts[:-1]][run])
            yield from self.rows(LOST, batch.slice(a, z - a), (docs >= self.min_docs)[run] & ~keeps)
        if z:
            yield from self.part((int(h1[z]), int(h2[z])), batch.slice(z), doc[z:], known[z:], int(docs[-1]))

    def part(self, key: tuple[int, int], batch: pa.RecordBatch, doc: np.ndarray, known: np.ndarray, docs: int) -> Iterator[pa.RecordBatch]:
        """More rows of the last key, or the first ones of a new key."""
        if key != self.key:
            if self.key is not None:
                yield from self.leave(False)
            if self.first is None:
                self.first = key
            self.key, self.docs, self.keeper, self.doc = key, 0, None, None
        elif known[0] and self.doc == int(doc[0]):
            docs -= 1  # the batch begins amid a document
        if docs > 0 and self.keeper is None:
            self.keeper = int(doc[0])
        self.docs += docs
        if known.any():
            self.doc = int(doc[known][-1])
        if key == self.first:
            yield from self.rows(OPEN, batch)
        elif self.docs < self.min_docs:
            self.waiting.append(batch)
        else:
            for b in [*self.waiting, batch]:
                ids = b.column("doc_id")
                yield from self.rows(LOST, b, np.asarray(ids.is_null()) | (np.asarray(ids.fill_null(0)) != self.keeper))
            self.waiting = []

    def over(self) -> Iterator[pa.RecordBatch]:
        if self.key is not None:
            yield from self.leave(True)


def lost_lines(rows: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id``, ``mark``, ``at`` of the lines that go, from a written table of ``doc_id``, ``mark``, ``at``, ``h1``, ``h2``."""
    # Largest id first, missing ids last. A document's rows of a key never part, so each range counts whole documents.
    order = ["h1", "h2", F.col("doc_id").desc_nulls_last()]
    rows = rows.select("h1", "h2", "doc_id", "mark", "at").repartitionByRange(*order).sortWithinPartitions(*order, "at")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Range(min_docs)
        for b in batches:
            if b.num_rows:
                yield from r.add(b)
        yield from r.over()

    got = saved(rows.mapInArrow(stream, "kind int, h1 bigint, h2 bigint, doc_id bigint, mark bigint, at int, n bigint"), "lines-decided")
    out = got.filter(F.col("kind") == LOST).select("doc_id", "mark", "at")
    # At most two rows a range, so this side stays small whatever the lines are.
    seen = got.filter(F.col("kind") == SEEN).groupBy("h1", "h2").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("keeper"))
    seen = F.broadcast(seen.filter(F.col("docs") >= min_docs).drop("docs"))
    open_ = got.filter(F.col("kind") == OPEN).join(seen, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return out.unionByName(open_.select("doc_id", "mark", "at"))


def bitmap(lost: np.ndarray) -> bytes:
    """One bit a line, 1 for those that stay, up to the byte with the last one that goes; compressed."""
    bits = np.ones((int(lost.max()) // 8 + 1) * 8, np.uint8)
    bits[lost] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def stays(keep: bytes, n_lines: int) -> np.ndarray:
    """Whether each of a document's lines stays; those behind the bitmap do."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n_lines].astype(bool)
    return np.concatenate([bits, np.ones(n_lines - len(bits), bool)])


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per different ``doc_id`` and ``mark`` that loses lines, with ``n_dropped`` and the compressed bitmap ``keep``."""
    hashes = line_hashes(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), min_chars)
    hashes = saved(hashes.filter(F.size("at") > 0), "lines-hashes")
    each = hashes.select("doc_id", "mark", F.explode(F.arrays_zip("at", "h1", "h2")).alias("x")).select("doc_id", "mark", "x.*")
    # Repeated rows bring the same places again; sets are combined before the shuffle and are no larger than a document has lines.
    places = lost_lines(each, min_docs).groupBy("doc_id", "mark").agg(F.collect_set("at").alias("lost"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lost = [np.asarray(x.values) for x in b.column("lost")]
            new = [pa.array([len(x) for x in lost], pa.int64()), pa.array([bitmap(x) for x in lost], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), *new], ["doc_id", "mark", "n_dropped", "keep"])

    return places.mapInArrow(pack, "doc_id bigint, mark bigint, n_dropped bigint, keep binary")


def apply_bitmaps(docs: DataFrame, maps: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``text`` without its lost lines (a null text becomes an empty one), with all other columns, plus ``n_lines`` (before), ``n_dropped``
    and ``kept_sha256``. Columns named like a new one are replaced. ``keep`` names the columns to return, all by default; without the
    text among them no text travels back from the Python workers."""
    new = ["n_lines", "n_dropped", "kept_sha256"]
    names = [c for c in (docs.columns if keep is None else keep) if c not in new]
    back = ["__text"] if text in names else []
    rows = docs.select(F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in names if c != text]).alias("__row"), F.col(f"`{doc_id}`").cast("bigint").alias("__id"),
                       F.xxhash64(F.col(f"`{text}`")).alias("__mark"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    maps = maps.select(F.col("doc_id").alias("__m_id"), F.col("mark").alias("__m_mark"), "n_dropped", "keep")
    rows = rows.join(maps, (F.col("__id").eqNullSafe(F.col("__m_id"))) & (F.col("__mark") == F.col("__m_mark")), "left")
    rows = rows.select("__row", "__text", F.coalesce("n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), "keep")
    schema = extended(rows, ["__row", *back], "n_lines bigint, n_dropped bigint, kept_sha256 string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes, digests = [], [], []
            for t, keep in zip(b.column("__text"), b.column("keep")):
                t = t.as_py()
                sizes.append(t.count("\n") + 1)
                if keep.is_valid:
                    t = "\n".join(compress(t.split("\n"), stays(keep.as_py(), sizes[-1]).tolist()))
                if back:
                    texts.append(t)
                digests.append(hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("__row"), *[pa.array(texts, pa.string())] * len(back), pa.array(sizes, pa.int64()), b.column("n_dropped"), pa.array(digests, pa.string())],
                ["__row", *back, *new])

    out = rows.mapInArrow(cut, schema)
    return out.select(*[F.col("__text").alias(text) if c == text else F.col(f"__row.`{c}`").alias(c) for c in names], *new)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, doc_id: str = "doc_id", text: str = "text",
                keep: list[str] | None = None) -> DataFrame:
    """``docs`` without the lines that at least ``min_docs`` documents share, except in the one with the largest id."""
    return apply_bitmaps(docs, saved(shared_lines(docs, min_chars, min_docs, doc_id, text), "lines-maps"), doc_id, text, keep)
