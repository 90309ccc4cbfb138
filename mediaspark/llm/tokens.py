"""Token ids of texts with a public tokenizer, and sorted ORC files of them.

The tokenizer cuts at white space before anything else, so a text's ids are the ids of its words in order. A bounded
cache of words per task replaces most calls; a tokenizer without that property is called with whole texts.

The file format is ORC: rows ``(doc_id, n_tokens, ids)`` in ascending ``doc_id`` order, one range per file. Ids are stored with
ORC's integer run-length encoding; stripes, row-group indexes and a Bloom filter on ``doc_id`` let a reader split files by stripe
and skip what cannot match. ``start`` (ids of all documents before) follows from the counts in the files.

Defined results: a null text is an empty one and gets the end id alone. Null ids sort first. Rows with the same
``doc_id`` all stay, ordered by count and checksum. Other columns are left out of the files. An empty table writes an
empty data set. Writing goes to a new folder per call; a lost executor repeats its own range only.
"""

from __future__ import annotations

import json
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .text import CACHE, extended, lists, pieces

END_ID = 2


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_LETTERS = _byte_letters()
#: Signs that stay in one piece behind a word; an apostrophe may start a contraction.
_SIGNS = "!#$%&*+,-./:;<=>?@\\^_`|~()[]{}\""


class WordIds(dict):
    """Ids of a word as raw little-endian unsigned 32-bit integers.

    Bounded: a full cache becomes the old generation, from which words still in use move over.
    """

    def __init__(self, tokenizer, plain: bool):
        self.tokenizer, self.plain = tokenizer, plain
        self.old, self.parts, self.old_parts = {}, {}, {}
        self.piece = tokenizer.model.tokenize

    def _part(self, part: str) -> bytes:
        """Ids of one run of lower-case letters or of signs, which the tokenizer never splits further."""
        got = self.parts.get(part)
        if got is None:
            got = self.old_parts.get(part)
            if got is None:
                inner = part if part.isascii() else "".join([_LETTERS[b] for b in part.encode()])
                got = _raw([t.id for t in self.piece(inner)])
            if len(self.parts) >= CACHE:
                self.old_parts, self.parts = self.parts, {}
            self.parts[part] = got
        return got

    def _new(self, word: bytes) -> bytes:
        if not self.plain:
            return _raw(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids)
        if word.isalpha():  # ASCII letters only
            return self._part(word.lower().decode())
        text = word.decode("utf-8", "replace")
        bare = text.rstrip(_SIGNS)
        if not bare:
            return self._part(text)
        # Letters below U+0180 that stand alone are in normal form and have one-letter lower cases.
        if bare.isalpha() and max(bare) < "\u0180" and "\u0130" not in bare:
            return self._part(bare.lower()) + (self._part(text[len(bare):]) if len(bare) < len(text) else b"")
        return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._new(word)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


def _raw(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Encodes whole texts with the tokenizer in ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # The steps of a tokenizer that drops white space and cuts there.
        kinds = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (kinds == ["NFC", "Replace", "Lowercase"] and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
                        and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
                        and r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in steps[0]["pattern"].get("Regex", "")
                        and not any(t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])))
        self.words = WordIds(self.tokenizer, self.by_word)

    def ids(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.by_word:
            return b"".join(map(self.words.__getitem__, text.encode("utf-8", "replace").split()))
        return _raw(self.tokenizer.encode(text, add_special_tokens=False).ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker, so that its caches serve all its tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode(df: DataFrame, path: str, text: str = "text", keep=("doc_id",), end: int | None = END_ID) -> DataFrame:
    """``keep`` plus ``n_tokens`` and ``ids`` (array of int) of each whole text, with the end id appended."""
    keep = list(keep)
    tail = b"" if end is None else np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for whole in batches:
            for b in pieces(whole, text):
                rows = [np.frombuffer(e.ids(t.as_py()) + tail, "<i4") for t in b.column(text)]
                n = pa.array([len(r) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], n, lists(rows, pa.int32())], [*keep, "n_tokens", "ids"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, extended(df, keep, "n_tokens bigint, ids array<int>"))


def count_tokens(df: DataFrame, path: str, text: str = "text", keep=(), end: int | None = None) -> DataFrame:
    """``keep`` plus ``n_tokens``; the ids stay in the Python workers."""
    keep = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = pa.array([len(e.ids(t.as_py())) // 4 + (end is not None) for t in b.column(text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], n], [*keep, "n_tokens"])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, extended(df, keep, "n_tokens bigint"))


def write_tokens(df: DataFrame, folder: str, path: str, text: str = "text", doc_id: str = "doc_id", end: int = END_ID,
                 stripe_bytes: int = 64 << 20, index_rows: int = 10_000) -> str:
    """Encode all texts and write them as ORC in ascending order of their ids. Returns the folder."""
    ordered = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    (encode(ordered, path, end=end).write.mode("errorifexists")
     .option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
     .option("compression", "zstd").orc(folder))
    return folder


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """Rows of the files; a condition on ``doc_id`` skips files, stripes and row groups by their statistics and Bloom filters."""
    df = spark.read.schema("doc_id bigint, n_tokens bigint, ids array<int>").orc(folder)
    return df if where is None else df.filter(where)


def checksums(df: DataFrame) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids_crc32`` of rows with ids, plus the file that each came from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, ends = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(ends, ends[1:])]
            n = np.diff(ends)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.int64()), b.column("file")],
                                             ["doc_id", "n_tokens", "ids_crc32", "file"])

    return (df.select("doc_id", "ids", F.col("_metadata.file_name").alias("file"))
            .mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, file string"))


def with_starts(rows: DataFrame) -> DataFrame:
    """``start`` of each document: the ids in all earlier files (a sum over the table of files) and earlier in its own.

    ``rows`` is read twice, so it should be a written table. A file holds one task's range, which bounds the windows.
    """
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("low"))
    # A null id is the smallest; then comes the file's order of the range partitioning.
    before = W.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(W.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = W.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    return rows.join(files, "file").withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).drop("base", "file")
