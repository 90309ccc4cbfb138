"""Helpers that several corpus operators share: words, word hashes, list columns, bounded caches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

#: Pattern of a word for Spark's and Python's text functions: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_BLANK = " \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Entries that one generation of a worker's word cache may hold (about 200 bytes each).
CACHE = 250_000


def words(text: Column) -> Column:
    """Words of a text as an array, in order; empty for null, empty and blank texts."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(_BLANK))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def byte_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The same words in Python; bytes.split() cuts at exactly the six ASCII blanks."""
    if not text:
        return []
    b = text.encode("utf-8", "surrogatepass")
    return (b.translate(LOWER) if lower else b).split()


class WordHashes(dict):
    """64-bit hash of each word; a bounded cache, because words repeat."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(h: np.ndarray) -> np.ndarray:
    """Bit mixer for 64-bit values (the finaliser of the splitmix generator)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` words, from the words' hashes; order counts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * 0x9E3779B97F4A7C15 + 0x2545F4914F6CDD1D & (2**64 - 1) | 1
        out += h[k:k + n] * np.uint64(factor)
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array per row."""
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) for r in rows], out=ends[1:])
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def extended(df: DataFrame, columns: list[str], ddl: str) -> StructType:
    """Types of some columns of ``df`` and of new ones behind them."""
    return StructType([*df.select(*[f"`{c}`" for c in columns]).schema.fields, *StructType.fromDDL(ddl).fields])


def pieces(batch: pa.RecordBatch, column: str, chars: int = 4_000_000):
    """Rows of a batch in runs of bounded text size, so that long texts do not add up in memory."""
    texts = batch.column(column)
    start = held = 0
    for i in range(len(texts)):
        held += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
        if held > chars:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)
