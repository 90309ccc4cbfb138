"""Periodic runs of words, found by block convolution.

A run is a stretch of words with smallest period ``q`` and at least ``max(MIN_LENGTH, MIN_POWER * q)`` words that cannot be made longer
on either side. Periods are looked for at dyadic scales. At scale ``B`` every document is cut into blocks of ``B`` words; a run whose
period lies between ``B`` and ``2 B`` (for the first scale: below ``2 B``) holds a whole block whose copy stands one period behind it.
The squared differences between a block and all places of its following window,

    sum (x - y)^2 = sum x^2 - 2 sum x y + sum y^2,

are taken with an exact number-theoretic transform modulo a prime, for all blocks of all documents of a batch at once. A difference of zero
is a seed; seeds are compared word by word and extended to both sides, so a difference that is only zero modulo the prime does no harm.

Two exact rules save work. A block is convolved only if each of its words occurs again within ``2 B`` words, else no copy of
the block can be there. Inside a run of short period a block recurs at every multiple of that period: a seed whose
copy lies in the same run has no smallest period of its own, and one whose copy lies in another such run can only be longer than the two where their ends
fit together.

All work happens inside the document's row: hot sources and groups of copies change nothing. Memory is bounded by the texts of
one piece (``PIECE`` bytes, or one longer text).

Defined results: null, empty and blank texts have no words and no runs; the strongest run's four columns are null there. Repeated rows and rows
with null ids get their own answers. Columns named like a new one are replaced, all other columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import byte_words, extended, pieces, words

MIN_LENGTH, MIN_POWER = 24, 3
#: Words in a block of the first scale. A run has at least 2 * FIRST - 1 words before its last period, so it holds a whole block.
FIRST = 8
#: Modulus of the transform, a prime 15 * 2^27 + 1 below 2^31, and a generator of its multiplicative group.
PRIME, ROOT = 15 * 2**27 + 1, 31
#: Bytes of text that are coded and convolved together.
PIECE = 2_000_000
#: Numbers in one matrix of blocks.
CELLS = 1 << 20
_P = np.uint64(PRIME)


@lru_cache(maxsize=None)
def _twiddles(size: int, inverse: bool) -> tuple[np.ndarray, ...]:
    """Powers of the root of unity for each step of a transform, from ``size`` down to 2."""
    out, step = [], size
    while step > 1:
        w = pow(ROOT, (PRIME - 1) // step, PRIME)
        w = pow(w, PRIME - 2, PRIME) if inverse else w
        t = np.ones(1, np.uint64)
        while len(t) < step // 2:
            t = np.concatenate([t, t * np.uint64(pow(w, len(t), PRIME)) % _P])
        out.append(t[:step // 2])
        step //= 2
    return tuple(out)


def transform(a: np.ndarray) -> np.ndarray:
    """Transform of each row, in bit-reversed order. The length of a row is a power of two."""
    rows, size = a.shape
    step = size
    for t in _twiddles(size, False):
        a = a.reshape(rows, size // step, 2, step // 2)
        lo, hi = a[:, :, 0], a[:, :, 1]
        a = np.stack([(lo + hi) % _P, (lo + (_P - hi)) * t % _P], axis=2)
        step //= 2
    return a.reshape(rows, size)


def inverse(a: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``, from bit-reversed order."""
    rows, size = a.shape
    step = 2
    for t in reversed(_twiddles(size, True)):
        a = a.reshape(rows, size // step, 2, step // 2)
        lo, hi = a[:, :, 0], a[:, :, 1] * t % _P
        a = np.stack([(lo + hi) % _P, (lo + (_P - hi)) % _P], axis=2)
        step *= 2
    return a.reshape(rows, size) * np.uint64(pow(size, PRIME - 2, PRIME)) % _P


def products(blocks: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """``sum_j blocks[r, j] * wide[r, d + j]`` modulo the prime, for each row and each ``d`` at which the block does not wrap around."""
    size = wide.shape[1]
    turned = np.zeros_like(wide)
    turned[:, 0] = blocks[:, 0]
    turned[:, size - blocks.shape[1] + 1:] = blocks[:, :0:-1]
    return inverse(transform(turned) * transform(wide) % _P)


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


class Finder:
    """Runs of several documents whose words stand behind each other in one array of codes."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER):
        if min_power < 3 or min_length < 3 * FIRST:
            raise ValueError(f"runs shorter than {3 * FIRST} words or three periods may hold no whole block")
        self.codes, self.sizes = codes, sizes
        self.ends = np.cumsum(sizes)
        self.min_length, self.min_power = min_length, min_power
        self.found: list[tuple[int, int, int]] = []  # start, end, period, in places of the array
        squares = codes.astype(np.uint64) % _P
        self.squares = np.concatenate([[0], np.cumsum((squares * squares % _P).astype(np.int64))])

    def again(self) -> np.ndarray:
        """Distance from each word to the next equal one of its document; very large if there is none."""
        at = np.argsort(self.codes, kind="stable")
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        same = (self.codes[at[1:]] == self.codes[at[:-1]]) & (doc[at[1:]] == doc[at[:-1]])
        out = np.full(len(self.codes), np.iinfo(np.int64).max)
        out[at[:-1][same]] = (at[1:] - at[:-1])[same]
        return out

    def runs(self) -> list[tuple[int, int, int]]:
        again, size = self.again(), FIRST
        while size == FIRST or (self.sizes >= self.min_power * size).any():
            rare = np.concatenate([[0], np.cumsum(again >= 2 * size)])
            own = self.sizes >= max(self.min_length, self.min_power * (1 if size == FIRST else size))
            count = np.where(own, self.sizes // size, 0)
            first = np.repeat(self.ends - self.sizes, count)
            at = first + (np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)) * size
            end = np.repeat(self.ends, count)
            able = rare[at + size] == rare[at]
            at, end = at[able], end[able]
            per = max(1, CELLS // (4 * size))
            for k in range(0, len(at), per):
                self.extend(size, *self.seeds(size, at[k:k + per], end[k:k + per]))
            size *= 2
        return sorted(set(self.found), key=lambda r: (r[0], r[2]))

    def seeds(self, size: int, at: np.ndarray, end: np.ndarray):
        """Places and distances of blocks with no difference to a place of their window, and the ends of their documents."""
        low = 1 if size == FIRST else size
        width = 4 * size if size == FIRST else 2 * size
        last = len(self.codes) - 1
        blocks = self.codes[at[:, None] + np.arange(size)].astype(np.uint64)
        wide = self.codes[np.minimum(at[:, None] + low + np.arange(width), last)].astype(np.uint64)
        shift = np.arange(low, 2 * size)
        cross = products(blocks % _P, wide % _P)[:, :len(shift)].astype(np.int64)
        there = at[:, None] + shift
        fits = there + size <= end[:, None]
        there = np.where(fits, there, 0)
        own = (self.squares[at + size] - self.squares[at])[:, None]
        diff = (own + self.squares[there + size] - self.squares[there] - 2 * cross) % PRIME
        row, d = np.nonzero(fits & (diff == 0))
        return at[row], shift[d], end[row]

    def extend(self, size: int, at: np.ndarray, dist: np.ndarray, end: np.ndarray) -> None:
        order = np.lexsort((at, dist))
        at, dist, end = at[order], dist[order], end[order]
        if size > FIRST:
            may = self.independent(size, at, dist)
            at, dist, end = at[may], dist[may], end[may]
        done, known = -1, 0
        short: dict[int, list[int]] = {}  # first scale: bounds of runs found by period
        for b, q, z in zip(at.tolist(), dist.tolist(), end.tolist()):
            if q != known:
                done, known = -1, q
            if b < done:
                continue
            if size == FIRST and any(q % p == 0 and s <= b and b + size + q <= e for p, v in short.items() for s, e in v[-1:]):
                continue
            left, right = self.stretch(b, q, size, z)
            done = right
            if right + q - left >= max(self.min_length, self.min_power * q) and self.smallest(left, q):
                self.found.append((left, right + q, q))
                if size == FIRST:
                    short.setdefault(q, []).append((left, right + q))

    def independent(self, size: int, at: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Which seeds can have a smallest period of their own, by the runs of short period that hold the block and its copy."""
        short = sorted((s, e) for s, e, q in set(self.found) if 2 * q <= size)
        if not short or not len(at):
            return np.ones(len(at), bool)
        starts, ends = np.array(short).T
        # Of the runs that begin up to a place, the one that reaches furthest holds the block if any does.
        far = np.maximum.accumulate(ends)
        which = np.maximum.accumulate(np.where(ends == far, np.arange(len(ends)), 0))

        def holder(place):
            k = np.searchsorted(starts, place, side="right") - 1
            k = np.where(k >= 0, which[np.maximum(k, 0)], -1)
            return np.where((k >= 0) & (ends[k] >= place + size), k, -1)

        a, b = holder(at), holder(at + dist)
        both = (a >= 0) & (b >= 0)
        fit = (ends[b] - ends[a] == dist) | (starts[b] - starts[a] == dist)
        return ~both | ((a != b) & fit)

    def stretch(self, b: int, q: int, size: int, end: int) -> tuple[int, int]:
        """The longest range of places around the block at which the word equals the one ``q`` behind; empty if the block itself does not."""
        w = self.codes
        if not np.array_equal(w[b:b + size], w[b + q:b + q + size]):
            return b, b + 1 - q if q > 1 else b
        begin = end - int(self.sizes[np.searchsorted(self.ends, b, side="right")])
        right, step = b + size, 64
        while right < end - q:
            z = min(right + step, end - q)
            differ = np.flatnonzero(w[right:z] != w[right + q:z + q])
            if len(differ):
                right += int(differ[0])
                break
            right, step = z, step * 2
        left, step = b, 64
        while left > begin:
            a = max(begin, left - step)
            differ = np.flatnonzero(w[a:left] != w[a + q:left + q])
            if len(differ):
                left = a + int(differ[-1]) + 1
                break
            left, step = a, step * 2
        return left, right

    def smallest(self, left: int, q: int) -> bool:
        """Whether no part of ``q`` is a period of a run of three periods that starts at ``left``."""
        w = self.codes
        return not any(np.array_equal(w[left:left + q], w[left + q // p:left + q // p + q]) for p in _primes(q))


class Codes(dict):
    """A number for each different word, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def runs_of(texts: list[list[bytes]], **limits) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each text, in order of start and period; texts are lists of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return [[] for _ in texts]
    codes = np.fromiter(map(Codes().__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum(sizes)
    for s, e, q in Finder(codes, sizes, **limits).runs():
        k = int(np.searchsorted(ends, s, side="right"))
        out[k].append((s - int(ends[k] - sizes[k]), e - s, q))
    return out


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties: smallest start, then period. Compared as whole numbers."""
    best = None
    for r in runs:  # in order of start and period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(found: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(found)
    change = np.zeros(len(found) + 1, np.int64)
    for s, n, q in runs:
        change[s + q] += 1
        change[s + n] -= 1
    return b" ".join(w for w, k in zip(found, np.cumsum(change[:-1]).tolist()) if not k)


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed_sha256")


def periodic_runs(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_length: int = MIN_LENGTH, min_power: int = MIN_POWER,
                  with_text: bool = False) -> DataFrame:
    """Add ``n_runs``, the strongest run (``start``, ``length``, ``period``, ``exponent_milli``), ``runs`` (array of start, length, period)
    and the digests of the list of runs and of the text without repetitions; with ``with_text`` also that text as ``collapsed``.

    ``keep`` names the columns to return, all by default; texts that are not among them do not travel back from the Python workers.
    """
    names = [*NAMES, *["collapsed"] * with_text]
    kept = [c for c in (df.columns if keep is None else keep) if c not in names]
    ddl = ("n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
           "runs array<struct<start:bigint,length:bigint,period:bigint>>, runs_sha256 string, collapsed_sha256 string" + ", collapsed string" * with_text)
    schema = extended(df, kept, ddl)
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
    types = [pa.int64()] * 5 + [kind] + [pa.string()] * (2 + with_text)
    df = df.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in pieces(whole, text, PIECE):
                texts = [byte_words(t.as_py()) for t in b.column(text)]
                rows = []
                for found, runs in zip(texts, runs_of(texts, min_length=min_length, min_power=min_power)):
                    best = strongest(runs)
                    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
                    rest = collapsed(found, runs)
                    rows.append((len(runs), *top, [{"start": s, "length": n, "period": q} for s, n, q in runs],
                                 hashlib.sha256(listing).hexdigest(), hashlib.sha256(rest).hexdigest(),
                                 *[rest.decode("utf-8", "surrogatepass")] * with_text))
                new = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *new], [*kept, *names])

    return df.mapInArrow(scan, schema)


def planted(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with the texts of a trial: for a tenth of the ids, by checksum, the words from some place on repeat with some period; others stay."""
    h = F.crc32(F.col(f"`{doc_id}`").cast("string"))
    g = F.floor(h / 10)
    n = F.size("__w")
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + g % 8))).cast("int")
    # The words and places are columns of their own, so that the function over the words does not take them from the text again for each word.
    df = df.withColumn("__w", F.when(h % 10 == 0, words(F.col(f"`{text}`"))))
    df = df.withColumns({"__a": F.when(n > 0, a), "__p": F.when(n > 0, p)})
    again = F.transform("__w", lambda x, i: F.when(i < F.col("__a"), x).otherwise(F.get("__w", F.col("__a") + (i - F.col("__a")) % F.col("__p"))))
    return df.withColumn(text, F.when(F.col("__a").isNotNull(), F.array_join(again, " ")).otherwise(F.col(f"`{text}`"))).drop("__w", "__a", "__p")
