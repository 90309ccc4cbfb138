"""Benchmark decontamination by templates: copies of a benchmark item are found even with other numbers, names and units.

Texts become tokens: words without outer punctuation, in lower case; numbers, units behind a number and names (capitalised inside
a sentence) become placeholders that remember what stood there. Windows of ``WINDOW`` tokens with enough literal words
are hashed. Beside them all windows of the plain lower-case tokens are, without placeholders and however few words they hold: they
find exact copies, whatever their numbers, capitals and full stops, and are windows without slots. The windows of all documents that may occur in the benchmark (a bitmap of fixed size says so) are joined to its
windows by hash. Matches of one document and item at one distance are a run; a run counts as a whole if its slots are consistent,
each value of the item standing for one value of the document, and otherwise only by its windows that say the same as the item.

A document is contaminated by an item if the matched windows cover ``MIN_TOKENS`` tokens of the item, or ``MIN_SHARE`` of them.

Items of equal plain tokens are one class and stand in the result by its smallest id (``item_classes`` tells the members). A window that more than
``COMMON`` classes hold, such as an instruction in front of every question, makes no pair by itself: it counts for an item only where the document
shares one of the item's rarer windows of the same kind (plain, or with slots). If an item has none, its common windows stand for the class with the smallest
id among those that hold them. So each window of a document leads to at most ``COMMON`` items, however many share it.

With ``shared`` nothing is left out: every document is found that any item matches by all its windows. Items whose common windows are the same at the same
distances are then one class for matches by these alone, and its shortest item makes the pairs (``shared_members`` tells the others); an item's own pairs
come by its rarer windows as before. A window then leads to at most ``COMMON`` items and one for each different common part that it stands in.

The work on documents is one pass; what is shuffled are matches only. A passage that a third of all documents hold is
split by adaptive execution, because its windows are few keys of a small table. Nothing is collected but the bitmap.

Defined results: null and empty texts match nothing; items shorter than a window are matched whole, with other values
only from ``MIN_LITERAL`` literal words on. Rows with the same id and text get the same answer, and rows with a null
id are judged too. An empty benchmark flags nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .ordered import saved
from .text import CACHE, byte_words, pieces, signed, windows

WINDOW, MIN_LITERAL = 8, 5
MIN_TOKENS, MIN_SHARE = 12, 0.4
#: Classes of items that may share a window before it is common.
COMMON = 10
#: Bits of the bitmap; one megabyte, whatever the benchmark's size.
BITMAP_BITS = 23

# Units that are placeholders behind a number.
UNITS = frozenset("""
    mm cm dm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec min h hr hrs hours hour minutes minute seconds second days day weeks week
    months month years year hz khz mhz ghz w kw v a kb mb gb tb bytes k c f eur usd gbp dollars euros cents percent % miles meters metres
    kilometers kilometres grams kilograms liters litres inches feet pounds""".split())
NUMBER = re.compile(r"[+\-$€£#]?\d[\d.,:/]*%?")
NUMBER_UNIT = re.compile(r"([+\-$€£]?\d[\d.,]*)([A-Za-z]+)")
LITERAL, NUM, UNIT, DROPPED, NUM_UNIT = range(5)
_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
_TAIL, _STOPS = b"\"')]}*#$%&|", tuple(b".!?:")
_UNITS = frozenset(u.encode() for u in UNITS)
KINDS = {NUM: "num", UNIT: "unit", "name": "name"}
_HOLDERS = {k: np.uint64(xxhash.xxh64_intdigest(f"<{n}>") & ~31) for k, n in KINDS.items()}
_CAP, _END = 8, 16


def core(word: str) -> str:
    """The word without outer signs."""
    a, z = 0, len(word)
    while a < z and not word[a].isalnum():
        a += 1
    while z > a and not word[z - 1].isalnum():
        z -= 1
    return word[a:z]


class Words(dict):
    """Each word as one number: its hash, with kind, capital and sentence end in the five lowest bits. Bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        if word.isascii():
            # The usual word, without a number and in bytes; the rules are those below.
            bare = word.strip(_SIGNS)
            if bare and not bare[:1].isdigit():
                low = bare.lower()
                unit = low in _UNITS
                capital = 0 if unit or not bare[:1].isupper() or (len(bare) > 1 and bare.isupper()) else _CAP
                end = _END if word.rstrip(_TAIL)[-1] in _STOPS else 0
                h = self[word] = xxhash.xxh64_intdigest(low) & ~31 | (UNIT if unit else LITERAL) | capital | end
                return h
        text = word.decode("utf-8", "replace")
        inner = core(text)
        low = inner.lower()
        kind, capital = LITERAL, 0
        if not inner:
            kind = DROPPED
        elif inner[0].isdigit() and NUMBER.fullmatch(inner):
            kind = NUM
        elif inner[0].isdigit() and (m := NUMBER_UNIT.fullmatch(inner)) and m[2].lower() in UNITS:
            kind = NUM_UNIT
        elif low in UNITS:
            kind = UNIT
        elif inner[0].isupper() and (len(inner) == 1 or not inner.isupper()):
            capital = _CAP
        end = _END if text.rstrip("\"')]}*#$%&|")[-1:] in (".", "!", "?", ":") else 0
        h = self[word] = _hash(low) | kind | capital | end
        return h


def _hash(low: str) -> int:
    return xxhash.xxh64_intdigest(low.encode()) & ~31


class Template:
    """Tokens of a text, or of several behind each other: ``hashes`` with placeholders and ``plain`` ones without, ``literal`` flags, the word each stems from and
    the text (``doc``) it stands in, and each text's first token (``base``)."""

    def __init__(self, text: str | None, known: Words, texts: list[list[bytes]] | None = None):
        texts = [byte_words(text)] if texts is None else texts
        self.words = list(chain.from_iterable(texts))
        sizes = np.array([len(t) for t in texts], np.int64)
        starts = (np.cumsum(sizes) - sizes)[sizes > 0]
        p = np.fromiter(map(known.__getitem__, self.words), np.uint64, len(self.words))
        flags = (p & np.uint64(31)).astype(np.int64)
        kind = flags & 7
        first = np.ones(len(p), bool)
        first[1:] = (flags[:-1] & _END) > 0
        after_number = np.zeros(len(p), bool)
        after_number[1:] = kind[:-1] == NUM
        first[starts], after_number[starts] = True, False
        kind = np.where((kind == UNIT) & ~after_number, LITERAL, kind)
        name = (flags & _CAP > 0) & ~first & (kind == LITERAL)
        plain = p & np.uint64(2**64 - 32)
        h = plain.copy()
        h[(kind == NUM) | (kind == NUM_UNIT)] = _HOLDERS[NUM]
        h[kind == UNIT] = _HOLDERS[UNIT]
        h[name] = _HOLDERS["name"]
        times = np.where(kind == DROPPED, 0, np.where(kind == NUM_UNIT, 2, 1))
        self.at = np.repeat(np.arange(len(p)), times)
        self.doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), times)
        self.base = np.searchsorted(self.doc, np.arange(len(sizes)))
        self.hashes = np.repeat(h, times)
        self.literal = np.repeat((kind == LITERAL) & ~name, times)
        second = np.zeros(len(self.at), bool)
        second[1:] = self.at[1:] == self.at[:-1]
        self.hashes[second] = _HOLDERS[UNIT]
        self.plain = np.repeat(plain, times)
        for k in np.flatnonzero(second):
            m = NUMBER_UNIT.fullmatch(core(self.words[self.at[k]].decode("utf-8", "replace")).lower())
            self.plain[k - 1:k + 1] = _hash(core(m[1])), _hash(m[2])
        self.second = second

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all windows and whether each has enough literal words to count, hashes of all plain windows and whether each is not among the former."""
        h, plain = windows(self.hashes, size), windows(self.plain, size)
        if not len(h):
            return h, np.empty(0, bool), plain, np.empty(0, bool)
        literal = np.concatenate([[0], np.cumsum(self.literal)])
        good = literal[size:] - literal[:-size] >= min(size, MIN_LITERAL)
        within = self.doc[size - 1:] == self.doc[:len(h)]
        return h, good & within, plain, (~good | (h != plain)) & within

    def slots(self, start: int, size: int) -> list[str]:
        """What stands in the placeholders of a window, in order."""
        out = []
        for i in range(start, start + size):
            if not self.literal[i]:
                inner = core(self.words[self.at[i]].decode("utf-8", "replace")).lower()
                if m := NUMBER_UNIT.fullmatch(inner):
                    inner = m[2] if self.second[i] else m[1]
                out.append(inner)
        return out


def benchmark_windows(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``hash``, ``key`` (hash of all plain tokens), ``item_id``, ``item_pos``, ``slots``, ``size`` and ``n_tokens`` of all windows of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for b in batches:
            rows = []
            for i, t in zip(b.column("item_id").to_pylist(), b.column("text")):
                x = Template(t.as_py(), known)
                n = len(x.hashes)
                size = min(WINDOW, n)
                if size:
                    key = int(np.uint64(xxhash.xxh64_intdigest(x.plain.tobytes())).view(np.int64))
                    h, good, plain, other = x.windows(size)
                    rows += [(int(v), key, i, int(k), x.slots(int(k), size), size, n) for k, v in zip(np.flatnonzero(good), signed(h[good]))]
                    rows += [(int(v), key, i, int(k), [], size, n) for k, v in zip(np.flatnonzero(other), signed(plain[other]))]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["hash", "key", "item_id", "item_pos", "slots", "size", "n_tokens"])

    return (items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
            .mapInArrow(run, "hash bigint, key bigint, item_id bigint, item_pos int, slots array<string>, size int, n_tokens int"))


def item_classes(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id`` and ``class_id``, the smallest id of the items with equal plain tokens; items without tokens are left out."""
    rows = benchmark_windows(items, item_id, text).select("item_id", "key").distinct()
    return rows.join(rows.groupBy("key").agg(F.min("item_id").alias("class_id")), "key").select("item_id", "class_id")


def _listed_windows(raw: DataFrame, shared: bool = False) -> DataFrame:
    """Windows of the classes, each with ``rare``: whether it makes pairs by itself."""
    ids = raw.groupBy("key").agg(F.min("item_id").alias("item_id"))
    kind = F.size("slots") > 0
    rows = raw.drop("item_id").distinct().join(ids, "key").withColumn("slotted", kind)
    held = rows.groupBy("hash").agg(F.count_distinct("key").alias("n"), F.min(F.struct("item_id", "key")).alias("least"))
    rows = rows.join(held, "hash")
    if shared:
        stand = shared_parts(rows).filter("key = stands.key").select("key", F.lit(True).alias("stands"))
        return rows.join(stand, "key", "left").withColumn("rare", (F.col("n") <= COMMON) | F.col("stands").isNotNull()).drop("n", "least", "stands", "slotted")
    own = rows.groupBy("key", "slotted").agg(F.min("n").alias("fewest"))
    rows = rows.join(own, ["key", "slotted"])
    alone = (F.col("fewest") > COMMON) & (F.col("least.key") == F.col("key"))
    return rows.withColumn("rare", (F.col("n") <= COMMON) | alone).drop("n", "least", "fewest", "slotted")


def shared_parts(rows: DataFrame) -> DataFrame:
    """``key``, ``item_id``, ``n_tokens`` of the classes whose common windows alone could make a match, and ``stands``: the class that stands for it there.

    ``rows`` are windows of classes with ``n``, the number of classes that hold them. Classes with the same common windows at the same distances match the same
    documents as far as these windows go, but for the share of their tokens: the shortest of them, which is the first to match, stands for all."""
    common = rows.filter(F.col("n") > COMMON)
    first = common.groupBy("key").agg(F.min("item_pos").alias("low"))
    at = F.sort_array(F.collect_set(F.struct((F.col("item_pos") - F.col("low")).alias("at"), "hash", "size", "slots")))
    parts = common.join(first, "key").groupBy("key", "item_id", "n_tokens").agg(at.alias("x"))
    most = F.aggregate("x", F.struct(F.lit(0).alias("n"), F.lit(-1000000).alias("last")),
                       lambda a, w: F.struct((a["n"] + F.least(w["size"], w["at"] - a["last"])).alias("n"), w["at"].alias("last")))["n"]
    parts = parts.filter((most >= MIN_TOKENS) | (most >= MIN_SHARE * F.col("n_tokens"))).select("key", "item_id", "n_tokens", F.xxhash64("x").alias("part"), F.size("x").alias("k"))
    stands = parts.groupBy("part", "k").agg(F.min(F.struct("n_tokens", "item_id", "key")).alias("stands"))
    return parts.join(stands, ["part", "k"]).select("key", "item_id", "n_tokens", "stands")


def shared_members(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``item_id``, ``n_tokens`` and ``stands_for``: the members of the classes that stand for others where only common windows match (``shared=True``).

    A document that the class ``item_id`` matches by common windows is matched by each of them of which ``covered`` is enough."""
    raw = benchmark_windows(items, item_id, text)
    ids = raw.groupBy("key").agg(F.min("item_id").alias("item_id"))
    rows = raw.drop("item_id").distinct().join(ids, "key")
    held = rows.groupBy("hash").agg(F.count_distinct("key").alias("n"))
    return shared_parts(rows.join(held, "hash")).select(F.col("stands.item_id").alias("item_id"), F.col("item_id").alias("stands_for"), "n_tokens")


def bitmap(hashes: DataFrame) -> np.ndarray:
    """Which top bits occur among the hashes; built by a grouped bit-or, so that only its fixed size reaches the driver."""
    at = F.shiftrightunsigned("hash", 64 - BITMAP_BITS)
    cells = (hashes.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(_bit(at)).alias("bits")))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for cell, bits in cells.collect():
        out[cell] = np.uint64(bits & (2**64 - 1))
    return out


def _bit(at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)]), (at % 64 + 1).cast("int"))


def document_windows(docs: DataFrame, may: np.ndarray, sizes: list[int]) -> DataFrame:
    """``doc_id``, ``th``, ``doc_pos``, ``hash``, ``slots`` of the documents' windows that may be in the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(may)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cells = Words(), shared.value

        def maybe(h: np.ndarray, wanted: np.ndarray) -> np.ndarray:
            at = h >> np.uint64(64 - BITMAP_BITS)
            return np.flatnonzero(wanted & ((cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)) > 0))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string())]
        for whole in batches:
            for b in pieces(whole, "text", 1_000_000):
                rows = []
                ids, ths = b.column("doc_id").to_pylist(), b.column("th").to_pylist()
                x = Template(None, known, [byte_words(t.as_py()) for t in b.column("text")])
                for size in sizes:
                    h, good, plain, other = x.windows(size)
                    if not len(h):
                        continue
                    hit = maybe(h, good)
                    rows += [(ids[d], ths[d], int(k - x.base[d]), int(v), x.slots(int(k), size)) for d, k, v in zip(x.doc[hit].tolist(), hit, signed(h)[hit])]
                    hit = maybe(plain, other)
                    if size < WINDOW:  # the whole item; once in a text says as much as often
                        hit = hit[np.unique(np.stack([x.doc[hit].astype(np.uint64), plain[hit]]), axis=1, return_index=True)[1]]
                    rows += [(ids[d], ths[d], int(k - x.base[d]), int(v), []) for d, k, v in zip(x.doc[hit].tolist(), hit, signed(plain)[hit])]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "th", "doc_pos", "hash", "d_slots"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, doc_pos int, hash bigint, d_slots array<string>")


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _matches(own: DataFrame, bench: DataFrame) -> DataFrame:
    """Windows of documents with the windows of items: by rare ones, and by common ones of items that a rare one has led to."""
    rare, common = bench.filter("rare").drop("rare"), bench.filter("NOT rare").drop("rare")
    if common.isEmpty():
        return own.join(rare, "hash")
    own = saved(own, "bench-matches")
    found = own.join(rare, "hash")
    pairs = found.select(F.col("doc_id").alias("c_doc"), F.col("th").alias("c_th"), F.col("key").alias("c_key")).distinct()
    more = common.join(pairs, common["key"] == pairs["c_key"]).drop("c_key").withColumnRenamed("hash", "c_hash")
    more = own.join(more, (own["hash"] == more["c_hash"]) & (own["th"] == more["c_th"]) & own["doc_id"].eqNullSafe(more["c_doc"]))
    return found.unionByName(more.select(found.columns))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", shared: bool = False) -> DataFrame:
    """One row per contaminated document and item: ``doc_id``, ``th`` (hash of the text), ``item_id``, ``n_windows``, ``n_tokens``
    (of the item), ``covered`` (of these), ``exact`` (no slot has another value). With ``shared`` common windows count by themselves, too."""
    bench = saved(_listed_windows(saved(benchmark_windows(items, item_id, item_text), "bench-raw"), shared), "bench-windows")
    sizes = sorted(r[0] for r in bench.select("size").distinct().collect())  # at most WINDOW values
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), text_key(text).alias("th"), F.col(text).alias("text"))
    found = _matches(document_windows(docs, bitmap(bench.select("hash")), sizes), bench)
    same = F.zip_with("slots", "d_slots", lambda i, d: F.struct(i.alias("i"), d.alias("d")))
    # A run has at most as many windows as its item.
    runs = (found.withColumn("pairs", same).groupBy("doc_id", "th", "key", "item_id", "size", "n_tokens", (F.col("doc_pos") - F.col("item_pos")).alias("run"))
            .agg(F.collect_set("item_pos").alias("all"), F.collect_set(F.when(F.col("slots") == F.col("d_slots"), F.col("item_pos"))).alias("plain"),
                 F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs")))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"])))
    moved = F.exists("pairs", lambda p: p["i"] != p["d"])
    runs = runs.withColumn("at", F.when(consistent, F.col("all")).otherwise(F.col("plain"))).withColumn("moved", consistent & moved)
    both = (runs.filter(F.size("at") > 0).groupBy("doc_id", "th", "key", "item_id", "size", "n_tokens")
            .agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("at")))).alias("at"), F.min("moved").alias("moved")))
    covered = F.aggregate("at", F.struct(F.lit(0).alias("n"), F.lit(-1000000).alias("last")),
                          lambda a, p: F.struct((a["n"] + F.least(F.col("size"), p - a["last"])).alias("n"), p.alias("last")))["n"]
    both = both.withColumn("covered", covered)
    return (both.filter((F.col("covered") >= MIN_TOKENS) | (F.col("covered") >= MIN_SHARE * F.col("n_tokens")))
            .select("doc_id", "th", "item_id", F.size("at").alias("n_windows"), "n_tokens", "covered", (~F.col("moved")).alias("exact")))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **names) -> DataFrame:
    """Documents without the contaminated ones. No clean text is shuffled unless the list of contaminated ones is long."""
    from .jaccard import _listed
    bad = saved(contaminated(docs, items, doc_id, text, **names).select(F.col("doc_id").alias("__d"), F.col("th").alias("__t")).distinct(), "bench-found")
    return docs.join(_listed(bad), F.col(doc_id).cast("bigint").eqNullSafe(F.col("__d")) & (text_key(text) == F.col("__t")), "left_anti")
