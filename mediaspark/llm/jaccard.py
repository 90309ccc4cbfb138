"""N-gram Jaccard join: which documents share nearly all their word n-grams.

The join is a product of the sparse document by n-gram matrix with itself, in two blocks of columns:

1. Documents with equal n-gram sets are one row of the matrix, known by a hash of the set.
2. Columns are ordered from rare to frequent by counts over all documents (a table of hashed counters; any order is
   right, a good one is fast). The first block holds each row's rarest n-grams: as many as two linked rows
   cannot all miss, plus a few, so that linked rows share at least ``bound`` of them.
3. Products of the first block are accumulated per pair. Pairs of sizes that cannot reach the threshold, and pairs with fewer
   shared columns than the bound, are discarded. The others are counted exactly over all columns.

Large groups of near copies would still give all their pairs, so the product runs twice: first each column links
its rows to one leader only, which is linear, and the exact links found so become components; then the full
product runs between rows of different components only. A pair inside a component is already connected, so no link is lost.

Defined results: null, empty and blank texts have no n-grams and are linked with nothing. Texts shorter than an n-gram
are one n-gram. Rows with a null id are linked with nothing and have no component. Rows with the same id are one document with
several texts. Other columns are not returned. Hashes have 64 bits; sets are told apart by hash and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .graph import components
from .ordered import ranged, running, saved
from .text import WordHashes, byte_words, mix, pieces, signed, windows

#: Counters for the order of columns; their size is fixed, so they may go to the driver and to all tasks.
COUNTERS = 1 << 18
#: Ids in a list that is broadcast, 8 bytes each; longer lists are joined by a shuffle.
MAX_BROADCAST_IDS = 1_000_000
#: Rows, and columns of rows, of one block of the product; a task holds two such blocks and their table of counts.
BLOCK_ROWS, BLOCK_ENTRIES = 512, 1_000_000
#: Sets that a task remembers in order to send copies only once.
SEEN = 500_000


class Measure:
    """Shingle width and threshold in percent, with the bounds that follow from a set's size."""

    def __init__(self, width: int = 3, percent: int = 90):
        self.width, self.percent, self.hashes = width, percent, WordHashes()
        self.spare = (100 - percent) / 300

    def shingles(self, text: str | None) -> np.ndarray:
        """The text's set of hashed n-grams, sorted."""
        h = self.hashes.of(byte_words(text, lower=True))
        if len(h) >= self.width:
            return np.unique(windows(h, self.width))
        return windows(h, len(h)) if len(h) else h

    def bound(self, n: int) -> int:
        """Columns of the first block that a row of n shares with any linked row that is not smaller."""
        return 1 + int(self.spare * n)

    def block(self, n: int) -> int:
        """Rarest columns of a row of n that the first block holds."""
        return min(n, n - -(-self.percent * n // 100) + self.bound(n))

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = np.concatenate([a, b])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return 100 * shared >= self.percent * (len(both) - shared)


def node_of(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63)


def _sets(batches, m: Measure):
    for whole in batches:
        for b in pieces(whole, "text"):
            ids = b.column("doc_id").to_pylist()
            for i, t in zip(ids, b.column("text")):
                yield i, m.shingles(t.as_py())


def features(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) of every row, and (bucket, count) of the columns' counters; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, counts, seen, rows = Measure(width, percent), np.zeros(COUNTERS, np.int64), set(), []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)] + [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64())],
                ["doc_id", "n", "node", "bucket", "count"])
        for i, s in _sets(batches, m):
            node = node_of(s)
            rows.append((i, len(s), node))
            if node not in seen:
                if len(seen) < SEEN:
                    seen.add(node)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            if len(rows) == 10_000:
                yield out()
                rows = []
        yield out()
        full = np.flatnonzero(counts)
        for at in range(0, len(full), 50_000):
            f = full[at:at + 50_000]
            none = pa.nulls(len(f), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.array(f, pa.int32()), pa.array(counts[f])], ["doc_id", "n", "node", "bucket", "count"])

    both = saved(docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, node bigint, bucket int, count bigint"), "jaccard-features")
    return (both.filter("bucket IS NULL").select("doc_id", "n", "node"),
            both.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("count").alias("count")))


def classes_of(counters: DataFrame) -> np.ndarray:
    """Frequency class per counter: 0 for what chance explains, then half doublings above it. One byte each."""
    counts = np.zeros(COUNTERS, np.int64)
    t = counters.toArrow()
    counts[t.column("bucket").to_numpy()] = t.column("count").to_numpy()
    usual = np.median(counts)
    above = counts - usual
    return np.where(above < 4 * np.sqrt(usual) + 8, 0, np.ceil(2 * np.log2(np.maximum(above, 1)))).astype(np.uint8)


def postings(docs: DataFrame, order: np.ndarray, width: int, percent: int) -> DataFrame:
    """The first block of columns: (token, node, n), rows with equal sets mostly once."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, rank, seen, held = Measure(width, percent), shared.value, set(), []

        def out():
            t = np.concatenate([h[0] for h in held])
            sizes = [len(h[0]) for h in held]
            return pa.RecordBatch.from_arrays([pa.array(signed(t)), pa.array(np.repeat([h[1] for h in held], sizes), pa.int64()),
                                               pa.array(np.repeat([h[2] for h in held], sizes), pa.int32())], ["token", "node", "n"])
        total = 0
        for i, s in _sets(batches, m):
            node = node_of(s)
            if i is None or not len(s) or node in seen:
                continue
            if len(seen) < SEEN:
                seen.add(node)
            k = m.block(len(s))
            # Rare first; within a class by a mixed hash, so that equal classes are in the same order everywhere.
            key = mix(s) >> np.uint64(8) | rank[(s & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56)
            held.append((s[np.argpartition(key, k - 1)[:k]], node, len(s)))
            total += k
            if total > 100_000:
                yield out()
                held, total = [], 0
        if held:
            yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "token bigint, node bigint, n int")


def _listed(ids: DataFrame) -> DataFrame:
    """A list of ids for a join, broadcast only if it is counted to be small."""
    return F.broadcast(ids) if ids.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS else ids


def _sizes_fit(percent: int, a: str, b: str):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _block(percent: int, n: str):
    """``Measure.block`` of a size, with the same arithmetic."""
    n = F.col(n)
    return F.least(n, n - F.ceil(percent * n / 100) + 1 + F.floor(F.lit((100 - percent) / 300) * n))


def _missed(percent: int, n: str, a: str, b: str):
    """n-grams of a row of ``n`` that a linked pair of sizes ``a`` and ``b`` may leave unshared."""
    return F.col(n) - F.ceil(percent * (F.col(a) + F.col(b)) / (100 + percent))


def _bound(percent: int, a: str, b: str):
    """Columns of the first block that a linked pair shares at least: even if all its unshared n-grams are in the block."""
    return F.least(_block(percent, a) - _missed(percent, a, a, b), _block(percent, b) - _missed(percent, b, a, b))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes whose whole sets reach the threshold. Only texts of nodes in a pair are read into sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("doc_id").distinct()
    wanted = saved(wanted, "jaccard-wanted")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measure(width, percent)
        for whole in batches:
            for b in pieces(whole, "text"):
                sets = [m.shingles(t.as_py()) for t in b.column("text")]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "grams"])

    sets = saved(docs.join(_listed(wanted), "doc_id", "left_semi").select("text").mapInArrow(read, "node bigint, grams binary"), "jaccard-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measure(width, percent)
        for b in batches:
            x, y = (b.column(c) for c in ("x", "y"))
            ok = [m.linked(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b"))
    return full.select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint").distinct()


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows with the keys ``k1``, ``k2`` of the pair of row blocks in which they meet others, and ``second`` for the second block.

    Columns with one leader are a block of columns. If its rows are too many for a task, they are cut into blocks of rows, each pair of which is
    one key. A component that is too large alone has blocks of its own, which need not meet each other.
    """
    weight = F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum(F.size("tokens")) / BLOCK_ENTRIES)
    parts = rows.groupBy("lead", "comp").agg(weight.alias("w"))
    leads = parts.groupBy("lead").agg(F.sum("w").alias("all"), F.coalesce(F.sum(F.when(F.col("w") <= 1, F.col("w"))), F.lit(0.0)).alias("rest"))
    large = saved(leads.filter("all > 1").select("lead", F.ceil("rest").alias("n_rest")), "jaccard-large")
    few = rows.join(large, "lead", "left_anti").select("*", F.lit("").alias("k1"), F.lit("").alias("k2"), F.lit(False).alias("second"))
    if not large.limit(1).count():
        return few
    own = saved(parts.filter("w > 1").join(large, "lead").select("lead", "comp", F.ceil("w").alias("n_own")), "jaccard-own")

    def numbered(n):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    blocks = (own.select("lead", F.col("comp").alias("o_comp"), numbered("n_own").alias("j"))
              .union(large.filter("n_rest > 0").select("lead", F.lit(None).cast("bigint").alias("o_comp"), numbered("n_rest").alias("j"))))

    def label(comp, j):
        return F.concat_ws(":", F.coalesce(comp.cast("string"), F.lit("rest")), j)
    many = rows.join(large, "lead").join(own, ["lead", "comp"], "left")
    mine = F.when(F.col("n_own").isNotNull(), F.col("comp"))
    many = many.withColumn("mine", label(mine, F.pmod(F.xxhash64("node"), F.coalesce("n_own", "n_rest"))))
    met = many.join(blocks, "lead").filter(F.col("n_own").isNull() | F.col("o_comp").isNull() | (F.col("o_comp") != F.col("comp")))
    met = met.withColumn("theirs", label(F.col("o_comp"), F.col("j")))
    return few.unionByName(met.select(*rows.columns, F.least("mine", "theirs").alias("k1"), F.greatest("mine", "theirs").alias("k2"),
                                      (F.col("mine") > F.col("theirs")).alias("second")))


def product(part: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of rows in different components that share enough of the first block's columns.

    Counts are accumulated inside a task per block of columns; a pair leaves it only if its count and all columns that the two rows have in other
    blocks could reach the bound. The counts of the blocks are then summed. No pair is written once per column.
    """
    rows = part.groupBy("lead", "comp", "node", "n", "s").agg(F.collect_list("token").alias("tokens"))
    rows = saved(rows, "jaccard-rows")
    keyed = _blocked(rows).repartition("lead", "k1", "k2").sortWithinPartitions("lead", "k1", "k2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Measure(width, percent)
        now, held, out, total = None, [], [], 0
        names = ["a", "b", "a_n", "b_n", "c"]

        def flush():
            if len(held) > 1:
                found = _pairs(held, now[1] != now[2], m)
                if found is not None:
                    out.append(found)

        def batch():
            whole = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in whole], names)
        for b in batches:
            t = b.column("tokens")
            flat, ends = t.values.to_numpy(), t.offsets.to_numpy()
            for k, row in enumerate(zip(*[b.column(c).to_pylist() for c in ("lead", "k1", "k2", "node", "comp", "n", "s", "second")])):
                if row[:3] != now:
                    flush()
                    now, held = row[:3], []
                held.append((*row[3:], flat[ends[k]:ends[k + 1]]))
            if sum(x.shape[1] for x in out) > 50_000:
                yield batch()
                out = []
        flush()
        if out:
            yield batch()

    pairs = keyed.mapInArrow(run, "a bigint, b bigint, a_n bigint, b_n bigint, c bigint")
    return (pairs.groupBy("a", "b", "a_n", "b_n").agg(F.sum("c").alias("c")).filter(F.col("c") >= _bound(percent, "a_n", "b_n")).select("a", "b"))


def _pairs(held: list, across: bool, m: Measure) -> np.ndarray | None:
    """Columns a, b, their sizes and their count, for the pairs of a block that may still be linked."""
    node, comp, n, s = (np.array([h[k] for h in held], np.int64) for k in range(4))
    own = np.array([len(h[5]) for h in held], np.int64)
    fits = (comp[:, None] != comp) & (100 * np.minimum(n[:, None], n) >= m.percent * np.maximum(n[:, None], n)) & (node[:, None] < node)
    if across:
        second = np.array([h[4] for h in held])
        fits &= second[:, None] != second
    if not fits.any():
        return None
    block = np.array([m.block(int(x)) for x in n])
    need = -(-m.percent * (n[:, None] + n) // (100 + m.percent))
    bound = np.minimum((block - n)[:, None], block - n) + need
    fits &= np.minimum(s[:, None], s) >= bound
    if not fits.any():
        return None
    tokens, row = np.concatenate([h[5] for h in held]), np.repeat(np.arange(len(held)), own)
    at = np.argsort(tokens, kind="stable")
    tokens, row = tokens[at], row[at]
    cuts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
    count = np.zeros((len(held), len(held)), np.int32)
    for a, z in zip(cuts, cuts[1:]):
        if z - a > 1:
            r = row[a:z]
            count[r[:, None], r] += 1
    rest = s - own
    a, b = np.nonzero(fits & (count > 0) & (count + np.minimum(rest[:, None], rest) >= bound))
    return np.array([node[a], node[b], n[a], n[b], count[a, b]]) if len(a) else None


def join(docs: DataFrame, width: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links) and ``copies`` (rows with an equal set)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, counters = features(docs, width, percent)
    nodes = saved(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("node", "n").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")), "jaccard-nodes")
    block = saved(postings(docs, classes_of(counters), width, percent), "jaccard-block")
    # Columns with more than one row. Each has one leader: the row with the fewest columns of its own, which is near the middle of its copies.
    lists = block.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("token")
    shared = saved(block.join(lists, "token").distinct(), "jaccard-shared")
    alone = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("s")).select("node", (_block(percent, "n") - F.col("s")).alias("alone"))
    led = shared.join(alone, "node")
    leads = led.groupBy("token").agg(F.min(F.struct("alone", "node", "n")).alias("l")).select("token", F.col("l.node").alias("lead"), F.col("l.n").alias("lead_n"))
    shared = saved(shared.join(leads, "token"), "jaccard-led")
    stars = (shared.filter(F.col("node") != F.col("lead")).filter(_sizes_fit(percent, "n", "lead_n"))
             .groupBy(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("lead_n"), F.col("n")).agg(F.count(F.lit(1)).alias("c"))
             .filter(F.col("c") >= _bound(percent, "n", "lead_n")).select("a", "b"))
    stars = saved(stars, "jaccard-stars")
    links = saved(verified(stars, docs, nodes, width, percent), "jaccard-links")
    groups = saved(components(links), "jaccard-groups")

    # The product between components. Columns that one component has alone are done, and a row that is left with too few
    # columns for any link makes no pairs.
    part = shared.select("token", "lead", "node", "n").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    part = saved(part, "jaccard-part")
    mixed = part.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("token")
    part = saved(part.join(mixed, "token"), "jaccard-mixed")
    able = part.groupBy("node", "n").agg(F.count(F.lit(1)).alias("s"))
    able = able.filter(_block(percent, "n") - F.col("s") <= F.col("n") - F.ceil(percent * F.col("n") / 100)).drop("n")
    pairs = product(part.join(able, "node"), width, percent)
    done = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    pairs = saved(pairs.join(done, ["a", "b"], "left_anti"), "jaccard-pairs")
    more = saved(verified(pairs, docs, nodes, width, percent), "jaccard-more")
    groups = saved(components(links.union(more)), "jaccard-groups") if more.limit(1).count() else groups

    # The smallest id of each component, then of each node; nodes without links keep their own.
    known = nodes.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = known.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    ids = known.join(least, "comp").filter("copies > 1 OR component_id <> doc_id").select("node", "n", "component_id", "copies")
    out = rows.join(ids, ["node", "n"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component: the one with the smallest id. Rows with a null id all stay; repeated rows stay once.

    Where one id has several texts, each text is a document of its own: it goes only if its own component has a smaller row. Of one id's texts in one component that with the
    smallest hash stays, and of rows that differ in other columns only the first one by its JSON text.
    """
    known = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark")).filter("id IS NOT NULL")
    if known.groupBy("id").count().filter("count > 1").isEmpty():
        found = saved(join(docs, width, percent, doc_id, text), "jaccard-found")
        lost = saved(found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "jaccard-lost")
        return docs.join(_listed(lost), doc_id, "left_anti")
    # Ids repeat: every id and text gets a number in their order, which takes the id's part.
    pairs = known.distinct().withColumn("one", F.lit(1).cast("bigint"))
    numbers = running(ranged(pairs, ["id", "mark"], "jaccard-ids"), ["id", "mark"], [], no="one").select("id", "mark", "no")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"), row).filter("id IS NOT NULL")
    named = saved(named.join(numbers, ["id", "mark"]).select("no", "text", "row"), "jaccard-named")
    found = saved(join(named, width, percent, "no", "text"), "jaccard-found")
    lost = saved(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("no")).distinct(), "jaccard-lost")
    kept = named.join(_listed(lost), "no", "left_anti").groupBy("no").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.select("row.*").unionByName(docs.filter(F.col(doc_id).isNull()))
