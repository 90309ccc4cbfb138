"""Routing of URLs over a catalogue of patterns of any size.

A pattern can only match a URL that holds its literal texts. The catalogue becomes an inverted index: every pattern is listed under one
piece of a literal that it needs, or under one for each alternative; of all pieces it could take, those that the fewest patterns of the catalogue
hold. A piece is a word up to the sign behind it, or ``GRAM`` bytes. URLs are cut into the same pieces and joined to the index, so a URL meets only
patterns that it shares a rare piece with, however many there are. Pieces that no pattern is listed under are dropped before the shuffle, by a filter of
bounded size. The few patterns that need no literal are tried on every URL, or on every URL of the host they name. What
matches is reduced to the smallest ``ord`` of each URL, on the map side first.

The catalogue stays a table: nothing of it but that filter passes through the driver, and nothing becomes part of the plan. Spark broadcasts the index if
the written table is small, and shuffles by the piece otherwise. Equal URLs are tried once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions import patterns, urls as ux
from ..session import scratch_path

#: Bytes of a short piece.
GRAM = 5
#: Bits of the filter of pieces that is broadcast, as a power of two: 32 MB.
MOST_BITS = 28


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def analysed(catalog: DataFrame) -> DataFrame:
    """``catalog`` with ``java`` (the pattern in Java's dialect, at the start of a text), ``id_group`` and ``clauses`` of required literals."""
    least = GRAM
    anchored, java_pattern, required = patterns.anchored, patterns.java_pattern, patterns.required

    def analyse(batches):
        import pyarrow as pa
        for b in batches:
            rows = [(*java_pattern(p), required(p, least)) for p in b.column("url_regex").to_pylist()]
            new = [pa.array([anchored(r[0]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()),
                   pa.array([r[2] for r in rows], pa.list_(pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "java", "id_group", "clauses"])

    schema = StructType([*catalog.schema.fields, *StructType.fromDDL("java string, id_group int, clauses array<array<string>>").fields])
    return catalog.mapInArrow(analyse, schema)


def index(rules: DataFrame) -> DataFrame:
    """``piece`` (its key), ``ord``, ``java``, ``host``: each pattern under the pieces that lead to it; a pattern without a literal has no piece."""
    gram, piece_keys = GRAM, patterns.piece_keys

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            row, key = piece_keys([x.encode() for x in b.column("text").to_pylist()], gram, literal=True)
            cols = [b.column(i).take(pa.array(row)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(key.view(np.int64))], ["ord", "clause", "text_no", "piece"])

    own = rules.select("ord", "java", "clauses", "host")
    texts = own.select("ord", F.posexplode("clauses").alias("clause", "texts")).select("ord", "clause", F.posexplode("texts").alias("text_no", "text"))
    parts = texts.mapInArrow(cut, StructType([texts.schema["ord"], *StructType.fromDDL("clause int, text_no int, piece bigint").fields]))
    # How often the catalogue holds a piece; the best piece of each literal, the clause whose pieces lead to the fewest patterns.
    common = parts.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    best = parts.join(common, "piece").groupBy("ord", "clause", "text_no").agg(F.min(F.struct("n", "piece")).alias("b"))
    clause = best.groupBy("ord", "clause").agg(F.sum("b.n").alias("n"), F.collect_set("b.piece").alias("pieces"))
    chosen = clause.groupBy("ord").agg(F.min(F.struct("n", "clause", F.sort_array("pieces").alias("pieces"))).alias("c"))
    return own.join(chosen, "ord", "left").select(F.explode_outer("c.pieces").alias("piece"), "ord", "java", "host")


def _sketch(pieces: DataFrame):
    """Bits of a filter of the pieces and its size as a power of two. Only the filter reaches the driver: 16 to 32 bits a piece, at most ``MOST_BITS``."""
    import numpy as np
    n = pieces.count()
    bits = min(max(16, (16 * n).bit_length()), MOST_BITS)
    places = patterns.sketch_places

    def cells(batches):
        import numpy as np
        import pyarrow as pa
        for b in batches:
            at = np.concatenate(places(np.array(b.column("piece")).view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["cell", "bit"])

    told = pieces.mapInArrow(cells, "cell bigint, bit bigint").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[told.column("cell").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    return out, bits


def _met(each: DataFrame, pieces: DataFrame) -> DataFrame:
    """``__url`` and ``piece`` of the pieces of each URL that may be in the index; the others never leave their task."""
    sketch, bits = _sketch(pieces)
    shared = each.sparkSession.sparkContext.broadcast(sketch)
    gram, piece_keys, places = GRAM, patterns.piece_keys, patterns.sketch_places

    def meet(batches):
        import numpy as np
        import pyarrow as pa
        cells = shared.value
        held = lambda at: cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) > 0
        for whole in batches:
            urls = whole.column("__url")
            texts = [u.encode("utf-8", "surrogatepass").lower() for u in urls.to_pylist()]
            # About a million bytes at a time; bytes.lower changes A-Z only.
            part = np.cumsum([len(x) for x in texts]) // 1_000_000
            for k in np.unique(part):
                at = np.flatnonzero(part == k)
                row, key = piece_keys([texts[i] for i in at], gram)
                a, b = places(key, bits)
                keep = held(a) & held(b)
                pair = np.unique(np.stack([at[row[keep]].astype(np.uint64), key[keep]]), axis=1)
                yield pa.RecordBatch.from_arrays([urls.take(pa.array(pair[0].astype(np.int64))), pa.array(pair[1].view(np.int64))], ["__url", "piece"])

    return each.mapInArrow(meet, "__url string, piece bigint")


def route(urls: DataFrame, catalog: DataFrame, col: str = "url", prefilter: bool = False) -> DataFrame:
    """Give each URL the first catalogue entry whose pattern matches from its start.

    ``catalog(ord, extractor_key, url_regex[, host_token])``, with ``ord`` unique. Adds ``ord``, ``extractor_key`` and ``media_id`` (the
    pattern's ``id`` group; null without one, empty if it took no part). With ``prefilter`` a pattern that names its host is only tried on URLs of that host.
    """
    own = ["ord", "extractor_key", "url_regex", *["host_token"] * prefilter]
    named = F.nullif("host_token", F.lit("")) if prefilter else F.lit(None).cast("string")
    rules = _saved(analysed(catalog.select(*own)).withColumn("host", named), "routes")
    lists = _saved(index(rules), "routes-index")
    each = urls.select(F.col(col).alias("__url")).filter("__url IS NOT NULL").distinct()
    host = F.substring_index(ux.host(F.col("__url")), ".", -2)
    listed = lists.filter("piece IS NOT NULL")
    met = _met(each, listed.select("piece")).join(listed, "piece").drop("piece")
    # Patterns that need no literal: those of a host by the host, the others on every URL. They are a table of their own, so that Spark knows how few they
    # are; as a part of the index they would be read in as many parts as the index has, and all URLs once for each.
    rest = _saved(lists.filter("piece IS NULL").drop("piece"), "routes-free")
    free = each.crossJoin(rest.filter("host IS NULL"))
    if prefilter:
        met = met.filter(F.col("host").isNull() | (F.col("host") == host))
        free = free.unionByName(each.withColumn("__host", host).join(rest.filter("host IS NOT NULL"), F.col("__host") == F.col("host")).drop("__host"))
    met = met.unionByName(free)
    first = met.filter(F.expr("__url RLIKE java")).groupBy("__url").agg(F.min("ord").alias("ord"))
    won = rules.select("ord", "extractor_key", "java", "id_group")
    media_id = F.when(F.col("id_group") > 0, F.expr("regexp_extract(__url, java, id_group)"))
    found = first.join(won, "ord").select("__url", "ord", "extractor_key", media_id.alias("media_id"))
    return urls.drop("ord", "extractor_key", "media_id").join(found, F.col(col) == F.col("__url"), "left").drop("__url")
