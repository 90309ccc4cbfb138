"""Playlists, item filters, archive and reference resolution (family G)."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import skew
from ..functions import urls as ux
from ..session import cut

# --- entries ------------------------------------------------------------------------------------


def expand_playlists(playlists: DataFrame, entries: DataFrame, start: int = 1) -> DataFrame:
    """Attach playlist fields, entry count and index to each entry; the entry's own values win."""
    tot = entries.groupBy("playlist_id").agg(F.count(F.lit(1)).alias("n_entries"))
    about = playlists.join(tot, "playlist_id").select(
        "playlist_id", "n_entries", F.coalesce(F.nullif("title", F.lit("")), F.col("playlist_id").cast("string")).alias("playlist"),
        F.col("title").alias("playlist_title"), F.col("uploader").alias("playlist_uploader"),
        F.col("extractor_key").alias("__ek"), F.col("webpage_url").alias("__wu"))
    e = entries if "playlist_index" in entries.columns else index_entries(entries, start)
    own = lambda c, other: F.coalesce(F.col(c), F.col(other)) if c in entries.columns else F.col(other)
    out = e.join(about, "playlist_id")
    return (out.withColumn("extractor_key", own("extractor_key", "__ek"))
            .withColumn("webpage_url", own("webpage_url", "__wu"))
            .withColumn("webpage_url_basename", ux.basename(F.col("webpage_url"))).drop("__ek", "__wu"))


def index_entries(df: DataFrame, start: int = 1, order=None, hot_rows: int | None = None, upto: int | None = None) -> DataFrame:
    """Number the entries of each playlist in list order, from ``start``; with ``upto`` only so many of each."""
    out = skew.numbered(df, "playlist_id", order or [F.col("pos")], "playlist_index", hot_rows, upto=upto)
    return out.withColumn("playlist_index", F.col("playlist_index") + (start - 1))


def slice_entries(df: DataFrame, start: int = 1, end: int | None = None, hot_rows: int | None = None) -> DataFrame:
    """Entries start..end (1-based, -1 or None = to the end) with their index in the whole list."""
    return index_entries(df, hot_rows=hot_rows, upto=None if end in (None, -1) else end).filter(F.col("playlist_index") >= start)


def item_spans(text: str) -> list[tuple[int, int, int]]:
    """(numbers before it, first, last) of the spans of a request such as ``1,3-5``, in order, without what an earlier span has."""
    out: list[tuple[int, int, int]] = []
    n, taken = 0, []  # spans so far, sorted and apart
    for part in text.split(","):
        lo, hi = map(int, part.split("-")) if "-" in part else (int(part), int(part))
        at, free = lo, []
        for a, z in taken:
            if z >= at and a <= hi:
                free += [(at, a - 1)] if a > at else []
                at = z + 1
        free += [(at, hi)] if at <= hi else []
        for a, z in free:
            if out and a == out[-1][2] + 1 and a > 1:
                out[-1] = (out[-1][0], out[-1][1], z)
            else:
                out.append((n, a, z))
            n += z - a + 1
        taken = sorted([*taken, *free])
    return out


def item_list(text: str) -> list[int]:
    """The numbers of a request, in order, without repeats."""
    return [i for _, a, z in item_spans(text) for i in range(a, z + 1)]


#: Spans of a request that become conditions; more become a table.
MAX_SPANS = 64


def pick_items(df: DataFrame, items: str, hot_rows: int | None = None) -> DataFrame:
    """Requested entries in request order.

    0 names the last entry, numbers beyond the list give nothing. The index comes from the request
    by output position, so an entry that gives nothing shifts the ones after it. A request stays the spans that it is written as, however long they are.
    """
    spans = item_spans(items)
    listed = [(n, a, z) for n, a, z in spans if z > 0]
    nums = index_entries(df, hot_rows=hot_rows, upto=max([z for _, _, z in listed], default=0)).withColumnRenamed("playlist_index", "__no")
    hits = _in_spans(nums, "__no", listed, lambda n, a, z: (a, z), lambda n, a, no: no - a + n, "ord")
    zero = next((n for n, a, _ in spans if a == 0), None)
    if zero is not None:
        last = df.groupBy("playlist_id").agg(F.max_by(F.struct(*df.columns), "pos").alias("__l")) \
            .select("playlist_id", *[F.col(f"__l.{c}").alias(c) for c in df.columns if c != "playlist_id"])
        hits = hits.select(*df.columns, "ord").unionByName(last.select(*df.columns, F.lit(zero).cast("bigint").alias("ord")))
    place = skew.numbered(hits, "playlist_id", [F.col("ord")], "out_pos", hot_rows, sizes=df)
    out = place.select(*df.columns, F.col("out_pos").cast("int").alias("out_pos"))
    # The number that the request has at that place.
    return _in_spans(out, "out_pos", spans, lambda n, a, z: (n + 1, n + 1 + z - a), lambda n, a, at: at - 1 - n + a, "playlist_index")


def _in_spans(df: DataFrame, col: str, spans, bounds, value, out: str) -> DataFrame:
    """Rows whose number lies in a span, with ``value`` of the span and the number."""
    no = F.col(col).cast("bigint")
    if len(spans) <= MAX_SPANS:
        pick = F.lit(None).cast("bigint")
        for n, a, z in reversed(spans):
            lo, hi = bounds(n, a, z)
            pick = F.when(no.between(lo, hi), value(n, a, no)).otherwise(pick)
        return df.withColumn(out, pick).filter(F.col(out).isNotNull())
    # Spans by the blocks of numbers that they touch: a join by block, at most 100,000 rows more than spans.
    ends = [bounds(*s) for s in spans]
    width = max(1024, max(hi for _, hi in ends) // 100_000)
    rows = [(b, n, a, lo, hi) for (n, a, _), (lo, hi) in zip(spans, ends) for b in range(lo // width, hi // width + 1)]
    table = df.sparkSession.createDataFrame(rows, "__b bigint, __n bigint, __a bigint, __lo bigint, __hi bigint")
    got = df.withColumn("__at", no).join(table, (F.floor(no / width) == F.col("__b")) & no.between(F.col("__lo"), F.col("__hi")))
    return got.withColumn(out, value(F.col("__n"), F.col("__a"), F.col("__at"))).drop("__b", "__n", "__a", "__lo", "__hi", "__at")


def reverse_entries(df: DataFrame, start: int = 1) -> DataFrame:
    """Entries last to first; the index is assigned after the reversal."""
    return index_entries(df, start, [-F.col("pos")])


def shuffle_entries(df: DataFrame, seed: str, key: str = "media_id", start: int = 1) -> DataFrame:
    """Entries in a random order that the seed makes repeatable."""
    return index_entries(df, start, [F.md5(F.concat(F.lit(seed), F.lit("-"), F.col(key).cast("string"))), F.col("pos")])


def cap(df: DataFrame, n: int, order) -> DataFrame:
    """The first ``n`` accepted items of the run; apply after the filters (G06). No task gathers them, whatever ``n`` is."""
    return skew.numbered(df.withColumn("__all", F.lit(0)), "__all", order, "__n", upto=n).drop("__all", "__n")


def pages_for_slice(df: DataFrame, size: int, start: int = 1, end: int | None = None) -> DataFrame:
    """Rows of a paged source that hold items start..end; whole pages outside are pruned.

    ``df`` has 0-based ``page`` and ``page_pos``; the page predicate prunes partitions or row groups.
    """
    lo = (start - 1) // size
    out = df.filter(F.col("page") >= lo)
    if end not in (None, -1):
        out = out.filter(F.col("page") <= (end - 1) // size)
    item = F.col("page").cast("bigint") * size + F.col("page_pos") + 1
    out = out.withColumn("item", item).filter(F.col("item") >= start)
    return out if end in (None, -1) else out.filter(F.col("item") <= end)


# --- item predicates (true = keep) --------------------------------------------------------------

def _keep_null(pred: Column) -> Column:
    return F.coalesce(pred, F.lit(True))


def title_filter(match: str | None = None, reject: str | None = None, col: str = "title") -> Column:
    """Case-insensitive search in the title; items without one pass."""
    ok = F.lit(True)
    if match:
        ok = ok & _keep_null(F.col(col).rlike(f"(?i){match}"))
    if reject:
        ok = ok & _keep_null(~F.col(col).rlike(f"(?i){reject}"))
    return ok


def day_of(text: str | None, today: dt.date) -> dt.date | None:
    """A ``YYYYMMDD`` day or one told relative to ``today``; months count 30 days, years 365."""
    if text is None:
        return None
    if text in ("now", "today"):
        return today
    if text == "yesterday":
        return today - dt.timedelta(days=1)
    m = re.match(r"(?:now|today)([+-])(\d+)(day|week|month|year)s?", text)
    if m:
        days = int(m.group(2)) * {"day": 1, "week": 7, "month": 30, "year": 365}[m.group(3)]
        return today + dt.timedelta(days=days if m.group(1) == "+" else -days)
    return dt.datetime.strptime(text, "%Y%m%d").date()


def date_filter(lo: str | None = None, hi: str | None = None, today: dt.date | None = None, col: str = "upload_day") -> Column:
    """Upload day within an inclusive range; a missing day passes."""
    today = today or dt.date.today()
    lo_day, hi_day = day_of(lo, today), day_of(hi, today)
    if lo_day and hi_day and lo_day > hi_day:
        raise ValueError("date range is empty")
    ok = F.lit(True)
    if lo_day:
        ok = ok & (F.col(col) >= F.lit(lo_day))
    if hi_day:
        ok = ok & (F.col(col) <= F.lit(hi_day))
    return _keep_null(ok)


def view_filter(lo: int | None = None, hi: int | None = None, col: str = "view_count") -> Column:
    """View count bounds; missing passes."""
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (F.col(col) >= lo)
    if hi is not None:
        ok = ok & (F.col(col) <= hi)
    return _keep_null(ok)


def age_filter(age: int | None, col: str = "age_limit") -> Column:
    """Blocked only where the item's limit is above the viewer's."""
    return F.lit(True) if age is None else _keep_null(F.col(col) <= age)


def available(now: int, col: str = "available_at") -> Column:
    """False while the item's availability time lies in the future."""
    return _keep_null(F.col(col) <= now)


def archive_key(df: DataFrame) -> Column:
    """Archive id of an item, null where id or extractor is unknown."""
    names = [F.col(c) for c in ("extractor_key", "ie_key") if c in df.columns]
    key = F.coalesce(*[F.nullif(n, F.lit("")) for n in names])
    return F.when(F.col("id") != "", F.concat(F.lower(key), F.lit(" "), F.col("id")))


def skip_archived(df: DataFrame, archive: DataFrame) -> DataFrame:
    """Drop items already in the archive; items without a derivable id stay."""
    known = archive.select(F.trim("archive_id").alias("__a"))
    out = df.withColumn("__id", archive_key(df))
    return out.join(known, F.col("__id") == F.col("__a"), "left_anti").drop("__id")


# Powers for size suffixes of attribute bounds.
_POWERS = {c: i + 1 for i, c in enumerate("kmgtpezy")}


def size_value(text) -> float:
    """Number with an optional size suffix: ``k``, ``M``, ``G``… decimal, with ``i`` binary."""
    m = re.fullmatch(r"([0-9.]+)(?:([kKmMgGtTpPeEzZyY])(i?)[Bb]?)?", str(text))
    if not m:
        raise ValueError(f"bad number {text!r}")
    if not m.group(2):
        return float(text) if "." in str(text) else int(text)
    return int(float(m.group(1)) * (1024 if m.group(3) else 1000) ** _POWERS[m.group(2).lower()])


_OPS = {"<": Column.__lt__, "<=": Column.__le__, ">": Column.__gt__, ">=": Column.__ge__,
        "=": Column.__eq__, "!=": Column.__ne__}


def attr(df: DataFrame, name: str, op: str, value, or_null: bool = False) -> Column:
    """Comparison of an item attribute; strings allow only (in)equality; null rejects unless told otherwise."""
    is_text = dict(df.dtypes)[name] == "string"
    if is_text and op not in ("=", "!="):
        raise ValueError(f"operator {op} does not support strings")
    bound = F.lit(str(value)) if is_text else F.lit(size_value(value))
    return F.coalesce(_OPS[op](F.col(name), bound), F.lit(or_null))


def present(df: DataFrame, name: str) -> Column:
    """Attribute is there; a boolean must be true."""
    c = F.col(name)
    return c.eqNullSafe(F.lit(True)) if dict(df.dtypes)[name] == "boolean" else c.isNotNull()


def absent(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.eqNullSafe(F.lit(False)) if dict(df.dtypes)[name] == "boolean" else c.isNull()


def match(df: DataFrame, preds) -> DataFrame:
    """Keep items for which all predicates hold."""
    return df.filter(reduce(lambda a, b: a & b, preds))


REASONS = ("title does not match", "title rejected", "upload date out of range", "too few views", "too many views",
           "age restricted", "in archive", "attributes")


def reject_reason(df: DataFrame, archive: DataFrame | None = None, *, title=None, reject=None, dates=(None, None),
                  today=None, views=(None, None), age=None, preds=None) -> DataFrame:
    """Add ``reason``: the first rule, in fixed order, that an item fails, null if it is accepted."""
    out = df
    seen = F.lit(True)
    if archive is not None:
        known = archive.select(F.trim("archive_id").alias("__a")).distinct()
        out = df.withColumn("__id", archive_key(df)).join(known, F.col("__id") == F.col("__a"), "left")
        seen = F.col("__a").isNull()
    rules = [title_filter(match=title), title_filter(reject=reject), date_filter(*dates, today=today),
             view_filter(lo=views[0]), view_filter(hi=views[1]), age_filter(age), seen,
             reduce(lambda a, b: a & b, preds) if preds else F.lit(True)]
    chain = None
    for text, ok in zip(REASONS, rules):
        chain = F.when(~ok, F.lit(text)) if chain is None else chain.when(~ok, F.lit(text))
    return out.withColumn("reason", chain).drop("__id", "__a")


def audit(df: DataFrame, archive: DataFrame | None = None, by=(), **rules) -> DataFrame:
    """Counts per reason, and per further columns such as the playlist."""
    r = reject_reason(df, archive, **rules)
    return r.groupBy(*by, F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def filter_early(entries: DataFrame, archive: DataFrame | None = None, **rules) -> DataFrame:
    """Cheap rules on entry rows before their references are resolved; unknown values pass."""
    rules = {k: v for k, v in rules.items() if k != "preds"}
    return reject_reason(entries, archive, **rules).filter(F.col("reason").isNull()).drop("reason")


def filter_full(items: DataFrame, archive: DataFrame | None = None, **rules) -> DataFrame:
    """All rules, on resolved items."""
    return reject_reason(items, archive, **rules).filter(F.col("reason").isNull()).drop("reason")


# --- references ---------------------------------------------------------------------------------

_OWN = ("type", "url", "target", "id", "extractor", "extractor_key", "ie_key")


def resolve_refs(results: DataFrame, mode: str = "full") -> DataFrame:
    """Replace reference rows by what they point to, over chains of any length.

    ``results(url, type, target, ...)``: a ``url`` row becomes its target; a ``url_transparent`` row
    keeps its own non-null fields over the target's, also along chains. ``status`` tells ``resolved``,
    ``missing`` (no such target) or ``cycle`` (the chain never ends; the row stays as it is).
    ``mode='flat'`` leaves references alone; ``mode='flat_in_playlist'`` those with ``in_playlist``.

    The rows are told apart from the nodes that references lead to: one per url, of several rows with one url the first by their JSON text.
    So equal or conflicting rows each get their own answer, and as many rows come out as go in.
    Pointer doubling on the nodes: each round joins all open references with themselves and doubles the length of the chain that a
    node has taken in, so that the rounds grow with its logarithm. A chain longer than the number of references is a cycle.
    A third of all rows may point to one target; AQE splits that key of the join.
    """
    fields = [c for c in results.columns if c not in ("url", "type", "target", "in_playlist")]
    kept = [c for c in fields if c not in _OWN]
    is_ref = F.col("type").isin("url", "url_transparent")
    if mode == "flat":
        return results.withColumn("source", F.col("url")).withColumn("status", F.when(is_ref, "kept").otherwise("resolved"))
    hold = F.coalesce(F.col("in_playlist"), F.lit(False)) & is_ref if mode == "flat_in_playlist" else F.lit(False)
    own = ["source", "url", "type", "target", *fields]
    whole = results.withColumn("source", F.col("url"))
    done = [whole.filter(hold).select(*own, F.lit("kept").alias("status")),
            whole.filter(~is_ref).select(*own, F.lit("resolved").alias("status"))]
    row = F.struct("type", "target", *fields)
    nodes = cut(results.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min_by(row, F.to_json(row)).alias("n")))
    through = lambda type_: type_ == "url_transparent"
    values = lambda r: F.struct(*[r[c].alias(c) for c in kept]) if kept else F.struct(F.lit(0).alias("none"))

    def over(x, y):
        names = kept or ["none"]
        return F.struct(*[F.coalesce(x[c], y[c]).alias(c) for c in names])
    # A segment of a chain: where it ends, its last reference, whether a transparent one is in it, the fields from the first such one on, and all fields.
    n_ = F.col("n")
    refs = cut(nodes.filter(n_["type"].isin("url", "url_transparent")).select(
        F.col("url").alias("at"), n_["target"].alias("next"), F.col("url").alias("last"), through(n_["type"]).alias("thr"),
        F.when(through(n_["type"]), values(n_)).alias("top"), values(n_).alias("all")))
    n, span = refs.count(), 1
    while span <= n:
        far = refs.select(F.col("at").alias("f_at"), *[F.col(c).alias(f"f_{c}") for c in ("next", "last", "thr", "top", "all")])
        j = refs.join(far, refs["next"] == far["f_at"], "left")
        more = F.col("f_at").isNotNull()
        step = cut(j.select("at", F.when(more, F.col("f_next")).otherwise(F.col("next")).alias("next"), F.when(more, F.col("f_last")).otherwise(F.col("last")).alias("last"),
                            F.when(more, F.col("thr") | F.col("f_thr")).otherwise(F.col("thr")).alias("thr"),
                            F.when(~more, F.col("top")).when(F.col("thr"), over(F.col("top"), F.col("f_all"))).otherwise(F.col("f_top")).alias("top"),
                            F.when(more, over(F.col("all"), F.col("f_all"))).otherwise(F.col("all")).alias("all"), more.alias("open")))
        refs, span = step.drop("open"), span * 2
        if step.filter("open").isEmpty():
            break
    # Each row's own reference, then the chain of the node that it points to.
    mine = whole.filter(is_ref & ~hold).select("source", F.struct(*own[1:]).alias("self"))
    me, own_thr, more = F.col("self"), through(F.col("self.type")), F.col("at").isNotNull()
    ends = mine.join(refs, me["target"] == refs["at"], "left")
    ends = ends.select("source", "self", "last", F.when(more, F.col("next")).otherwise(me["target"]).alias("next"), (own_thr | F.coalesce("thr", F.lit(False))).alias("thr"),
                       F.when(own_thr, F.when(more, over(values(me), F.col("all"))).otherwise(values(me))).otherwise(F.col("top")).alias("top"))
    look = nodes.select(F.col("url").alias("t_url"), F.col("n").alias("t"))
    ends = ends.join(look, ends["next"] == look["t_url"], "left")
    # The last reference of a chain stands for a target that is missing.
    back = nodes.select(F.col("url").alias("l_url"), F.col("n").alias("l"))
    ends = ends.join(back, ends["last"] == back["l_url"], "left")
    found = F.col("t_url").isNotNull()
    loops = F.coalesce(F.col("t.type").isin("url", "url_transparent"), F.lit(False))
    last = lambda c: F.when(F.col("last").isNull(), me[c]).otherwise(F.col("l")[c])

    def field(c):
        end = F.when(found, F.col("t")[c]).otherwise(last(c))
        mixed = F.when(F.col("thr"), F.coalesce(F.col("top")[c], F.col("t")[c])).otherwise(end) if c in kept else end
        return F.when(loops, me[c]).otherwise(mixed).alias(c)
    kind = F.when(found, F.col("t.type")).when(F.col("thr"), F.lit("url_transparent")).otherwise(last("type"))
    done.append(ends.select(
        "source", F.when(loops, me["url"]).when(found, F.col("t_url")).otherwise(F.coalesce("last", me["url"])).alias("url"),
        F.when(loops, me["type"]).otherwise(kind).alias("type"),
        F.when(loops, me["target"]).when(found, F.col("t.target")).otherwise(last("target")).alias("target"), *[field(c) for c in fields],
        F.when(loops, F.lit("cycle")).when(found, F.lit("resolved")).otherwise(F.lit("missing")).alias("status")))
    return reduce(DataFrame.unionByName, done)


def expand_nested(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Items of playlists within playlists of any depth, each playlist expanded once per root, where a depth-first walk meets it first.

    ``edges(parent, pos, child)``, ``roots(root)``; a child that is no parent itself is an item. The walk's place of a
    playlist is the smallest path to it that visits no playlist twice; rounds improve the paths until none changes.
    Result: ``root, playlist, parent, level, path, pos, item``; ``path`` and ``pos`` give the order of the walk.
    """
    lists = edges.select(F.col("parent").alias("child")).distinct()
    tagged = edges.join(lists.withColumn("is_list", F.lit(True)), "child", "left")
    inner = tagged.filter("is_list").select(F.col("parent").alias("of"), "pos", F.col("child").alias("next"))
    front = roots.select("root", F.col("root").alias("playlist"), F.lit(None).cast("string").alias("parent"),
                         F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("path"), F.array("root").alias("nodes")).distinct()
    best = front = cut(front)
    while True:
        # A walk goes from the newest paths only; all others have been followed before.
        step = front.join(inner, front["playlist"] == inner["of"]).filter(~F.array_contains("nodes", F.col("next")))
        step = step.select("root", F.col("next").alias("playlist"), F.struct(F.concat("path", F.array(F.col("pos").cast("bigint"))).alias("path"),
                                                                             F.concat("nodes", F.array("next")).alias("nodes"), F.col("of").alias("parent")).alias("x"))
        step = step.groupBy("root", "playlist").agg(F.min("x").alias("x"))
        old = best.select("root", "playlist", F.struct("path", "nodes").alias("old"))
        step = step.join(old, ["root", "playlist"], "left").filter(F.col("old").isNull() | (F.struct("x.path", "x.nodes") < F.col("old")))
        front = cut(step.select("root", "playlist", "x.parent", "x.path", "x.nodes"))
        if front.isEmpty():
            break
        best = cut(best.join(front.select("root", "playlist"), ["root", "playlist"], "left_anti").unionByName(front))
    items = tagged.filter(F.col("is_list").isNull()).select(F.col("parent").alias("__p"), "pos", F.col("child").alias("item"))
    out = best.join(items, best["playlist"] == items["__p"])
    return out.select("root", "playlist", "parent", F.size("path").alias("level"), "path", "pos", "item")
