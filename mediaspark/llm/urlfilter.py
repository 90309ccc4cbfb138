"""Allow and block lists for URLs: a trie over reversed host labels and then path segments.

Rules are rows ``(rule, verdict)``; ``rule`` is a host, a slash and an optional start of a path
(``example.org/fr/``), ``verdict`` is ``allow`` or ``block``. A rule fits its host and all hosts below it
if the URL's path starts with the rule's path. The longest rule wins: most host labels first, then the
longest path; of two equal rules ``block`` wins.

Up to ``MAX_BROADCAST_RULES`` rules (checked before anything is sent) the trie is broadcast and no URL is
shuffled. Longer lists are joined by hash on (host suffix, first path segment), with the same answers.

Defined results: a null URL and one without ``://`` have an empty host and an empty path and match nothing;
URLs without a rule get ``default``. Repeated URLs get equal answers; other columns pass through; columns
named like the results are replaced. An empty table of rules gives ``default`` everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .text import extended

MAX_BROADCAST_RULES = 200_000
MAX_RULE_CHARS = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to ``?``, ``#`` or the end."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    bare = F.regexp_extract(rest, r"^[^?#]*", 0)
    host = F.regexp_extract(bare, r"^[^/]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.substr(bare, F.length(host) + 1)


class Trie:
    """Host labels from the right, then path segments with their slashes; ends hold (rule, verdict)."""

    def __init__(self, rules):
        self.root: dict = {}
        for rule, verdict in rules:
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(("host", label), {})
            *whole, rest = f"{slash}{path}".split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            ends = node.setdefault("ends", {})  # by an unfinished last segment, often empty
            if rest not in ends or verdict == "block":
                ends[rest] = (rule, verdict)

    @staticmethod
    def _on_path(node: dict, segments: list[str]):
        """The longest path rule below a host's node."""
        best = None
        for i, segment in enumerate(segments):
            ends = node.get("ends")
            if ends:
                fit = [rest for rest in ends if segment.startswith(rest)]
                if fit:
                    best = ends[max(fit, key=len)]
            node = node.get(("path", segment)) if i + 1 < len(segments) else None
            if node is None:
                break
        return best

    def find(self, host: str, path: str):
        """(rule, verdict) of the longest rule that fits, or None."""
        node, best, segments = self.root, None, path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._on_path(node, segments) or best
        return best


def _by_trie(df: DataFrame, rules: list) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(Trie(rules))
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            found = [trie.find(h, p) if h else None for h, p in zip(hosts, paths)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([x and x[0] for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.string())],
                [*b.schema.names, "rule", "verdict"])

    return df.mapInArrow(look, extended(df, df.columns, "rule string, verdict string"))


def _by_join(df: DataFrame, rules: DataFrame) -> DataFrame:
    """The same through a hash join: each URL offers its host's suffixes with its first path segment and without."""
    split = F.locate("/", "rule")
    path = F.when(split > 0, F.substr(F.col("rule"), split)).otherwise(F.lit(""))
    keyed = rules.select("rule", "verdict", F.when(split > 0, F.substring_index("rule", "/", 1)).otherwise(F.col("rule")).alias("r_host"),
                         path.alias("r_path"))
    # Rules that name a whole first segment are looked up by it; the few others by the host alone.
    seg = F.regexp_extract("r_path", r"^/[^/]*/", 0)
    keyed = keyed.withColumn("r_key", F.concat_ws("\n", "r_host", seg)).dropDuplicates(["rule", "verdict"])
    urls = df.select("host", "path").filter(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.regexp_extract("path", r"^/[^/]*/", 0)
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.array(F.concat_ws("\n", s, F.lit("")), F.concat_ws("\n", s, own)))))
    hit = (urls.select("host", "path", F.explode(keys).alias("r_key")).join(keyed, "r_key")
           .filter(F.startswith("path", "r_path")))
    order = F.struct(F.size(F.split("r_host", r"\.")), F.length("r_path"), (F.col("verdict") == "block").cast("int"))
    best = hit.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("b"))
    return df.join(best, ["host", "path"], "left").select(*df.columns, "b.rule", "b.verdict")


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
                max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to each row."""
    host, path = host_and_path(F.col(url))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    df = df.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rules = rules.filter(F.col("rule").isNotNull() & F.col("verdict").isin("allow", "block")).select("rule", "verdict")
    fits = rules.filter(F.length("rule") <= MAX_RULE_CHARS).limit(max_broadcast + 1).collect()
    small = len(fits) <= max_broadcast and rules.filter(F.length("rule") > MAX_RULE_CHARS).limit(1).count() == 0
    out = _by_trie(df, [tuple(r) for r in fits]) if small else _by_join(df, rules)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
