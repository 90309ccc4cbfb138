"""Input tables of the registered queries, derived from the given data by portable SQL.

The same text serves Spark and the SQL counterparts. ``pos`` is the original order inside an item:
a number computed per row (no shuffle), unique within the item, not dense.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
       "embeddings", "pages", "benchmark", "labels", "conversations")

SQL = {
    "formats": """
SELECT l_orderkey AS media_id,
  ((((CAST(l_linenumber AS BIGINT) % 8) * 64 + CAST(l_quantity AS BIGINT) % 64) * 65536
    + (year(l_shipdate) % 128) * 512 + dayofyear(l_shipdate)) * 65536 + l_suppkey % 65536) * 4194304
    + l_partkey % 4194304 AS pos,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('f', l_linenumber) END AS format_id,
  concat('https://cdn.example.com/', l_orderkey, '/', l_partkey % 5, '.bin') AS url,
  CASE l_suppkey % 4 WHEN 0 THEN 'mp4' WHEN 1 THEN 'webm' WHEN 2 THEN 'flv' ELSE 'm4a' END AS ext,
  CASE WHEN l_returnflag = 'A' THEN 'none' WHEN l_linestatus = 'F' THEN 'avc1.4d401f' END AS vcodec,
  CASE WHEN l_returnflag = 'R' THEN 'none' WHEN l_linestatus = 'O' THEN 'mp4a.40.2' END AS acodec,
  CASE WHEN l_quantity >= 5 THEN l_extendedprice / 10 END AS tbr,
  CAST(CASE l_partkey % 6 WHEN 0 THEN 144 WHEN 1 THEN 240 WHEN 2 THEN 360 WHEN 3 THEN 720 WHEN 4 THEN 1080 END AS INT) AS height,
  CASE WHEN l_tax <= 0.06 THEN CAST(floor(l_extendedprice * 1000) AS BIGINT) END AS filesize,
  CASE l_suppkey % 5 WHEN 0 THEN 'm3u8' WHEN 1 THEN 'http' WHEN 2 THEN 'rtsp' ELSE 'https' END AS protocol,
  CASE WHEN l_discount > 0.08 THEN l_linenumber - 3 END AS preference
FROM {lineitem}""",
    "media": """
SELECT o_orderkey AS media_id, concat('Site', o_orderkey % 25) AS extractor_key, CAST(o_orderkey AS VARCHAR(20)) AS id,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE concat(o_orderpriority, ' clip ', o_orderkey) END AS title,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS view_count,
  CAST(o_orderdate AS DATE) AS upload_day,
  CAST(CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 18 WHEN '2' THEN 12 WHEN '3' THEN 0 END AS INT) AS age_limit,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderkey % 50 = 0 END AS is_live
FROM {orders}""",
    "playlist_entries": """
SELECT o_custkey AS playlist_id,
  (CAST(year(o_orderdate) AS BIGINT) * 512 + dayofyear(o_orderdate)) * 1099511627776 + o_orderkey AS pos,
  o_orderkey AS media_id FROM {orders}""",
    "archive": """
SELECT concat(lower(concat('Site', o_orderkey % 25)), ' ', o_orderkey) AS archive_id
FROM {orders} WHERE o_orderstatus = 'F'""",
    "progress": """
SELECT event_id, ts, concat('file', user_id) AS file,
  CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'finished' ELSE 'downloading' END AS status,
  CAST(floor(value * 1000) AS BIGINT) AS bytes FROM {events}""",
}


def define(name: str, sql: str) -> None:
    """Add a derived table that other derived tables and queries may name as ``{name}``; a second table of one name is an error."""
    if SQL.setdefault(name, sql) != sql:
        raise ValueError(f"derived table {name} is defined twice")


def _needs(sql: str):
    return [n for n in dict.fromkeys(re.findall(r"\{(\w+)\}", sql)) if n in RAW or n in SQL]


class Tables:
    """The tables of one data folder: raw parquet by name, or derived ones by their SQL."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        if name in RAW:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.sql(SQL[name])

    def sql(self, text: str) -> DataFrame:
        names = _needs(text)
        # Braces that do not name a table are doubled, as the formatter of spark.sql wants it.
        marked = re.sub(r"\{(\w+)\}|[{}]", lambda m: m.group(0) if m.group(1) in names else
                        m.group(0).replace("{", "{{").replace("}", "}}"), text)
        return self.spark.sql(marked, **{n: self[n] for n in names})


def oracle(body: str) -> str:
    """DuckDB text of ``body``: derived tables named as ``{name}`` become common table expressions."""
    done: dict[str, str] = {}

    def visit(sql):
        for n in _needs(sql):
            if n in SQL and n not in done:
                visit(SQL[n])
                done[n] = SQL[n]
    visit(body)
    plain = lambda s: re.sub(r"\{(\w+)\}", lambda m: m.group(1) if m.group(1) in RAW or m.group(1) in SQL else m.group(0), s)
    head = ",\n".join(f"{n} AS ({plain(s)})" for n, s in done.items())
    body = plain(body).strip()
    if not head:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"
