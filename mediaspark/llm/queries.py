"""One registered query per corpus operator, with SQL where SQL can express it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import configure

QUERIES: dict = {}
ORACLES: dict = {}

#: Rows in one batch sent to a Python worker; texts of 100 kB then make at most 50 MB.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    # Python workers find this package where the driver does, unless it was shipped or installed otherwise.
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark, sf_dir):
            return fn(prepare(spark), lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op2_filter_urls", sql=r"""
    WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    b AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS bare FROM u),
    h AS (SELECT page_id, regexp_extract(bare, '^[^/]*') AS host, bare FROM b),
    p AS (SELECT page_id, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 substr(bare, length(host) + 1) AS path FROM h),
    rules(rule, r_host, r_path, r_verdict, rank) AS (VALUES
        ('net/', 'net', '/', 'block', 1), ('example.net/en/', 'example.net', '/en/', 'allow', 2),
        ('example.com/de/', 'example.com', '/de/', 'block', 2), ('org/fr/', 'org', '/fr/', 'allow', 1)),
    m AS (SELECT page_id, host, path, (SELECT {'rule': rule, 'verdict': r_verdict} FROM rules
              WHERE (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
              ORDER BY rank DESC LIMIT 1) AS hit FROM p)
    SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, 'allow') AS verdict FROM m""")
def op2(spark, t) -> DataFrame:
    from .urlfilter import filter_urls
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return filter_urls(t("pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@query("op7_scan_secrets")
def op7(spark, t) -> DataFrame:
    from .secrets import scan_secrets
    found = scan_secrets(t("documents").select("doc_id", "text"), keep=["doc_id"], narrow=True)

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), "base_sha256", F.col("all_spans").alias("spans"))


@query("op8_quality_ledger", sql=r"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT id, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
    k AS (SELECT id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {'k': ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], 'i': i})) AS x FROM w),
    r AS (SELECT id, x.i AS i, count(*) OVER (PARTITION BY id, x.k) AS n FROM k),
    c AS (SELECT id, count(DISTINCT p) AS n_repeat_words FROM (SELECT id, unnest([i, i + 1, i + 2]) AS p FROM r WHERE n > 1) GROUP BY id),
    m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                 length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
                 length(t) - length(regexp_replace(t, '\p{L}', '', 'g')) AS n_letters FROM w LEFT JOIN c USING (id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 50 * n_lines OR 100 * n_upper > 50 * n_letters
                 OR (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words)) AS more_failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
           NOT (base_failed OR more_failed) AS kept FROM b""")
def op8(spark, t) -> DataFrame:
    from .rules import POLICIES, apply_policy, ledger, rejected
    book = apply_policy(ledger(t("documents").select("doc_id", "text")))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       rejected(POLICIES["base"]).alias("base_failed"), "kept")


@query("op6_token_files")
def op6(spark, t) -> DataFrame:
    from ..session import scratch_path
    from .tokens import vocabulary_path, write_tokens
    folder = write_tokens(t("documents"), scratch_path(spark, "tokens"), vocabulary_path())
    return starts_from_files(spark, folder)


def starts_from_files(spark, folder) -> DataFrame:
    from ..session import cut
    from .tokens import checksums, read_tokens, with_starts
    rows = cut(checksums(read_tokens(spark, folder)))
    return with_starts(rows).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op10_length_histogram")
def op10(spark, t) -> DataFrame:
    from .lengths import histogram, suffix_sums
    from .tokens import vocabulary_path
    from ..session import cut
    return suffix_sums(cut(histogram(t("documents").select("text"), vocabulary_path())))


@query("op3_mix_sources", sql=r"""
    WITH d AS (SELECT doc_id, source, coalesce(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')), 0)::BIGINT AS size,
                      md5(coalesce(doc_id::VARCHAR, '')) AS h, row_number() OVER () AS id FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM d GROUP BY source),
    w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(s - 1) % 3 + 1] AS w, source_size * 2.0::DOUBLE AS cap,
                 (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget FROM s),
    l AS (SELECT *, row_number() OVER (ORDER BY cap / w, s) AS s_level,
                 budget - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                 sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM w),
    f AS (SELECT s_level AS f_level, rest AS f_rest, w_rest AS f_w FROM l WHERE rest * w < cap * w_rest ORDER BY s_level LIMIT 1),
    g AS (SELECT s, source, source_size, budget, CASE WHEN s_level >= f_level THEN f_rest * w / f_w ELSE cap END AS target
          FROM l LEFT JOIN f ON true),
    q AS (SELECT id, doc_id, size, h, g.*, (sum(size) OVER (PARTITION BY s ORDER BY h, doc_id, size, id ROWS UNBOUNDED PRECEDING))::BIGINT AS upto
          FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
    c AS (SELECT *, (upto + lap * source_size)::DOUBLE / target AS finish FROM q, (VALUES (0), (1)) AS laps(lap) WHERE target > 0),
    t AS (SELECT finish, sum(sum(size)) OVER (ORDER BY finish) AS upto, max(max(budget)) OVER () AS budget FROM c GROUP BY finish),
    e AS (SELECT max(finish) AS stop FROM t WHERE upto <= budget),
    n AS (SELECT id, count(*) AS copies FROM c, e WHERE finish <= stop GROUP BY ALL)
    SELECT q.doc_id, q.size, source_size, target, (q.size * coalesce(copies, 0))::BIGINT AS taken
    FROM q LEFT JOIN n ON q.id = n.id""")
def op3(spark, t) -> DataFrame:
    from .mixing import mix
    return mix(t("documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op4_shard")
def op4(spark, t) -> DataFrame:
    from .sharding import shard
    return shard(t("documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op1_ngram_jaccard", sql=r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
            WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
    g AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
    p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
    e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r(x, y) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
    SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.g)""")
def op1(spark, t) -> DataFrame:
    from .jaccard import join
    return join(t("documents"), width=3, percent=90).select("doc_id", "n_shingles", "component_id")


@query("op5_decontaminate")
def op5(spark, t) -> DataFrame:
    from .decontam import contaminated
    return contaminated(t("documents"), t("benchmark"), shared=True).select("doc_id", "item_id", "n_windows", "n_tokens", "covered", "exact")


@query("op9_quality_score")
def op9(spark, t) -> DataFrame:
    from .classifier import THRESHOLD, fit, fold, score
    docs = t("documents").select("doc_id", "text")
    scored = score(docs, *fit(docs, t("labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op11_line_dedup", sql=r"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
    s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    g AS (SELECT k.*, s.key IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS goes FROM k LEFT JOIN s ON k.key = s.key)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE goes)::BIGINT AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256 FROM g GROUP BY id, doc_id""")
def op11(spark, t) -> DataFrame:
    from .linededup import dedup_lines
    return dedup_lines(t("documents").select("doc_id", "text"), keep=["doc_id"]).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


@query("op12_filter_audit", sql=r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
    e AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
    f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
                 + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t))::INT
                 + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(least < doc_id, false)::INT AS mask FROM w JOIN e USING (t)),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
    x(a) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
    o AS (SELECT a.a || b.a || c.a || d.a || e.a AS filter_order FROM x a, x b, x c, x d, x e
          WHERE a.a <> b.a AND a.a <> c.a AND a.a <> d.a AND a.a <> e.a AND b.a <> c.a AND b.a <> d.a AND b.a <> e.a AND c.a <> d.a AND c.a <> e.a AND d.a <> e.a),
    s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, 1 << (instr('ABCDE', substr(filter_order, step, 1)) - 1) AS bit,
                 list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', substr(filter_order, i, 1)) - 1))) AS before
          FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
    r AS (SELECT part, filter_order, step, letter,
                 sum(CASE WHEN mask & (coalesce(before, 0)::BIGINT | bit) = 0 THEN n ELSE 0 END) AS kept,
                 sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN n ELSE 0 END) AS removed,
                 sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::BIGINT <> 0 THEN n ELSE 0 END) AS redundant,
                 sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
                 sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN good ELSE 0 END) AS good_lost,
                 sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN toxic ELSE 0 END) AS toxic_lost
          FROM c, s GROUP BY ALL)
    SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r""")
def op12(spark, t) -> DataFrame:
    from .audit import interactions
    return interactions(t("documents"), t("labels"))


@query("op13_periodic_runs")
def op13(spark, t) -> DataFrame:
    from .periodic import periodic_runs, planted
    return periodic_runs(planted(t("documents").select("doc_id", "text")), keep=["doc_id"]).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
