"""A training corpus from ``documents``, stage by stage.

Every stage takes the Parquet table that the one before wrote, in the shared scratch folder, and returns rows with the columns of
``documents``; the last returns the digest of the token files that it wrote. Each is one of the operators in
``mediaspark.llm`` with production parameters, and works on all rows that its predecessor kept.

1. ``quality_rules``: documents that the production policy rejects go.
2. ``ngram_jaccard``: of each group of documents linked by five-word shingles with a similarity of 0.8, the smallest id stays.
3. ``decontaminate``: documents that hold a benchmark item, also with other numbers, names or units, go.
4. ``mix_sources``: each document stays as often as the mix takes it, up to two times.
5. ``token_files``: ids of all texts as ORC files in order of ``doc_id``, read back for their counts and checksums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaspark.llm.decontam import clean
from mediaspark.llm.jaccard import keep_one
from mediaspark.llm.mixing import mixed
from mediaspark.llm.ordered import saved
from mediaspark.llm.queries import prepare, starts_from_files
from mediaspark.llm.rules import apply_policy, ledger
from mediaspark.llm.tokens import vocabulary_path, write_tokens
from mediaspark.session import scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    book = apply_policy(ledger(docs.select(F.struct(*docs.columns).alias("__row"), "text")))
    return book.filter("kept").select("__row.*")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return keep_one(docs, width=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shared=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return starts_from_files(spark, write_tokens(docs, scratch_path(spark, "tokens"), vocabulary_path()))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("decontaminate", decontaminate),
          ("mix_sources", mix_sources), ("token_files", token_files)]

#: SQL cannot encode tokens; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
