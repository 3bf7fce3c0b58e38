"""A corpus pipeline of five stages; each takes all its predecessor kept and is written and read again before the next.

Rows are documents. A null doc_id names no document: such rows are told apart by their text. Null and empty texts pass the stages
that look at texts only if the classifier keeps them, and the mix, which takes words, takes none of them. Extra columns of any name come
through all stages; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queuelens.llm import decontam, mixture, ngram_join, ordinal, sharding
from queuelens.llm.common import keep


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the ordinal classifier rejects go. Rows that repeat a text are judged alike."""
    model = ordinal.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return ordinal.select_good(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays, in one row.

    Rows with a null doc_id take part under ids drawn from their texts, above all others. Of rows that repeat a doc_id the one whose
    text has the smallest hash stays.
    """
    text = F.col("text").cast("string")
    own = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62)))
    named = docs.select(own.alias("doc_id"), text.alias("text"))
    gone = ngram_join.ngram_join(named).filter("component_id <> doc_id").select(F.col("doc_id").alias("__ql_doc")).distinct()
    rows = docs.withColumn("__ql_id", own)
    kept = rows.join(gone, F.col("__ql_id") == F.col("__ql_doc"), "left_anti")
    twice = keep(named.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("__ql_twice")), "twice")
    if twice.isEmpty():
        return kept.drop("__ql_id")
    first = Window.partitionBy("__ql_id").orderBy(F.xxhash64("text"), "text")
    again = kept.join(twice, F.col("__ql_id") == F.col("__ql_twice"), "left_semi").withColumn("__ql_n", F.row_number().over(first)).filter("__ql_n = 1")
    return kept.join(twice, F.col("__ql_id") == F.col("__ql_twice"), "left_anti").drop("__ql_id").unionByName(again.drop("__ql_id", "__ql_n"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go. A benchmark without items takes none."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time a document is taken. Rows lie by the shards of the splitting tree, shuffled within each."""
    return mixture.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and its bytes; columns of these names that came with the documents are replaced."""
    out = sharding.shards(docs)
    names = [c for c in docs.columns if c.lower() not in ("shard", "shard_bytes")]
    return out.select(*[F.col(f"`{c}`") for c in names], F.col("__ql_shard").alias("shard"), F.col("__ql_shard_bytes").alias("shard_bytes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixture", source_mixture),
    ("sharding", sharded),
]

#: SQL can't express the fitted classifier; tests/llm hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
