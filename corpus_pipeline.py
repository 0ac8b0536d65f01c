"""Corpus cleaning pipeline: quality, line deduplication, near-duplicate documents, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents; n_chars follows the text. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, labelled, line_dedup, mixing, ngram_join, prefilter, quality, runtime


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars brought up to date, where there is such a column."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is fitted on labelled documents outside the held-out fold."""
    train = F.coalesce(labelled.fold("doc_id", 5) != 0, F.lit(False))
    sample = labelled.labelled_sample(docs, _table(spark, sf_dir, "labels"), "quality", train)
    return quality.keep_good(docs, quality.fit_quality(sample))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks leave the later document; a document that has nothing but blanks left goes."""
    found = line_dedup.dedup_lines(docs)
    return _counted(found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group stays, once. Rows of a null id stay, as do rows without words; rows
    that repeat an id with another text are told apart by their sets; of those that are one group the smallest row stays."""
    groups = runtime.cut(ngram_join.ngram_groups(docs))
    again = runtime.cut(groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    gone = groups.where("doc_id != component_id").select("doc_id")
    if not again.limit(1).count():
        return prefilter.without_ids(docs, "doc_id", gone, "doc_id")
    kept = prefilter.without_ids(docs, "doc_id", gone.union(again).distinct(), "doc_id")
    first = groups.where("doc_id = component_id").select(F.col("doc_id").alias("__id"), F.col("set_key").alias("__set"), F.col("group").alias("__group")).distinct()
    keyed = ngram_join.with_key(docs.join(again, "doc_id", "left_semi"), key="__key")
    keyed = keyed.join(first, (F.col("doc_id") == F.col("__id")) & F.col("__key").eqNullSafe(F.col("__set")))
    once = keyed.where("__key is not null").groupBy("doc_id", "__group").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return kept.unionByName(once).unionByName(keyed.where("__key is null").select(docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Hit words leave the text; a document that was hit and has nothing but blanks left goes."""
    found = decontaminate.without_runs(decontaminate.contamination(docs, _table(spark, sf_dir, "benchmark")))
    return _counted(found.where((F.size("runs") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", source_mixing),
]

#: the first stages cannot be told in SQL; tests hold them against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote goes when the next has read it."""
    docs = _table(spark, sf_dir, "documents")
    at = f"{runtime.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
        if k:
            runtime.remove(spark, f"{at}/{k - 1}")
    return docs
