"""A bounded sample of labelled documents, for fitting; everything else here covers all data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 12_000


def fold(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text, label) of at most `rows` labelled documents for which `train` holds: those of the smallest id hashes.

    Only ids and labels are gathered, at most `rows` of them, and broadcast; texts stay where they are read.
    An id that is labelled twice takes its larger label; null ids and labels don't count.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & train).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    picked = chosen.orderBy(F.xxhash64(doc_id), doc_id).limit(rows).collect()
    spark = docs.sparkSession
    small = spark.createDataFrame([(int(r[0]), int(r[1])) for r in picked], "picked_id long, label int")
    return docs.select(F.col(doc_id).cast("long").alias("picked_id"), F.col(text).alias("text")).join(F.broadcast(small), "picked_id").select("text", "label")
