"""An extension: alignment of a stream of answers, and rolling groundedness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import api
from ..config import CitationConfig


def align_stream(answers: DataFrame, sources: DataFrame, passages: DataFrame, path: str, checkpoint: str, config: CitationConfig | None = None):
    """Start a query that writes the metrics of each micro-batch of answers (query_id, corpus_id, answer, ts) as Parquet,
    partitioned by batch so that a repeated batch replaces itself. passages: api.prepare_passages() of the corpus, whose
    frequencies stay fixed while the stream runs."""

    def each(batch: DataFrame, number: int) -> None:
        cited = api.align_citations(batch, sources, config, passages=passages)
        found = api.compute_hallucination_metrics(cited, batch).drop("span_confidences", "unsupported_spans", "weakly_supported_spans")
        found.join(batch.select("query_id", "ts"), "query_id").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return answers.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()


def rolling_groundedness(metrics: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Mean groundedness and counts of a stream of metrics (ts, groundedness_score, num_spans) by windows of event time;
    rows later than the watermark are dropped."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return metrics.withWatermark("ts", late).groupBy(window).agg(F.avg("groundedness_score").alias("groundedness_score"), F.sum("num_spans").alias("num_spans"), F.count("*").alias("answers"))
