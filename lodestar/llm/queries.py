"""The registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, mixing, url_filter
from .embedding_dedup import near_duplicates
from .language_model import score_language
from .line_dedup import dedup_lines
from .ngram_join import ngram_components
from .quality import quality
from .substring_dedup import remove_repeats
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "partner_ids", "text")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_line_dedup": op3_line_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_source_mixing": op6_source_mixing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_toxicity": op10_toxicity,
}

_GROUPS = """reach AS (SELECT rn, rn AS far FROM {rows} UNION SELECT reach.rn, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = reach.far),
groups AS (SELECT reach.rn, min({id}) AS component_id FROM reach JOIN {rows} r ON r.rn = reach.far GROUP BY reach.rn)"""

EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS rn, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS MATERIALIZED (SELECT rn, label, e, sqrt(list_dot_product(e, e)) AS size FROM v
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.rn AS a, b.rn AS b FROM u a JOIN u b ON a.label = b.label AND a.rn < b.rn AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / a.size / b.size >= 0.98),
counts AS (SELECT rn, count(*) AS n FROM (SELECT a AS rn FROM links UNION ALL SELECT b FROM links) GROUP BY rn),
{_GROUPS.format(rows="v", id="vec_id")}
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept FROM v LEFT JOIN counts USING (rn) LEFT JOIN groups USING (rn)"""

NGRAM_SQL = rf"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
d AS MATERIALIZED (SELECT rn, doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
x AS MATERIALIZED (SELECT rn, unnest(s) AS x FROM d),
common AS (SELECT p.rn AS a, q.rn AS b, count(*) AS k FROM x p JOIN x q ON p.x = q.x AND p.rn < q.rn GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common JOIN d p ON p.rn = a JOIN d q ON q.rn = b WHERE 100 * k >= 75 * (len(p.s) + len(q.s) - k)),
{_GROUPS.format(rows="d", id="doc_id")}
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM d LEFT JOIN groups USING (rn)"""

SQL: dict[str, str] = {
    "op2_embedding_near_dedup": EMBEDDINGS_SQL,
    "op4_ngram_jaccard_join": NGRAM_SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_source_mixing": mixing.SQL,
    "op9_benchmark_decontamination": decontaminate.SQL,
}
