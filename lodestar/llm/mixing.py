"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions.

DataFrame functions only. Sizes are counted once; what follows works on three narrow columns. The fractional part of a
source is a seeded order of its documents, cut where the target is reached; the order is dealt into 4096 buckets by its
leading digits, so that a source with a third of all rows is summed by many tasks and no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .runtime import cut

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
SEED = "17"
#: hexadecimal digits that name a bucket
DIGITS = 3


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size and the seeded order `h`, one row for each row of docs; a null text has size 0."""
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("s"),
        F.col(source).isNull().alias("none"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).alias("h"),
    )


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """s, none, source_size, target: the water level that fills the total with each source at its weight or its cap.

    One row a source is ordered in one task: the table has as many rows as there are sources.
    """
    by_name = W.orderBy("none", "s")
    t = sizes.withColumn("w", (F.row_number().over(by_name) - 1) % 3 + 1)
    t = t.withColumn("cap", F.lit(cap) * F.col("source_size"))
    up = W.orderBy(F.col("cap") / F.col("w"), "none", "s")
    t = t.withColumn("capped", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("rest", F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)))
    t = t.withColumn("total", F.sum("source_size").over(W.partitionBy()))
    t = t.withColumn("level", (F.col("total") - F.col("capped")).cast("double") / F.col("rest").cast("double"))
    t = t.withColumn("level", F.first(F.when(F.col("cap").cast("double") >= F.col("level") * F.col("w"), F.col("level")), ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    filled = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return t.select("s", "none", "source_size", filled.alias("target"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs.

    Size counts `[^\\x20\\x09-\\x0D]+`; a null text is 0. Sources in code-point order, null last, weigh 1, 2, 3,
    repeating. taken is whole repetitions of the document, and one more for those first in the seeded order until the
    source's target is met; the last of them gives only the words that are missing. Sums are therefore within one word
    of the target. Repeated rows are documents of their own; rows alike in id and size are interchangeable. A null id
    is ordered as the empty string. An empty table gives no rows; other columns are not read.
    """
    rows = cut(sized(docs, doc_id, text, source, seed).withColumn("bucket", F.substring("h", 1, DIGITS)))
    part = rows.groupBy("s", "none", "bucket").agg(F.sum("size").alias("part"))
    sizes = part.groupBy("s", "none").agg(F.sum("part").alias("source_size"))
    part = part.withColumn("ahead", F.sum("part").over(W.partitionBy("s", "none").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("part"))
    goal = targets(sizes, cap)
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("more", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + F.lit(0.5)).cast("long"))
    part = part.join(goal, ["s", "none"])
    within = W.partitionBy("s", "none", "bucket").orderBy("h", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    got = rows.withColumn("before", F.sum("size").over(within) - F.col("size")).join(part, ["s", "none", "bucket"])
    extra = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("more") - F.col("ahead") - F.col("before")))
    return got.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS none,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat('17:', coalesce(doc_id::VARCHAR, ''))) AS h
  FROM documents),
t AS (SELECT s, none, sum(size)::BIGINT AS source_size FROM d GROUP BY s, none),
w AS (SELECT *, (row_number() OVER (ORDER BY none, s) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM t),
u AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, none, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, none, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         sum(source_size) OVER () AS total
  FROM w),
l AS (SELECT *, (total - capped)::DOUBLE / rest::DOUBLE AS level FROM u),
f AS (SELECT level FROM l WHERE cap::DOUBLE >= level * w ORDER BY cap::DOUBLE / w, none, s LIMIT 1),
g AS (SELECT s, none, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM f) * w, cap::DOUBLE)) AS target FROM l),
n AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM g),
m AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS more FROM n),
o AS (SELECT *, sum(size) OVER (PARTITION BY s, none ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before FROM d)
SELECT o.doc_id, o.size, m.source_size, m.target,
       (m.whole * o.size + least(o.size, greatest(0, m.more - o.before)))::BIGINT AS taken
FROM o JOIN m ON o.s = m.s AND o.none = m.none
"""
