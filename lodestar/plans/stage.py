"""Derived tables that several later steps read: computed once, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def materialised(df: DataFrame) -> DataFrame:
    """df, run once; its lineage ends in a reliable checkpoint in spark.checkpoint.dir (a fresh folder where unset and
    the session is local; on a cluster it must be set)."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if at is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
    return checkpointed(df)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, run once, as a reliable checkpoint that doesn't inherit the estimate of its size. Spark takes the size of a join for
    the product of its sides', so that over rounds that read each other's checkpoints the estimate's digits multiply until
    they fill the driver. A checkpoint of unknown size counts as one too large to broadcast; what runs is measured."""
    done = df.checkpoint(eager=True)
    spark, session, plan = df.sparkSession, done._jdf.sparkSession(), done._jdf.queryExecution().logical()
    none = spark._jvm.scala.Option.empty()
    bare = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), session, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, bare), spark)
