"""What every operator here needs from the session: shared checkpoint folder, lineage cuts, shuffle width."""

from __future__ import annotations

import ctypes
import gc
import tempfile

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

from ..plans.stage import checkpointed


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset and the session is local."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if known:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(known)
        return known
    at = sc._jsc.sc().getCheckpointDir()
    if not at.isDefined():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-checkpoint-"))
        at = sc._jsc.sc().getCheckpointDir()
    return at.get()


def cut(df: DataFrame, *past: DataFrame) -> DataFrame:
    """Run df once and cut its lineage by a reliable checkpoint in the shared folder. past: earlier cuts that nothing
    needs any more; their files go. Shuffle files of earlier steps go when the driver's garbage is collected, so that is
    asked for before more are written."""
    shared_dir(df.sparkSession)
    tidied(df.sparkSession)
    done = checkpointed(df)
    for p in past:
        forget(p)
    return done


def tidied(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that shuffle files of what nothing refers to any more go, and give memory back."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()
    give_back_jvm(spark)


def forget(past: DataFrame) -> None:
    """Delete the files of a cut that nothing needs any more."""
    plan = past._jdf.queryExecution().logical()
    if plan.nodeName() == "LogicalRDD" or plan.getClass().getSimpleName() == "LogicalRDD":
        at = plan.rdd().getCheckpointFile()
        if at.isDefined():
            remove(past.sparkSession, at.get())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def give_back() -> None:
    """Give this process's freed memory back to the system."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def give_back_jvm(spark: SparkSession) -> bool:
    """Give what the driver's JVM has freed outside its heap back to the system: the hundreds of threads that plan and send
    tasks leave it in as many arenas. False where the JVM has no such command."""
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # the server's own class is closed to Py4J, so its interface is asked for the method
        of, types, given = jvm.java.lang.Class.forName, new(jvm.java.lang.Class, 4), new(jvm.java.lang.Object, 4)
        for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            types[k] = of(name)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        of("javax.management.MBeanServerConnection").getMethod("invoke", types).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:
        return False
    return True


def tidy(run):
    """An Arrow batch function that gives freed memory back to the system when it ends: workers stay for later stages."""

    def tidied(source):
        try:
            yield from run(source)
        finally:
            give_back()

    return tidied
