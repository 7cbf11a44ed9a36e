"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; only where it is unset (one machine, tests) a folder of our own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    one_machine = context.master.startswith("local") and not context.master.startswith("local-cluster")
    if not named and not context.getCheckpointDir() and not one_machine:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named or f"file://{tempfile.mkdtemp(prefix='veriloom-')}")
    path = (named or context.getCheckpointDir()).rstrip("/")
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path


def fresh(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, with copies that survive the loss of executors."""
    folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that nothing refers to any more; else they stay until the driver happens to collect its garbage.
    What the driver's JVM has freed outside its heap (compilers, codecs, buffers) goes back to the system: the C library keeps it else."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim(spark)


def _trim(spark: SparkSession) -> bool:
    """Whether the JVM could be asked to give freed native memory back; some have no such command, and lose nothing but that."""
    gateway = spark.sparkContext._gateway
    jvm = gateway.jvm
    named = jvm.java.lang.Class.forName
    try:
        kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface's method: the server's own class isn't open to reflection
        named("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return False
    return True


def table(df: DataFrame, name: str) -> DataFrame:
    """Write as a compressed Parquet table under the shared folder and read that: like cut(), but smaller, and by column."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that table() wrote, once nothing that is still to be computed reads them."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.table_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
