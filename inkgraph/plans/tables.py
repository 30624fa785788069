"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is empty and Spark runs on this machine alone is a folder of our own made.
    """
    named = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError(f"{SETTING} must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="inkgraph-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def give_back(spark: SparkSession) -> bool:
    """Whether the driver's JVM could give the native memory it has freed back to the machine.

    Each of its some hundred threads leaves freed memory in one of the allocator's arenas, which keep it
    unless they are asked. Not every JVM can be asked.
    """
    sc = spark.sparkContext
    try:
        # By reflection: the server's own class is not open to calls from outside.
        ask = next(m for m in sc._jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = sc._gateway.new_array(sc._jvm.java.lang.Object, 4)
        args[0], args[1] = sc._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        ask.invoke(sc._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return False
    return True


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


class Scratch:
    """Tables written for one run of an operator; ``drop`` removes those no longer read."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        # By application, so that what an ended one has left can be removed.
        self.base = f"{shared_dir(spark)}/inkgraph/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.base}/{self._n:03d}-{label}"

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        """Write ``df`` once as Parquet and return the written table (lineage ends there)."""
        return self.keep_at(df, label)[0]

    def keep_at(self, df: DataFrame, label: str) -> tuple[DataFrame, str]:
        at = self.path(label)
        schema = df.schema
        df.write.option("compression", "zstd").parquet(at)
        give_back(self.spark)
        return self.spark.read.schema(schema).parquet(at), at

    def drop(self, *paths: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            at = jvm.org.apache.hadoop.fs.Path(p)
            at.getFileSystem(conf).delete(at, True)
