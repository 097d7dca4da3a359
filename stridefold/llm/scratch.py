"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``; a lost
executor then costs only its running tasks. Where the setting is absent (tests,
notebooks), a temporary folder of this machine is set, which is right in local
mode only.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="stridefold-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that texts travel in small, unless the session says otherwise.

    The default of 10,000 rows is tens of megabytes of text, held several times
    over by the JVM and by Python. The setting stays: a frame is run, and reads
    it, after the operator has returned.
    """
    for key, default, ours in (("maxRecordsPerBatch", "10000", "512"), ("maxBytesPerBatch", None, str(4 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if default is None or spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


def trim_driver(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM has freed outside its heap to the system; False where the JVM cannot.

    Spark plans and runs each exchange on a thread of its own, and glibc keeps
    what each of these hundreds of threads has freed. Takes some 10 to 20 ms.
    """
    jvm = spark._jvm
    try:  # by reflection: the bean's own class is closed to py4j
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


class Scratch:
    """Named tables of one run; ``drop`` frees those that nothing reads any more.

    What is left (a returned frame may read it at any time) goes when the
    session's JVM ends. A folder given as ``root`` is kept.
    """

    def __init__(self, spark: SparkSession, label: str, root: str | None = None):
        self.spark = spark
        self.root = root or f"{shared_dir(spark)}/stridefold/{label}-{uuid.uuid4().hex[:12]}"
        if not root:
            fs, where = self._fs(self.root)
            fs.mkdirs(where)
            fs.deleteOnExit(where)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        trim_driver(self.spark)
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def exists(self, name: str) -> bool:
        fs, where = self._fs(self.path(name))
        return fs.exists(where)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, where = self._fs(self.path(name))
            fs.delete(where, True)
