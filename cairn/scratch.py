"""Tables written between the steps of an iterative operator.

They lie in the shared folder of ``spark.checkpoint.dir``, so a later step can
read them again after any executor is lost. Only where that setting is absent
(tests, a laptop) a local folder is made and set.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share: tables between steps are written there")
        folder = "file://" + tempfile.mkdtemp(prefix="cairn-scratch-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """A folder of written tables that belongs to one run of one operator.

    The operator's result reads the last of them, so they are removed when the
    driver ends; a driver that lives long gives its operators a Scratch of its
    own and leaves it, or calls ``drop``, once the result is stored.
    """

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def write(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Write df and return a DataFrame that reads what was written."""
        self._n += 1
        at = f"{self.path}/{self._n:04d}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        atexit.unregister(self.drop)
