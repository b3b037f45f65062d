"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's own
    checkpoint folder; a fresh temporary one only where neither is set and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            named = held.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            folder = tempfile.mkdtemp(prefix="wavemill-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            named = "file://" + folder
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is such a file or folder, in whatever file system it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


class Scratch:
    """Tables written once to the shared folder and read back, which cuts lineage:
    a lost executor costs no recomputation of what stands before the table."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/wavemill-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._wavemill_path = path
        return out

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def free(self, *tables: DataFrame) -> None:
        """Deletes tables that no later result reads."""
        for t in tables:
            self._delete(t._wavemill_path)

    def clear(self) -> None:
        """Deletes all its tables."""
        self._delete(self.root)

    def release(self) -> None:
        """Lets Spark's cleaner drop the shuffle files of finished steps, which it does for
        plans that the driver's garbage collector has found unused."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def settle(df: DataFrame) -> DataFrame:
    """A small table (a row for each channel or block), computed now and read back: what uses
    it several times over neither plans nor computes its sources again."""
    return Scratch(df.sparkSession).save(df)
