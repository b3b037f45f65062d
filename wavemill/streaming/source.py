"""A recording as a stream: stretches of samples that arrive one after another."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


STRETCHES = 8  # micro-batches that a recording is cut into, as long as these have LONGEST samples at most
LONGEST = 1 << 18


def stretch_length(long: DataFrame, least: int) -> int:
    """Samples of a stretch: each micro-batch has a cost of its own, so stretches grow with the recording, up to
    what one task can hold of a channel."""
    last = long.agg(F.max("sample")).first()[0] or 0
    return max(least, min(-(-(last + 1) // STRETCHES), LONGEST))


def write_stretches(long: DataFrame, folder: str, stretch: int) -> None:
    """Writes a file for each ``stretch`` samples of all channels, dated in the order of the
    samples, which is the order in which a stream takes them."""
    spark = long.sparkSession
    rows = long.withColumn("stretch", F.floor(F.col("sample") / stretch).cast("long"))
    rows.repartition("stretch").sortWithinPartitions("sample").write.partitionBy("stretch").parquet(folder)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs, first = root.getFileSystem(conf), int(time.time() * 1000) - 10_000_000
    found = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("stretch=")}
    for k, at in enumerate(sorted(found)):
        for status in fs.listStatus(found[at]):
            fs.setTimes(status.getPath(), first + 1000 * k, -1)


def read_stretches(spark: SparkSession, folder: str, schema: StructType, files: int = 1) -> DataFrame:
    """The stream over a folder of stretches; those that are added later follow."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/stretch=*")
