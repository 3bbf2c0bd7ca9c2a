"""Tables in the shared folder, which cut the lineage: a lost executor costs a reread only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Folders written by this process, by session.
_written: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one that the context was given. Where neither is set, one in the
    warehouse, but only if Spark runs on this machine alone or the warehouse has a shared file system."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (":" not in house or house.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return house + "/_checkpoints"


def fixed(df: DataFrame) -> DataFrame:
    """df, evaluated once, written to the shared folder and read back. What Parquet can't hold is checkpointed."""
    spark = df.sparkSession
    if len(set(df.columns)) < len(df.columns) or '"void"' in df.schema.json() or "interval" in df.schema.json():
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_folder(spark))
        return df.checkpoint()
    path = f"{shared_folder(spark)}/fixed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes what fixed() has written for this application; results that still read it are lost. How many tables went."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def numbered(rows: DataFrame, start: int = 1) -> DataFrame:
    """Adds ids from start on. Rows are counted by partition first, so that no task sees them all."""
    rows = fixed(rows.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    own = Window.partitionBy("_part").orderBy("_row")
    sizes = rows.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    placed = rows.withColumn("_row", F.row_number().over(own)).join(F.broadcast(sizes), "_part")  # a row for each partition
    return placed.withColumn("id", (F.col("_before") + F.col("_row") + start - 1).cast("long")).drop("_part", "_row", "_before")
