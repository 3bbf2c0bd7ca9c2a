"""What the corpus operators share: scratch tables, text slices for Arrow tasks, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task holds as Python objects at once.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, or the checkpoint folder that the context was given.
    Where neither is set, a folder in the warehouse, but only if Spark runs on this machine alone or the warehouse has
    a shared file system."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    house = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (":" not in house or house.startswith("file:")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return house + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


#: Folders that staged() has written, by application.
_written: dict[str, list[str]] = {}


def staged(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, and a lost executor costs a reread only."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that no later plan reads."""
    for table in tables:
        own = _written.get(table.sparkSession.sparkContext.applicationId, [])
        if table._scratch_path in own:
            own.remove(table._scratch_path)
        _delete(table.sparkSession, table._scratch_path)


def clear_scratch(spark: SparkSession) -> int:
    """Deletes what is left of this application's staged tables, those of results included: to be called once results have
    been read. How many went."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session has a lower bound: long texts take less memory beside the
    heap and in the tasks' Python."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `limit` text bytes; a longer text is a run of its own. column: texts, or
    their sizes."""
    import pyarrow.compute as pc

    sizes = batch.column(column)
    if not pa.types.is_integer(sizes.type):
        sizes = pc.binary_length(sizes)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if held and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def crc32_text(column: str):
    """crc32 of a number's decimal text."""
    return F.crc32(F.col(column).cast("string"))


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """Components of edges (a, b), both long: one row (node, component) for each node of an edge between different
    nodes, component being its smallest node. Alternates the large-star and small-star steps (Kiveris et al. 2014)
    until the edges no longer change; each round is written to the shared folder. No neighbourhood is collected: hubs
    are joined rows, which skew handling can split."""
    now = staged(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        then = staged(small, "edges")
        discard(now)
        now = then
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
