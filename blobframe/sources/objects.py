"""Readers of objects and topologies, and splits of what may come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import COORDINATOR_BODY_LIMIT
from ..schemas import NODES


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, where its files give fewer: a file of one row group is one task, however many
    cores wait for it. Large tables have more partitions than that and are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Objects (file_id, data) from files below a path; the id is the file's path."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.load(path).select(F.col("path").alias("file_id"), F.col("content").alias("data"))


def stored_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_hash, chunk_size) of a chunk store on disk; bytes are not read and temporary files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.where(~name.startswith(".tmp-")).select(name.alias("chunk_hash"), F.col("length").alias("chunk_size"))


def from_text(df: DataFrame, key: str, text: str, prefix: str = "file_") -> DataFrame:
    """Objects of a text column's UTF-8 bytes."""
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("file_id"), F.encode(F.col(text), "UTF-8").alias("data"))


def seeded_objects(spark: SparkSession, count: int, size: int, seed: int, prefix: str = "file_") -> DataFrame:
    """Objects of `size` bytes that look random and are the same every time: runs of hashes of seed, object and place."""
    runs = F.transform(F.sequence(F.lit(0), F.lit((size - 1) // 32)), lambda i: F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col("id").cast("string"), i.cast("string")), 256))
    data = F.substring(F.unhex(F.array_join(runs, "")), 1, size)
    return spark.range(count).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("file_id"), data.alias("data"))


def body_split(objects: DataFrame, limit: int = COORDINATOR_BODY_LIMIT) -> DataFrame:
    """Adds `status`: 201 for a body that is taken, 400 for none, 413 for one over the limit."""
    return objects.withColumn("status", F.when(F.col("data").isNull(), 400).when(F.octet_length("data") > limit, 413).otherwise(201))


# Fixed value: the topology where none is given.
LOCAL_TOPOLOGY = "node-0=http://127.0.0.1:4100,node-1=http://127.0.0.1:4101,node-2=http://127.0.0.1:4102"


def topology(spark: SparkSession, text: str | None = None) -> DataFrame:
    """Nodes from 'id=url,id=url'; a url ends at a second equals sign. Order is the order of adding."""
    rows = []
    for i, pair in enumerate(p for p in (text or LOCAL_TOPOLOGY).split(",")):
        parts = pair.split("=")
        rows.append((parts[0], parts[1] if len(parts) > 1 else None, i))
    return spark.createDataFrame(rows, NODES)


def write_store(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Chunks (chunk_hash, data) as Parquet below the first two hex digits of their hashes; the committer publishes whole files
    or none."""
    chunks.withColumn("prefix", F.substring("chunk_hash", 1, 2)).repartition("prefix").write.mode(mode).partitionBy("prefix").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
