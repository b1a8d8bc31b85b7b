"""Fixed-size chunks of objects, their manifests and their way back to bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_SIZE
from .hashing import sha256_hex


def slice_bytes(data: Column, at: Column, size: int) -> Column:
    return F.substring(data, at * F.lit(size) + F.lit(1), F.lit(size))


def chunk(objects: DataFrame, size: int = CHUNK_SIZE, key: str = "file_id", data: str = "data", keep_data: bool = False) -> DataFrame:
    """One row per chunk: key, seq, chunk_hash, chunk_size and, if asked for, its bytes. An empty object has no chunks and a
    null one neither. Chunks are cut on bytes in a generator, so no row but the object itself is moved."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    rows = objects.where(F.octet_length(data) > 0).select(F.col(key), F.col(data).alias("_d"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    rows = rows.withColumn("_d", slice_bytes(F.col("_d"), F.col("seq"), size))
    columns = [F.col(key), F.col("seq"), sha256_hex(F.col("_d")).alias("chunk_hash"), F.octet_length("_d").alias("chunk_size")]
    return rows.select(*columns, *([F.col("_d").alias("data")] if keep_data else []))


def reassemble(manifest: DataFrame, chunks: DataFrame, key: str = "file_id") -> DataFrame:
    """One row per object of the manifest: key, data (null if a chunk is missing), missing (how many are), first_missing (the
    hash at the lowest seq that is). chunks holds (chunk_hash, data), one row per hash."""
    joined = manifest.select(key, "seq", "chunk_hash").join(chunks.select("chunk_hash", "data"), "chunk_hash", "left")
    gone = F.col("data").isNull()
    parts = joined.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("parts"),
        F.count_if(gone).alias("missing"),
        F.min_by("chunk_hash", F.when(gone, F.col("seq"))).alias("_first"),
    )
    # by way of hex digits, as they are joined in one step, in time linear in the object's bytes
    whole = F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["data"])), ""))
    return parts.select(key, F.when(F.col("missing") == 0, whole).alias("data"), "missing", F.when(F.col("missing") > 0, F.col("_first")).alias("first_missing"))


def verified(chunks: DataFrame) -> DataFrame:
    """Adds ok: whether a chunk's bytes have the hash it is named by."""
    return chunks.withColumn("ok", F.coalesce(sha256_hex(F.col("data")) == F.col("chunk_hash"), F.lit(False)))
