"""Collection of orphaned chunks as one batch over a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_SIZE
from .catalog import reap
from .replication import delete_acks


def sweep(orphans: DataFrame, placed: DataFrame, reachable: DataFrame, sizes: DataFrame) -> DataFrame:
    """Per orphan: replicas reached, whether it counts as reclaimed, and its exact size from sizes (chunk_hash, chunk_size).
    placed: (chunk_hash, node_id) of every replica."""
    acks = delete_acks(orphans.join(placed, "chunk_hash"), reachable)
    return orphans.join(acks, "chunk_hash", "left").join(sizes, "chunk_hash", "left").select("chunk_hash", F.coalesce("reached", F.lit(0)).alias("reached"), (F.coalesce("reached", F.lit(0)) > 0).alias("reclaimed"), "chunk_size")


def summary(swept: DataFrame, size_hint: int = CHUNK_SIZE) -> DataFrame:
    """scanned, reclaimed chunks, their bytes by the hint, and, as an extension, exactly."""
    return swept.agg(
        F.count("*").alias("scanned"),
        F.count_if("reclaimed").alias("reclaimed_chunks"),
        (F.count_if("reclaimed") * size_hint).alias("reclaimed_bytes_hint"),
        F.coalesce(F.sum(F.when(F.col("reclaimed"), F.col("chunk_size"))), F.lit(0)).cast("long").alias("reclaimed_bytes_exact"),
    )


def next_counts(counts: DataFrame, swept: DataFrame) -> DataFrame:
    """Reference counts after the sweep: orphans are reaped whether or not a replica was reached."""
    return reap(counts, swept)
