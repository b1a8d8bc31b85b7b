"""Explicit schemas of the store's tables."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType


def _of(*fields: tuple) -> StructType:
    return StructType([StructField(n, t, *more) for n, t, *more in fields])


OBJECTS = _of(("file_id", StringType(), False), ("data", BinaryType()))
CHUNKS = _of(("file_id", StringType(), False), ("seq", IntegerType(), False), ("chunk_hash", StringType(), False), ("chunk_size", IntegerType(), False), ("data", BinaryType()))
FILES = _of(("file_id", StringType(), False), ("created_at", LongType(), False), ("current_version_id", StringType(), True))
VERSIONS = _of(("version_id", StringType(), False), ("file_id", StringType(), False), ("size", LongType(), False), ("created_at", LongType(), False))
MANIFEST = _of(("version_id", StringType(), False), ("seq", IntegerType(), False), ("chunk_hash", StringType(), False))
REFCOUNTS = _of(("chunk_hash", StringType(), False), ("refcount", LongType(), False))
NODES = _of(("node_id", StringType(), False), ("url", StringType()), ("add_order", IntegerType(), False))
ATTEMPTS = _of(("chunk_hash", StringType(), False), ("rank", IntegerType(), False), ("node_id", StringType(), False), ("outcome", StringType()), ("deduped", BooleanType()), ("latency_ms", DoubleType()))
REQUESTS = _of(("client", StringType()), ("ts_ms", LongType(), False), ("request_id", LongType(), False), ("method", StringType()), ("route", StringType()), ("status", IntegerType()), ("latency_s", DoubleType()))
PLACEMENTS = _of(("chunk_hash", StringType(), False), ("nodes", ArrayType(StringType()), False))
