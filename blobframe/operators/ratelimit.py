"""Token-bucket admission over a request log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Limiter


def admit(tokens: float, last_ms: int | None, ts_ms: int, limit: Limiter) -> tuple[bool, float, int]:
    """One step of a bucket: (allowed, tokens, last_ms). A new client's bucket is full; a refusal takes nothing."""
    if last_ms is None:
        tokens, last_ms = limit.capacity, ts_ms
    elapsed = ts_ms - last_ms
    if elapsed > 0:
        tokens = min(limit.capacity, tokens + elapsed / 1000.0 * limit.refill_per_second)
        last_ms = ts_ms
    if tokens >= limit.cost:
        return True, tokens - limit.cost, last_ms
    return False, tokens, last_ms


def client_key(header: Column, address: Column) -> Column:
    """Who a request counts for: the client that it names, or else its address."""
    return F.coalesce(F.when(header != "", header), address)


def admission(requests: DataFrame, limit: Limiter) -> DataFrame:
    """requests (client, ts_ms, request_id, status and others) after the hook that stands before every route: what a bucket refuses
    is answered with 429 and goes no farther."""
    said = verdicts(requests, limit).select(F.col("request_id"), "allowed")
    return requests.join(said, "request_id").withColumn("status", F.when(F.col("allowed"), F.col("status")).otherwise(429)).drop("allowed")


def verdicts(requests: DataFrame, limit: Limiter) -> DataFrame:
    """requests (client, ts_ms, request_id) with `allowed`. A refusal depends on all that came before, so a client's requests
    are folded in order; partitions are sorted and streamed, so that memory does not grow with a client's requests."""

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, last = None, 0.0, None
        for p in parts:
            out = []
            for c, ts in zip(p["client"].tolist(), p["ts_ms"].tolist(), strict=True):
                if c != client:
                    client, tokens, last = c, 0.0, None
                ok, tokens, last = admit(tokens, last, ts, limit)
                out.append(ok)
            yield p.assign(allowed=out)

    rows = requests.select(F.col("client").cast("string").alias("client"), "ts_ms", "request_id")
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "client").sortWithinPartitions("client", "ts_ms", "request_id").mapInPandas(fold, "client string, ts_ms long, request_id long, allowed boolean")
