"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Limiter
from ..operators.ratelimit import admit


def ingest_once(chunks: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Each chunk hash once while the watermark remembers it."""
    return chunks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["chunk_hash"])


def request_rate(requests: DataFrame, ts: str = "ts", window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Requests per route in closed windows; what comes later than the watermark is left out."""
    counts = requests.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), "route").agg(F.count("*").alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), "route", "events")


def admissions(requests: DataFrame, limit: Limiter) -> DataFrame:
    """requests (client, ts_ms, request_id) with `allowed`. A client's bucket is the state; rows of one batch are taken in
    order of time, and rows that come in a later batch with an earlier time refill nothing."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(parts)).sort_values(["ts_ms", "request_id"])
        out = []
        for ts in rows["ts_ms"].tolist():
            ok, tokens, last = admit(tokens, last, ts, limit)
            out.append(ok)
        state.update((tokens, last))
        yield rows.assign(allowed=out)[["client", "ts_ms", "request_id", "allowed"]]

    return (
        requests.select(F.col("client").cast("string").alias("client"), "ts_ms", "request_id")
        .groupBy("client")
        .applyInPandasWithState(step, "client string, ts_ms long, request_id long, allowed boolean", "tokens double, last_ms long", "append", GroupStateTimeout.NoTimeout)
    )


def sweep_each(stream: DataFrame, sweep: Callable[[DataFrame], None], checkpoint: str, every: str | None = "15 minutes"):
    """Runs a sweep over each batch of a stream, on a timer or, with every=None, over what is there now."""
    writer = stream.writeStream.foreachBatch(lambda df, _: sweep(df)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
