"""Admission, histograms, percentiles, streams."""

import math
import random

from pyspark.sql import functions as F

from blobframe import streaming
from blobframe.config import HTTP_BUCKETS, Limiter, StoreConfig
from blobframe.operators import metrics, ratelimit
from blobframe.sources import objects


def allowed(spark, limit, *rows):
    df = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(rows)], "client string, ts_ms long, request_id long")
    return [r.allowed for r in ratelimit.verdicts(df, limit).orderBy("request_id").collect()]


def test_burst(spark):
    assert allowed(spark, Limiter(5, 0), *[("a", 0)] * 6) == [True] * 5 + [False]


def test_refill(spark):
    assert allowed(spark, Limiter(2, 100), ("a", 0), ("a", 0), ("a", 0), ("a", 30)) == [True, True, False, True]


def test_independent_clients(spark):
    assert allowed(spark, Limiter(2, 0), ("a", 0), ("a", 0), ("b", 0), ("b", 0), ("a", 1), ("b", 1)) == [True] * 4 + [False] * 2


def test_refusal_takes_nothing_and_clamp():
    ok, tokens, last = ratelimit.admit(0.4, 1000, 1000, Limiter(3, 1, 1))
    assert (ok, tokens, last) == (False, 0.4, 1000)
    assert ratelimit.admit(0.0, 0, 10**9, Limiter(3, 1, 1)) == (True, 2.0, 10**9)
    assert StoreConfig().clamped(2) == (2, 2) and StoreConfig().clamped(0) == (0, 0)


def test_histogram_and_quantile(spark):
    r = random.Random(3)
    vals = [r.expovariate(3) for _ in range(400)] + [9.0]
    df = spark.createDataFrame([("a", v) for v in vals], "route string, v double")
    cells = metrics.histogram(df, "v", HTTP_BUCKETS, "route")
    got = {c.le: c.bucket_count for c in cells.collect()}
    assert got == {**{metrics.le_text(b): sum(v <= b for v in vals) for b in HTTP_BUCKETS}, "+Inf": 401}
    for q in (0.2, 0.5, 0.9, 0.9999):
        rank, lo, below, want = q * 401, 0.0, 0, HTTP_BUCKETS[-1]
        for b in HTTP_BUCKETS:
            c = sum(v <= b for v in vals)
            if c >= rank:
                want = lo + (b - lo) * (rank - below) / (c - below)
                break
            lo, below = b, c
        assert abs(metrics.histogram_quantile(cells, q, "route").first()["quantile"] - want) < 1e-9


def test_percentiles(spark):
    vals = [5.0, 1.0, 1.0, 7.0, 3.0, None]
    df = spark.createDataFrame([("a", v) for v in vals], "route string, v double")
    got = {r.p: r.value for r in metrics.percentiles(df, "v", (0, 50, 90, 99, 100), "route").collect()}
    s = sorted(v for v in vals if v is not None)
    assert got == {p: s[min(4, math.floor(p / 100 * 5))] for p in (0, 50, 90, 99, 100)}


def test_text(spark):
    df = spark.createDataFrame([("up", {}, 1), ("hits", {"route": "/x", "code": "200"}, 7)], "metric string, labels map<string,string>, value long")
    assert {r.line for r in metrics.exposition(df).collect()} == {"up 1", 'hits{code="200",route="/x"} 7'}


def batches(spark, df, path, n):
    rows = df.orderBy("ts_ms", "request_id").collect()
    for i in range(n):
        spark.createDataFrame(rows[i * len(rows) // n : (i + 1) * len(rows) // n], df.schema).coalesce(1).write.mode("append").parquet(path)


def test_streaming_admissions_equal_batch(spark, tmp_path):
    r = random.Random(5)
    df = spark.createDataFrame([(f"c{r.randrange(4)}", r.randrange(100_000), i) for i in range(300)], "client string, ts_ms long, request_id long")
    limit = Limiter(3, 0.1)
    batches(spark, df, str(tmp_path / "in"), 3)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = streaming.admissions(stream, limit).writeStream.format("memory").queryName("admissions").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {x.request_id: x.allowed for x in spark.table("admissions").collect()}
    want = {x.request_id: x.allowed for x in ratelimit.verdicts(df, limit).collect()}
    assert len(got) == 300 and not all(want.values()) and got == want


def test_streaming_dedup_rate_and_sweep(spark, tmp_path):
    df = spark.range(60).select(F.concat(F.lit("h"), (F.col("id") % 20).cast("string")).alias("chunk_hash"), (F.col("id") % 3).cast("string").alias("route"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = lambda s, name: s.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    run(streaming.ingest_once(src(), delay="1 hour"), "once")
    assert spark.table("once").count() == 20
    run(streaming.request_rate(src(), delay="1 minute"), "rates")
    closed = {(r.window_start, r.route): r.events for r in spark.table("rates").collect()}
    batch = {(r.w.start, r.route): r["count"] for r in df.groupBy(F.window("ts", "5 minutes").alias("w"), "route").count().collect()}
    assert closed and all(batch[k] == v for k, v in closed.items())
    seen = []
    streaming.sweep_each(src(), lambda b: seen.append(b.count()), str(tmp_path / "ck2"), every=None).awaitTermination(120)
    assert sum(seen) == 60


def test_sources_are_typed(spark):
    assert dict(objects.topology(spark).dtypes) == {"node_id": "string", "url": "string", "add_order": "int"}


def test_percentiles_of_many_values_and_null_labels(spark):
    r = random.Random(6)
    rows = [(g, round(r.expovariate(1), 3)) for g in ("a", "b", None) for _ in range(700)] + [("one", 5.0)] + [("same", 2.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double")
    ps = (0, 1, 50, 90, 99, 100)

    def want(values, p):
        v = sorted(values)
        return v[min(len(v) - 1, p * len(v) // 100)]

    got = {(x.g, x.p): (x.value, x.n) for x in metrics.percentiles(df, "v", ps, "g").collect()}
    by = {g: [v for h, v in rows if h == g] for g in {g for g, _ in rows}}
    assert got == {(g, p): (want(v, p), len(v)) for g, v in by.items() for p in ps}
    flat = {x.p: x.value for x in metrics.percentiles(df, "v", ps).collect()}
    assert flat == {p: want([v for _, v in rows], p) for p in ps}
    assert metrics.percentiles(df.where("false"), "v", ps).count() == 0 == metrics.percentiles(df.where("false"), "v", ps, "g").count()
