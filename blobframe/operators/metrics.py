"""Counters, histograms and percentiles of request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Ranges that a label's distinct values are dealt over for percentiles.
RANGES = 64


def histogram(rows: DataFrame, value: str, bounds: tuple[float, ...], *labels: str) -> DataFrame:
    """Long format: labels, le, and the cumulative count of values at most le, with +Inf; one pass, all bounds at once."""
    cells = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias(f"b{len(bounds)}")]
    named = [F.struct(F.lit(float(b)).alias("le_value"), F.lit(le_text(b)).alias("le"), F.col(f"b{i}").alias("bucket_count")) for i, b in enumerate(bounds)]
    named.append(F.struct(F.lit(float("inf")).alias("le_value"), F.lit("+Inf").alias("le"), F.col(f"b{len(bounds)}").alias("bucket_count")))
    return rows.groupBy(*labels).agg(*cells).select(*labels, F.inline(F.array(*named)))


def le_text(b: float) -> str:
    return f"{b:g}"


def histogram_sums(rows: DataFrame, value: str, *labels: str) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(value).alias("n"), F.sum(value).alias("total"))


def histogram_quantile(cells: DataFrame, q: float, *labels: str) -> DataFrame:
    """The quantile by linear interpolation within the bucket that its rank falls in; the highest finite bound where that is
    +Inf."""
    w = W.partitionBy(*labels).orderBy("le_value")
    rows = cells.select(*labels, "le_value", "bucket_count", F.lag("le_value", 1, 0.0).over(w).alias("_lo"), F.lag("bucket_count", 1, 0).over(w).alias("_below"), F.max("bucket_count").over(W.partitionBy(*labels)).alias("_n"))
    rank = F.lit(q) * F.col("_n")
    hit = rows.where((F.col("bucket_count") >= rank) & ((F.col("_below") < rank) | (F.col("_below") == 0)))
    inside = F.col("_lo") + (F.col("le_value") - F.col("_lo")) * (rank - F.col("_below")) / (F.col("bucket_count") - F.col("_below"))
    value = F.when(F.isnan("le_value") | (F.col("le_value") == float("inf")), F.col("_lo")).otherwise(inside)
    return hit.groupBy(*labels).agg(F.min_by(value, F.col("le_value")).alias("quantile"))


def percentiles(rows: DataFrame, value: str, ps: tuple[int, ...], *labels: str) -> DataFrame:
    """labels, p and the value at index min(n - 1, floor(p / 100 * n)) of the sorted values. Counts of distinct values come
    first; these are dealt over ranges between approximate quantiles, the ranges' counts tell in which one an index lies, and only
    that one is put in order. So no task holds more than a range of a label's values, however many there are."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*labels, value).agg(F.count("*").alias("_c"))
    cuts = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 16 * RANGES)
    bounds = per.groupBy(*labels).agg(cuts.alias("_cuts"))
    dealt = _joined(per, bounds, labels).withColumn("_r", F.size(F.filter("_cuts", lambda b: b < F.col(value)))).drop("_cuts")
    ranges = dealt.groupBy(*labels, "_r").agg(F.sum("_c").alias("_in"))
    below = F.coalesce(F.sum("_in").over(W.partitionBy(*labels).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*labels, "_r", "_in", below.alias("_below"), F.sum("_in").over(W.partitionBy(*labels)).alias("_n"))
    wanted = F.explode(F.array(*[F.lit(p) for p in ps]))
    index = F.least(F.col("_n") - 1, F.floor(F.col("p") / F.lit(100.0) * F.col("_n")))
    hit = ranges.select("*", wanted.alias("p")).withColumn("_at", index).where((F.col("_below") <= F.col("_at")) & (F.col("_at") < F.col("_below") + F.col("_in")))
    upto = F.sum("_c").over(W.partitionBy(*labels, "_r").orderBy(value))
    run = _joined(dealt.withColumn("_upto", upto), hit.select(*labels, "_r", "_below", "_n", "p", "_at"), (*labels, "_r"))
    return run.where(F.col("_below") + F.col("_upto") > F.col("_at")).groupBy(*labels, "p").agg(F.min(value).alias("value"), F.max("_n").alias("n"))


def _joined(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Inner join on keys, nulls equal; b has one row where there are no keys."""
    named = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(named[f"__{k}"])
    return a.join(named if keys else F.broadcast(named), on).drop(*[f"__{k}" for k in keys])


def window_rate(rows: DataFrame, ts_ms: str, seconds: int, *labels: str, where: Column | None = None) -> DataFrame:
    """Events per second in tumbling windows: a fixed grid in place of a sliding range, without extrapolation at its ends."""
    rows = rows if where is None else rows.where(where)
    start = (F.floor(F.col(ts_ms) / (seconds * 1000)) * seconds).alias("window_start")
    return rows.groupBy(*labels, start).agg(F.count("*").alias("events")).withColumn("rate", F.col("events") / F.lit(float(seconds)))


def load_summary(rows: DataFrame, status: str, seconds: float) -> DataFrame:
    """Completed, limited and other replies of a run of so many seconds, and the rounded rate of completed ones."""
    done = F.col(status).isin(200, 201)
    return rows.agg(F.count_if(done).alias("completed"), F.count_if(F.col(status) == 429).alias("limited"), F.count_if(~done & (F.col(status) != 429)).alias("other"), F.round(F.count_if(done) / F.lit(seconds), 2).alias("per_second"))


def exposition(samples: DataFrame) -> DataFrame:
    """Text lines of samples (metric, labels map<string,string>, value), labels in order of their names."""
    pairs = F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    name = F.when(F.size("labels") > 0, F.concat(F.col("metric"), F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.col("metric"))
    return samples.select(F.concat(name, F.lit(" "), F.col("value").cast("string")).alias("line"))
