"""Quorum writes, ordered failover reads and deletes over replica outcomes that come as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, MISMATCH, CORRUPT, NOT_FOUND, NETWORK = "ok", "integrity_mismatch", "corrupt", "not_found", "network_error"


def status_outcome(status: Column, body_ok: Column = None, latency_ms: Column = None, timeout_ms: int = 3000) -> Column:
    """Class of a replica's reply: null status or a late one is a network error."""
    late = F.lit(False) if latency_ms is None else F.coalesce(latency_ms > timeout_ms, F.lit(False))
    good = F.lit(OK) if body_ok is None else F.when(body_ok, OK).otherwise(MISMATCH)
    return F.when(status.isNull() | late, NETWORK).when(status.isin(200, 201), good).when(status == 404, NOT_FOUND).when(status == 409, CORRUPT).otherwise(F.concat(F.lit("http_"), status.cast("string")))


def quorum(attempts: DataFrame, quorum_size: int, size: str = "chunk_size", *by: str) -> DataFrame:
    """Write results of attempts (chunk_hash, by, outcome, deduped, size): acks over all replicas, the quorum's verdict, and the
    bytes that deduplication saved, counted once and only if the quorum was met."""
    ok = F.col("outcome") == OK
    out = attempts.groupBy("chunk_hash", *by).agg(
        F.count_if(ok).alias("acks"),
        F.count("*").alias("of"),
        F.coalesce(F.bool_and(F.when(ok, F.col("deduped"))), F.lit(True)).alias("all_deduped"),
        F.max(size).alias("_size"),
    )
    met = F.col("acks") >= quorum_size
    return out.select(
        "chunk_hash", *by, "acks", "of", met.alias("quorum_met"), (met & F.col("all_deduped")).alias("deduped"),
        F.when(met & F.col("all_deduped"), F.col("_size")).otherwise(0).cast("long").alias("saved_bytes"),
        F.when(~met, F.concat(F.lit("quorum "), F.col("acks").cast("string"), F.lit("/"), F.lit(str(quorum_size)))).alias("error"),
    )


def upload_abort(manifest: DataFrame, written: DataFrame, file: str = "file_id") -> DataFrame:
    """Per object: abort_seq, the first chunk in order that missed its quorum (null: none), and the chunks attempted. Earlier
    chunks stay written, later ones are not tried."""
    m = manifest.join(written.select("chunk_hash", "quorum_met"), "chunk_hash")
    return m.groupBy(file).agg(F.min(F.when(~F.col("quorum_met"), F.col("seq"))).alias("abort_seq"), F.count("*").alias("chunks")).select(
        file, "abort_seq", "chunks", F.coalesce(F.col("abort_seq") + 1, F.col("chunks")).cast("long").alias("attempted"), F.col("abort_seq").isNull().alias("committed")
    )


def read_results(attempts: DataFrame) -> DataFrame:
    """Per chunk of attempts (chunk_hash, rank, node_id, outcome): result (ok, missing or unavailable), the node and rank that
    served it. Exhausted replicas mean missing if the last one had not found it, else unavailable."""
    ok = F.col("outcome") == OK
    out = attempts.groupBy("chunk_hash").agg(
        F.min(F.when(ok, F.col("rank"))).alias("served_rank"),
        F.min_by("node_id", F.when(ok, F.col("rank"))).alias("_node"),
        F.max_by("outcome", "rank").alias("_last"),
    )
    served = F.col("served_rank").isNotNull()
    return out.select("chunk_hash", F.when(served, "ok").when(F.col("_last") == NOT_FOUND, "missing").otherwise("unavailable").alias("result"), F.when(served, F.col("_node")).alias("served_by"), "served_rank")


def with_urls(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds the url of each row's node; the topology is small by its nature, and the optimizer broadcasts it where it is."""
    return ranked.join(nodes.select("node_id", "url").dropDuplicates(["node_id"]), "node_id", "left")


def failovers(attempts: DataFrame, *by: str) -> DataFrame:
    """Per reason (and by, columns that are alike in all attempts of a chunk), the failovers that ordered reads count: only attempts up to the first success; a first replica that has not
    found the chunk is silent; a success after the first replica counts once. Integrity failures are mismatches seen here."""
    first = attempts.groupBy("chunk_hash").agg(F.min(F.when(F.col("outcome") == OK, F.col("rank"))).alias("_first"))
    seen = attempts.join(first, "chunk_hash").where(F.col("_first").isNull() | (F.col("rank") <= F.col("_first")))
    reason = (
        F.when((F.col("outcome") == OK) & (F.col("rank") > 0), "failover_success")
        .when(F.col("outcome") == OK, None)
        .when((F.col("outcome") == NOT_FOUND) & (F.col("rank") == 0), None)
        .otherwise(F.col("outcome"))
    )
    return seen.select(reason.alias("reason"), *by).where("reason is not null").groupBy("reason", *by).agg(F.count("*").alias("failovers"), F.count_if(F.col("reason") == MISMATCH).alias("integrity_failures"))


def put_status(hash_ok: Column, exists: Column) -> Column:
    """Node's answer to a chunk write."""
    return F.when(~hash_ok, 422).when(exists, 200).otherwise(201)


def get_status(exists: Column, hash_ok: Column) -> Column:
    """Node's answer to a chunk read."""
    return F.when(~exists, 404).when(~hash_ok, 409).otherwise(200)


def delete_acks(targets: DataFrame, reachable: DataFrame) -> DataFrame:
    """Per chunk of (chunk_hash, node_id): replicas that could be reached, whether or not they held it."""
    up = reachable.select("node_id").distinct().withColumn("_up", F.lit(1))
    return targets.join(up, "node_id", "left").groupBy("chunk_hash").agg(F.count("_up").alias("reached"))
