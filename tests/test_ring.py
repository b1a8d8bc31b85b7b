"""Consistent hashing and replica outcomes."""

import bisect
import hashlib

import pytest
from pyspark.sql import functions as F

from blobframe.functions import hashing
from blobframe.operators import replication, ring
from blobframe.schemas import NODES
from blobframe.sources import objects


def nodes(spark, *ids):
    return spark.createDataFrame([(n, None, i) for i, n in enumerate(ids)], NODES)


def position(text):
    return int(hashlib.sha1(text.encode()).hexdigest()[:8], 16)


def walk(ids, vnodes, key, n):
    pts = sorted((position(f"{x}#vnode{v}"), i, v, x) for i, x in enumerate(ids) for v in range(vnodes))
    at = bisect.bisect_left([p[0] for p in pts], position(key))
    out = []
    for k in range(len(pts)):
        x = pts[(at + k) % len(pts)][3]
        if x not in out:
            out.append(x)
        if len(out) == n:
            break
    return out


def lists(spark, ids, keys, n, vnodes=100):
    df = spark.createDataFrame([(k,) for k in keys], "chunk_hash string")
    return {r.chunk_hash: list(r.nodes) for r in ring.place(df, ring.arcs(nodes(spark, *ids), n, vnodes)).collect()}


def test_golden_positions(spark):
    r = spark.range(1).select(hashing.ring_position(F.lit("node-0#vnode0")).alias("a"), hashing.ring_position(F.lit("some-key")).alias("b")).first()
    assert (r.a, r.b) == (1256090140, 2632599219)


def test_golden_lists(spark):
    ids = ["node-a", "node-b", "node-c"]
    assert lists(spark, ids, ["some-key"], 3) == {"some-key": ["node-c", "node-b", "node-a"]}
    assert lists(spark, ids, ["deterministic-key"], 2) == {"deterministic-key": ["node-b", "node-a"]}


@pytest.mark.parametrize("ids,n,vnodes", [(["a"], 3, 100), (["a", "b"], 5, 7), (["n1", "n2", "n3", "n4", "n5"], 3, 100), ([f"m{i}" for i in range(40)], 3, 20)])
def test_equals_walk(spark, ids, n, vnodes):
    keys = [f"key-{i}" for i in range(300)]
    got = lists(spark, ids, keys, n, vnodes)
    assert got == {k: walk(ids, vnodes, k, min(n, len(ids))) for k in keys}


def test_empty_ring(spark):
    assert lists(spark, [], ["k"], 3) == {}


def test_removal_and_balance(spark):
    ids, keys = ["node-a", "node-b", "node-c", "node-d"], [f"key-{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "chunk_hash string")
    four = nodes(spark, *ids)
    three = ring.remove_nodes(four, four.where("node_id = 'node-b'"))
    moved = ring.movement(ring.place(df, ring.arcs(four, 1, 200)), ring.place(df, ring.arcs(three, 1, 200))).collect()
    assert len(moved) == 115 and {m.old_owner for m in moved} == {"node-b"}
    own = [v[0] for v in lists(spark, ids[:3], [f"distribution-key-{i}" for i in range(3000)], 1, 200).values()]
    assert [own.count(x) for x in ids[:3]] == [964, 1020, 1016]


def test_add_is_idempotent(spark):
    a = nodes(spark, "x", "y")
    assert ring.add_nodes(a, nodes(spark, "y", "z")).select("node_id").rdd.map(lambda r: r[0]).collect().count("y") == 1


def test_no_nested_loop(spark):
    df = spark.createDataFrame([("k",)], "chunk_hash string")
    plan = ring.place(df, ring.arcs(nodes(spark, "a", "b"), 2))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan.split("BroadcastExchange")[0] and "NestedLoop" not in plan.split("BroadcastExchange")[0]


ATTEMPTS = [
    ("first", ["ok", "ok", "ok"]), ("second", ["not_found", "ok", "ok"]), ("bad", ["integrity_mismatch", "corrupt", "ok"]),
    ("gone", ["network_error", "corrupt", "not_found"]), ("down", ["not_found", "not_found", "network_error"]), ("busy", ["http_503", "ok", "not_found"]),
]


def attempts(spark):
    return spark.createDataFrame([(c, i, f"n{i}", o, True, 7) for c, os in ATTEMPTS for i, o in enumerate(os)], "chunk_hash string, rank int, node_id string, outcome string, deduped boolean, chunk_size int")


def test_reads(spark):
    got = {r.chunk_hash: (r.result, r.served_by) for r in replication.read_results(attempts(spark)).collect()}
    assert got == {"first": ("ok", "n0"), "second": ("ok", "n1"), "bad": ("ok", "n2"), "gone": ("missing", None), "down": ("unavailable", None), "busy": ("ok", "n1")}


def test_failover_truth_table(spark):
    want: dict = {}
    for _, outcomes in ATTEMPTS:
        for i, o in enumerate(outcomes):
            if o == "ok":
                if i:
                    want["failover_success"] = want.get("failover_success", 0) + 1
                break
            if not (o == "not_found" and i == 0):
                want[o] = want.get(o, 0) + 1
    rows = replication.failovers(attempts(spark)).collect()
    assert {r.reason: r.failovers for r in rows} == want
    assert sum(r.integrity_failures for r in rows) == 1


def test_quorum(spark):
    rows = {r.chunk_hash: r for r in replication.quorum(attempts(spark), 2).collect()}
    assert rows["first"].acks == 3 and rows["first"].deduped and rows["first"].saved_bytes == 7
    assert not rows["bad"].quorum_met and rows["bad"].saved_bytes == 0 and rows["bad"].error == "quorum 1/2"
    none = replication.quorum(attempts(spark).where("chunk_hash = 'down'"), 0).first()
    assert none.quorum_met and none.deduped  # nothing asked for, nothing stored
    m = spark.createDataFrame([("f", 0, "first"), ("f", 1, "bad"), ("f", 2, "first"), ("g", 0, "first")], "file_id string, seq int, chunk_hash string")
    got = {r.file_id: (r.abort_seq, r.attempted, r.committed) for r in replication.upload_abort(m, replication.quorum(attempts(spark), 2)).collect()}
    assert got == {"f": (1, 2, False), "g": (None, 1, True)}


def test_status_classes(spark):
    df = spark.createDataFrame([(200, True, 1.0), (201, True, 1.0), (200, False, 1.0), (404, True, 1.0), (409, True, 1.0), (503, True, 1.0), (None, True, 1.0), (200, True, 3000.5)], "s int, ok boolean, ms double")
    got = [r[0] for r in df.select(replication.status_outcome(F.col("s"), F.col("ok"), F.col("ms"))).collect()]
    assert got == ["ok", "ok", "integrity_mismatch", "not_found", "corrupt", "http_503", "network_error", "network_error"]
    r = spark.range(1).select(replication.put_status(F.lit(False), F.lit(True)), replication.put_status(F.lit(True), F.lit(True)), replication.put_status(F.lit(True), F.lit(False)), replication.get_status(F.lit(False), F.lit(True)), replication.get_status(F.lit(True), F.lit(False)), replication.get_status(F.lit(True), F.lit(True))).first()
    assert r[:] == (422, 200, 201, 404, 409, 200)


def test_clashing_columns_pass_through(spark):
    nodes = objects.topology(spark)
    names = ("lo", "hi", "nodes", "_b", "_p", "position", "prev")
    keys = spark.createDataFrame([(f"k{i}", *["x"] * len(names)) for i in range(20)], "chunk_hash string, " + ", ".join(f"{n} string" for n in names))
    plain = {r.chunk_hash: r.nodes for r in ring.place(keys.select("chunk_hash"), ring.arcs(nodes, 2)).collect()}
    rows = ring.place(keys, ring.arcs(nodes, 2)).collect()
    assert {r.chunk_hash: r.nodes for r in rows} == plain and all(r.lo == r.hi == r._b == "x" for r in rows) and len(rows) == 20
