"""Chunking, stores, presigned URLs."""

import hashlib
import hmac

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blobframe.functions import chunking, hashing, presign
from blobframe.operators import catalog
from blobframe.schemas import OBJECTS
from blobframe.sources import objects


def objs(spark, **data):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in data.items()], OBJECTS)


def chunks_of(spark, size, **data):
    rows = chunking.chunk(objs(spark, **data), size, keep_data=True).collect()
    return sorted((r.file_id, r.seq, r.chunk_hash, r.chunk_size, bytes(r.data)) for r in rows)


def test_sizes(spark):
    rows = chunks_of(spark, 262_144, a=b"\x07" * (2 * 262_144 + 100))
    assert [r[3] for r in rows] == [262_144, 262_144, 100]
    assert [r[2][:16] for r in rows] == ["3637bbb97e98d009", "3637bbb97e98d009", "d876885b7f40eae7"]


def test_hashes_name_data(spark):
    for r in chunks_of(spark, 100, a=b"abcdefgh" * 1000):
        assert r[2] == hashlib.sha256(r[4]).hexdigest()


def test_equal_runs_share_a_hash(spark):
    h = [r[2] for r in chunks_of(spark, 500, a=bytes([42]) * 500 + bytes([1]) * 500 + bytes([42]) * 500)]
    assert h[0] == h[2] != h[1]


def test_empty_and_null(spark):
    assert chunks_of(spark, 10, a=b"", b=None) == []


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=6), st.integers(1, 300))
def test_round_trip(spark, bodies, size):
    data = {f"f{i}": b for i, b in enumerate(bodies)}
    cut = chunking.chunk(objs(spark, **data), size, keep_data=True)
    rows = cut.collect()
    for k, b in data.items():
        mine = sorted((r.seq, bytes(r.data)) for r in rows if r.file_id == k)
        assert [s for s, _ in mine] == list(range(-(-len(b) // size))) and b"".join(d for _, d in mine) == b
        assert all(len(d) == size for _, d in mine[:-1])
    whole = chunking.reassemble(cut, cut.groupBy("chunk_hash").agg(F.first("data").alias("data"))).collect()
    assert {r.file_id: bytes(r.data) for r in whole} == {k: b for k, b in data.items() if b}


def test_reassembly_reports_first_missing(spark):
    cut = chunking.chunk(objs(spark, a=b"aabbccdd"), 2, keep_data=True)
    rows = {r.seq: r.chunk_hash for r in cut.collect()}
    store = cut.where(F.col("seq").isin(0, 2)).select("chunk_hash", "data")
    r = chunking.reassemble(cut, store).first()
    assert r.data is None and r.missing == 2 and r.first_missing == rows[1]


def test_store_put(spark):
    good = bytearray(b"deduplicate me")
    h = hashlib.sha256(good).hexdigest()
    rows = spark.createDataFrame([(h, good), (h, good), ("0" * 64, bytearray(b"other"))], "chunk_hash string, data binary")
    empty = spark.createDataFrame([], "chunk_hash string")
    assert [r.chunk_hash for r in catalog.store_put(empty, rows).collect()] == [h]
    assert catalog.store_put(rows.select("chunk_hash"), rows).count() == 0
    assert {r.chunk_hash: r.ok for r in chunking.verified(rows).collect()} == {h: True, "0" * 64: False}


def test_store_on_disk(spark, tmp_path):
    cut = chunking.chunk(objs(spark, a=b"x" * 600), 100, keep_data=True).dropDuplicates(["chunk_hash"])
    objects.write_store(cut.select("chunk_hash", "data"), str(tmp_path / "s"))
    back = objects.read_store(spark, str(tmp_path / "s"))
    assert back.agg(F.count("*"), F.sum(F.octet_length("data"))).first()[:] == (1, 100)
    for name, n in (("a" * 64, 100), ("b" * 64, 200), (".tmp-1", 5)):
        p = tmp_path / "raw" / name[:2] / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"z" * n)
    rows = objects.stored_sizes(spark, str(tmp_path / "raw")).collect()
    assert sorted((r.chunk_hash[0], r.chunk_size) for r in rows) == [("a", 100), ("b", 200)]
    assert objects.read_files(spark, str(tmp_path / "raw")).count() == 2


def test_topology_and_limits(spark):
    assert [tuple(r) for r in objects.topology(spark, "a=http://x,b=http://y=z").collect()] == [("a", "http://x", 0), ("b", "http://y", 1)]
    assert objects.topology(spark).count() == 3
    rows = objects.body_split(objs(spark, a=b"12345", b=b"123456", c=None), 5).collect()
    assert {r.file_id: r.status for r in rows} == {"a": 201, "b": 413, "c": 400}


@pytest.mark.parametrize("value,ok", [("a" * 64, True), ("A" * 64, False), ("a" * 63, False), ("a" * 65, False), ("g" + "a" * 63, False), (None, False), ("a" * 64 + "\n", False)])
def test_hash_validity(spark, value, ok):
    df = spark.createDataFrame([(value,)], "h string").select(hashing.is_chunk_hash(F.col("h")).alias("ok"), hashing.chunk_path(F.col("h")).alias("p"))
    r = df.first()
    assert r.ok is ok and (r.p == f"aa/aa/{value}" if ok else r.p is None)


def test_hmac_golden(spark):
    m = "GET:/files/abc123/download-presigned:1700000000000"
    df = spark.createDataFrame([(m,), ("",), ("é" * 100,)], "m string").select("m", hashing.hmac_sha256_hex(F.col("m"), "dev-secret-change-in-production").alias("h"))
    rows = {r.m: r.h for r in df.collect()}
    assert rows[m] == "41a9037a9720ffdcb88011eca0411675d28b45d21651ea69db9e9018158c6c4d"
    for k, v in rows.items():
        assert v == hmac.new(b"dev-secret-change-in-production", k.encode(), "sha256").hexdigest()


def test_presign_ladder(spark):
    made = spark.range(1).select(presign.presign(F.lit("GET"), F.lit("/f/1"), F.lit(1000), 60).alias("s")).select("s.*").first()
    assert made.expires_at == 61_000 and made.url == f"/f/1?expires=61000&sig={made.signature}"
    s, e = made.signature, "61000"
    cases = [
        ("GET", "/f/1", e, s, 61_000, "ok"), ("GET", "/f/1", e, s.upper(), 5, "ok"), ("GET", "/f/1", "61000.0", s, 5, "ok"), ("GET", "/f/1", e, s, 61_001, "expired"),
        ("GET", "/f/1", e, s[:-4] + "aaaa", 5, "tampered"), ("DELETE", "/f/1", e, s, 5, "tampered"), ("GET", "/f/2", e, s, 5, "tampered"),
        ("GET", "/f/1", None, s, 5, "missing"), ("GET", "/f/1", e, "", 5, "missing"), ("GET", "/f/1", "soon", s, 5, "malformed"),
    ]
    df = spark.createDataFrame(cases, "m string, p string, e string, s string, n long, want string")
    for r in df.select("want", presign.verify(*(F.col(c) for c in "mpesn")).alias("got")).collect():
        assert r.got == r.want
