"""The routes end to end, on tables."""

import pytest
from pyspark.sql import functions as F

from blobframe.config import StoreConfig
from blobframe.functions import presign
from blobframe.operators import catalog
from blobframe.plans import service
from blobframe.schemas import FILES, MANIFEST, VERSIONS
from blobframe.sources import objects

SMALL = StoreConfig(chunk_size=262_144)


@pytest.fixture
def empty(spark):
    return service.Tables(spark.createDataFrame([], FILES), spark.createDataFrame([], VERSIONS), spark.createDataFrame([], MANIFEST), spark.createDataFrame([], "chunk_hash string, data binary"))


def bodies(spark, key, **data):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in data.items()], f"{key} string, data binary")


def files(t):
    return {r.file_id: (r.status, bytes(r.data) if r.data is not None else None) for r in service.download(t, t.files).collect()}


def test_round_trip(spark, empty):
    body = bytes(i % 256 for i in range(700 * 1024))
    t, replies = service.upload(empty, bodies(spark, "request_id", a=body, none=None, empty=b"", big=b"x" * 800_000), 1000, SMALL, limit=750_000)
    r = {x.request_id: x for x in replies.collect()}
    assert {k: x.status for k, x in r.items()} == {"a": 201, "none": 400, "empty": 201, "big": 413}
    assert (r["a"].chunk_count, r["a"].size, r["empty"].chunk_count) == (3, 700 * 1024, 0) and r["none"].file_id is None
    assert files(t) == {r["a"].file_id: (200, body), r["empty"].file_id: (200, b"")}
    assert t.store.count() == 2  # the first two chunks are alike


def test_second_upload_adds_no_chunk(spark, empty):
    t, _ = service.upload(empty, bodies(spark, "request_id", a=b"\x07" * 400 * 1024), 1000, SMALL)
    n = t.store.count()
    t, _ = service.upload(t, bodies(spark, "request_id", b=b"\x07" * 400 * 1024), 2000, SMALL)
    assert t.store.count() == n == 2 and t.files.count() == 2


def test_update_of_one_file_keeps_the_other(spark, empty):
    c = StoreConfig(chunk_size=4)
    t, r = service.upload(empty, bodies(spark, "request_id", a=b"shrdaaaa", b=b"bbbbshrd"), 1000, c)
    ids = {x.request_id: x.file_id for x in r.collect()}
    before = t.manifest
    t, r = service.update(t, bodies(spark, "file_id", **{ids["a"]: b"newxyyyy", "missing": b"x", ids["b"]: None}), 2000, c)
    assert {x.file_id: x.status for x in r.collect()} == {ids["a"]: 200, "missing": 404, ids["b"]: 400}
    assert files(t) == {ids["a"]: (200, b"newxyyyy"), ids["b"]: (200, b"bbbbshrd")}
    orphans = catalog.orphans(before.unionByName(t.manifest), t.manifest)
    assert orphans.count() == 1  # aaaa; the shared chunk stays
    meta = {x.file_id: x for x in service.metadata(t, spark.createDataFrame([(ids["a"],), ("missing",)], "file_id string")).collect()}
    assert meta["missing"].status == 404 and meta[ids["a"]].status == 200 and len(meta[ids["a"]].versions) == 1


def test_missing_chunk_and_absent_file(spark, empty):
    t, _ = service.upload(empty, bodies(spark, "request_id", a=b"aaaabbbb"), 1000, StoreConfig(chunk_size=4))
    first = t.manifest.where("seq = 0").first().chunk_hash
    broken = service.Tables(t.files, t.versions, t.manifest, t.store.where(F.col("chunk_hash") != first))
    r = service.download(broken, t.files.select("file_id").unionByName(spark.createDataFrame([("nope",)], "file_id string"))).collect()
    got = {(x.status, x.first_missing, x.data) for x in r}
    assert got == {(500, first, None), (404, None, None)}


def test_presigned(spark, empty):
    t, _ = service.upload(empty, bodies(spark, "request_id", a=b"short text"), 1000, SMALL)
    f = t.files.first().file_id
    s = spark.range(1).select(presign.presign(F.lit("GET"), F.lit(f"/files/{f}/download-presigned"), F.lit(5000)).alias("s")).select("s.*").first()
    rows = [("ok", f, str(s.expires_at), s.signature, 6000), ("late", f, str(s.expires_at), s.signature, s.expires_at + 1), ("bad", f, str(s.expires_at), "0" * 64, 6000)]
    got = {r.request_id: (r.status, r.verdict, r.data) for r in service.presigned_download(t, spark.createDataFrame(rows, "request_id string, file_id string, expires string, sig string, now_ms long")).collect()}
    assert got == {"ok": (200, "ok", bytearray(b"short text")), "late": (403, "expired", None), "bad": (403, "tampered", None)}


def test_seeded_objects(spark):
    a, b = ({r.file_id: bytes(r.data) for r in objects.seeded_objects(spark, 3, 100, s).collect()} for s in (1, 2))
    assert len(a) == 3 and all(len(v) == 100 for v in a.values()) and len(set(a.values()) | set(b.values())) == 6
    assert a == {r.file_id: bytes(r.data) for r in objects.seeded_objects(spark, 3, 100, 1).collect()}


def test_published_dedup_measurement(spark, empty):
    """A = 512K + 4M shared + 512K, B = 256K + 4M shared + 1M: 39.0 % saved."""
    k = 1024
    part = {r.file_id: bytes(r.data) for n, s in ((4 * k * k, 1), (512 * k, 2), (512 * k, 3), (256 * k, 4), (k * k, 5)) for r in objects.seeded_objects(spark, 1, n, s, prefix=f"{s}_").collect()}
    shared, a0, a1, b0, b1 = (part[f"{s}_0"] for s in range(1, 6))
    t, _ = service.upload(empty, bodies(spark, "request_id", a=a0 + shared + a1, b=b0 + shared + b1), 1000, SMALL)
    cut = t.manifest.join(t.store.select("chunk_hash", F.octet_length("data").alias("chunk_size")), "chunk_hash")
    r = catalog.dedup_savings(cut).first()
    assert (r.total_bytes, r.unique_bytes, r.saved_bytes, r.saved_pct) == (10_747_904, 6_553_600, 4_194_304, 39.0)


def test_two_bodies_for_one_file_leave_one_version(spark, empty):
    t, replies = service.upload(empty, spark.createDataFrame([(1, bytearray(b"first"))], "request_id long, data binary"), 1000)
    file_id = replies.first().file_id
    bodies = spark.createDataFrame([(file_id, bytearray(b"one")), (file_id, bytearray(b"two")), (file_id, bytearray(b"two"))], "file_id string, data binary")
    after, said = service.update(t, bodies, 2000)
    assert [r.status for r in said.collect()] == [200, 200, 200]
    rows = after.files.collect()
    assert len(rows) == 1 and [r.version_id for r in after.versions.collect()] == [rows[0].current_version_id]
    assert bytes(service.download(after, after.files).first().data) in (b"one", b"two")
