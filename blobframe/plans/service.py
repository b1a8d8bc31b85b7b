"""The store's routes as plans over its tables: upload, update, metadata, download, presigned download."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COORDINATOR_BODY_LIMIT, DEV_SECRET, StoreConfig
from ..functions import chunking, presign
from ..functions.hashing import deterministic_id
from ..operators import catalog
from ..sources.objects import body_split


@dataclass(frozen=True)
class Tables:
    """A snapshot of the store. A change gives a new one, so there is no partial commit."""

    files: DataFrame
    versions: DataFrame
    manifest: DataFrame
    store: DataFrame


def _cut(bodies: DataFrame, config: StoreConfig) -> DataFrame:
    return chunking.chunk(bodies, config.chunk_size, key="version_id", keep_data=True)


def _commit(bodies: DataFrame, created: DataFrame, t: Tables, now_ms: int, config: StoreConfig, files: DataFrame) -> Tables:
    """bodies: (file_id, version_id, data)."""
    cut = _cut(bodies, config)
    versions = bodies.select("version_id", "file_id", F.octet_length("data").cast("long").alias("size"), F.lit(now_ms).cast("long").alias("created_at"))
    new = catalog.store_put(t.store, cut.select("chunk_hash", "data"))
    current = bodies.select("file_id", F.col("version_id").alias("_v"))
    pointed = files.join(current, "file_id", "left").select("file_id", "created_at", F.coalesce("_v", "current_version_id").alias("current_version_id"))
    return Tables(pointed, t.versions.unionByName(versions), t.manifest.unionByName(cut.select("version_id", "seq", "chunk_hash")), t.store.unionByName(new.select("chunk_hash", "data")))


def _version_id(file_id: Column, data: Column, now_ms: int) -> Column:
    return deterministic_id("ver", file_id, F.lit(str(now_ms)), F.sha2(data, 256))


def upload(t: Tables, objects: DataFrame, now_ms: int, config: StoreConfig = StoreConfig(), limit: int = COORDINATOR_BODY_LIMIT) -> tuple[Tables, DataFrame]:
    """New files of objects (request_id, data). Replies: request_id, status (201, 400 without a body, 413 over the limit),
    file_id, version_id, chunk_count, size."""
    split = body_split(objects, limit).withColumn("file_id", deterministic_id("file", F.col("request_id").cast("string"), F.lit(str(now_ms))))
    split = split.withColumn("version_id", _version_id(F.col("file_id"), F.col("data"), now_ms))
    taken = split.where("status = 201")
    made = catalog.create_files(t.files, taken.select("file_id", F.lit(now_ms).cast("long").alias("created_at")))
    after = _commit(taken.select("file_id", "version_id", "data"), made, t, now_ms, config, made)
    size = F.octet_length("data").cast("long")
    ok = F.col("status") == 201
    replies = split.select("request_id", "status", *[F.when(ok, c).alias(n) for c, n in ((F.col("file_id"), "file_id"), (F.col("version_id"), "version_id"), (F.ceil(size / F.lit(config.chunk_size)), "chunk_count"), (size, "size"))])
    return after, replies


def update(t: Tables, bodies: DataFrame, now_ms: int, config: StoreConfig = StoreConfig(), limit: int = COORDINATOR_BODY_LIMIT) -> tuple[Tables, DataFrame]:
    """New versions of files from bodies (file_id, data). The previous version's rows go, its chunks stay for collection. Of
    several bodies for one file, which a batch gives no order, each is answered and the one with the greatest version id stays.
    Replies: file_id, status (404 comes before 400 and 413), version_id, previous_version_id."""
    split = body_split(bodies, limit).join(t.files.select("file_id", F.col("current_version_id").alias("previous_version_id"), F.lit(True).alias("_known")), "file_id", "left")
    split = split.withColumn("status", F.when(F.col("_known").isNull(), 404).when(F.col("status") == 201, 200).otherwise(F.col("status")))
    split = split.withColumn("version_id", _version_id(F.col("file_id"), F.col("data"), now_ms))
    taken = split.where("status = 200").dropDuplicates(["file_id", "version_id"])
    last = taken.groupBy("file_id").agg(F.max("version_id").alias("version_id"))
    taken = taken.join(last, ["file_id", "version_id"], "left_semi")
    after = _commit(taken.select("file_id", "version_id", "data"), t.files, t, now_ms, config, t.files)
    gone = taken.where("previous_version_id is not null and previous_version_id <> version_id").select(F.col("previous_version_id").alias("version_id")).distinct()
    after = Tables(after.files, after.versions.join(gone, "version_id", "left_anti"), after.manifest.join(gone, "version_id", "left_anti"), after.store)
    ok = F.col("status") == 200
    return after, split.select("file_id", "status", F.when(ok, F.col("version_id")).alias("version_id"), F.when(ok, F.col("previous_version_id")).alias("previous_version_id"))


def metadata(t: Tables, wanted: DataFrame) -> DataFrame:
    """Of wanted (file_id): status (200 or 404), the file's row and its versions in order of creation."""
    ids = wanted.select("file_id").distinct()
    rows = t.versions.join(ids, "file_id", "left_semi").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("created_at", "version_id", "size"))).alias("versions"))
    found = t.files.join(ids, "file_id", "left_semi").join(rows, "file_id", "left").withColumn("_known", F.lit(True))
    return wanted.select("file_id").join(found, "file_id", "left").select("file_id", F.when(F.col("_known"), 200).otherwise(404).alias("status"), "created_at", "current_version_id", "versions")


def download(t: Tables, wanted: DataFrame) -> DataFrame:
    """Of wanted (file_id): status (200, 404 without file or version, 500 if a chunk is missing), data and first_missing. Only
    the narrow manifest of what is asked for is joined before the bytes are."""
    at = wanted.select("file_id").distinct().join(t.files, "file_id", "left").join(t.versions.select("version_id", F.lit(True).alias("_has")), F.col("current_version_id") == F.col("version_id"), "left")
    m = t.manifest.join(at.where("_has").select("version_id", "file_id"), "version_id")
    whole = chunking.reassemble(m, t.store)
    out = at.select("file_id", "_has").join(whole, "file_id", "left")
    status = F.when(F.col("_has").isNull(), 404).when(F.col("missing") > 0, 500).otherwise(200)
    empty = F.when(status == 200, F.coalesce("data", F.lit(bytearray())))
    return out.select("file_id", status.alias("status"), empty.alias("data"), "first_missing")


def presigned_download(t: Tables, requests: DataFrame, secret: str = DEV_SECRET) -> DataFrame:
    """Of requests (request_id, file_id, expires, sig, now_ms): 403 with the check that failed, or what download() says."""
    path = F.concat(F.lit("/files/"), F.col("file_id"), F.lit("/download-presigned"))
    checked = requests.withColumn("verdict", presign.verify(F.lit("GET"), path, F.col("expires"), F.col("sig"), F.col("now_ms"), secret))
    got = download(t, checked.where("verdict = 'ok'"))
    out = checked.join(got, "file_id", "left")
    return out.select("request_id", "file_id", "verdict", F.when(F.col("verdict") != "ok", 403).otherwise(F.col("status")).alias("status"), F.when(F.col("verdict") == "ok", F.col("data")).alias("data"))
