"""Files, versions, manifests and reference counts.

Every statement of the catalogue is a function of whole tables, so a partial commit cannot exist: what an update leaves behind
is what the next snapshot of the tables says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .replication import get_status


def create_files(files: DataFrame, new: DataFrame) -> DataFrame:
    """Adds files (file_id, created_at) that have no version yet."""
    return files.unionByName(new.select("file_id", "created_at", F.lit(None).cast("string").alias("current_version_id")))


def commit(versions: DataFrame, manifest: DataFrame, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Appends commits (version_id, file_id, size, created_at, hashes) to both tables."""
    rows = commits.select("version_id", F.posexplode("hashes").alias("seq", "chunk_hash"))
    return versions.unionByName(commits.drop("hashes")), manifest.unionByName(rows)


def current_versions(versions: DataFrame, *order: Column, file: str = "file_id", version: str = "version_id") -> DataFrame:
    """(file, current version): the last commit in the given order, ties by version id. A partial aggregate, not a window."""
    last = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(version).alias("v"))
    return versions.groupBy(file).agg(F.max(last).alias("last")).select(file, F.col("last.v").alias("current_version_id"))


def history(versions: DataFrame) -> DataFrame:
    """Versions with their place in the file's history and whether they are its last."""
    w = W.partitionBy("file_id").orderBy("created_at", "version_id")
    return versions.withColumn("version_no", F.row_number().over(w)).withColumn("is_current", F.lead("version_id").over(w).isNull())


def version_hashes(manifest: DataFrame) -> DataFrame:
    """One row per version with its hashes in order."""
    rows = manifest.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk_hash"))).alias("rows"))
    return rows.select("version_id", F.transform("rows", lambda r: r["chunk_hash"]).alias("hashes"), F.size("rows").alias("chunk_count"))


def live_manifest(manifest: DataFrame, current: DataFrame) -> DataFrame:
    return manifest.join(current.select(F.col("current_version_id").alias("version_id")), "version_id", "left_semi")


def refcounts(manifest: DataFrame) -> DataFrame:
    """References per chunk; each occurrence in a manifest counts."""
    return manifest.groupBy("chunk_hash").agg(F.count("*").alias("refcount"))


def add_refcounts(counts: DataFrame, added: DataFrame, sign: int = 1) -> DataFrame:
    """Upserts the occurrences of manifest rows into a table of counts; with sign -1 it takes them off."""
    change = refcounts(added).select("chunk_hash", (F.col("refcount") * sign).alias("change"))
    return counts.join(change, "chunk_hash", "full").select("chunk_hash", (F.coalesce("refcount", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("refcount"))


def refcount_of(hashes: DataFrame, counts: DataFrame) -> DataFrame:
    return hashes.join(counts, "chunk_hash", "left").select("chunk_hash", F.coalesce("refcount", F.lit(0)).alias("refcount"))


def orphans(committed: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks that were committed once and that no live manifest row refers to."""
    return committed.select("chunk_hash").distinct().join(live.select("chunk_hash"), "chunk_hash", "left_anti")


def dropped_by_file(old: DataFrame, new: DataFrame, file: str = "file_id") -> DataFrame:
    """The unsafe rule, kept as a negative control: chunks that some file's new version dropped, although another file may
    still hold them."""
    return old.select(file, "chunk_hash").distinct().join(new.select(file, "chunk_hash"), [file, "chunk_hash"], "left_anti").select("chunk_hash").distinct()


def delete_versions(versions: DataFrame, manifest: DataFrame, counts: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes versions (version_id): their rows, their manifest and their references. Unknown ids do nothing; the pointer in
    files stays as it is."""
    ids = gone.select("version_id").distinct()
    removed = manifest.join(ids, "version_id", "left_semi")
    return versions.join(ids, "version_id", "left_anti"), manifest.join(ids, "version_id", "left_anti"), add_refcounts(counts, removed, -1)


def reap(counts: DataFrame, reaped: DataFrame) -> DataFrame:
    return counts.join(reaped.select("chunk_hash"), "chunk_hash", "left_anti")


def dangling_pointers(files: DataFrame, versions: DataFrame) -> DataFrame:
    """Files whose current version has no row."""
    ids = versions.select(F.col("version_id").alias("current_version_id"))
    return files.where("current_version_id is not null").join(ids, "current_version_id", "left_anti")


def store_put(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_hash, data) that a store does not hold yet, one row per hash, after their hash is checked."""
    new = chunks.join(store.select("chunk_hash"), "chunk_hash", "left_anti")  # before any bytes are hashed or told apart
    return new.where(F.sha2("data", 256) == F.col("chunk_hash")).dropDuplicates(["chunk_hash"])


def store_get(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of wanted (chunk_hash): status (200, 404 where the store has no such chunk, 409 where its bytes have another hash) and data,
    null unless the status is 200."""
    held = store.select("chunk_hash", "data", F.lit(True).alias("_held"))
    got = wanted.select("chunk_hash").distinct().join(held, "chunk_hash", "left")
    status = get_status(F.coalesce("_held", F.lit(False)), F.coalesce(F.sha2("data", 256) == F.col("chunk_hash"), F.lit(False)))
    return got.select("chunk_hash", status.alias("status"), F.when(status == 200, F.col("data")).alias("data"))


def store_delete(store: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The store without the chunks of gone (chunk_hash), and for each of these whether it was there. Unknown ones do nothing."""
    ids = gone.select("chunk_hash").distinct()
    held = store.select("chunk_hash", F.lit(True).alias("_held")).distinct()
    replies = ids.join(held, "chunk_hash", "left").select("chunk_hash", F.coalesce("_held", F.lit(False)).alias("deleted"))
    return store.join(ids, "chunk_hash", "left_anti"), replies


def unreferenced(held: DataFrame, live: DataFrame) -> DataFrame:
    """Chunks and bytes of held (chunk_hash, chunk_size) that no row of live refers to."""
    idle = held.dropDuplicates(["chunk_hash"]).join(live.select("chunk_hash"), "chunk_hash", "left_anti")
    return idle.agg(F.count("*").alias("chunks"), F.coalesce(F.sum("chunk_size"), F.lit(0)).cast("long").alias("bytes"))


def dedup_savings(chunks: DataFrame, *by: str) -> DataFrame:
    """Bytes of all chunks, bytes of distinct ones, and what is saved, over all rows or within groups."""
    per = chunks.groupBy(*by, "chunk_hash").agg(F.count("*").alias("n"), F.max("chunk_size").cast("long").alias("s"))
    sums = [F.sum(F.col("s") * F.col("n")).alias("total_bytes"), F.sum("s").alias("unique_bytes"), F.sum("n").alias("chunk_rows"), F.count("*").alias("unique_chunks")]
    out = per.groupBy(*by).agg(*sums) if by else per.agg(*sums)
    out = out.withColumn("saved_bytes", F.col("total_bytes") - F.col("unique_bytes"))
    return out.withColumn("saved_pct", F.round(F.col("saved_bytes") * 100.0 / F.col("total_bytes"), 1))


def percent_text(part: Column, whole: Column) -> Column:
    """A share as text with one decimal place and the sign."""
    return F.format_string("%.1f%%", part * F.lit(100.0) / whole)
