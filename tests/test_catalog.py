"""Versions, reference counts, orphans and their collection."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blobframe.operators import catalog, gc, ring
from blobframe.schemas import FILES, MANIFEST, NODES, REFCOUNTS, VERSIONS


def manifest(spark, **versions):
    return spark.createDataFrame([(v, i, h) for v, hs in versions.items() for i, h in enumerate(hs)], MANIFEST)


def counts(df):
    return {r.chunk_hash: r.refcount for r in df.collect()}


def test_duplicates_count(spark):
    assert counts(catalog.refcounts(manifest(spark, v=["a", "b", "a"]))) == {"a": 2, "b": 1}


def test_shared_chunk_survives(spark):
    m = manifest(spark, va=["shared", "only"], vb=["shared"])
    v = spark.createDataFrame([("va", "fa", 2, 1), ("vb", "fb", 1, 2)], VERSIONS)
    gone = spark.createDataFrame([("va",), ("unknown",)], "version_id string")
    v2, m2, c2 = catalog.delete_versions(v, m, catalog.refcounts(m), gone)
    assert counts(c2) == {"shared": 1, "only": 0} and v2.count() == 1 and m2.count() == 1
    assert [r.chunk_hash for r in catalog.orphans(m, m2).collect()] == ["only"]
    asked = spark.createDataFrame([("shared",), ("never",)], "chunk_hash string")
    assert counts(catalog.refcount_of(asked, c2)) == {"shared": 1, "never": 0}
    assert counts(catalog.reap(c2, c2.where("refcount <= 0"))) == {"shared": 1}


def test_order_and_current(spark):
    files = catalog.create_files(spark.createDataFrame([], FILES), spark.createDataFrame([("f", 1)], "file_id string, created_at long"))
    assert files.first().current_version_id is None
    v0, m0 = spark.createDataFrame([], VERSIONS), spark.createDataFrame([], MANIFEST)
    c = spark.createDataFrame([("v1", "f", 5, 10, ["h3", "h1", "h4", "h1", "h5"]), ("v2", "f", 1, 20, ["h9"]), ("v3", "f", 0, 30, [])], "version_id string, file_id string, size long, created_at long, hashes array<string>")
    v, m = catalog.commit(v0, m0, c)
    assert {r.version_id: list(r.hashes) for r in catalog.version_hashes(m).collect()} == {"v1": ["h3", "h1", "h4", "h1", "h5"], "v2": ["h9"]}
    assert catalog.current_versions(v, F.col("created_at")).first().current_version_id == "v3"
    assert [(r.version_id, r.version_no, r.is_current) for r in catalog.history(v).orderBy("version_no").collect()] == [("v1", 1, False), ("v2", 2, False), ("v3", 3, True)]
    dangling = spark.createDataFrame([("f", 1, "v9"), ("g", 1, None), ("h", 1, "v1")], FILES)
    assert [r.file_id for r in catalog.dangling_pointers(dangling, v).collect()] == ["f"]


def test_update_of_one_file_leaves_the_other(spark):
    """The unsafe rule would collect a chunk that another file holds; the orphan rule does not."""
    old, new = manifest(spark, a1=["s", "x"], b1=["y", "s"]), manifest(spark, a2=["z"], b1=["y", "s"])
    of = lambda m: m.withColumn("file_id", F.substring("version_id", 1, 1))
    assert {r.chunk_hash for r in catalog.dropped_by_file(of(old), of(new)).collect()} == {"s", "x"}
    assert {r.chunk_hash for r in catalog.orphans(old, new).collect()} == {"x"}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcdef"), st.lists(st.sampled_from("uvwxyz"), max_size=6), min_size=1), st.sets(st.sampled_from("abcdef")))
def test_counts_equal_live_occurrences(spark, versions, deleted):
    m = manifest(spark, **versions)
    v = spark.createDataFrame([(k, "f", 0, 0) for k in versions], VERSIONS)
    _, left, c = catalog.delete_versions(v, m, catalog.refcounts(m), spark.createDataFrame([(d,) for d in deleted], "version_id string"))
    live = [h for k, hs in versions.items() if k not in deleted for h in hs]
    assert counts(c) == {h: live.count(h) for hs in versions.values() for h in hs}
    assert {r.chunk_hash for r in catalog.orphans(m, left).collect()} == {h for h, n in counts(c).items() if n == 0}


def test_sweep(spark):
    nodes = spark.createDataFrame([(f"n{i}", None, i) for i in range(3)], NODES)
    c = spark.createDataFrame([("shared", 2), ("gone", 0), ("gone2", 0)], REFCOUNTS)
    orphans = c.where("refcount <= 0").select("chunk_hash")
    placed = ring.ranked(ring.place(orphans, ring.arcs(nodes, 3))).select("chunk_hash", "node_id")
    sizes = spark.createDataFrame([("gone", 10), ("gone2", 20)], "chunk_hash string, chunk_size int")
    swept = gc.sweep(orphans, placed, nodes.where("add_order < 2"), sizes)
    assert gc.summary(swept, 262_144).first()[:] == (2, 2, 2 * 262_144, 30)
    assert {r.reached for r in swept.collect()} == {2}
    down = gc.sweep(orphans, placed, nodes.where("false"), sizes)
    assert gc.summary(down).first()[:] == (2, 0, 0, 0)
    assert counts(gc.next_counts(c, down)) == {"shared": 2}  # reaped all the same
