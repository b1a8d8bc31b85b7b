import math

import numpy as np
from pyspark.sql import types as T

from blobframe.llm import covertree, queries

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("node", T.StringType())])


def brute(rows, cosine=0.93):
    ok = [r for r in rows if r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])]
    links, root = {r[0]: 0 for r in rows}, {r[0]: r[0] for r in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[i + 1 :]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= cosine:
                    links[a[0]] += 1
                    links[b[0]] += 1
                    x, y = top(a[0]), top(b[0])
                    root[max(x, y)] = min(x, y)
    return {k: (links[k], top(k), top(k) == k) for k in links}


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = queries.op7_embedding_dedup(spark, "/root/testdata/sf0.001").collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows) and len(got) == len(rows)


def test_blocks_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 16)
    rnd = np.random.default_rng(2)
    rows = []
    for i in range(160):
        base = np.random.default_rng(i % 9).standard_normal(6)
        rows.append((i, [float(np.float32(x)) for x in base + 0.25 * rnd.standard_normal(6)], 0 if i % 4 else 1))
    rows += [(200 + i, rows[3][1], 0) for i in range(40)]  # many copies of one vector
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 6, 0), (303, [float("nan")] + [1.0] * 5, 0), (304, [None] + [1.0] * 5, 0), (305, rows[3][1], None), (306, [float("inf")] + [1.0] * 5, 0), (307, [1.0, 2.0], 0), (308, [2.0, 4.0], 0)]
    got = covertree.near_duplicates(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == brute(rows)
    assert covertree.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tree_pairs():
    rnd = np.random.default_rng(1)
    x = rnd.standard_normal((300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = covertree.CoverTree(x[:200]), covertree.CoverTree(x[200:])
    for u, v in ((a, a), (a, b)):
        i, j = covertree.linked_pairs(u, v, 0.9)
        want = {(min(p, q), max(p, q)) if u is v else (p, q) for p, q in zip(*np.nonzero(u.x @ v.x.T >= 0.9)) if u is not v or p != q}
        got = [(min(p, q), max(p, q)) if u is v else (p, q) for p, q in zip(i.tolist(), j.tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_traversal_prunes_clusters():
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((40, 16))
    x = np.repeat(centres, 25, axis=0) + 0.02 * rnd.standard_normal((1000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t, tally = covertree.CoverTree(x), []
    i, j = covertree.linked_pairs(t, t, 0.93, tally)
    assert len(i) == int((np.triu(x @ x.T, 1) >= 0.93).sum())
    assert tally[0] + t.compared < 0.2 * len(x) ** 2


def test_trees_are_the_same_when_read_back():
    rnd = np.random.default_rng(4)
    x = rnd.standard_normal((500, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = covertree.CoverTree(x)
    u = covertree.CoverTree.loaded(4, **t.dumped())
    assert u.centre == t.centre and u.radius == t.radius
    for k in range(len(t.centre)):
        assert sorted(u.points[k].tolist()) == sorted(t.points[k].tolist()) and np.array_equal(u.children[k], t.children[k]) if t.children[k] is not None else u.children[k] is None
    far = np.sqrt(np.maximum(0, 2 - 2 * x @ x.T))
    for k, c in enumerate(t.centre):
        assert far[c, t.points[k]].max() <= t.radius[k] + 1e-6


def test_rows_that_repeat_a_key(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, a, 0, "x"), (1, b, 0, "x"), (2, a, 0, "x"), (2, b, 0, "x"), (3, b, 0, "x"), (3, b, 0, "x"), (None, a, 0, "x")]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert got == [(1, 1, 1, True), (1, 3, 1, True), (2, 1, 1, False), (2, 3, 1, False), (3, 3, 1, False), (3, 3, 1, False), (None, 0, None, False)]
    assert [r.vec_id for r in covertree.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]
