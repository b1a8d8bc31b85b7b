import itertools
import random
from collections import Counter

import numpy as np

from blobframe.llm import quality, queries


def test_em_recovers_planted_accuracies():
    r, right = random.Random(3), [0.95, 0.9, 0.8, 0.85, 0.7]
    rows = Counter()
    for _ in range(6000):
        y = r.random() < 0.6
        v = tuple((int(y) if r.random() < a else 1 - int(y)) if r.random() < 0.8 else -1 for a in right)
        rows[v] += 1
    share, table, post = quality.weak_label_model(sorted(rows.items()))
    assert abs(share - 0.6) < 0.04
    for j, a in enumerate(right):
        assert abs(table[j, 0, 1] - a) < 0.06 and abs(table[j, 1, 2] - a) < 0.06
    # posteriors equal a direct product over labellers
    for v in itertools.islice(rows, 20):
        good, bad = share, 1 - share
        for j, x in enumerate(v):
            if x >= 0:
                good *= table[j, 1, x + 1]
                bad *= table[j, 0, x + 1]
        assert abs(post[v] - good / (good + bad)) < 1e-3


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.kept == (r.score >= 0.5) == bool(r.predicted) for r in rows.values())
    good = [rows[k].kept for k, q in truth.items() if q == 1]
    bad = [rows[k].kept for k, q in truth.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "One fine sentence is here. And one more follows it.", "c"), (4, "word " * 30000, "d"), (4, "word " * 30000, "d")], "doc_id long, text string, v string")
    model = quality.fit(df)
    out = quality.score(df, model).collect()
    assert len(out) == 5 and all(0 <= r.quality <= 1 for r in out) and out[0].v == "a"
    none = df.where("false")
    assert quality.drop_low_quality(none, quality.fit(none)).count() == 0


def test_query_equals_plain_version(spark):
    import struct

    import xxhash

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    voted = {k: tuple(quality.votes(quality.statistics(t))) for k, t in texts.items()}
    _, _, post = quality.weak_label_model(sorted(Counter(voted.values()).items()))
    key = {k: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0] for k, t in texts.items()}
    picked = {}
    for good in (True, False):
        rows = sorted({(key[k], ",".join(map(str, v)), k) for k, v in voted.items() if (post[v] >= 0.5) == good})
        first = {}
        for h, _, k in rows:
            first.setdefault(h, k)
        picked |= {h: (k, post[voted[k]]) for h, k in list(first.items())[: quality.SAMPLE // 2]}
    order = sorted(picked)
    w = quality.train_scorer([quality.hashed(texts[picked[h][0]]) for h in order], [picked[h][1] for h in order])
    got = {r.doc_id: r.score for r in queries.op2_quality(spark, sf).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        assert abs(got[k] - quality.score_text(t, w)) < 1e-6
