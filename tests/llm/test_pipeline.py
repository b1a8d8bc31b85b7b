import json
import re

import public_tokenizers as P

import corpus_pipeline
from blobframe.llm import bpe, queries, secrets, toxicity
from test_shingles import kept_brute

SF = "/root/testdata/sf0.001"


def test_run_equals_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    net = toxicity.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [k for k, s in zip(docs, toxicity.score_texts(net, [r.text for r in docs.values()])) if s < 0.5]
    stay = kept_brute({k: docs[k].text for k in kept})
    kept = [k for k in kept if k in stay]

    def leaks(text):
        w = re.findall(r"[^\W_]+", text.lower())
        for it in items:
            n = min(16, len(it))
            for d in range(-len(it), len(w)):
                eq = [0 <= d + j < len(w) and w[d + j] == x for j, x in enumerate(it)]
                if sum(eq) >= 8 and any(sum(eq[s : s + n]) >= 0.8 * n for s in range(len(it) - n + 1)):
                    return True
        return False

    kept = [k for k in kept if not leaks(docs[k].text)]
    tok = bpe.tokenizer(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = {}
    for k in kept:
        text = secrets.redact(docs[k].text, secrets.scan(docs[k].text))
        want[k] = (docs[k].lang, docs[k].source, len(text), tok.encode(text))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)
    assert {r.doc_id: (r.lang, r.source, r.n_chars, list(r.ids)) for r in rows} == want and len(rows) == len(want)
    assert 0 < len(want) < len(docs)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    empty = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_toxicity_held_out(spark):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert sum(p == y for p, y in held) / len(held) > 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_toxicity_gradient_matches_differences():
    import numpy as np

    net = toxicity.Network(["bad", "good"], seed=1)
    w = toxicity.Windows(["bad good other words", "good x"])
    feats, ids, rows = net.features(w.words)
    at, mask = w.take(np.arange(2), len(feats))
    y = np.array([1.0, 0.0], np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    loss = lambda: float(np.mean(np.logaddexp(0, (z := net.logits(net.features(w.words)[0], at, mask).astype(float))) - y * z))
    g = net.gradients(*net.features(w.words)[:1], (ids, rows), at, mask, y)
    for k in ("uf", "wb", "a", "v", "o", "cf", "word"):
        i = tuple(int(x) for x in np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape))
        old, eps = net.p[k][i], 1e-3
        net.p[k][i] = old + eps
        up = loss()
        net.p[k][i] = old - eps
        down = loss()
        net.p[k][i] = old
        assert abs((up - down) / (2 * eps) - g[k][i]) < 0.02 * abs(g[k][i]) + 1e-4, k


def test_odd_texts():
    import numpy as np

    net = toxicity.train(["you idiot"] * 5 + ["fine words here"] * 9, [1] * 5 + [0] * 9)
    s = toxicity.score_texts(net, ["", None, "word " * 5000 + "you idiot", "x" * 20000])
    assert np.isfinite(s).all() and ((s >= 0) & (s <= 1)).all()
    assert toxicity.window_starts(64) == [0] and toxicity.window_starts(65) == [0, 1] and toxicity.window_starts(200) == [0, 48, 96, 136]
    only = toxicity.train(["a", "b"], [0, 0])
    assert (toxicity.score_texts(only, ["a", ""]) < 0.5).all()
    assert json.dumps(toxicity.split_words(None)) == "[]"


def test_toxicity_query_equals_plain_version(spark):
    import struct
    import zlib

    import xxhash

    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    marks = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if r.toxic is not None and r.doc_id in rows and zlib.crc32(str(r.doc_id).encode()) % 5:
            marks[r.doc_id] = max(marks.get(r.doc_id, 0), r.toxic)
    order = sorted(marks, key=lambda k: (struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", k), 42)))[0], k))
    used = sorted([k for k in order if marks[k]][: toxicity.SAMPLE_TOXIC] + [k for k in order if not marks[k]][: toxicity.SAMPLE_CLEAN])
    net = toxicity.train([rows[k] for k in used], [marks[k] for k in used])
    want = dict(zip(rows, toxicity.score_texts(net, list(rows.values()))))
    got = queries.op8_toxicity(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-3 and r.predicted == (r.score >= 0.5)


def test_long_documents_are_learnt_from():
    """Beside short ones: a word that only long toxic documents hold counts."""
    filler = "plain words of an ordinary kind that say nothing at all "
    toxic = ["you rotten idiot"] * 20 + [filler * 150 + "you rotten scumbag " + filler * 150] * 20
    clean = [filler * 300] * 20 + ["you are kind", "words of kind people", "all at an ordinary place"] * 15
    net = toxicity.train(toxic + clean, [1] * len(toxic) + [0] * len(clean))
    s = toxicity.score_texts(net, [toxic[0], toxic[-1], clean[0], clean[-1]])
    assert min(s[:2]) >= 0.5 > max(s[2:])
