import re

from pyspark.sql import types as T

from blobframe.llm import decontaminate, queries, secrets, simhash, toxicity

ITEM = "What is the name of the long river that crosses the old town before it meets the sea in the north"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("k", "_k", "h", "text_hash", "item", "n", "simhash", "_key", "t")]])


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, *["x"] * 9) for i, t in enumerate(texts)], SCHEMA)


def changed(text, *at):
    w = text.split()
    for i in at:
        w[i] = "other"
    return " ".join(w)


def test_substitutions(spark):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short to count"), (None, ITEM), (3, None), (4, "")], "item_id long, text string")
    d = docs(
        spark, f"Intro words. {ITEM}? And more.", f"Some {changed(ITEM, 4, 12)} end", f"Some {changed(ITEM, *range(0, 20, 3))} end", "nothing of it here at all, " * 5,
        " ".join(ITEM.split()[:12]) + " goes elsewhere now", None, "", f"Intro words. {ITEM}? And more.", ITEM.upper(), "too short to count", "  " + ITEM.replace(" ", ",  "),
    )
    rows = {r.doc_id: r for r in decontaminate.contaminated(d, bench).collect()}
    assert set(rows) == {0, 1, 7, 8, 10}
    assert list(rows[0].item_ids) == [1] and rows[0].matched == 21 and rows[0].coverage == 1.0 and rows[1].matched == 19
    kept = decontaminate.drop_contaminated(d, bench)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 9]
    assert decontaminate.drop_contaminated(d, bench.where("false")).count() == 11
    assert decontaminate.contaminated(d.where("false"), bench).count() == 0


def test_join_without_broadcast_is_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    a = {tuple(r) for r in queries.op5_decontaminate(spark, sf).collect()}
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert a and a == {tuple(r) for r in queries.op5_decontaminate(spark, sf).collect()}


def test_whole_items_are_found(spark):
    sf = "/root/testdata/sf0.01"
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    items = [norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(i in norm(r.text) for i in items)}
    assert want and want <= {r.doc_id for r in queries.op5_decontaminate(spark, sf).collect()}


def test_native_plan(spark):
    plan = queries.op5_decontaminate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|NestedLoop|Cartesian", plan)


def test_clashing_columns(spark):
    d = docs(spark, "one text that is here", "password=abcdefgh", "you idiot", None)
    net = toxicity.train(["you idiot"] * 4 + ["fine words"] * 6, [1] * 4 + [0] * 6)
    for out in (secrets.redact_secrets(d), toxicity.drop_toxic(d, net), simhash.drop_near_duplicates(d)):
        assert out.columns == d.columns and out.count() >= 3


def test_masks_miss_no_accepted_substitutions():
    import itertools
    import math

    for n in range(decontaminate.SPAN, decontaminate.WINDOW + 1):
        for out in itertools.combinations(range(n), n - math.ceil(n * decontaminate.SHARE)):
            assert any(not any(s + o in out for o in m) for m in decontaminate.MASKS for s in range(n - decontaminate.SPAN + 1)), (n, out)
