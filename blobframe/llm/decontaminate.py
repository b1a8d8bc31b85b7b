"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Fixed masks pick token positions of a window and ignore the others, so a hash of the picked tokens survives substitutions at
the ignored ones. Hashes of the corpus are joined with those of the benchmark, and around each hit the two texts are compared
token by token along the hit's diagonal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Offsets that each mask reads in a window of SPAN tokens. Of the substitutions that the rule below accepts in an item of SPAN to
#: WINDOW tokens, each arrangement leaves some mask untouched at some place (a test enumerates them).
MASKS = ((0, 4, 5, 6, 7), (0, 1, 3, 4, 6), (0, 1, 3, 6, 7), (1, 3, 4, 5, 7))
SPAN = 8
#: A hit counts if, of WINDOW tokens of the item that hold it (or of the whole item where that is shorter), SHARE are equal.
WINDOW, SHARE = 16, 0.8
#: Bytes of the benchmark's seeds, and of its words, up to which they are broadcast; beyond it the joins shuffle.
BROADCAST_BYTES = 32 << 20


def words(text: str) -> Column:
    """Runs of letters and digits, lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _seeds(hashes: str) -> Column:
    """The masks' hashes at every position, one mask after the other, from the tokens' own hashes."""

    def at(mask: int):
        return lambda i: F.xxhash64(F.lit(mask), *[F.get(hashes, i + F.lit(o)) for o in MASKS[mask]])

    places = F.sequence(F.lit(0), F.size(hashes) - F.lit(SPAN))
    return F.when(F.size(hashes) >= SPAN, F.concat(*[F.transform(places, at(m)) for m in range(len(MASKS))]))


def _token_hashes(tokens: str) -> Column:
    return _held(F.transform(tokens, lambda w: F.xxhash64(w)))


def _held(value: Column) -> Column:
    """The value from a generator of one row: filters and projections above it use the result and do not repeat the work."""
    return F.explode_outer(F.array(value))


def _hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified hits: the columns k and h of docs, item, and the number of equal tokens on the diagonal. Seeds are joined without
    the texts they stand for; an item's words come to the hits, and where the join shuffles, the document's do too."""
    items = items.withColumn("id", F.xxhash64("item", "it")).distinct()
    n = F.size("g") - F.lit(SPAN - 1)
    bench = items.select("id", _token_hashes("it").alias("g")).select("id", "g", F.posexplode_outer(_seeds("g")).alias("x", "seed")).where("seed is not null")
    bench = bench.select("id", "seed", F.pmod("x", n).alias("ipos"), F.floor(F.col("x") / n).cast("int").alias("mask"))
    small = bench.count() * 64 <= BROADCAST_BYTES  # a row is four numbers and its overhead
    # outer generators, as an inner one would add a filter that computes the seeds once more; no seed joins with nothing
    seeds = docs.select("k", "h", "t", _token_hashes("t").alias("g")).select("k", "h", "t", F.size("t").alias("m"), _seeds("g").alias("seeds"))
    keep = ["k", "h", *(["t"] if small else [])]
    seeds = seeds.select(*keep, "m", F.posexplode_outer("seeds").alias("y", "seed"))
    met = seeds.join(F.broadcast(bench) if small else bench, "seed")
    met = met.select(*keep, "id", "ipos", (F.col("y") - F.col("mask") * (F.col("m") - F.lit(SPAN - 1)) - F.col("ipos")).alias("diag"))
    if not small:
        same = F.col("dh") == F.col("h")
        whole = docs.select(F.col("k").alias("dk"), F.col("h").alias("dh"), "t")
        met = met.distinct().join(whole, same & F.col("dk").eqNullSafe(F.col("k"))).drop("dk", "dh")
    words_bytes = items.agg(F.coalesce(F.sum(F.aggregate("it", F.lit(64).cast("long"), lambda s, w: s + F.octet_length(w) + F.lit(16))), F.lit(0))).first()[0]
    met = met.join(F.broadcast(items) if words_bytes <= BROADCAST_BYTES else items, "id")
    # equality of the item's tokens with the document's along the diagonal
    equal = F.transform("it", lambda w, j: F.when(F.col("diag") + j >= 0, F.coalesce(F.get("t", F.col("diag") + j) == w, F.lit(False))).otherwise(F.lit(False)).cast("int"))
    met = met.select("k", "h", "item", "ipos", F.size("it").alias("n"), _held(equal).alias("eq"))
    wide = F.least(F.lit(WINDOW), F.col("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("ipos") + SPAN - wide), F.least(F.col("ipos"), F.col("n") - wide))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, v: s + v)

    best = F.array_max(F.transform(starts, lambda s: total(F.slice("eq", s + F.lit(1), wide))))
    met = met.select("k", "h", "item", "n", _held(F.struct(best.alias("best"), total(F.col("eq")).alias("matched"), F.ceil(wide * F.lit(SHARE)).alias("least"))).alias("r"))
    return met.where("r.best >= r.least").select("k", "h", "item", "n", "r.matched")


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document that overlaps an item: key, text_hash, n_items, item_ids (ascending), matched (most equal tokens
    along one diagonal) and coverage (its largest share of an item). Documents and items of fewer words than a window, null
    and empty ones among them, never match; items with a null id are left out. Rows with equal key and text give one row; a
    null key is a key of its own. Clean documents give no row. Other columns are not read."""
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), words(text).alias("t"))
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), words(item_text).alias("it"))
    per = _hits(rows, items).groupBy("k", "h", "item").agg(F.max("matched").alias("m"), F.max(F.col("matched") / F.col("n")).alias("c"))
    return per.groupBy("k", "h").agg(
        F.count("*").alias("n_items"),
        F.sort_array(F.collect_set("item")).alias("item_ids"),
        F.max("m").alias("matched"),
        F.max("c").alias("coverage"),
    ).select(F.col("k").alias(key), F.col("h").alias("text_hash"), "n_items", "item_ids", "matched", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that overlap no benchmark item."""
    bad = contaminated(docs, benchmark, key, text)
    same = docs[key].eqNullSafe(bad[key]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def oracle_sql() -> str:
    """The same result in DuckDB SQL over `documents` and `benchmark`, with the picked tokens themselves in place of hashes."""
    pick = [" || ' ' || ".join(f"t[p + {o + 1}]" for o in m) for m in MASKS]
    seeds = lambda k: " union all ".join(f"select {k}, t, p, {i} as mask, {e} as seed from {k}_at" for i, e in enumerate(pick))
    at = lambda k, name: f"select {name} as {k}, t, unnest(range(0, len(t) - {SPAN - 1})) as p from {k}_words where len(t) >= {SPAN}"
    split = lambda k, name, tab: f"select {name}, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') as t from {tab}"
    return f"""
with doc_words as ({split("doc", "doc_id", "documents")}), item_words as ({split("item", "item_id", "benchmark")} where item_id is not null),
doc_at as ({at("doc", "doc_id")}), item_at as ({at("item", "item_id")}),
doc_seeds as ({seeds("doc")}), item_seeds as ({seeds("item")}),
met as (select d.doc, i.item, i.p as ipos, len(i.t) as n, list_transform(range(0, len(i.t)), lambda j: case when d.p - i.p + j >= 0
  and d.t[greatest(d.p - i.p + j, 0) + 1] = i.t[j + 1] then 1 else 0 end) as eq, least({WINDOW}, len(i.t)) as wide
  from doc_seeds d join item_seeds i on d.mask = i.mask and d.seed = i.seed),
good as (select doc, item, n, list_sum(eq) as matched from met where list_max(list_transform(
  range(greatest(0, ipos + {SPAN} - wide), least(ipos, n - wide) + 1), lambda s: list_sum(eq[s + 1 : s + wide]))) >= ceil(wide * {SHARE}))
select doc as doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as item_ids,
  cast(max(matched) as bigint) as matched, round(max(matched / n), 6) as coverage from good group by doc"""
