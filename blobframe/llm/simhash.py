"""SimHash near-duplicate detection over word shingles.

Candidates come from an inverted index on byte positions of the 64-bit fingerprint with count filtering. Fingerprints that
differ in at most d bits share at least 8 - d of their 8 positional bytes. Postings are by few positions at a time, so chosen
that any 8 - d positions hold those of some posting: every linked pair meets. Where two meet, their shared positional bytes are
tallied, pairs below the guaranteed count go, and the exact distance of the others is verified, once for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import OWN, components, cut, ship

#: A posting of more fingerprints than this is dealt over pairs of its blocks.
BLOCK = 2048
_ONES, _GATHER = np.uint64(0x0101010101010101), np.uint64(0x0102040810204080)


def text_fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit i is 1 if more than half of the shingle hashes have it; no words: zero."""
    if not text:
        return 0
    raw = text.encode("utf-8", "replace")
    w = raw.lower().split()  # bytes.lower() and bytes.split() know A-Z and exactly these six blanks
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= words:
        return xxhash.xxh64_intdigest(line, seed)
    end = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], end[:-1] + 1])
    stop = end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[a:b], seed) for a, b in zip(starts[: len(stop)].tolist(), stop, strict=True)], dtype=np.uint64, count=len(stop))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 8192):
        ones += np.unpackbits(h[at : at + 8192, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", output: str = "simhash", words: int = 4) -> DataFrame:
    """Adds `output` (bigint, the fingerprint's bits as signed). Null, empty and blank texts have fingerprint zero; a text of
    fewer words than a shingle hashes them all as one. A column named `output` is replaced."""
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(output, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, text):
                f = np.array([text_fingerprint(t, words) for t in b.column(text).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(f)], names=[*keep, output])

    return df.mapInArrow(run, schema)


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """Edges that keep the connectivity of the given ones, at most one per node."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := root.get(x, x)) != x:
            root[x] = root.get(p, p)
            x = root[x]
        return x

    out = []
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        a, b = top(x), top(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def postings(least: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which any `least` positions hold one. For 4 of 8, Turan's system of 20 triples: three groups,
    triples within a group, and those with two positions in a group and one in the next; else all sets of that size."""
    if least != 4:
        return list(combinations(range(8), least))
    groups = ((0, 1, 2), (3, 4, 5), (6, 7))
    out = [t for g in groups for t in combinations(g, 3)]
    for g, h in zip(groups, groups[1:] + groups[:1], strict=True):
        out += [tuple(sorted((*two, one))) for two in combinations(g, 2) for one in h]
    return out


def _first_posting(sets: list[tuple[int, ...]]) -> np.ndarray:
    """For each set of shared positions, as bits, the first posting in which such a pair meets."""
    out = np.full(256, -1, dtype=np.int64)
    for shared in range(256):
        for k, places in enumerate(sets):
            if all(shared >> p & 1 for p in places):
                out[shared] = k
                break
    return out


def _linked(x: np.ndarray, k: np.ndarray | int, bits: int, first: np.ndarray) -> np.ndarray:
    """Of the exclusive ors of fingerprints that meet in posting k, places of those that are linked and have not met before."""
    t = x | x >> np.uint64(4)
    t |= t >> np.uint64(2)
    t |= t >> np.uint64(1)
    t &= _ONES  # a bit for each byte that differs
    at = np.flatnonzero(8 - np.bitwise_count(t).ravel().astype(np.int8) >= 8 - bits)  # the tally of shared positional bytes
    at = at[np.bitwise_count(x.ravel()[at]) <= bits]
    shared = 255 ^ (t.ravel()[at] * _GATHER >> np.uint64(56)).astype(np.int64)
    return at[first[shared] == (k if isinstance(k, int) else k[at])]


def _block_links(f: np.ndarray, g: np.ndarray | None, k: int, bits: int, first: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within f, or between f and g, in pieces of bounded memory."""
    within = g is None
    g = f if within else g
    us, vs = [], []
    step = max(1, 2_000_000 // max(len(g), 1))
    for at in range(0, len(f), step):
        i, j = np.divmod(_linked(f[at : at + step, None] ^ g[None, :], k, bits, first), len(g))
        i = i + at
        if within:
            i, j = i[i < j], j[i < j]
        links = _forest(f[i].view(np.int64), g[j].view(np.int64))
        us += [x for x, _ in links]
        vs += [y for _, y in links]
    return _forest(np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64))


def linked_fingerprints(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Spanning links (a, b) among the distinct values of the bigint column `f` that differ in at most `bits` bits, 7 at most."""
    if not 0 <= bits < 8:
        raise ValueError("positional bytes guarantee a match for 0 to 7 differing bits")
    spark = fps.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets, keys = postings(8 - bits), []
    for k, places in enumerate(sets):
        mask = sum(0xFF << (8 * p) for p in places)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).alias("k"), F.xxhash64(F.lit(k), F.col("f").bitwiseAND(F.lit(mask))).alias("key")))
    posted = fps.repartition(n, "f").select("f", F.explode(F.array(*keys)).alias("p")).select("f", "p.k", "p.key")
    counts = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    mine = F.pmod(F.xxhash64("f", F.lit(1)), F.col("nb")).cast("int")
    # a fingerprint of block i goes to the pairs (0, i) .. (i, i) and (i, i) .. (i, nb - 1)
    placed = (
        posted.join(counts, "key")
        .select("key", "k", "f", blocks.alias("nb"))
        .withColumn("i", mine)
        .select("key", "k", "f", "i", F.explode(F.when(F.col("nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("nb") - 1))).alias("j"))
        .select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "k", "f", (F.col("i") > F.col("j")).cast("int").alias("side"), (F.col("i") == F.col("j")).cast("int").alias("same"))
    )
    sorted_ = placed.repartition(n, "cell").sortWithinPartitions("cell", "k", "side", "f")
    first = _first_posting(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for b in batches:
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "k", "f", "side", "same")]
            if rest is not None:
                cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
            cell = cols[0]
            if not len(cell):
                continue
            last = int(np.searchsorted(cell, cell[-1]))  # cells ascend, so the last one may go on
            yield _edges([c[:last] for c in cols], bits, first)
            rest = [c[last:] for c in cols]
        if rest is not None:
            yield _edges(rest, bits, first)

    return sorted_.mapInArrow(run, "a long, b long").distinct()


def _edges(cols: list[np.ndarray], bits: int, first: np.ndarray) -> pa.RecordBatch:
    cell, k, f, side, same = cols
    f = f.view(np.uint64)
    out: list[tuple[int, int]] = []
    if len(cell):
        new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (k[1:] != k[:-1])]))
        size = np.diff(np.append(new, len(cell)))
        small = size <= 24
        # small cells: shifted comparisons over all of them at once
        use = np.repeat(small & (size > 1) & (same[new] == 1), size)
        c, kk, x = cell[use], k[use], f[use]
        for d in range(1, 24):
            if len(c) <= d:
                break
            at = np.flatnonzero((c[d:] == c[:-d]) & (kk[d:] == kk[:-d]))
            at = at[_linked(x[at + d] ^ x[at], kk[at], bits, first)]
            out += zip(x[at + d].view(np.int64).tolist(), x[at].view(np.int64).tolist(), strict=True)
        for s, n in zip(new[~(small & (same[new] == 1))].tolist(), size[~(small & (same[new] == 1))].tolist(), strict=True):
            part, sides = f[s : s + n], side[s : s + n]
            if same[s]:
                out += _block_links(part, None, int(k[s]), bits, first)
            else:
                out += _block_links(part[sides == 0], part[sides == 1], int(k[s]), bits, first)
        flat = np.array(list(chain.from_iterable(out)), dtype=np.int64).reshape(-1, 2)
        out = _forest(flat[:, 0], flat[:, 1]) if len(flat) else []
    return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row per row of df: key, simhash (bigint) and component_id, the smallest key reachable over links of at most `bits`
    differing bits, the row's own key included. Equal fingerprints are one node, so copies never become pairs. Rows with a null
    key take part with a null key and do not lower a component's id (a component of null keys only has a null id); empty texts
    link with each other; an empty table gives no rows. Columns of df other than key and text are not read."""
    docs, _ = cut(fingerprints(df.select(F.col(key).alias("key"), F.col(text).alias("text")), words=words).select("key", "simhash"), "simhash")
    nodes, _ = cut(docs.groupBy(F.col("simhash").alias("f")).agg(F.min("key").alias("low")), "simhash-nodes")
    cc = components(linked_fingerprints(nodes.select("f"), bits))
    rooted = nodes.join(cc, nodes.f == cc.node, "left").select("f", "low", F.coalesce("root", "f").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = rooted.join(least, "root").select(F.col("f").alias("simhash"), "component_id")
    return docs.join(labels, "simhash").select(F.col("key").alias(key), "simhash", "component_id")


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of df that carry their component's smallest key; of several rows with that key one stays. Rows with a null key
    stay only where their whole component has none, and then one of them does."""
    found, _ = cut(near_duplicates(df, key, text, words, bits), "near-duplicates")
    stays = found.where(F.col(key) == F.col("component_id")).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    repeated = bool(stays.where("_n > 1").limit(1).count())
    kept = df.join(stays, df[key] == stays["_key"], "left_semi")
    if repeated:  # rows that share a key and stay: one of them does
        kept = kept.dropDuplicates([key])
    alone = found.where(F.col(key).isNull() & F.col("component_id").isNull()).select("simhash").distinct()
    if not alone.limit(1).count():
        return kept
    printed = fingerprints(df.where(F.col(key).isNull()), text, OWN, words)
    nulls = printed.join(alone, printed[OWN] == alone["simhash"], "left_semi").dropDuplicates([OWN]).drop(OWN)
    return kept.unionByName(nulls)
