"""Quality scoring by a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on each text. Expectation-maximisation over the counts of vote patterns
estimates each labeller's accuracy and the share of good texts without any gold label; the posterior of a text's pattern is its
label. Those labels train a logistic scorer over hashed word, mark and shape features, which also judges texts on which the
labellers are silent or divided.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import OWN, cut, remove, ship

#: Bound of the scorer's training sample, in texts. Only their features, at most WIDTH numbers each, leave the executors.
SAMPLE = 4000
BITS = 13
_MASK = (1 << BITS) - 1

GOOD, BAD, NONE = 1, 0, -1
LABELLERS = ("marks", "capitals", "bangs", "repeats", "table", "lines", "sentences", "variety", "letters", "word_size")
SYMBOLS = "#%&$*@^~<>{}[]|\\=+_"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def statistics(text: str | None, counts: Counter | None = None) -> dict[str, float]:
    """Shares and counts over the whole text; zeros for a null or empty one. counts takes up those of its words."""
    t = text or ""
    words = t.split()
    counts = Counter() if counts is None else counts
    counts.update(words)
    n = len(words)
    loud = sum([c for w, c in counts.items() if w.isupper() and len(w) > 1])
    stops = sum(map(t.count, (". ", ".\n", "! ", "!\n", "? ", "?\n"))) + t.endswith((".", "!", "?"))
    lines = [x for x in t.split("\n") if x.strip()]
    repeats = max(sum(map(eq, words, words[1:])), sum(map(eq, words, words[2:])))
    return {
        "words": n,
        "symbols": sum(map(t.count, SYMBOLS)) / max(1, len(t)),
        "bangs": t.count("!") / max(1, n),
        "capitals": loud / max(1, n),
        "top": max(0, max(counts.values(), default=0) - 1) / max(1, n),
        "distinct": len(counts) / max(1, n),
        "pair": repeats / max(1, n),
        "bars": t.count(" | ") / max(1, n),
        "stops": stops / max(1, n),
        "letters": len(_NO_LETTERS.sub("", t)) / max(1, len(t)),
        "size": sum(map(len, words)) / max(1, n),
        "line_repeats": 1 - len(set(lines)) / max(1, len(lines)),
    }


def votes(s: dict[str, float]) -> list[int]:
    """One vote per labeller."""

    def vote(bad: bool, good: bool) -> int:
        return BAD if bad else GOOD if good else NONE

    n = s["words"]
    loud, marked = max(s["capitals"], s["bangs"]), max(s["symbols"], s["bars"])
    return [
        vote(s["symbols"] > 0.05, False),
        vote(s["capitals"] > 0.25, False),
        vote(s["bangs"] > 0.25, False),
        vote(n >= 10 and (s["pair"] > 0.15 or s["top"] > 0.3), False),
        vote(s["bars"] > 0.1, False),
        vote(s["line_repeats"] > 0.5, n >= 20 and s["line_repeats"] < 0.1 and s["pair"] < 0.08 and loud < 0.1),
        vote(n >= 30 and s["stops"] < 0.01, 0.02 < s["stops"] < 0.35 and loud < 0.1 and marked < 0.015),
        vote(n >= 40 and s["distinct"] < 0.15, n >= 20 and s["distinct"] > 0.35 and s["symbols"] < 0.02 and loud < 0.1),
        vote(n == 0 or s["letters"] < 0.55, s["letters"] > 0.72 and s["bangs"] < 0.05),
        vote(s["size"] > 20, 2 <= s["size"] <= 10 and marked < 0.02 and s["pair"] < 0.1 and loud < 0.1),
    ]


def weak_label_model(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[float, np.ndarray, dict[tuple[int, ...], float]]:
    """Expectation-maximisation over (votes, count): the share of good, each labeller's shares of votes by class (rows: class;
    columns: silent, bad, good), and each pattern's posterior of good. It starts from the balance of votes, in which a bad
    vote counts double, as the labellers speak up for different faults."""
    if not patterns:
        return 0.5, np.full((len(LABELLERS), 2, 3), 1 / 3), {}
    v = np.array([p for p, _ in patterns])
    c = np.array([k for _, k in patterns], dtype=float)
    p = 1 / (1 + np.exp(-((v == GOOD).sum(axis=1) - 2.0 * (v == BAD).sum(axis=1) + 0.5)))
    table = np.full((v.shape[1], 2, 3), 1 / 3)
    # a few prior votes: a labeller is silent or right more often than wrong
    prior = np.array([[2.0, 3.0, 0.5], [2.0, 0.5, 3.0]])
    share = 0.5
    # silence says nothing, unless a labeller has only one thing to say: then it is the other outcome
    told = (v != NONE) | ~((v == GOOD).any(axis=0) & (v == BAD).any(axis=0))
    for _ in range(rounds):
        old = p
        for y, w in ((0, c * (1 - p)), (1, c * p)):
            votes_of = np.stack([(w[:, None] * (told & (v == k))).sum(axis=0) for k in (NONE, BAD, GOOD)], axis=1) + prior[y] * np.array([0, 1, 1])
            table[:, y] = votes_of / votes_of.sum(axis=1, keepdims=True)
        table = np.maximum(table, 1e-6)
        share = float(np.clip((c * p).sum() / c.sum(), 0.02, 0.98))
        log = (np.log(table)[np.arange(v.shape[1]), :, v + 1] * told[:, :, None]).sum(axis=1)
        p = 1 / (1 + np.exp(np.clip(log[:, 0] + np.log(1 - share) - log[:, 1] - np.log(share), -50, 50)))
        if np.abs(p - old).max() < 1e-9:
            break
    return share, table, {tuple(k): float(x) for (k, _), x in zip(patterns, p, strict=True)}


def hashed(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values: hashed words by their share, a number for each occurrence, and the statistics in steps."""
    counts: Counter = Counter()
    s = statistics(text, counts)
    keys = [crc32(w) & _MASK for w in " ".join(counts).lower().encode("utf-8", "replace").split(b" ")] if counts else []
    each = 1.0 / max(1, s["words"])
    values = [c * each for c in counts.values()]
    for i, (name, x) in enumerate(s.items()):
        step = int(min(15, math.log2(1 + x))) if name == "words" else int(min(15, x * 30)) if name != "size" else int(min(15, x))
        keys.append((1 << BITS) + 16 * i + step)
        values.append(1.0)
    return np.array(keys, dtype=np.int64), np.array(values)


WIDTH = (1 << BITS) + 16 * 12


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: list[float], epochs: int = 8, rate: float = 0.3, seed: int = 5) -> np.ndarray:
    """Weights and a bias of logistic regression on soft labels, by Adagrad. rows: features as hashed() gives them."""
    w, g2 = np.zeros(WIDTH + 1), np.full(WIDTH + 1, 1e-2)
    rnd = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rnd.permutation(len(rows)):
            k, x = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[k] @ x + w[-1], -30, 30)))
            d = p - targets[i]
            g = np.bincount(k, d * x, minlength=1)
            at = np.unique(k)
            g = g[at] + 1e-5 * w[at]
            for at, g in ((at, g), (WIDTH, d)):
                g2[at] += g * g
                w[at] -= rate * g / np.sqrt(g2[at])
    return w


def score_text(text: str | None, w: np.ndarray) -> float:
    k, x = hashed(text)
    return float(1 / (1 + np.exp(-np.clip(w[k] @ x + w[-1], -30, 30))))


def _mapped(df: DataFrame, text: str, output: str, kind: T.DataType, f, array: pa.DataType) -> DataFrame:
    ship(df.sparkSession)
    keep = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(output, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, text):
                col = pa.array([f(t) for t in b.column(text).to_pylist()], array)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], col], names=[*keep, output])

    return df.mapInArrow(run, schema)


class Model:
    def __init__(self, share: float, accuracy: np.ndarray, posterior: dict, weights: np.ndarray):
        self.share, self.accuracy, self.posterior, self.weights = share, accuracy, posterior, weights


def fit(df: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """The labellers vote on every text of df; only the counts of vote patterns, at most three to the power of the number of
    labellers whatever the table's size, come to the driver for the estimation. The scorer is fitted on the features of at most
    `sample` whole texts, half of them from each side of the posterior, first in the order of a hash of the text."""
    spark = df.sparkSession
    texts = df.select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    voted = _mapped(texts, "t", "v", T.StringType(), lambda t: ",".join(map(str, votes(statistics(t)))), pa.string())
    voted, path = cut(voted.select("h", "v"), "votes")
    counts = voted.groupBy("v").agg(F.count("*").alias("c")).collect()
    patterns = sorted((tuple(map(int, r.v.split(","))), r.c) for r in counts)
    share, acc, post = weak_label_model(patterns)
    side = {",".join(map(str, p)): x for p, x in post.items()}
    picked: dict[int, float] = {}  # hashes of the sample's texts, bounded by its size
    for good in (True, False):
        group = spark.createDataFrame([(p,) for p, x in side.items() if (x >= 0.5) == good], "v string")
        best = voted.join(F.broadcast(group), "v").select("h", "v").distinct().orderBy("h", "v").limit(sample // 2)
        picked |= {r.h: side[r.v] for r in best.collect()}
    remove(spark, path)
    wanted = spark.createDataFrame([(h,) for h in picked], "h long")
    rows = texts.join(F.broadcast(wanted), "h").groupBy("h").agg(F.min("t").alias("t"))
    rows = rows.mapInArrow(_features, "h long, k array<int>, x array<double>").orderBy("h").collect()
    return Model(share, acc, post, train_scorer([(np.array(r.k, dtype=np.int64), np.array(r.x)) for r in rows], [picked[r.h] for r in rows]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, k, x): the features of each text, those of one number added up."""
    for whole in batches:
        for b in _slices(whole, "t"):
            ks, xs = [], []
            for t in b.column("t").to_pylist():
                k, which = np.unique((made := hashed(t))[0], return_inverse=True)
                ks.append(k.astype(np.int32))
                xs.append(np.bincount(which, made[1], minlength=len(k)))
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(ks, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64()))], names=["h", "k", "x"])


def score(df: DataFrame, model: Model, text: str = "text", output: str = "quality") -> DataFrame:
    """Adds `output` (double, 0 to 1, higher is better) from each row's whole text. Null and empty texts are scored as texts
    without words. A column named `output` is replaced; rows are independent, an empty table stays empty."""
    shared = df.sparkSession.sparkContext.broadcast(model.weights)  # WIDTH numbers
    return _mapped(df, text, output, T.DoubleType(), lambda t: score_text(t, shared.value), pa.float64())


def drop_low_quality(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is at least the threshold."""
    return score(df, model, text, OWN).where(F.col(OWN) >= threshold).drop(OWN)
