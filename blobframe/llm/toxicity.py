"""Toxicity scoring: a bidirectional gated recurrent network with attention pooling over word and character inputs.

The network is written and trained in numpy. A word's input is the embedding of the word itself, if the training sample knows
it, beside the mean embedding of its hashed character n-grams, so unseen inflections of a stem still carry its sense. Texts are
read in overlapping windows of words; every window of the whole text is scored and the text has the highest score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _slices
from .common import OWN, ship

#: Words of a window and from one window's start to the next.
WINDOW, STRIDE = 64, 48
#: Bound of the training sample: documents of each class.
SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 3000
_WORDS, _GRAMS, _GRAM_ROWS = 8, 8, 1 << 14
_HIDDEN, _ATTEND, _VOCABULARY = 8, 8, 20_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (positions, 3) of the 3- to 5-grams that begin at each byte of <word>, each word's first position, and its number
    of n-grams. Row 0 stands for none."""
    raw = [b"<" + w.encode("utf-8", "replace") + b">" for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    b = np.frombuffer(b"".join(raw) + b"\0" * 5, dtype=np.uint8).astype(np.uint32)
    n = len(b) - 5
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    left = np.repeat(first + size, size) - np.arange(n)  # bytes from here to the word's end
    rows = np.empty((n, 3), dtype=np.int32)
    h = b[:n] * np.uint32(0x9E3779B1) + b[1 : n + 1]
    h = h * np.uint32(0x85EBCA77) + b[2 : n + 2]
    for k in range(3):
        if k:
            h = h * np.uint32(0x85EBCA77) + b[2 + k : n + 2 + k]
        m = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
        rows[:, k] = np.where(left >= 3 + k, 1 + (m >> np.uint32(18)) % np.uint32(_GRAM_ROWS - 1), 0)
    counts = np.maximum(size - 2, 0) + np.maximum(size - 3, 0) + np.maximum(size - 4, 0)
    return rows, first, np.maximum(counts, 1)


def _rows_summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """(n, k) sums of the values' rows by index."""
    out = np.zeros((n, values.shape[1]), np.float32)
    order = np.argsort(index, kind="stable")
    at = index[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    if len(at):
        out[at[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Parameters in a dict of float32 arrays, and a word list."""

    def __init__(self, vocabulary: list[str], prior: float = 0.0, seed: int = 7):
        rnd = np.random.default_rng(seed)
        h, e = _HIDDEN, _WORDS + _GRAMS
        f = lambda *s, k=0.3: (rnd.standard_normal(s) * k).astype(np.float32)
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.p = {"word": f(len(vocabulary) + 1, _WORDS, k=0.01), "gram": f(_GRAM_ROWS, _GRAMS, k=0.01)}
        self.p["word"][0] = self.p["gram"][0] = 0
        for d in "fb":
            self.p |= {f"w{d}": f(e, 3 * h, k=1.0), f"u{d}": f(h, 3 * h), f"c{d}": np.zeros(3 * h, np.float32)}
        self.p |= {"a": f(2 * h, _ATTEND), "v": f(_ATTEND), "o": f(2 * h), "k": np.full(1, prior, np.float32)}

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, tuple]:
        get = self.index.get
        ids = np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words))
        rows, first, counts = _grams(words)
        g = self.p["gram"]
        sums = np.add.reduceat(g[rows[:, 0]] + g[rows[:, 1]] + g[rows[:, 2]], first, axis=0) if len(words) else np.zeros((0, _GRAMS), np.float32)
        return np.concatenate([self.p["word"][ids], sums / counts[:, None].astype(np.float32)], axis=1), ids, (rows, first, counts)

    def _gru(self, x: np.ndarray, at: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """Hidden states (T, B, H) along the rows of `at` (T, B), indices into the projected inputs x, whose last row is
        padding: there the gate is shut and the state stays."""
        h, u = _HIDDEN, self.p[f"u{d}"]
        t, b = at.shape
        out = np.empty((t, b, h), dtype=np.float32)
        s = np.zeros((b, h), dtype=np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a = x[at[i]]
            su = s @ u
            zr = a[:, : 2 * h] + su[:, : 2 * h]
            zr = _sigmoid(zr)
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(a[:, 2 * h :] + r * su[:, 2 * h :])
            new = n + z * (s - n)
            if keep is not None:
                keep.append((i, s, z, r, n, su[:, 2 * h :]))
            out[i] = s = new
        return out

    def logits(self, feats: np.ndarray, at: np.ndarray, mask: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Window logits; at and mask are (T, B), at's padding is the row after the last of feats."""
        p, h = self.p, _HIDDEN
        hidden, tapes = [], {}
        for d in "fb":
            x = np.empty((len(feats) + 1, 3 * h), dtype=np.float32)
            np.matmul(feats, p[f"w{d}"], out=x[:-1])
            x[:-1] += p[f"c{d}"]
            x[-1] = 0
            x[-1, :h] = 30
            tapes[d] = [] if tape is not None else None
            hidden.append(self._gru(x, at, d, tapes[d]))
        hs = np.concatenate(hidden, axis=2)
        q = np.tanh(hs @ p["a"])
        e = np.where(mask, q @ p["v"], -1e9)
        e = np.exp(e - e.max(axis=0)) * mask
        w = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", w, hs)
        if tape is not None:
            tape |= {"tapes": tapes, "hs": hs, "q": q, "w": w, "pooled": pooled}
        return pooled @ p["o"] + p["k"][0]

    def gradients(self, feats, back, at, mask, y) -> dict[str, np.ndarray]:
        p, h, tape = self.p, _HIDDEN, {}
        logit = self.logits(feats, at, mask, tape)
        b = len(y)
        dl = ((_sigmoid(logit.copy()) - y) / b).astype(np.float32)
        hs, q, w, pooled = (tape[k] for k in ("hs", "q", "w", "pooled"))
        g = {"o": pooled.T @ dl, "k": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * p["o"]
        dw = np.einsum("tbh,bh->tb", hs, dp)
        de = w * (dw - (w * dw).sum(axis=0))
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["v"] = np.einsum("tb,tba->a", de, q)
        g["a"] = np.einsum("tbh,tba->ha", hs, dq)
        dh = w[:, :, None] * dp + dq @ p["a"].T
        dx_in = np.zeros((len(feats) + 1, feats.shape[1]), np.float32)
        for k, d in enumerate("fb"):
            u, gu = p[f"u{d}"], np.zeros_like(p[f"u{d}"])
            part = dh[:, :, k * h : (k + 1) * h]
            da_all = np.empty((*at.shape, 3 * h), np.float32)
            carry = np.zeros((at.shape[1], h), np.float32)
            for i, s, z, r, n, sn in reversed(tape["tapes"][d]):
                ds = carry + part[i]
                dn = ds * (1 - z) * (1 - n * n)
                dz = ds * (s - n) * z * (1 - z)
                dr = dn * sn * r * (1 - r)
                da = da_all[i]
                da[:, :h], da[:, h : 2 * h], da[:, 2 * h :] = dz, dr, dn
                dsu = np.concatenate([dz, dr, dn * r], axis=1)
                gu += s.T @ dsu
                carry = ds * z + dsu @ u.T
            da_all *= mask[:, :, None]
            acc = _rows_summed(at.reshape(-1), da_all.reshape(-1, 3 * h), len(feats) + 1)[:-1]
            g[f"u{d}"], g[f"w{d}"], g[f"c{d}"] = gu, feats.T @ acc, acc.sum(axis=0)
            dx_in[:-1] += acc @ p[f"w{d}"].T
        dx = dx_in[:-1]
        ids, (rows, first, counts) = back
        g["word"] = _rows_summed(ids, dx[:, :_WORDS], len(p["word"]))
        per = np.repeat(dx[:, _WORDS:] / counts[:, None], np.diff(np.append(first, len(rows))), axis=0)
        g["gram"] = _rows_summed(rows.T.reshape(-1), np.concatenate([per, per, per]), _GRAM_ROWS)
        g["word"][0] = g["gram"][0] = 0
        return g


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    s = list(range(0, n - WINDOW, STRIDE))
    return [*s, n - WINDOW]


def split_words(text: str | None) -> list[str]:
    return text.lower().split() if text else []


class Windows:
    """All windows of some texts, with words numbered."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        ids, starts, sizes, doc, at = [], [], [], [], 0
        for i, t in enumerate(texts):
            w = split_words(t)
            for x in w:
                if x not in number:
                    number[x] = len(number)
            ids.append(np.fromiter(map(number.__getitem__, w), dtype=np.int32, count=len(w)))
            s = window_starts(len(w))
            starts += [at + k for k in s]
            sizes += [min(len(w), WINDOW)] * len(s)
            doc += [i] * len(s)
            at += len(w)
        self.words = list(number)
        self.ids = np.concatenate([*ids, np.zeros(WINDOW, np.int32)])
        self.starts, self.sizes, self.doc = np.array(starts, np.int64), np.array(sizes, np.int64), np.array(doc, np.int64)

    def take(self, which: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
        size = self.sizes[which]
        t = np.arange(max(1, size.max()))[:, None]
        mask = t < size
        at = np.where(mask, self.ids[np.minimum(self.starts[which] + t, len(self.ids) - 1)], pad)
        return at, mask


def score_windows(net: Network, w: Windows, batch: int = 2048) -> np.ndarray:
    step = 20_000
    feats = np.concatenate([net.features(w.words[i : i + step])[0] for i in range(0, max(1, len(w.words)), step)])
    order = np.argsort(w.sizes, kind="stable")
    out = np.empty(len(order), dtype=np.float32)
    for i in range(0, len(order), batch):
        which = order[i : i + batch]
        at, mask = w.take(which, len(feats))
        out[which] = net.logits(feats, at, mask)
    return out


def score_texts(net: Network, texts: list[str | None]) -> np.ndarray:
    w = Windows(texts)
    best = np.full(len(texts), -np.inf, dtype=np.float64)
    np.maximum.at(best, w.doc, score_windows(net, w).astype(np.float64))
    return 1 / (1 + np.exp(-np.clip(best, -30, 30)))


def train(texts: list[str | None], labels: list[int], rounds: int = 7, batch: int = 128, rate: float = 0.02, seed: int = 3) -> Network:
    """Multiple-instance training: each round takes every text's highest-scoring window and one more at random, then runs
    Adam over them."""
    y = np.array(labels, dtype=np.float32)
    counts: Counter = Counter()
    for t in texts:
        counts.update(set(split_words(t)))
    vocabulary = [x for x, c in sorted(counts.items(), key=lambda i: (-i[1], i[0])) if c >= 4][:_VOCABULARY]
    rnd = np.random.default_rng(seed)
    share = float(y.mean()) if len(y) else 0.0
    net = Network(vocabulary, prior=float(np.log((share + 0.01) / (1.01 - share))))
    if not 0 < share < 1:
        net.p["o"][:] = 0
        net.p["k"][:] = 6.0 if share else -6.0
        return net
    w = Windows(texts)
    m1 = {k: np.zeros_like(v) for k, v in net.p.items()}
    m2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        s = score_windows(net, w) if turn else rnd.random(len(w.doc)).astype(np.float32)
        order = np.lexsort((s, w.doc))
        last = np.flatnonzero(np.append(w.doc[order][1:] != w.doc[order][:-1], True))
        top = order[last]
        other = np.lexsort((rnd.random(len(w.doc)), w.doc))[last]
        clean = other[y[w.doc[other]] == 0]
        pick = np.concatenate([top, clean])
        if turn == 0:  # where a text is one window, that window has its label
            alone = np.bincount(w.doc, minlength=len(texts)) == 1
            sure = pick[alone[w.doc[pick]] | (y[w.doc[pick]] == 0)]
            pick = sure if (y[w.doc[sure]] == 1).any() else pick
        for _ in range(min(30, max(1, -(-4000 // len(pick))))):
            rnd.shuffle(pick)
            for i in range(0, len(pick), batch):
                which = pick[i : i + batch]
                at, mask = w.take(which, 0)
                used, at_small = np.unique(at, return_inverse=True)
                feats, ids, rows = net.features([w.words[j] for j in used] if len(w.words) else [""])
                at_small = np.where(mask, at_small.reshape(at.shape), len(feats))
                g = net.gradients(feats, (ids, rows), at_small, mask, y[w.doc[which]])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                scale = min(1.0, 2.0 / (norm + 1e-9))
                step += 1
                lr = rate / (1 + turn * 0.5) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, v in g.items():
                    v *= scale
                    m1[k] += 0.1 * (v - m1[k])
                    m2[k] += 0.001 * (v * v - m2[k])
                    net.p[k] -= lr * (m1[k] / (np.sqrt(m2[k]) + 1e-7))
    return net


def in_training(key: str):
    """Rows whose labels may be learnt from: crc32 of the key as text, modulo 5, is not 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5, F.lit(0)) != 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Network:
    """Fits the network on labelled rows outside the held-out fifth: at most `toxic` and `clean` whole documents of each class, the
    first in the order of a hash of their key. That sample is the only part of the corpus that comes to the driver. Null labels and keys are left out; a key labelled twice counts as toxic if any row says so."""
    marks = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where(in_training("k") & F.col("y").isNotNull())
    marks = marks.groupBy("k").agg(F.max("y").cast("int").alias("y"))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    sized = rows.join(marks, "k").select("k", "y", F.xxhash64("k").alias("h"))
    # keys of the sample, bounded by its parameters
    picked = [sized.where(F.col("y") == v).select("k", "y", "h").distinct().orderBy("h", "k").limit(n).select("k", "y") for v, n in ((1, toxic), (0, clean))]
    sample = docs.sparkSession.createDataFrame(picked[0].unionByName(picked[1]).collect(), sized.select("k", "y").schema)
    got = rows.join(F.broadcast(sample), "k").groupBy("k", "y").agg(F.min("t").alias("t")).orderBy("k").collect()
    return train([r.t for r in got], [r.y for r in got])


def score(df: DataFrame, net: Network, text: str = "text", output: str = "toxicity") -> DataFrame:
    """Adds `output` (double, 0 to 1): the highest score of all overlapping windows of each row's whole text; a null or empty
    text is one empty window. A column named `output` is replaced; rows are independent."""
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(net)  # its size is set by the constants above
    keep = [c for c in df.columns if c != output]
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(output, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for b in _slices(whole, text):
                s = score_texts(model, b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(s)], names=[*keep, output])

    return df.mapInArrow(run, schema)


def drop_toxic(df: DataFrame, net: Network, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score is under the threshold."""
    return score(df, net, text, OWN).where(F.col(OWN) < threshold).drop(OWN)
