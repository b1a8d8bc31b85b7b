"""Embedding near-duplicates by dual traversal of cover trees.

A cover tree has nested levels of nodes whose radii halve from level to level. Two nodes can hold a linked pair only if their
centres are no farther apart than the link distance and both covering radii; the traversal drops all other node pairs, takes
whole those that hold nothing else, and compares the points that are left in double precision, so the result is exact. Large
labels are split at the top of the tree: vectors are dealt to the nearest of some centres and on to blocks, each block's tree is
built once, and only pairs of blocks that the same bound allows are traversed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, components, cut, remove, ship

#: Vectors of a block, the unit that a tree is built for, and the most top nodes that one label is split into; what a top node
#: holds beyond a block is dealt over several.
BLOCK, TOPS = 1024, 256
#: Slack for rounding in the bounds; pairs within it are compared.
SLACK = 1e-7
_LEAF = 16
_STEP = 128


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (a @ b.T)))


class CoverTree:
    """Nodes as lists: centre (a point's index), covering radius, children, and the points below."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.points: list[np.ndarray] = []
        self.compared = 0
        if len(x):
            self._node(np.arange(len(x)), 0, 2.0)
        self._finish()

    def _finish(self) -> None:
        self.centres = self.x[np.array(self.centre, dtype=np.int64)] if self.centre else self.x
        self.radii = np.array(self.radius)

    def _node(self, points: np.ndarray, c: int, scale: float) -> int:
        """A node over points around c; scale bounds its radius and half of it those of its children."""
        me, far = len(self.centre), float(_apart(self.x[points], self.x[c : c + 1]).max())
        self.compared += len(points)
        self.centre.append(c)
        self.radius.append(far)
        self.children.append(None)
        self.points.append(points)
        if len(points) <= _LEAF or far <= SLACK:
            return me
        half = scale / 2
        while far <= half:  # levels at which the node would be its only child
            half /= 2
        centres, owner = self._net(points, c, half)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(centres) + 1))
        self.children[me] = np.array([self._node(points[order[s:e]], ci, half) for ci, s, e in zip(centres, ends[:-1], ends[1:], strict=True)], dtype=np.int64)
        return me

    def _net(self, points: np.ndarray, c: int, reach: float) -> tuple[list[int], np.ndarray]:
        """Centres, c the first, no two of them within reach, and the number of each point's own, which is within reach."""
        centres, owner = [c], np.zeros(len(points), dtype=np.int64)
        for at in range(0, len(points), _STEP):
            part = points[at : at + _STEP]
            far = _apart(self.x[part], self.x[centres])
            near = far.argmin(axis=1)
            owner[at : at + _STEP] = near
            left = np.flatnonzero(far[np.arange(len(part)), near] > reach)
            among = _apart(self.x[part[left]], self.x[part[left]])
            self.compared += far.size + among.size
            open_ = np.ones(len(left), dtype=bool)
            for i in range(len(left)):
                if open_[i]:
                    mine = open_ & (among[i] <= reach)
                    mine[i] = True
                    owner[at + left[mine]] = len(centres)
                    open_ &= ~mine
                    centres.append(int(part[left[i]]))
        return centres, owner

    def dumped(self) -> dict[str, bytes]:
        """The tree as numbers: vectors, and per node its centre, radius, parent and, for those without children, points."""
        parent = np.full(len(self.centre), -1, dtype=np.int64)
        for k, below in enumerate(self.children):
            if below is not None:
                parent[below] = k
        held = [p if kids is None else p[:0] for p, kids in zip(self.points, self.children, strict=True)]
        size = np.array([len(p) for p in held], dtype=np.int64)
        nodes = np.stack([np.array(self.centre, dtype=np.int64), parent, size]) if self.centre else np.zeros((3, 0), np.int64)
        return {"x": self.x.tobytes(), "nodes": nodes.tobytes(), "radii": self.radii.tobytes(), "points": (np.concatenate(held) if held else np.zeros(0, np.int64)).tobytes()}

    @classmethod
    def loaded(cls, width: int, x: bytes, nodes: bytes, radii: bytes, points: bytes) -> CoverTree:
        me = cls(np.zeros((0, width)))
        me.x = np.frombuffer(x).reshape(-1, width)
        centre, parent, size = np.frombuffer(nodes, dtype=np.int64).reshape(3, -1)
        me.centre, me.radius = centre.tolist(), np.frombuffer(radii).tolist()
        ends = np.cumsum(size)
        held = np.frombuffer(points, dtype=np.int64)
        me.points = [held[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
        kids: list[list[int]] = [[] for _ in me.centre]
        for k, p in enumerate(parent.tolist()):
            if p >= 0:
                kids[p].append(k)
        me.children = [np.array(k, dtype=np.int64) if k else None for k in kids]
        for k in range(len(kids) - 1, -1, -1):  # parents come before their children
            if kids[k]:
                me.points[k] = np.concatenate([me.points[c] for c in kids[k]])
        me._finish()
        return me


def linked_pairs(a: CoverTree, b: CoverTree, cosine: float, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all points with at least that cosine; each pair once where a is b. tally takes up how many distances were
    computed."""
    same, out_i, out_j, computed = a is b, [], [], 0
    linked = np.sqrt(max(0.0, 2 - 2 * cosine))
    reach, sure = linked + SLACK, linked - SLACK
    stack = [(0, 0)] if a.centre and b.centre else []
    while stack:
        x, y = stack.pop()
        kx, ky = a.children[x], b.children[y]
        if kx is None and ky is None:
            i, j = a.points[x], b.points[y]
            computed += len(i) * len(j)
            at_i, at_j = np.nonzero(a.x[i] @ b.x[j].T >= cosine)
            i, j = i[at_i], j[at_j]
            if same and x == y:
                i, j = i[i < j], j[i < j]
            out_i.append(i)
            out_j.append(j)
            continue
        kx = np.array([x]) if kx is None else kx
        ky = np.array([y]) if ky is None else ky
        far = _apart(a.centres[kx], b.centres[ky])
        computed += far.size
        both = a.radii[kx][:, None] + b.radii[ky][None, :]
        keep = far <= reach + both
        if same and x == y:  # each pair of children once; a child with itself only if it has two points
            keep &= np.tri(len(kx), dtype=bool).T
            np.fill_diagonal(keep, [len(a.points[k]) > 1 for k in kx.tolist()])
        whole = keep & (far + both <= sure)  # every point of the one is linked with every one of the other
        if same and x == y:
            np.fill_diagonal(whole, False)
        for p, q in zip(*np.nonzero(whole), strict=True):
            i, j = a.points[kx[p]], b.points[ky[q]]
            out_i.append(np.repeat(i, len(j)))
            out_j.append(np.tile(j, len(i)))
        u, v = np.nonzero(keep & ~whole)
        stack += zip(kx[u].tolist(), ky[v].tolist(), strict=True)
    if tally is not None:
        tally.append(computed)
    i, j = (np.concatenate(w) if w else np.zeros(0, np.int64) for w in (out_i, out_j))
    return i, j


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    dot = x @ centres.T
    at = dot.argmax(axis=1)
    return at, np.sqrt(np.maximum(0.0, 2 - 2 * dot[np.arange(len(x)), at]))


def _unit(column) -> np.ndarray:
    x = np.array(column.tolist() if hasattr(column, "tolist") else list(column), dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if len(x) else x.reshape(0, 1)


_TREES = "group string, block int, width int, node binary, copies binary, x binary, nodes binary, radii binary, points binary"


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """One row per row of df: key, n_links (other vectors of its label with at least that cosine, computed in double
    precision), component_id (smallest key reachable over links) and kept (key = component_id). Rows with a null label or a
    vector that is null, empty, zero, or holds null or non-finite components link with nothing; vectors of unequal lengths do
    not either. Equal vectors of a label are one node, so copies never become pairs. Each row is a vector of its own: rows that
    repeat a key with another vector or label have their own links and component, and rows that repeat it with the same ones are
    links of each other. A null key links with nothing, has no component and is not kept. Extra columns are not read; an empty
    table gives no rows."""
    spark = df.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad, F.lit(False)) & F.col("id").isNotNull())
    good = rows.where("ok").withColumn("group", F.concat_ws("/", F.size("v").cast("string"), F.col("label").cast("string")))
    nodes = good.groupBy("group", "v").agg(F.min("id").alias("low"), F.count("*").alias("copies"))
    nodes, _ = cut(nodes.withColumn("node", F.xxhash64("group", "v")), "vectors")

    # centres of the top level: a bounded sample, in hash order; every vector is dealt to one
    largest = nodes.groupBy("group").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 0
    tops = int(min(TOPS, max(1, -(-largest // BLOCK))))
    sample = nodes.select("v", F.size("v").alias("d")).orderBy(F.xxhash64("v")).limit(8 * tops).collect()
    by_size: dict[int, np.ndarray] = {}
    for d in {r.d for r in sample}:
        x = _unit([r.v for r in sample if r.d == d])
        chosen, near = [0], np.full(len(x), 2.0)
        while len(chosen) < min(tops, len(x)):  # farthest first within the sample
            near = np.minimum(near, np.sqrt(np.maximum(0.0, 2 - 2 * x @ x[chosen[-1]])))
            chosen.append(int(near.argmax()))
        by_size[d] = x[chosen]

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            top, far = np.zeros(len(p), dtype=np.int32), np.full(len(p), 2.0)
            size = p["v"].map(len).to_numpy()
            for d in np.unique(size):
                if d in by_size:
                    m = np.flatnonzero(size == d)
                    top[m], far[m] = _nearest(_unit(p["v"].iloc[m]), by_size[d])
            yield p.assign(top=top, far=far)

    placed = nodes.select("group", "v", "node", "copies").mapInPandas(place, "group string, v array<double>, node long, copies long, top int, far double")
    dealt, dealt_path = cut(placed, "dealt")
    cells = dealt.groupBy("group", "top").agg(F.count("*").alias("c"), F.max("far").alias("r"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)) + SLACK)

    def blocks(p: pd.DataFrame) -> pd.DataFrame:
        """Of one label, at most TOPS rows: small top nodes share a block, large ones are split over several; then the pairs
        of blocks that the bound allows."""
        p = p.sort_values("top")
        group, d = p["group"].iloc[0], int(p["group"].iloc[0].split("/")[0])
        c = by_size.get(d)
        top, count, r = p["top"].to_numpy(), p["c"].to_numpy(), p["r"].to_numpy()
        first, split, total, open_at = [], [], 0, None
        for m in count:
            s = int(-(-m // BLOCK))
            if open_at is not None and s == 1 and open_at[1] + m <= BLOCK:
                open_at[1] += m
                first.append(open_at[0])
            else:
                first.append(total)
                open_at = [total, m] if s == 1 else None
                total += s
            split.append(s)
        gap = np.zeros((len(p), len(p))) if c is None else np.sqrt(np.maximum(0.0, 2 - 2 * c[top] @ c[top].T))
        allowed = gap <= reach + r[:, None] + r[None, :] + SLACK
        first_a = np.array(first)
        width = {f: max(s for f2, s in zip(first, split, strict=True) if f2 == f) for f in sorted(set(first))}
        # a block meets itself and the allowed ones after it
        met = {f: [{"b": int(g), "n": width[int(g)]} for g in np.unique(first_a[allowed[first_a == f].any(axis=0)]) if g >= f] for f in width}
        return pd.DataFrame({"group": group, "top": top, "first": first, "split": split, "meets": [met[f] for f in first]})

    plan, plan_path = cut(cells.groupBy("group").applyInPandas(blocks, "group string, top int, first int, split int, meets array<struct<b:int,n:int>>"), "blocks")
    own = (F.col("first") + F.pmod(F.xxhash64("node"), F.col("split"))).cast("int")
    parted = dealt.join(plan.drop("meets"), ["group", "top"]).select("group", own.alias("block"), "node", "copies", "v")
    parted = parted.repartition(n, "group", "block").sortWithinPartitions("group", "block", "node")

    def planted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A block's tree."""
        for p in _runs(parts, ["group", "block"]):
            x = _unit(p["v"])
            row = {"group": p["group"].iloc[0], "block": p["block"].iloc[0], "width": x.shape[1], "node": p["node"].to_numpy().tobytes(), "copies": p["copies"].to_numpy().tobytes()}
            yield pd.DataFrame([row | CoverTree(x).dumped()])

    trees, trees_path = cut(parted.mapInPandas(planted, _TREES), "trees")
    spread = plan.select("group", "meets", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("split") - 1)).alias("one")).distinct()
    spread = spread.select("group", "one", F.explode("meets").alias("m")).select("group", "one", F.explode(F.sequence(F.col("m.b"), F.col("m.b") + F.col("m.n") - 1)).alias("two"))
    spread = spread.where("one <= two").distinct().withColumn("cell", F.xxhash64("group", "one", "two"))
    sides = spread.select("group", F.col("one").alias("block"), "cell", F.lit(0).alias("side")).unionByName(spread.where("one < two").select("group", F.col("two").alias("block"), "cell", F.lit(1).alias("side")))
    ordered = trees.join(sides, ["group", "block"]).drop("group", "block").repartition(n, "cell").sortWithinPartitions("cell", "side")

    def traverse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in _runs(parts, ["cell"]):
            yield _links(p, cosine)

    found, _ = cut(ordered.mapInPandas(traverse, "node long, links long, other long"), "links")
    links = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null"), "node", "other")
    marks = nodes.select("node", "low", "copies").join(links, "node", "left").join(roots, "node", "left")
    marks = marks.select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root"))
    marks = marks.join(marks.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "n_links", "component_id")
    linked = good.withColumn("node", F.xxhash64("group", "v")).join(marks, "node").select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for path in (dealt_path, plan_path, trees_path):
        remove(spark, path)
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _runs(parts: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The stretches of rows that are equal in `by`, from rows in that order."""
    rest = None
    for p in parts:
        p = p if rest is None else pd.concat([rest, p], ignore_index=True)
        if not len(p):
            continue
        new = np.flatnonzero(np.append(True, (p[by].to_numpy()[1:] != p[by].to_numpy()[:-1]).any(axis=1)))
        for s, e in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
            yield p.iloc[s:e]
        rest = p.iloc[new[-1] :]
    if rest is not None and len(rest):
        yield rest


def _links(p: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Of one or two blocks: (node, links, null) sums and (node, null, other) edges that keep the connectivity."""
    from .simhash import _forest

    trees = [CoverTree.loaded(r.width, r.x, r.nodes, r.radii, r.points) for r in p.itertuples()]
    node, copies = ([np.frombuffer(b, dtype=np.int64) for b in p[c]] for c in ("node", "copies"))
    i, j = linked_pairs(trees[0], trees[-1], cosine)
    left = np.bincount(i, weights=copies[-1][j], minlength=len(node[0]))
    right = np.bincount(j, weights=copies[0][i], minlength=len(node[-1]))
    both, total = (node[0], left + right) if len(trees) == 1 else (np.append(node[0], node[1]), np.append(left, right))
    some = np.flatnonzero(total)
    edges = _forest(node[0][i], node[-1][j])
    nodes = [*both[some].tolist(), *(e[0] for e in edges)]
    return pd.DataFrame({
        "node": pd.array(nodes, dtype="Int64"),
        "links": pd.array([*total[some].astype(np.int64).tolist(), *[None] * len(edges)], dtype="Int64"),
        "other": pd.array([*[None] * len(some), *(e[1] for e in edges)], dtype="Int64"),
    })


def drop_near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93) -> DataFrame:
    """The rows of df whose key is its component's smallest; of several rows with that key one stays, whatever they hold."""
    kept, _ = cut(near_duplicates(df, key, vector, label, cosine).where("kept").groupBy(F.col(key).alias(OWN)).agg(F.count("*").alias("n")), "kept")
    out = df.join(kept.select(OWN), df[key] == F.col(OWN), "left_semi")
    return out.dropDuplicates([key]) if kept.where("n > 1").limit(1).count() else out
