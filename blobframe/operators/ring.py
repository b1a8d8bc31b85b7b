"""Consistent hashing: points of nodes on a ring of 2^32 positions, and the preference list of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import VNODES
from ..functions.hashing import ring_position

SPACE = 1 << 32
#: Arcs up to this number are broadcast; a larger ring is joined by shuffle.
BROADCAST_ARCS = 200_000


def add_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Adds (node_id, url, add_order); a node that is there already stays as it is."""
    return nodes.unionByName(new.join(nodes.select("node_id"), "node_id", "left_anti").dropDuplicates(["node_id"]))


def remove_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(gone.select("node_id"), "node_id", "left_anti")


def points(nodes: DataFrame, vnodes: int = VNODES) -> DataFrame:
    """(position, node_id, add_order, vnode) of every virtual node."""
    v = nodes.select("node_id", "add_order", F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("vnode"))
    return v.select(ring_position(F.concat("node_id", F.lit("#vnode"), F.col("vnode").cast("string"))).alias("position"), "node_id", "add_order", "vnode")


def arcs(nodes: DataFrame, replicas: int, vnodes: int = VNODES) -> DataFrame:
    """(lo, hi, nodes): the ring cut at its points, with the first `replicas` distinct nodes clockwise of each arc. One ordered
    pass over the ring's points, whose number is set by the topology and not by the keys; the look-ahead doubles until every
    arc has its full list."""
    count = nodes.select("node_id").distinct().count()
    want, look = min(replicas, count), 16
    ring = points(nodes, vnodes)
    if want == 0:
        return ring.select(F.col("position").alias("lo"), F.col("position").alias("hi"), F.array("node_id").alias("nodes")).where("false")
    wrapped = ring.unionByName(ring.withColumn("position", F.col("position") + SPACE))
    order = W.orderBy("position", "add_order", "vnode")
    while True:
        near = F.slice(F.array_distinct(F.collect_list("node_id").over(order.rowsBetween(0, look - 1))), 1, want)
        listed = wrapped.select("position", near.alias("nodes"), (F.lag("position").over(order) + 1).alias("prev"))
        first = listed.where(F.col("position") < SPACE).select(F.coalesce("prev", F.lit(0)).alias("lo"), F.col("position").alias("hi"), "nodes")
        # past the last point a key wraps to the first one
        top = ring.agg(F.max("position").alias("last"))
        start = listed.where((F.col("position") < SPACE) & F.col("prev").isNull()).select("nodes")
        wrap = top.crossJoin(start).select((F.col("last") + 1).alias("lo"), F.lit(SPACE - 1).cast("bigint").alias("hi"), "nodes")
        out = first.unionByName(wrap).where("lo <= hi").persist()  # of the topology's size; the check fills it, the joins read it
        if look >= count * vnodes or out.agg(F.min(F.size("nodes"))).first()[0] == want:
            return out
        out.unpersist()
        look *= 2


def place(keys: DataFrame, ring_arcs: DataFrame, key: str = "chunk_hash", bits: int = 12) -> DataFrame:
    """keys with `nodes`, the preference list of each. The arc of a position is found by an equi-join on the position's upper
    bits with the range as a residual, so it plans as a hash join and never as a nested loop. A column of keys named `nodes` is
    replaced; others pass through whatever their names."""
    shift = 32 - bits
    own = {c: f"__ring__{c}" for c in ("lo", "hi", "nodes", "b", "p")}  # the join's own names
    spread = ring_arcs.select(*[F.col(c).alias(own[c]) for c in ("lo", "hi", "nodes")], F.explode(F.sequence(F.shiftright("lo", shift), F.shiftright("hi", shift))).alias(own["b"]))
    if ring_arcs.count() <= BROADCAST_ARCS:
        spread = F.broadcast(spread)
    at = keys.drop("nodes").withColumn(own["p"], ring_position(F.col(key))).withColumn(own["b"], F.shiftright(own["p"], shift))
    met = at.join(spread, own["b"]).where(F.col(own["p"]).between(F.col(own["lo"]), F.col(own["hi"])))
    return met.drop(*(own[c] for c in ("lo", "hi", "b", "p"))).withColumnRenamed(own["nodes"], "nodes")


def ranked(placed: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """One row per key and replica: key, rank (0 first), node_id."""
    return placed.select(key, F.posexplode("nodes").alias("rank", "node_id"))


def movement(before: DataFrame, after: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """(key, old_owner, new_owner) of keys whose first node changes."""
    b, a = (d.select(key, F.get("nodes", F.lit(0)).alias(n)) for d, n in ((before, "old_owner"), (after, "new_owner")))
    return b.join(a, key).where("old_owner <> new_owner")
