"""Shared folders, lineage cuts and connected components for the text operators."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The one column name that operators keep for themselves within a frame.
OWN = "__blobframe__"
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: Bytes of an Arrow batch on its way to a Python worker: both sides hold some of them at a time, and texts can be long.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers where PYTHONPATH does not already do so, and keep Arrow batches small;
    a session that has set a smaller size keeps it."""
    conf = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(conf).rstrip("b"))
    except ValueError:
        now = BATCH_BYTES
    if now > BATCH_BYTES:
        spark.conf.set(conf, BATCH_BYTES)
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if any(p and os.path.realpath(p) == os.path.realpath(_ROOT) for p in paths):
        return
    sc = spark.sparkContext
    if getattr(sc, "_blobframe_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(), "blobframe.zip")
    with zipfile.ZipFile(target, "w") as z:
        top = os.path.join(_ROOT, "blobframe")
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(target)
    sc._blobframe_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of its
    own; on a cluster that is an error, as executors do not see each other's folders."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="blobframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/blobframe/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it back, which ends its lineage. The folder goes when the driver's JVM
    ends at the latest; what no later plan reads is to be removed before."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    files, p = _files(spark, path)
    files.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path), path


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    files, p = _files(spark, path)
    files.delete(p, True)


def sweep(spark: SparkSession) -> None:
    """Let the files of ended shuffles go. Spark removes them once the driver's JVM has collected what refers to them, which a
    driver that works little does seldom: without this all shuffles of a query can lie on the disks at once. What ended just now
    is referred to for a moment by the listeners, so a second round follows."""
    for wait in (0.5, 0.5):
        gc.collect()  # Python's handles of plans
        spark._jvm.System.gc()
        time.sleep(wait)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: one row (node, root) per node that has an edge, root being the smallest node
    reachable. Alternating large-star and small-star rounds; each round is cut to the shared folder. A node's minimum is a
    partial aggregate joined back, so a hub of any degree is split by the adaptive skew join. Self edges are ignored."""
    spark = edges.sparkSession
    e = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") > F.col("v"))
        .distinct()
    )
    e, path = cut(e, "cc")
    stamp = _stamp(e)
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        large, path2 = cut(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("e")
        )
        small = small.select("e.u", "e.v").where("u > v").distinct()
        small, path3 = cut(small, "cc")
        remove(spark, path)
        remove(spark, path2)
        e, path, old, stamp = small, path3, stamp, _stamp(small)
        if old == stamp:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _stamp(e: DataFrame):
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
