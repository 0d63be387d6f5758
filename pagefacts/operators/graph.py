"""Shared folder, tables written there, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of local sessions that name none, by application.
_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a local session gets a temporary one; on a
    cluster that is an error, as executors would each write to a disk of their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = spark.sparkContext.applicationId
        path = _OWN_DIRS[own] = _OWN_DIRS.get(own) or "file://" + tempfile.mkdtemp(prefix="pagefacts-")
    return path.rstrip("/")


_SCRATCH: ContextVar[str] = ContextVar("scratch", default="")


def work_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    return f"{shared_dir(spark)}/pagefacts/{'' if keep else _SCRATCH.get()}{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside, but for those to keep, are removed at the end; nothing may read them later."""
    outer = _SCRATCH.set(f"{_SCRATCH.get()}scratch-{uuid.uuid4().hex}/")
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pagefacts/{_SCRATCH.get()}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _SCRATCH.reset(outer)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and gives true sizes."""
    path = work_path(df.sparkSession, name, keep)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an edge list of longs; component is the smallest node that is reachable.

    Alternates two star contractions. A round joins each node's neighbours with their minimum, so a
    hub's edges are rows, never one group in memory; rounds grow with the log of the longest path.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low.hint("shuffle_hash"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("shuffle_hash"), "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").where("u != v").distinct(), "edges")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    return now.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(now.select("v", "v").distinct())
