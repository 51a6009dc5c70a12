"""Helpers that several operators share: table access, lineage cuts and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local folder is made only where the setting is absent and Spark runs in one machine, as
    in tests; a cluster without the setting is an error, since its executors share no disk.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tallyforge-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of our own, wherever Spark keeps it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole_path(spark: SparkSession, folder: str) -> str:
    """``folder`` with its scheme, as Spark reads it: a bare path is one of ``fs.defaultFS``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Documents are long: Arrow batches of the default 10,000 rows would hold tens of MB of
    text in both the JVM and Python for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and replace its lineage by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows hold ``rows`` rows."""
    return max(1, -(-rows // per_block))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected edge list: (node, component).

    Alternates large-star and small-star steps until the edges no longer change;
    every step is a minimum per node (combined before the shuffle) and a join back,
    so no neighbour list is ever gathered. Loops and null ends are ignored; nodes
    without a proper edge are absent from the result. component is the smallest node.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = cut(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("v"), F.least(x, y).alias("w"))
        .distinct()
    )
    mark = F.sum(F.xxhash64("v", "w").cast("decimal(38,0)"))
    seen = now.agg(F.count("*"), mark).head()
    while seen[0]:
        both = now.select(F.col("v").alias("u"), F.col("w").alias("n")).union(now.select(F.col("w").alias("u"), F.col("v").alias("n")))
        least = both.groupBy("u").agg(F.min("n").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("n") > F.col("u")).select(F.col("n").alias("v"), F.col("m").alias("w")).distinct()
        large = cut(large)
        root = large.groupBy("v").agg(F.min("w").alias("m"))
        moved = large.join(root, "v").where(F.col("w") != F.col("m")).select(F.col("w").alias("v"), F.col("m").alias("w"))
        now = cut(root.select("v", F.col("m").alias("w")).union(moved).distinct())
        last, seen = seen, now.agg(F.count("*"), mark).head()
        if last == seen:
            break
    return now.select(F.col("v").alias("node"), F.col("w").alias("component")).union(
        now.select(F.col("w").alias("node"), F.col("w").alias("component")).distinct()
    )


def gathered(rows: DataFrame, size: int, kind: str = "int64") -> np.ndarray:
    """(place, value) rows with places below ``size`` as one array on the driver; a task packs
    them, so the driver gets a single value of that fixed size."""

    def pack(table: pa.Table) -> pa.Table:
        held = np.zeros(size, dtype=kind)
        held[table.column("place").to_numpy()] = table.column("value").to_numpy()
        return pa.table({"held": pa.array([held.tobytes()], pa.binary())})

    got = rows.select("place", "value", F.lit(0).alias("all")).groupBy("all").applyInArrow(pack, "held binary").collect()
    return np.frombuffer(got[0]["held"], dtype=kind) if got else np.zeros(size, dtype=kind)


_STATE: dict = {}


def worker_state(key, make):
    """What a Python worker keeps for one operator. Workers serve many operators in turn;
    what another one left behind is let go first, so memory doesn't add up."""
    if key not in _STATE:
        _STATE.clear()
        gc.collect()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):  # glibc keeps freed memory otherwise
            libc.malloc_trim(0)
        _STATE[key] = make()
    return _STATE[key]
