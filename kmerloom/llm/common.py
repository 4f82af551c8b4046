"""Pieces shared by the operators: tokens, folds, shared storage and connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator here: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Array of the words of a text; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def fold(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def byte_words(text: str | None) -> list[bytes]:
    """Python's side of words(): bytes.split() breaks at exactly the same six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, one is made if all of Spark is this process; on a cluster that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = jvm.get() if jvm.isDefined() else None
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='kmerloom-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: a plan cut that survives the loss of executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/kmerloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._kmerloom_path = at
    for names in _OPEN:
        names.append(at)
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing lazy refers to it."""
    if at := getattr(df, "_kmerloom_path", None):
        _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The paths written in each scratch_tables() that is open.
_OPEN: list[list[str]] = []


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end what materialise() has written within it, but for the paths taken out of the list it gives."""
    names: list[str] = []
    _OPEN.append(names)
    try:
        yield names
    finally:
        _OPEN.remove(names)
        for at in names:
            _delete(spark, at)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let Spark remove shuffle files and broadcasts of finished queries now: it does so when the driver collects garbage."""
    gc.collect()
    spark._jvm.java.lang.System.gc()


def input_bytes(df: DataFrame, column: str = "text") -> int:
    """Size of the input, for choosing numbers of partitions (never results).

    Catalyst's estimate, which takes no job; where it has none, or one inflated by joins, the column is measured.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 44:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of nodes (i for rows, number of rows + j for columns): each node that links reach with its tree's first node."""
    rows, cols = linked.shape
    out, done_r, done_c = [], ~linked.any(1), ~linked.any(0)
    for seed in np.flatnonzero(~done_r):
        if done_r[seed]:
            continue
        done_r[seed] = True
        front = np.array([seed])
        while len(front):
            right = np.flatnonzero(linked[front].any(0) & ~done_c)
            done_c[right] = True
            out += [(seed, rows + j) for j in right.tolist()]
            front = np.flatnonzero(linked[:, right].any(1) & ~done_r)
            done_r[front] = True
            out += [(seed, i) for i in front.tolist()]
    return out


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long pairs: (node, component), component the smallest node reached.

    Large-star and small-star rounds in DataFrame operations: a node's minimum is pre-aggregated before the
    shuffle, a hub is an aggregation key and a side of a splittable join, never a collected list. Each round is
    written to the shared folder. Null ends and self loops are ignored; no edges give no rows.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = materialise(e, "edges")
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialise(small.where("u <> v").distinct(), "edges")
        state = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        discard(e)
        e = now
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    out = e.groupBy("u").agg(F.min("v").alias("component"))
    return out.select(F.col("u").alias("node"), "component").unionAll(out.select(F.col("component").alias("node"), "component").distinct())
