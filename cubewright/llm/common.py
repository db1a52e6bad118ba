"""Helpers shared by the corpus operators: shared storage, bounded broadcasts, group iteration, components."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows and bytes that a side of a join may have to be broadcast; beyond either the join shuffles.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 200_000, 16 << 20


@functools.lru_cache
def _local_dir(application: str) -> str:
    """The one local folder of a local session that names no shared one."""
    return "file://" + tempfile.mkdtemp(prefix="cubewright-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where the session names none, a local session, as in tests, gets a new local folder; on a cluster that is an error,
    as executors would write where the others can't read.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _local_dir(spark.sparkContext.applicationId)
    return path.rstrip("/")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Let Arrow batches hold at most ``size`` of rows from now on, where the session has Spark's default: tasks that read
    whole texts hold a batch several times over."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "67108864"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cubewright/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there, and lost executors take nothing with them."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that ``materialize`` wrote and that nothing will read again."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows of at most ``max_bytes`` in all, else unmarked, so
    that the join shuffles. ``df`` is read for that, so it should be a stored table or a small one."""
    size = F.lit(8 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind.startswith(("array", "map", "struct")):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    found = df.agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes")).first()
    return F.broadcast(df) if found["rows"] <= max_rows and (found["bytes"] or 0) <= max_bytes else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal ``keys`` in batches sorted by them; a run may cross batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        cuts = np.flatnonzero(change).tolist()
        at = 0
        for cut in cuts:
            if cut > at:
                held.append(batch.slice(at, cut - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], cut
        held.append(batch.slice(at))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of an undirected graph of long ids, ``component`` the smallest id reachable.

    ``edges`` has columns ``a`` and ``b``. Each round draws a new random order, maps every node to the first of itself
    and its neighbours, and rewrites the edges between the images, so the graph shrinks to half or so whatever its shape
    and ids are: a path of n nodes takes about log2(n) rounds. The maps are composed along the way, and what a round has
    replaced is removed. Loops, repeated edges and null ends are ignored; nodes without an edge are not returned.
    """
    edges = materialize(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, turn = None, 0
    while edges.limit(1).count():
        turn += 1
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(rank("b")).alias("first"))
        best = materialize(best.select(F.col("a").alias("node"), F.least("first", rank("a"))["id"].alias("to")), "best")
        left = best.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = best.select(F.col("node").alias("b"), F.col("to").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x != y")
        old, edges = edges, materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(old)
        if labels is None:
            labels = best.withColumnRenamed("to", "component")
            continue
        step = best.select(F.col("node").alias("component"), "to")
        old, labels = labels, labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        labels = materialize(labels, "labels")
        discard(old, best)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    return materialize(labels.join(least, "component").select("node", F.col("least").alias("component")), "components")
