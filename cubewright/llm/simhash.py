"""SimHash near-duplicates found by covering locality-sensitive hashing.

A covering family for radius r uses 2^(r+1)-1 bit masks: bit i has a label in {1 .. 2^(r+1)-1} and mask v keeps the
bits whose label has an odd number of ones in common with v. The labels of at most r differing bits span a space
that is orthogonal to some v, so under that mask the two fingerprints are equal: every pair within the radius
shares a bucket in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_broadcast, connected_components, groups, materialize

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: Fingerprints that one task compares with each other; larger buckets are dealt out as pairs of blocks.
BLOCK = 1024


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash, as a signed integer, of the word shingles of a text; 0 where there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        values = np.array([xxhash.xxh64_intdigest(whole, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        values = np.fromiter([digest(whole[s:e], SEED) for s, e in spans], dtype=np.uint64, count=len(words) - width + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 65_536):
        ones += np.unpackbits(values[at : at + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(values), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), width) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def masks(radius: int) -> list[int]:
    """The covering masks for 64 bits, as signed integers."""
    top = 1 << (radius + 1)
    label = [i % (top - 1) + 1 for i in range(64)]
    found = []
    for v in range(1, top):
        m = sum(1 << i for i in range(64) if (label[i] & v).bit_count() % 2)
        found.append(m - (1 << 64) if m >> 63 else m)
    return found


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect the same fingerprints as all pairs within the radius do: at most one a fingerprint."""
    n = len(fps)
    bits = fps.view(np.uint64)  # the count of a negative number would be that of its absolute value
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius
    label = np.arange(n)
    while True:
        low = np.where(near, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    return [(int(fps[i]), int(fps[label[i]])) for i in range(n) if label[i] != i]


def links(fps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: edges among the distinct fingerprints ``fp`` that connect just what all pairs within the radius connect."""
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = F.explode(F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(masks(radius))]))
    cells = fps.select("fp").repartition(parts).select(tables.alias("bucket"), "fp")  # a small table is one split or two
    size = cells.groupBy("bucket").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    size = materialize(size, "simhash-buckets")
    pairs = size.where("n = 2").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")

    many = cells.join(size.where("n > 2").select("bucket", "n"), "bucket")
    blocks = F.ceil(F.col("n") / block).cast("int")
    many = many.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = many.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["cell"]):
            found = _forest(np.unique(g.column("fp").to_numpy()), radius)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    compared = many.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")
    return pairs.union(compared)


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per row of ``docs``.

    Texts are lower-cased in A-Z and shingled by ``width`` words; fingerprints link at ``radius`` or fewer
    differing bits, and component_id is the smallest doc_id reachable. Null and empty texts have fingerprint 0 and
    are linked like any other. Exact copies are one fingerprint before anything is compared, so a large group of
    copies costs one row. An empty table gives an empty result; other columns are not read.
    """
    rows = materialize(fingerprints(docs, width), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    parts = connected_components(links(distinct.select("fp"), radius))
    named = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = materialize(named, "simhash-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "component").select(F.col("fp").alias("node"), "component_id")
    found = rows.join(ids, F.col("fp") == F.col("node"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """``docs`` without the rows that have a near copy of a smaller doc_id.

    The ids that go are joined back, so texts are shuffled only where these are too many to broadcast. Rows that repeat
    a doc_id stay or go together; rows without an id stay, as nothing names them; null and empty texts are near copies of
    each other; an empty table gives an empty result; columns and texts are as they were.
    """
    gone = near_duplicates(docs, radius, width).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = materialize(gone, "simhash-gone")
    return docs.join(bounded_broadcast(gone), docs["doc_id"] == F.col("__gone"), "left_anti")
