"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length 1, where a cosine is a distance: d^2 = 2 - 2 cos. Each of TABLES tables buckets a vector
by WIDTH-quantised random projections; vectors that share a bucket and a label are compared exactly. At cosine 0.98
(distance 0.2) one projection agrees with probability 0.84, a table with 0.25 and any of 24 tables with 0.999;
unrelated vectors meet in a table with probability 3e-5. Raise PROJECTIONS with the logarithm of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import connected_components, groups, materialize

TABLES, PROJECTIONS, WIDTH, SEED = 24, 8, 1.0, 20
#: Vectors that one task compares with each other; larger buckets are dealt out as pairs of blocks.
BLOCK = 512


def _planes(dimension: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dimension])
    plane = rng.standard_normal((dimension, TABLES * PROJECTIONS))
    shift = rng.uniform(0, WIDTH, TABLES * PROJECTIONS)
    mix = rng.integers(1, 1 << 62, PROJECTIONS, dtype=np.int64) | 1
    return plane, shift, mix


def table_keys(unit: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key for each row of ``unit`` and table."""
    plane, shift, mix = _planes(unit.shape[1])
    cells = np.floor((unit @ plane + shift) / WIDTH).astype(np.int64).reshape(len(unit), TABLES, PROJECTIONS)
    with np.errstate(over="ignore"):
        return (cells * mix).sum(axis=2)


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for v, label in zip(b.column("vector"), b.column("label"), strict=True):
            key = None
            if v.is_valid and label.is_valid:
                values = v.values
                x = values.to_numpy(zero_copy_only=False) if not values.null_count and len(values) else np.zeros(0)
                if np.isfinite(x).all() and x.any():
                    key = hashlib.blake2b((x + 0.0).tobytes() + str(label.as_py()).encode(), digest_size=16).digest()
            keys.append(key)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())], [*b.schema.names, "key"])


def _unit(vectors: pa.Array) -> list[np.ndarray]:
    """The vectors at length 1; divided by their largest component first, so that no square is too large or too small."""
    found = []
    for v in vectors:
        x = v.values.to_numpy(zero_copy_only=False)
        x = x / np.abs(x).max()
        found.append(x / np.sqrt(x @ x))
    return found


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        units = _unit(b.column("vector"))
        by_size: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            by_size.setdefault(len(u), []).append(i)
        for size, at in by_size.items():
            keys = table_keys(np.array([units[i] for i in at]))
            rep = np.repeat(b.column("rep").to_numpy()[at], TABLES)
            labels = pa.array(np.repeat(np.array(at), TABLES))
            salt = np.tile(np.arange(TABLES, dtype=np.int64), len(at)) * 1_000 + size * 1_000_003
            columns = [pa.array(keys.reshape(-1)), pa.array(salt), b.column("label").take(labels), pa.array(rep)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "salt", "label", "rep"])


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["cell"]):
            g = g.combine_chunks()
            rep, size = g.column("rep").to_numpy(), g.column("size").to_numpy()
            unit = np.array(_unit(g.column("vector").chunk(0)))
            keys, table = table_keys(unit), g.column("salt")[0].as_py() % 1_000_003 // 1_000
            near = unit @ unit.T >= threshold
            np.fill_diagonal(near, False)
            own, other = g.column("own").to_numpy(), g.column("other").to_numpy()
            if (own != other).any():
                near &= own[:, None] != own[None, :]
            first = near.copy()
            for t in range(table):  # a pair counts in the first table in which it meets
                first &= keys[:, t][:, None] != keys[:, t][None, :]
            links = first @ size
            label = np.arange(len(rep))
            linked = near | np.eye(len(rep), dtype=bool)
            while True:
                low = np.where(linked, label[None, :], len(rep)).min(axis=1)
                low = low[low]
                if (low == label).all():
                    break
                label = low
            some = near.any(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[label][some]), pa.array(links[some].astype(np.int64))], ["a", "b", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors`` (``vec_id, embedding, label``).

    Vectors with equal labels link at a cosine of ``threshold`` or more, in double precision. Null labels and
    vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths don't link. Equal vectors of a label are one class before anything is compared, so that a large group of
    copies costs one row; every row of the class counts as a link of the others. A pair is counted in the first
    table in which it meets. Rows that repeat a vec_id, or have none, are compared each by its own vector; a row whose
    component has no id at all gets a null component_id. An empty table gives an empty result; other columns are not read.
    """
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    kind = rows.schema["label"].dataType.simpleString()
    tagged = rows.mapInArrow(_identify, f"vec_id long, vector array<double>, label {kind}, key binary")
    ids = materialize(tagged.select("vec_id", "key"), "vector-ids")
    equal = tagged.where("key is not null").groupBy("key")
    classes = equal.agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    # vec_ids may be null or name several vectors, so classes get numbers of their own, which hold once stored
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    own = classes.select("rep", "size", "label", "vector").repartition(parts)  # a small table is one split or two

    cells = own.select("rep", "label", "vector").mapInArrow(_bucketed, f"key long, salt long, label {kind}, rep long")
    cells = materialize(cells.select(F.xxhash64("key", "salt", "label").alias("bucket"), "salt", "rep"), "vector-buckets")
    full = cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = cells.join(full, "bucket").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    met = met.select(F.xxhash64("bucket", low, high).alias("cell"), "salt", "rep", "own", "other").join(classes.select("rep", "size", "vector"), "rep")
    met = met.repartition(parts, "cell").sortWithinPartitions("cell")
    found = materialize(met.mapInArrow(_compare(threshold), "a long, b long, links long"), "vector-links")

    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    component = connected_components(found.select("a", "b")).withColumnRenamed("node", "rep")
    known = classes.select("rep", "key", "size", "least").join(links, "rep", "left").join(component, "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    out = ids.join(known, "key", "left")
    own_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own_id.alias("component_id"), own_id.eqNullSafe(F.col("vec_id")).alias("kept"))
