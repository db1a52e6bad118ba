"""Vector code compression: product codes whose nearest codebook entries come from slice-and-intersect bitmasks.

Components become integers, vectors are cut into equal parts, and each part is replaced by the index of the nearest
entry of its position's codebook, trained by Lloyd rounds in exact integer arithmetic. A codebook is searched by its
coordinates: along every dimension they are sorted, and each place in that order carries the mask of all entries before
it, so that the exclusive or of two such masks is the slice of entries within a radius. The slices of all dimensions,
ANDed, are the entries in a box around the part. If the nearest of them is no farther than the radius, nothing outside
the box can be as near, ties included; else the search goes on with the distance found, or twice the radius.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Integer components are held within this bound, so that squared distances of 500 components fit a long.
BOUND = 1 << 26
#: Rows that are searched at once.
ROWS = 1024
#: Salts by which the rows of a label are dealt out where its sum meets them.
SALTS = 32


class SliceIndex:
    """Exact nearest entries of one codebook (``entries``: int64, entries by dimensions)."""

    def __init__(self, entries: np.ndarray, radius: int | None = None):
        self.entries = entries
        n, width = entries.shape
        self.words = (n + 63) // 64
        own = np.zeros((n, self.words), np.uint64)
        own[np.arange(n), np.arange(n) // 64] = np.uint64(1) << (np.arange(n, dtype=np.uint64) % np.uint64(64))
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, axis=0)
        self.before = np.zeros((width, n + 1, self.words), np.uint64)
        for j in range(width):
            self.before[j, 1:] = np.bitwise_or.accumulate(own[order[:, j]], axis=0)
        self.all = np.bitwise_or.reduce(own, axis=0)
        self.radius = max(1, radius if radius is not None else self._spacing())

    def _spacing(self) -> int:
        """The median distance of an entry to the nearest other one: the radius that a search begins with."""
        if len(self.entries) < 2:
            return 1
        nearest = np.empty(len(self.entries))
        for i, e in enumerate(self.entries):
            d = ((self.entries - e) ** 2).sum(axis=1)
            d[i] = d.max()
            nearest[i] = d.min()
        return int(np.sqrt(np.median(nearest)))

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks of the entries whose every coordinate is within ``radius`` of the row's."""
        masks = np.tile(self.all, (len(x), 1))
        for j in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.sorted[:, j], x[:, j] + radius, "right")
            masks &= self.before[j, high] ^ self.before[j, low]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every row, ties to the lower index, and its squared distance."""
        code, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), ROWS):
            code[at : at + ROWS], best[at : at + ROWS] = self._nearest(x[at : at + ROWS])
        return code, best

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        todo, radius = np.arange(len(x)), np.full(len(x), self.radius, np.int64)
        while len(todo):
            bits = np.unpackbits(self.within(x[todo], radius).view(np.uint8), axis=1, bitorder="little")
            row, entry = np.nonzero(bits)  # by row, then entry
            distance = ((x[todo[row]] - self.entries[entry]) ** 2).sum(axis=1)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            some, least = row[starts], np.minimum.reduceat(distance, starts) if len(starts) else distance
            lengths = np.diff(starts, append=len(row))
            ties = np.flatnonzero(distance == np.repeat(least, lengths))
            first = ties[np.flatnonzero(np.diff(row[ties], prepend=-1))]
            code[todo[some]], best[todo[some]] = entry[first], least
            wider = 2 * radius
            wider[some] = np.ceil(np.sqrt(least.astype(np.float64))).astype(np.int64) + 1
            done = np.zeros(len(todo), bool)
            done[some] = least <= radius[some] ** 2
            todo, radius = todo[~done], wider[~done]
        return code, best


class Codebooks:
    """One codebook of equal size per part position: int64, parts by entries by components of a part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def indexes(self) -> list[SliceIndex]:
        return [SliceIndex(e) for e in self.entries] if self.entries.shape[1] else []

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()

    def decode(self, code: str) -> np.ndarray:
        """The vector that a code stands for."""
        return np.concatenate([self.entries[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]) / SCALE


def whole_components(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, x``: integer components of the rows whose vector is not null and holds only finite numbers."""
    finite = F.forall("e", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))  # false for NaN too, which is above infinity
    held = lambda v: F.greatest(F.lit(-float(BOUND)), F.least(v * SCALE, F.lit(float(BOUND))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("e"))
    rows = rows.where(F.col("e").isNotNull() & finite)
    return rows.select("vec_id", "label", F.transform("e", lambda v: F.floor(held(v)).cast("int")).alias("x"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``width`` components; shorter vectors end in zeros."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    if (sizes == width).all():
        return values.reshape(len(sizes), width).astype(np.int64)
    found = np.zeros((len(sizes), width), np.int64)
    found[np.arange(width)[None, :] < sizes[:, None]] = values
    return found


def _sums(books: Codebooks):
    parts, entries, each = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = books.indexes()
        sums, counts = np.zeros((parts, entries, each), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x = _matrix(b.column("x"), books.width)
            for p, index in enumerate(indexes):
                part = x[:, p * each : (p + 1) * each]
                code, _ = index.nearest(part)
                np.add.at(sums[p], code, part)
                counts[p] += np.bincount(code, minlength=entries)
        used = np.argwhere(counts > 0)
        rows = [used[:, 0].astype(np.int32), used[:, 1].astype(np.int32), counts[counts > 0]]
        yield pa.RecordBatch.from_arrays([*map(pa.array, rows), pa.array(list(sums[counts > 0]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _codes(books: Codebooks):
    parts, _, each = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = books.indexes()
        for b in batches:
            x = _matrix(b.column("x"), books.width)
            code, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, index in enumerate(indexes):
                code[:, p], distance = index.nearest(x[:, p * each : (p + 1) * each])
                error += distance
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of the stored rows ``vec_id, x``: they begin as the parts of the ``entries`` smallest vec_ids and move
    ``rounds`` times to the floor of the mean of what is nearest to them; unused entries stay.

    Every round reads all rows; a task sends one row of sums for each entry it used. Where vec_ids are repeated, the
    smaller vector comes first; null ones come last. Vectors of several lengths take the longest, in whole parts, and
    shorter ones end in zeros. Fewer rows than ``entries`` give as many entries; no rows give none. Codes are of two
    hexadecimal digits, so ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    each = -(-longest // parts)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.zeros((len(first), parts * each), np.int64)
    for i, row in enumerate(first):
        start[i, : len(row["x"])] = row["x"]
    books = Codebooks(np.ascontiguousarray(start.reshape(len(first), parts, each).transpose(1, 0, 2)))
    for _ in range(rounds if len(first) and each else 0):
        found = rows.select("x").mapInArrow(_sums(books), "part int, entry int, n long, sums array<long>")
        found = found.select("part", "entry", "n", F.posexplode("sums").alias("at", "sum")).groupBy("part", "entry", "at").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"))
        moved = books.entries.copy()
        for row in found.collect():  # as many as the codebooks have components
            moved[row["part"], row["entry"], row["at"]] = row["sum"] // row["n"]
        books = Codebooks(moved)
    return books


def encode(rows: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error``: each row's indexes by part as hexadecimal digits, and its squared distance from them."""
    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x").mapInArrow(_codes(books), f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """``vec_id, label, code, error, label_error`` of ``vectors`` (``vec_id, embedding, label``), and the codebooks.

    One row for each row whose vector is not null and holds only finite components; repeated and null vec_ids are kept.
    Components are held within ``BOUND`` (65,536 before scaling), far beyond those of normalised vectors. An empty
    vector is one of zeros; an empty table, or one without such a row, gives no rows. ``label_error`` sums the errors of
    equal labels, nulls together. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = whole_components(vectors)
    if rows.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # a small table is one split or two
    rows = materialize(rows, "vector-components")
    books = train(rows, parts, entries, rounds)
    codes = materialize(encode(rows, books), "vector-codes")
    discard(rows)
    # a label may be on a third of all rows: its rows are dealt out by salt, and its sum goes to the salts it has
    dealt = codes.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    partial = dealt.groupBy("label", "salt").agg(F.sum("error").alias("part"))
    total = partial.groupBy(F.col("label").alias("of")).agg(F.sum("part").alias("label_error"))
    known = partial.join(total, partial["label"].eqNullSafe(total["of"])).select("of", F.col("salt").alias("of_salt"), "label_error")
    joined = dealt.join(known, dealt["label"].eqNullSafe(known["of"]) & (dealt["salt"] == known["of_salt"]))
    return joined.select("vec_id", "label", "code", "error", "label_error"), books
