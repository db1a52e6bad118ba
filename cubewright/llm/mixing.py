"""Mixing sources to target weights by nested hash thresholds.

Every document has a 60-bit hash. A histogram of sizes by source and leading hash bits finds, per source, the
bucket in which the budget ends; only that bucket is histogrammed again by the next bits, until one hash value is
left. A document is then taken or not by comparing its hash with its source's threshold: nothing is sorted.
A source whose target exceeds its size is taken whole once, and the rest of the target by the threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, materialize

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """``(source, source_size, target)`` from per-source sizes.

    Sources ordered by code point, null last, take ``weights`` in turn and share ``share`` times the sum of sizes;
    a target stops at ``most`` times its source's size and the excess is shared among the others by weight until
    none is above. Only sums over the still open sources reach the driver, one row a round.
    """
    ordered = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = materialize(
        sizes.withColumn("rank", F.row_number().over(ordered) - 1)
        .withColumn("weight", F.element_at(cycle, F.col("rank") % len(weights) + 1))
        .select("source", "source_size", "weight"),
        "mix-sources",
    )
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * F.lit(float(most))
    level, closed = None, -1
    while True:
        capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        row = table.agg(
            F.sum(F.when(capped, cap).otherwise(0.0)).alias("used"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count(F.when(capped, 1)).alias("n"),
        ).first()
        if row["n"] == closed or not row["open"]:
            break
        closed, level = row["n"], (share * total - row["used"]) / row["open"]
    target = cap if level is None else F.least(cap, F.col("weight") * F.lit(level))
    return table.select("source", "source_size", target.alias("target"))


def _measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs``' columns ``keep`` and ``__mix``: source, hash and size of the row."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(*keep, F.struct(F.col("source").alias("source"), hashed.alias("hash"), size.alias("size")).alias("__mix"))


def thresholds(sized: DataFrame, weights: Sequence[int], share: float, most: float, bits: int) -> DataFrame:
    """Per source its size, target, whole repeats and the hash range in which the rest of its budget ends."""
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    repeats = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    state = sources.withColumns({
        "repeats": repeats, "rest": budget - repeats * F.col("source_size"), "low": F.lit(0).cast("long"),
        "high": F.lit((1 << HASH_BITS) - 1), "edge": F.lit(None).cast("long"),
    })
    state = materialize(state, "mix-state")

    # [low, high] is the hash range in which the budget ends; below it all is taken, and rest is what it may hold
    for shift in range(HASH_BITS - bits, -bits, -bits):
        shift = max(shift, 0)
        near = bounded_broadcast(state.select(F.col("source").alias("s"), "low", "high"))
        inside = sized.join(near, F.col("source").eqNullSafe(F.col("s"))).where(F.col("hash").between(F.col("low"), F.col("high")))
        cells = inside.groupBy("source", F.shiftright("hash", shift).alias("cell")).agg(F.sum("size").alias("words"))
        running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        upto = cells.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        hit = (
            upto.join(bounded_broadcast(state.select(F.col("source").alias("s"), "rest")), F.col("source").eqNullSafe(F.col("s")))
            .where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
            .select(F.col("source").alias("s"), "cell", "before", "words")
        )
        step = state.join(hit, F.col("source").eqNullSafe(F.col("s")), "left")
        found = F.col("cell").isNotNull()
        start = F.shiftleft(F.col("cell"), shift)
        state = materialize(
            step.select(
                "source", "source_size", "target", "repeats",
                F.when(found, F.col("rest") - F.col("before")).otherwise(F.col("rest")).alias("rest"),
                F.when(found, start).otherwise(F.col("low")).alias("low"),
                F.when(found, start + F.lit((1 << shift) - 1)).otherwise(F.col("high")).alias("high"),
                F.when(found, F.col("words")).otherwise(F.col("edge")).alias("edge"),
            ),
            "mix-state",
        )
        if not shift or not state.where("low < high and edge is not null and rest > 0").limit(1).count():
            break
    return state


def _with_taken(rows: DataFrame, state: DataFrame, whole_documents: bool) -> DataFrame:
    """``rows`` of ``_measured`` with their source's row as ``__at`` and the words taken of each as ``__taken``."""
    at = bounded_broadcast(state.select(F.col("source").alias("__s"), F.struct("source_size", "target", "repeats", "rest", "low", "high", "edge").alias("__at")))
    joined = rows.join(at, F.col("__mix.source").eqNullSafe(F.col("__s")))
    size, key, rest, edge = F.col("__mix.size"), F.col("__mix.hash"), F.col("__at.rest"), F.col("__at.edge")
    # a source without an edge has no budget that ends inside it: its rest is 0
    inside = edge.isNotNull() & key.between(F.col("__at.low"), F.col("__at.high"))
    if whole_documents:
        part = F.when(rest * 2 >= edge, size).otherwise(0)
    else:
        part = F.floor(size * rest / F.greatest(edge, F.lit(1)))
    once = F.when(inside, part).when(edge.isNotNull() & (key < F.col("__at.low")), size).otherwise(0)
    return joined.withColumn("__taken", (F.col("__at.repeats") * size + once).cast("long"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    whole_documents: bool = False, bits: int = 12,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` counts words, repeats included. With ``whole_documents`` every document is taken 0 or more times
    whole, the last one if that brings its source nearer to the target; without it the last one gives the words
    that are still missing. Null or empty texts have size 0 and take 0; null sources form one source; rows with
    the same doc_id share a hash and, at the threshold, its budget in proportion to their sizes. An empty table
    gives an empty result. Columns of ``docs`` other than doc_id, text and source are not read.
    """
    rows = materialize(_measured(docs, "doc_id"), "mix-sizes")
    state = thresholds(rows.select("__mix.*"), weights, share, most, bits)
    return _with_taken(rows, state, whole_documents).select(
        "doc_id", "__mix.source", "__mix.size", "__at.source_size", "__at.target", F.col("__taken").alias("taken")
    )


def apply_mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, bits: int = 12) -> DataFrame:
    """``docs`` as the mix takes them: whole rows, repeated or left out, with the columns of ``docs``.

    Texts are not shuffled: each row is decided where it is read. Rows without words are left out.
    """
    sized = materialize(_measured(docs).select("__mix.*"), "mix-sizes")
    rows = _with_taken(_measured(docs, *docs.columns), thresholds(sized, weights, share, most, bits), True).where("__taken > 0")
    copies = F.round(F.col("__taken") / F.col("__mix.size")).cast("int")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
