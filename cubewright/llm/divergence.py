"""Source divergence audit: how term shares differ between the sources of a language, from count-level bitmaps.

Each group (language and source) stores, for every count that a term has in it, the bitset of the terms with that count,
in 64-bit words of a language's term ids. The words of two groups, ANDed and counted, give the joint cells: how many
terms have count a in one and count b in the other. A cell adds its size times the divergence f of its two shares.
Terms that a group lacks need no bitset: they are the complement, so their cells follow from each group's own level
sizes and the number of terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_broadcast, groups, materialize

#: Documents of a language that a term must be in to be kept, and terms reported for a group.
MIN_DOCUMENTS, TOP = 10, 10
UNIT = 1_000_000_000
#: Terms whose ids are dealt in one window, different terms that a task holds before it sends them on, and levels compared at once.
BUCKET, HELD, BLOCK = 10_000, 300_000, 1024
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of every term by language and source, summed over what a task has read."""
    times: dict[tuple, Counter] = {}
    rows: dict[tuple, Counter] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), counted in times.items():
            terms = list(counted)
            within = rows[lang, source]
            for at in range(0, max(1, len(terms)), 50_000):  # a group without terms is one row of nulls
                some = terms[at : at + 50_000] or [None]
                n = len(some)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(some, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([counted.get(t, 0) for t in some], pa.int64()), pa.array([within.get(t, 0) for t in some], pa.int64())], ["lang", "source", "term", "n", "docs"])
        times.clear()
        rows.clear()

    for b in batches:
        texts = b.column("text").cast(pa.large_binary())
        for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), texts, strict=True):
            words = text.as_py().translate(_WORD).split()
            key = lang, source
            if key not in times:
                times[key], rows[key] = Counter(), Counter()
            times[key].update(words)
            rows[key].update(set(words))
        if sum(map(len, times.values())) > HELD:
            yield from sent()
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term in each group, and one row with a null term
    for each group where some task found no term."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    found = docs.select(*filled).mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(UNIT * (n + 2) / (total + 2 * terms))`` in whole numbers."""
    above = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.call_function("div", above, (total + 2 * terms).cast("decimal(20,0)")) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, a, b, value``: for the groups that share words, the sum over joint cells of both counts above zero of their
    sizes times what f differs by from the cells with a zero that the levels' own sizes account for."""
    held: Counter = Counter()

    def sent() -> pa.RecordBatch:
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in range(3)]
        batch = pa.RecordBatch.from_arrays([*columns, pa.array(list(held.values()), pa.int64())], ["lang", "a", "b", "value"])
        held.clear()
        return batch

    for g in groups(batches, ["lang", "bucket", "word"]):
        source = g.column("source").to_numpy()
        order = np.argsort(source, kind="stable")
        source = source[order]
        bits, p, zero = (g.column(c).to_numpy()[order] for c in ("bits", "p", "zero"))
        bits = bits.view(np.uint64)
        starts = np.flatnonzero(np.append(True, source[1:] != source[:-1]))
        edges = np.append(starts, len(source))
        number = np.repeat(np.arange(len(starts)), np.diff(edges))
        lang = g.column("lang")[0].as_py()
        total = np.zeros((len(starts), len(starts)), np.int64)
        for i in range(0, len(source), BLOCK):
            for j in range(i, len(source), BLOCK):  # sources are in order, so blocks below the diagonal repeat those above
                a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                size = np.bitwise_count(bits[a, None] & bits[None, b]).astype(np.int64)
                pa_, pb, za, zb = p[a, None], p[None, b], zero[a, None], zero[None, b]
                value = size * (_f(pa_, pb) - _f(pa_, zb) - _f(za, pb) + _f(za, zb))
                rows, columns = (np.flatnonzero(np.diff(number[s], prepend=-1)) for s in (a, b))
                np.add.at(total, (number[a][rows][:, None], number[b][columns][None, :]), np.add.reduceat(np.add.reduceat(value, rows, axis=0), columns, axis=1))
        names = source[starts]
        for i, j in zip(*np.triu_indices(len(names), 1), strict=True):
            held[lang, names[i], names[j]] += int(total[i, j])
        if len(held) > HELD:
            yield sent()
    if held:
        yield sent()


def bitmaps(counts: DataFrame, kept: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, bucket, word, source, n, p, zero, bits``: words of each group's bitset at each count, with the shares of that
    count and of zero. Only words with a bit are stored."""
    own = Window.partitionBy("lang", "bucket").orderBy(F.desc("docs"), "term")  # frequent terms together: the others' words have few levels
    buckets = 1 + kept.count() // BUCKET
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).withColumn("id", F.row_number().over(own) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("id", F.lit(64)))
    rows = counts.join(dealt.select("lang", "term", "bucket", "id"), ["lang", "term"]).join(bounded_broadcast(known), ["lang", "source"])
    rows = rows.select("lang", "bucket", F.floor(F.col("id") / 64).cast("int").alias("word"), "source", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "zero", bit.alias("bit"))
    return rows.groupBy("lang", "bucket", "word", "source", "n").agg(F.max("p").alias("p"), F.max("zero").alias("zero"), F.expr("bit_or(bit)").alias("bits"))


def pair_values(bits: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each two different groups of a language, both ways."""
    parts = int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = bits.repartition(parts, "lang", "bucket", "word").sortWithinPartitions("lang", "bucket", "word")
    cells = dealt.select("lang", "bucket", "word", "source", "p", "zero", "bits").mapInArrow(_cells, "lang string, a string, b string, value long")
    cells = cells.groupBy("lang", "a", "b").agg(F.sum("value").alias("cells"))
    levels = bits.groupBy("lang", "source", "n").agg(F.sum(F.bit_count("bits")).alias("size"), F.max("p").alias("p"))
    other = known.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"), F.col("present").alias("item_present"))
    alone = levels.join(other, "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("size") * divergence(F.col("p"), F.col("item_zero"))).alias("alone"))
    pairs = known.join(other, "lang").where("source <> item")
    pairs = pairs.join(alone, ["lang", "source", "item"], "left")
    pairs = pairs.join(alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), F.col("alone").alias("other_alone")), ["lang", "source", "item"], "left")
    pairs = pairs.withColumn("a", F.least("source", "item")).withColumn("b", F.greatest("source", "item")).join(cells, ["lang", "a", "b"], "left")
    none = (F.col("terms") - F.col("present") - F.col("item_present")) * divergence(F.col("zero"), F.col("item_zero"))
    value = sum((F.coalesce(c, F.lit(0)) for c in ("alone", "other_alone", "cells")), F.coalesce(none, F.lit(0)))
    return pairs.select("lang", "source", "item", value.alias("value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` of ``docs`` (``text, lang, source``; null ones count as empty).

    Terms are runs of ASCII letters, lower-cased, and characters beyond ASCII; each language keeps those in at least
    ``min_documents`` of its rows, each row being a document. Part ``pair`` ranks a group's divergences from every other
    group of its language over all kept terms (0 where none is kept), part ``term`` the ``top`` kept terms whose share
    in the group is above the language's. Whole numbers throughout. A group without terms has pairs only, a language of
    one source no pairs; an empty table gives no rows. Other columns are not read.
    """
    counts = materialize(term_counts(docs), "term-counts")
    words = counts.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    kept = materialize(kept.where(F.col("docs") >= min_documents), "kept-terms")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = words.join(kept.select("lang", "term"), ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("present"))
    known = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    known = known.fillna(0, ["total", "present", "terms", "lang_total"])
    zero = F.when(F.col("terms") > 0, share(F.lit(0), F.col("total"), F.col("terms")))
    known = materialize(known.withColumn("zero", zero), "audited-groups")

    bits = materialize(bitmaps(words, kept, known), "count-bitmaps")
    pairs = pair_values(bits, known).withColumn("part", F.lit("pair"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", "part", "item", "value", F.row_number().over(own).alias("rank"))

    shared = words.select("lang", "source", "term", "n").join(kept.select("lang", "term", "lang_n"), ["lang", "term"]).join(bounded_broadcast(known), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    above = shared.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    ranked = above.select("lang", "source", "part", "item", divergence(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(own))
    return pairs.union(ranked.where(F.col("rank") <= top))
