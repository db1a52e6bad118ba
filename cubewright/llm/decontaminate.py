"""Benchmark decontamination with a distributed positional inverted index.

The test terms' frequencies in the training texts choose, for every window of test words, its rarest terms. The
training texts' postings of those terms, with positions, are stored; starting from the rarest terms, lists are
intersected after subtracting each term's offset in the test item, which leaves alignments of item and document.
Exact phrases are then read off the document's words along each alignment.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, bounded_broadcast, materialize, new_path

CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of UTF-8 text with A-Z lower-cased and all that stands between words as a blank.
PLAIN = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Test terms that one pass over the training texts looks up; more are looked up in further passes.
MAX_TERMS = 400_000
#: Documents with alignments that are broadcast to the texts, if their bytes are few as well; more are joined by a shuffle.
MAX_ALIGNED = 30_000
#: Stands for a null doc_id inside this module.
NO_ID = -(1 << 63)


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased; none of a null."""
    return text.translate(PLAIN).split() if text else []


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def item_words(bench: DataFrame) -> DataFrame:
    """``item, item_id, n, p, term``: every test word with its position and its item's length.

    ``item`` numbers the distinct rows (item_id, text), as ids may be null or shared; it holds only once stored.
    """
    split = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(CLASS), F.lit(0))
    rows = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    rows = rows.select(F.monotonically_increasing_id().alias("item"), "item_id", split.alias("w"))
    return rows.select("item", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("p", "term"))


def _blocks(terms: DataFrame) -> Iterator[dict[bytes, int]]:
    """The distinct terms with numbers, at most about MAX_TERMS to a block."""
    count = terms.count()
    parts = -(-count // MAX_TERMS) or 1
    for k in range(parts):
        found = [r["term"] for r in terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect()]
        yield {t.encode(): i for i, t in enumerate(sorted(found))}


def _numbers(found: list[bytes], block: dict[bytes, int]) -> np.ndarray:
    """Each word's number in the block, -1 for those it lacks."""
    return np.fromiter(map(block.get, found, repeat(-1)), dtype=np.int64, count=len(found))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, df``: occurrences in all training texts of every distinct test term."""
    spark = docs.sparkSession
    found = None
    for block in _blocks(terms):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(shared.value) + 1, dtype=np.int64)
            for b in batches:
                for t in _texts(b):
                    hits = _numbers(words(t), shared.value)
                    np.add.at(total, hits[hits >= 0], 1)
            names = list(shared.value)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([names[i].decode() for i in some], pa.string()), pa.array(total[some], pa.int64())], ["term", "df"])

        part = docs.select("text").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
        found = part if found is None else found.union(part)
    return terms.join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def postings(docs: DataFrame, terms: DataFrame, path: str) -> DataFrame:
    """Store ``term, doc_id, positions`` of the given terms in all training texts; the index is read from ``path``."""
    spark = docs.sparkSession
    rows = keyed(docs)
    for k, block in enumerate(_blocks(terms)):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names = pa.array([t.decode() for t in shared.value], pa.string())
            for b in batches:
                docs, terms, places = [], [], []
                for doc, t in enumerate(_texts(b)):
                    number = _numbers(words(t), shared.value)
                    at = np.flatnonzero(number >= 0)
                    if len(at):
                        at = at[np.argsort(number[at], kind="stable")]
                        docs.append(np.full(len(at), doc))
                        terms.append(number[at])
                        places.append(at)
                if not docs:
                    continue
                doc, term, place = np.concatenate(docs), np.concatenate(terms), np.concatenate(places).astype(np.int32)
                start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (term[1:] != term[:-1]))))
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(place)), pa.int32()), pa.array(place))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(term[start])), b.column("doc_id").take(pa.array(doc[start])), lists], ["term", "doc_id", "positions"])

        index = rows.mapInArrow(run, "term string, doc_id long, positions array<int>")
        index.write.mode("append" if k else "errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema("term string, doc_id long, positions array<int>").parquet(path)


def anchors(items: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """``item, n, p1, term1, p2, term2``: for every window its rarest place and the next rarest, without repeats.

    An item shorter than the window is one window. The second is null where the window has one word.
    """
    placed = items.join(counts, "term")
    rank = F.struct(F.col("df"), F.col("p"), F.col("term"))
    size = F.least(F.lit(width), "n")
    starts = F.sequence(F.greatest(F.lit(0), F.col("p") - size + 1), F.least(F.col("p"), F.col("n") - size))
    cells = placed.select("item", "n", rank.alias("r"), F.explode(starts).alias("start"))
    two = cells.groupBy("item", "n", "start").agg(F.array_sort(F.collect_list("r")).alias("r"))  # at most width entries
    first, second = F.element_at("r", 1), F.try_element_at("r", F.lit(2))
    return two.select("item", "n", first["p"].alias("p1"), first["term"].alias("term1"), second["p"].alias("p2"), second["term"].alias("term2")).distinct()


def alignments(index: DataFrame, marks: DataFrame, slop: int = 0) -> DataFrame:
    """``item, doc_id, shift, p1``: where a window's two rarest terms stand at their offsets, give or take ``slop`` words.

    ``shift`` is the document position of the item's first word.
    """
    first = marks.select("item", F.col("term1").alias("term"), "p1", "p2", "term2")
    lists = index.join(bounded_broadcast(first), "term")
    moved = F.explode(F.transform("positions", lambda x: x - F.col("p1")))
    base = lists.select("item", "doc_id", "p1", "p2", "term2", moved.alias("shift"))
    alone = base.where("term2 is null").select("item", "doc_id", "shift", "p1")
    pair = base.where("term2 is not null").join(index.withColumnRenamed("term", "term2"), ["term2", "doc_id"])
    near = F.exists("positions", lambda x: F.abs(x - F.col("shift") - F.col("p2")) <= slop)
    return pair.where(near).select("item", "doc_id", "shift", "p1").union(alone)


def _index(docs: DataFrame, bench: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The test items' words, their windows' rarest terms, and the stored postings of those terms."""
    items = materialize(item_words(bench), "test-words")
    counts = materialize(term_counts(docs, items.select("term").distinct()), "test-terms")
    marks = materialize(anchors(items, counts, width), "test-anchors")
    terms = marks.select(F.explode(F.array("term1", "term2")).alias("term")).where("term is not null").distinct()
    return items, marks, postings(docs, terms, new_path(docs.sparkSession, "postings"))


def _verify(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hits(t, a.as_py() or [], width) for t, a in zip(_texts(b), b.column("__aligned"), strict=True)]
            columns = [pa.array([f[i] for f in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_words", "n_hit", "items"])

    return run


def hits(text: bytes | None, aligned: list[dict], width: int) -> tuple[int, int, list[str]]:
    """Words, hit words and items with a window in the text, along the given alignments."""
    found = words(text)
    hit = np.zeros(len(found), dtype=bool)
    items = set()
    for a in aligned:
        own = [w.encode() for w in a["own"]]
        size = min(width, len(own))
        for shift in a["shifts"]:
            run = 0
            for p in range(max(0, -shift), min(len(own), len(found) - shift)):
                run = run + 1 if own[p] == found[p + shift] else 0
                if run >= size:
                    hit[p + shift - size + 1 : p + shift + 1] = True
                    items.add(a["item_id"])
    return len(found), int(hit.sum()), sorted(items, key=lambda x: (x is None, x or ""))


def _aligned(docs: DataFrame, bench: DataFrame, width: int) -> DataFrame:
    """``__key, __aligned``: for every document with alignments its items, each with its words once and its alignments."""
    items, marks, index = _index(docs, bench, width)
    at = alignments(index, marks).groupBy("item", "doc_id").agg(F.collect_set("shift").alias("shifts"))
    own = items.groupBy("item", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "term"))), lambda x: x["term"]).alias("own"))
    each = at.join(bounded_broadcast(materialize(own, "test-items")), "item").groupBy(F.col("doc_id").alias("__key"))
    return materialize(each.agg(F.collect_list(F.struct("item_id", "shifts", "own")).alias("__aligned")), "alignments")


def matches(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` of every row of ``docs``: hit words lie in an occurrence of a window of ``width``
    consecutive words of a test item, or of a whole shorter item; ``items`` are the ids, as sorted strings, of those
    with occurring windows, with one null at the end where those without an id are among them.

    Repeated items count once, and texts that share an item_id are matched each. Null and empty texts have no words; items without words match nothing; repeated rows are each matched by their
    own words, also where they share a doc_id or have none. Empty tables give empty results or no hits; other
    columns are not read.
    """
    aligned = bounded_broadcast(_aligned(docs, bench, width), MAX_ALIGNED)
    rows = keyed(docs).join(aligned, F.col("doc_id") == F.col("__key"), "left").select("doc_id", "text", "__aligned")
    found = rows.mapInArrow(_verify(width), "doc_id long, n_words long, n_hit long, items array<string>")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def near_matches(docs: DataFrame, bench: DataFrame, width: int = 10, slop: int = 3, share: float = 0.5) -> DataFrame:
    """``item_id, doc_id, share``: proximity matches, where at least ``share`` of an item's windows have their two rarest
    terms in the document within ``slop`` words of their distance in the item; texts that share an item_id are rated each.

    Nulls, empty and repeated rows, and empty tables are treated as by ``matches``; rows that share a doc_id, or have
    none, are rated together."""
    items, marks, index = _index(docs, bench, width)
    total = marks.groupBy("item").agg(F.count_distinct("p1").alias("marks"))
    found = alignments(index, marks, slop).groupBy("item", "doc_id").agg(F.count_distinct("p1").alias("found"))
    total = total.join(items.select("item", "item_id").distinct(), "item")
    rated = found.join(bounded_broadcast(total), "item").withColumn("share", F.col("found") / F.col("marks"))
    return rated.where(F.col("share") >= share).select("item_id", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "share")


def drop_contaminated(docs: DataFrame, bench: DataFrame, width: int = 10) -> DataFrame:
    """``docs`` without the rows in which a window of a test item occurs, with their own columns.

    Every row is decided by its own text, also where ids are null or repeated; rows without words stay; empty tables give
    empty results or drop nothing."""
    aligned = bounded_broadcast(_aligned(docs, bench, width), MAX_ALIGNED)
    rows = docs.join(aligned, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__key"), "left").drop("__key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = zip(_texts(b), b.column("__aligned"), strict=True)
            clean = [not a.is_valid or not hits(t, a.as_py(), width)[1] for t, a in texts]
            yield b.filter(pa.array(clean, pa.bool_())).drop_columns(["__aligned"])

    return rows.mapInArrow(run, docs.schema)
