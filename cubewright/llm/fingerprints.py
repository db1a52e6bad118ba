"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last WINDOW bytes ends a chunk wherever its low bits are all ones, so that a cut depends on its
context alone and an edit moves only the cuts around it. ``b`` such bits give blocks of about 2^b bytes; a fingerprint
takes the least b that leaves at most CUTS cuts, and holds the signatures at b and b + 1, ``b:signature:signature``.
Each chunk is one of 64 characters. Fingerprints are compared where they share a block size, by the edit distance of
the signatures (an insertion or a deletion costs 1, a change 2).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import materialize

WINDOW, CUTS = 7, 64
#: Two signatures without a common run of so many characters (or the whole of one) are not alike at all.
RUN = 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Bytes of a text that are hashed at once, and the hashes' odd multipliers.
BLOCK = 1 << 16
ROLL, MULTIPLY, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD
_MASK = (1 << 64) - 1
_INVERSE = pow(MULTIPLY, -1, 1 << 64)


def _powers(of: int, n: int) -> np.ndarray:
    found = np.full(n, of, np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


_UP, _DOWN = _powers(MULTIPLY, BLOCK), _powers(_INVERSE, BLOCK)
_ROLLS = [np.uint64(pow(ROLL, j + 1, 1 << 64)) for j in range(WINDOW)]
_CHARACTERS = np.frombuffer(ALPHABET.encode(), np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(29))


def _rolled(data: np.ndarray, start: int, end: int) -> np.ndarray:
    """The rolling hash at each of the bytes ``start`` to ``end``; before the text there are zeros."""
    low = max(0, start - WINDOW + 1)
    some = np.zeros(end - start + WINDOW - 1, np.uint64)
    some[len(some) - (end - low) :] = data[low:end]
    some += np.uint64(1)
    found = np.zeros(end - start, np.uint64)
    for j, factor in enumerate(_ROLLS):
        found += some[WINDOW - 1 - j : len(some) - j] * factor
    return _mixed(found)


def _ones(h: np.ndarray) -> np.ndarray:
    """How many low bits are ones."""
    rest = ~h
    return np.bitwise_count((rest & (np.uint64(0) - rest)) - np.uint64(1))


def _signature(data: np.ndarray, ends: np.ndarray, contexts: np.ndarray) -> str:
    """One character for each chunk: of its own bytes, and of the context that ended the one before."""
    n = len(data)
    starts = np.append(0, ends + 1)
    contexts = np.append(np.uint64(0), contexts)
    if starts[-1] == n:
        starts, contexts = starts[:-1], contexts[:-1]
    total = np.zeros(len(starts), np.uint64)
    for at in range(0, n, BLOCK):
        some = data[at : at + BLOCK].astype(np.uint64) + np.uint64(1)
        some *= _UP[: len(some)]
        first, last = np.searchsorted(starts, [at, at + len(some)], "right")  # the chunk that holds the block's first byte, and those that begin in it
        inner = starts[first:last]
        inner = inner[inner < at + len(some)]
        cuts = np.append(0, inner - at)
        sums = np.add.reduceat(some, cuts)
        total[first - 1 : first] += sums[:1] * np.uint64(pow(MULTIPLY, at - int(starts[first - 1]), 1 << 64))
        total[first : first + len(inner)] += sums[1:] * _DOWN[inner - at]
    return _CHARACTERS[(_mixed(total ^ contexts) >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(text: str) -> str:
    """The fingerprint of a whole text's UTF-8 bytes. Lone surrogates are hashed as they are."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return "0::"
    levels = np.concatenate([_ones(_rolled(data, at, min(at + BLOCK, len(data)))) for at in range(0, len(data), BLOCK)])
    above = np.bincount(levels, minlength=65)[::-1].cumsum()[::-1]  # cuts at each number of bits
    bits = int(np.argmax(above <= CUTS))
    signatures = []
    for b in (bits, bits + 1):
        ends = np.flatnonzero(levels >= b)
        contexts = np.array([_rolled(data, e, e + 1)[0] for e in ends], np.uint64) if len(data) > BLOCK else _rolled(data, 0, len(data))[ends]
        signatures.append(_signature(data, ends, contexts))
    return f"{bits}:{signatures[0]}:{signatures[1]}"


def common(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = rest = (1 << len(a)) - 1
    for c in b:
        met = rest & places.get(c, 0)
        rest = (rest + met | rest - met) & whole
    return len(a) - rest.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    run = min(RUN, len(a), len(b))
    if not run or not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    distance = len(a) + len(b) - 2 * common(a, b)
    return 1 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the better of the signatures at the block sizes that both fingerprints have; 0 where they have none in
    common, or just one of the texts is empty; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (bits_a, *one), (bits_b, *two) = a.split(":"), b.split(":")
    if not one[0] or not two[0]:
        return 0.0
    apart = int(bits_b) - int(bits_a)
    both = [(one[i], two[i - apart]) for i in range(2) if 0 <= i - apart < 2]
    return max((_alike(x, y) for x, y in both), default=0.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by as many of the first characters of ``following``, or all."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id, text: str, own: str, following: str, following_own: str) -> tuple:
    new = edited(text, following)
    mark = own if new == text else fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, mark, likeness(own, mark), likeness(own, following_own)


_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])
_EDGES = pa.schema([*_FIELDS, ("at", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_()), ("text", pa.string())])
_EMPTY = (None,) * 6


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's rows against the next one's; its first and last rows also come with their texts, for its neighbours."""
    at = TaskContext.get().partitionId()
    rows, last = [], None

    def batch(some: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], f.type) for i, f in enumerate(_EDGES)], schema=_EDGES)

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            own = fingerprint(text)
            if last is None:
                rows.append((doc_id, *_EMPTY[:2], own, *_EMPTY[3:], at, True, False, text))
            else:
                rows.append((*_row(*last, text, own), at, False, False, None))
            last = doc_id, text, own
            if len(rows) == 2_000:
                yield batch(rows)
                rows = []
    if last is not None:
        rows.append((last[0], *_EMPTY[:2], last[2], *_EMPTY[3:], at, False, True, last[1]))
        yield batch(rows)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):  # a row holds two whole texts
            row = _row(*(b.column(c)[i].as_py() for c in ("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FIELDS, strict=True)], schema=_FIELDS)


def against_next(docs: DataFrame) -> DataFrame:
    """``RESULT``'s columns for each row of ``docs`` (``doc_id, text``), against its edited text and the next document.

    A null text is empty. Rows follow each other by doc_id, null ids last, repeated ids by a hash of their texts; the
    last is followed by the first, and a single row by itself. The texts are dealt by ranges of that order, once; a
    partition's last row meets the first of the next one that has rows in a join of two rows a partition, so no key,
    however often repeated, is in one task unless its texts are equal too. An empty table gives no rows. Other columns
    are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("h").asc()]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    found = materialize(dealt.mapInArrow(_in_order, f"{RESULT}, at int, is_first boolean, is_last boolean, text string"), "fingerprints")
    places = sorted(r["at"] for r in found.where("is_first").select("at").collect())  # as many as partitions
    following = spark.createDataFrame(list(zip(places, places[1:] + places[:1], strict=True)), "at int, next_at int")
    ends = found.where("is_last").select("at", "doc_id", "text", "fingerprint").join(following, "at")
    heads = found.where("is_first").select(F.col("at").alias("next_at"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    met = ends.join(heads, "next_at").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint").mapInArrow(_met, RESULT)
    return found.where("not is_first and not is_last").select(*met.columns).union(met)
