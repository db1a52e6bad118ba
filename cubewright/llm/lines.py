"""Line dedup by an exact set-similarity join.

A line is the set of its words; equal sets are one class. Words are ordered by rarity, two classes within a Jaccard
similarity share a word in the rarest few of either (the prefix), and postings of those words, filtered by length, by
position and by a bit signature, leave few rows to verify. A pair is verified and counted under the first word that
its prefixes share, so nothing is counted twice and no list of pairs is ever made: each class gets its number of links
and the earliest line that it is linked with. Postings of words on very many lines are compared as pairs of blocks.

Words are named by 44-bit hashes and line sets by 128-bit ones. Rarity is an exact count by hash bucket over all
lines, kept on a log scale, so that the order tells rare words from rarer ones at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import groups, materialize

#: Buckets of the rarity table, one byte each: what the tasks get has this size whatever the input.
BUCKET_BITS, BLOCK_BITS = 24, 16
#: Classes that one task compares with each other; longer postings are dealt out as pairs of blocks.
BLOCK = 512
#: Lines with a word from which its postings are dealt out by class instead of by word.
FREQUENT = 8_192
#: Words from which a line has a signature of 256 bits instead of 64, which its many words would fill.
WIDE = 100
#: Postings that one task sorts and compares at a time, and those a task holds before it sends them.
BUCKET_POSTINGS, HELD_POSTINGS = 250_000, 150_000
#: Bits of the filter that tells which classes' words are wanted again.
BLOOM_BITS = 26
#: Bytes and lines of text that arrays are made of at a time; a longer line is taken whole.
PIECE_BYTES, PIECE_LINES, WORD_BITS = 1 << 18, 1 << 12, 44
STEP = np.uint64(0x9E3779B97F4A7C15)
SHIFT, WORD_MASK = np.uint64(WORD_BITS), np.uint64((1 << WORD_BITS) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as texts have needed."""

    base = np.uint64(0xD6E8FEB86659FD93)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    up = down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.concatenate([cls.up, cls.up * cls.up[-1] * cls.base])
                cls.down = np.concatenate([cls.down, cls.down * cls.down[-1] * cls.inverse])
        return cls.up[:n], cls.down[:n]


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _packed(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Line number and word hash in one integer of every word of a piece, sorted, each once; ``ends`` are its lines' ends."""
    edge = np.flatnonzero(np.diff(BLANK[raw], prepend=True, append=True))
    starts, stops = edge[::2], edge[1::2]
    up, down = _Powers.to(len(raw) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:-1], out=run[1:])
        words = mixed((run[stops] - run[starts]) * down[starts] + (stops - starts).astype(np.uint64) * STEP)
    line = np.searchsorted(ends, starts).astype(np.uint64)
    packed = np.sort(line << SHIFT | words >> np.uint64(64 - WORD_BITS))
    return packed[np.diff(packed, prepend=packed[:1] ^ np.uint64(1)) != 0]


def pieces(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of at most PIECE_LINES lines of a lower-cased text: the first line's number, and its lines' words as
    ``line << 44 | word``, sorted, lines counted from the first and words each once a line."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    at = first = 0
    while first < len(ends):
        last = min(int(np.searchsorted(ends, at + PIECE_BYTES, "right")), first + PIECE_LINES)
        last = max(last, first + 1)
        yield first, _packed(raw[at : ends[last - 1]], ends[first:last] - at)
        at, first = int(ends[last - 1]) + 1, last


def chunks(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """Slices of at most ``most`` bytes, or of one document: the slice, its lower-cased texts joined by line ends, and their numbers of lines."""
    for b in batches:
        column = b.column("text").cast(pa.binary())
        size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = max(int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")), at + 1)
            texts = [t or b"" for t in column.slice(at, stop - at).to_pylist()]
            yield b.slice(at, stop - at), b"\n".join(texts).translate(LOWER), np.array([t.count(b"\n") + 1 for t in texts])
            at = stop


def set_keys(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set of words; ``starts`` are where the sets begin."""
    with np.errstate(over="ignore"):
        return tuple(np.add.reduceat(mixed(words ^ np.uint64(salt)), starts).view(np.int64) for salt in (0x1234567, 0x89ABCDEF))


def _starts(line: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with their class, and at the end the task's counts of words by bucket, packed by block of buckets."""
    count = np.zeros(1 << BUCKET_BITS, dtype=np.int64)
    names = ["doc_id", "line", "k1", "k2", "block", "at", "n"]
    for part, data, totals in chunks(batches):
        total = int(totals.sum())
        keys, bare = np.zeros((2, total), dtype=np.int64), np.ones(total, dtype=bool)
        for first, packed in pieces(data):
            if len(packed):
                line, words = (packed >> SHIFT).astype(np.int64), packed & WORD_MASK
                np.add.at(count, (words >> np.uint64(WORD_BITS - BUCKET_BITS)).astype(np.int64), 1)
                starts = _starts(line)
                at = line[starts] + first
                keys[0][at], keys[1][at] = set_keys(words, starts)
                bare[at] = False
        docs = part.column("doc_id").take(pa.array(np.repeat(np.arange(len(totals)), totals)))
        numbers = np.arange(total) - np.repeat(np.cumsum(totals) - totals, totals)
        none = [pa.nulls(total, k) for k in (pa.int32(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([docs, pa.array(numbers.astype(np.int32)), pa.array(keys[0], mask=bare), pa.array(keys[1], mask=bare), *none], names)
    blocks = count.reshape(-1, 1 << BLOCK_BITS)
    some = np.flatnonzero(blocks.any(axis=1))
    at = [np.flatnonzero(blocks[i]) for i in some]
    none = [pa.nulls(len(some), k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
    packed = [pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()), pa.array([blocks[i][a].astype("<i8").tobytes() for i, a in zip(some, at, strict=True)], pa.binary())]
    yield pa.RecordBatch.from_arrays([*none, pa.array(some, pa.int32()), *packed], names)


def _rarity(counts: DataFrame) -> tuple[np.ndarray, int]:
    """A byte a bucket that rises with the lines its words occur in, six steps an octave; and the sum of all counts.

    1 stands for one line. The table is built by blocks, and its size is the same at any input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(1 << BLOCK_BITS, dtype=np.int64)

        def made() -> pa.RecordBatch:
            scale = np.where(total > 0, 1 + np.ceil(6 * np.log2(np.maximum(total, 1))), 0)
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.minimum(scale, 255).astype(np.uint8).tobytes()], pa.binary()), pa.array([int(total.sum())], pa.int64())], ["block", "table", "total"])

        for b in batches:
            for k, at, n in zip(*[b.column(c).to_pylist() for c in ("block", "at", "n")], strict=True):
                if k != block and block is not None:
                    yield made()
                    total[:] = 0
                block = k
                total[np.frombuffer(at, dtype="<u2")] += np.frombuffer(n, dtype="<i8")
        if block is not None:
            yield made()

    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = counts.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, "block int, table binary, total long")
    whole, total = np.zeros(1 << BUCKET_BITS, dtype=np.uint8), 0
    for r in blocks.toLocalIterator():
        whole[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["table"], dtype=np.uint8)
        total += r["total"]
    return whole, total


def _byte(lines: int) -> int:
    """The rarity table's byte for a number of lines."""
    return min(255, 1 + int(np.ceil(6 * np.log2(lines))))


def _ordered(packed: np.ndarray, rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a piece's lines, each line's from the rarest on; their rarity; where lines start; and the lines' classes."""
    line, words = packed >> SHIFT, packed & WORD_MASK
    starts = _starts(line)
    k1, k2 = set_keys(words, starts)
    count = rarity[(words >> np.uint64(WORD_BITS - BUCKET_BITS)).astype(np.int64)]
    whole = np.sort(line << np.uint64(WORD_BITS + 8) | count.astype(np.uint64) << SHIFT | words)
    return whole & WORD_MASK, (whole >> SHIFT & np.uint64(255)).astype(np.int64), starts, k1, k2


#: Bits of a class's first name that postings carry.
CLASS_BITS = 48


def _class(k1: np.ndarray) -> np.ndarray:
    return k1 & ((1 << CLASS_BITS) - 1)


def _signatures(words: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of each line's words in 64 bits; and, for lines of WIDE words or more, the second to fourth quarter of 256
    bits that fold to those 64, else zeros."""
    bit = np.uint64(1) << (words >> np.uint64(8) & np.uint64(63))
    marks, quarters = np.bitwise_xor.reduceat(bit, starts), np.zeros((len(n), 3), dtype=np.uint64)
    wide = np.flatnonzero(n >= WIDE)
    if len(wide):
        of = np.repeat(n >= WIDE, n)
        bit, quarter = bit[of], words[of] >> np.uint64(14) & np.uint64(3)
        at = np.cumsum(n[wide]) - n[wide]
        for q in (1, 2, 3):
            quarters[wide, q - 1] = np.bitwise_xor.reduceat(np.where(quarter == q, bit, np.uint64(0)), at)
    return marks, quarters


def _pack(word: np.ndarray, k: np.ndarray, marks: np.ndarray, n: np.ndarray, place: np.ndarray, before: np.ndarray, quarters: np.ndarray) -> bytes:
    """Word, class, signature, line's size, place and the word before: columns one after another, narrow where all sizes
    are, and at the end the other quarters of wide signatures."""
    size = "<u2" if n.max() < 1 << 16 else "<u4"
    columns = [(word & np.uint64(0xFFFFFFFF), "<u4"), (word >> np.uint64(32), "<u2"), (k & 0xFFFFFFFF, "<u4"), (k >> 32, "<u2"), (marks, "<u8"), (n, size), (place, size), (before, "<u4"), (quarters[n >= WIDE], "<u8")]
    return bytes([int(n.max() >= 1 << 16)]) + b"".join(c.astype(t).tobytes() for c, t in columns)


def _unpack(rows: int, data: bytes) -> tuple[np.ndarray, ...]:
    size = "<u4" if data[0] else "<u2"
    found, at = [], 1
    for kind in ("<u4", "<u2", "<u4", "<u2", "<u8", size, size, "<u4"):
        found.append(np.frombuffer(data, dtype=kind, count=rows, offset=at))
        at += found[-1].nbytes
    low, high, k_low, k_high, marks, n, place, before = found
    quarters = np.zeros((rows, 3), dtype=np.uint64)
    quarters[n >= WIDE] = np.frombuffer(data, dtype="<u8", offset=at).reshape(-1, 3)
    word = low.astype(np.int64) | high.astype(np.int64) << 32
    return word, k_low.astype(np.int64) | k_high.astype(np.int64) << 32, marks, n.astype(np.int64), place.astype(np.int64), before, quarters


def _postings(rarity, similarity: float, buckets: int, frequent: int):
    """Postings of the prefixes' words of each class, packed by bucket of words; those of frequent words by bucket of classes."""
    least = next(n for n in range(1, 1000) if int(np.floor(n / similarity + 1e-9)) > n)  # shorter lines match only their equals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # classes this task has posted; forgetting some only repeats rows
        held: list[tuple] = []

        def sent() -> pa.RecordBatch:
            word, k, marks, n, place, before, quarters, count = (np.concatenate(c) for c in zip(*held, strict=True))
            by_word = (word >> np.uint64(WORD_BITS - BUCKET_BITS)).astype(np.int64) * buckets >> BUCKET_BITS
            bucket = np.where(count >= _byte(frequent), buckets + (k >> 16) % buckets, by_word)
            order = np.lexsort((word, bucket))
            cut = np.append(_starts(bucket[order]), len(order)).tolist()
            rows = [order[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
            data = [_pack(*(c[r] for c in (word, k, marks, n, place, before, quarters))) for r in rows]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([int(bucket[r[0]]) for r in rows], pa.int32()), pa.array([len(r) for r in rows], pa.int32()), pa.array(data, pa.binary())], ["bucket", "rows", "data"])

        holding = 0
        for _, data, _ in chunks(batches):
            for _, packed in pieces(data):
                if not len(packed):
                    continue
                words, count, starts, k1, _ = _ordered(packed, rarity.value)
                n = np.diff(np.append(starts, len(words)))
                new = n >= least
                for i in np.flatnonzero(new).tolist():
                    key = int(k1[i])
                    if key in done:
                        new[i] = False
                    else:
                        done.add(key)
                if len(done) > 250_000:
                    done.clear()
                marks, quarters = _signatures(words, starts, n)
                place = np.arange(len(words)) - np.repeat(starts, n)
                prefix = np.where(new, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)
                at = np.flatnonzero((place < np.repeat(prefix, n)) & (count > 1))  # a word on one line has no partner
                row = np.repeat(np.arange(len(n)), n)[at]
                before = np.where(place[at] > 0, words[at - 1] & np.uint64(0xFFFFFFFF), np.uint64(0))
                held.append((words[at], _class(k1)[row], marks[row], n[row], place[at], before, quarters[row], count[at]))
                holding += len(at)
                if holding > HELD_POSTINGS:
                    yield sent()
                    holding = 0
        if holding:
            yield sent()

    return run


def _alike(similarity: float, a: tuple, b: tuple) -> np.ndarray:
    """Whether pairs of postings pass the length, position and signature filters; each side is (class, marks, n, place)."""
    (k, m, n, x), (l, w, o, y) = a, b
    need = np.ceil(similarity / (1 + similarity) * (n + o) - 1e-9)
    left = np.minimum(n - x, o - y)
    apart = np.bitwise_count((m ^ w).view(np.uint64)).astype(np.int64)  # words that only one has differ in parity, at most
    return (k != l) & (left >= need) & (apart <= n + o - 2 * need)


def _filtered(similarity: float, buckets: int):
    """Postings that pass the filters with another of their word, a bucket at a time; those of frequent words as they are.

    Within a word, postings are ordered by their lines' sizes and each is compared with those 1, 2, 3 ... places on while
    the size still allows the similarity. A pair whose words before are the same shares that word too, and is left to it.
    """

    def passed(blobs: list[tuple[int, bytes]]) -> tuple[np.ndarray, ...]:
        rows = tuple(np.concatenate(c) for c in zip(*[_unpack(*x) for x in blobs], strict=True))
        order = np.lexsort((rows[1], rows[3], rows[0]))
        word, k, marks, n, place, before, quarters = (c[order] for c in rows)
        first = np.concatenate(([True], (word[1:] != word[:-1]) | (k[1:] != k[:-1])))  # a class may be posted by several tasks
        return tuple(c[first] for c in (word, k, marks, n, place, before, quarters))

    def compared(word, k, marks, n, place, before, quarters) -> tuple[np.ndarray, ...]:
        live = np.zeros(len(word), dtype=bool)
        at = np.arange(len(word))
        for step in range(1, len(word)):
            at = at[at + step < len(word)]
            at = at[(word[at + step] == word[at]) & (n[at] >= similarity * n[at + step] - 1e-9)]
            if not len(at):
                break
            on = at + step
            hit = _alike(similarity, (k[at], marks[at], n[at], place[at]), (k[on], marks[on], n[on], place[on]))
            hit &= (place[at] == 0) | (place[on] == 0) | (before[at] != before[on])
            at_, on_ = at[hit], on[hit]
            both = np.flatnonzero((n[at_] >= WIDE) & (n[on_] >= WIDE))
            a, b = at_[both], on_[both]
            other = quarters[a] ^ quarters[b]
            apart = np.bitwise_count(other).sum(axis=1, dtype=np.int64) + np.bitwise_count(marks[a] ^ marks[b] ^ np.bitwise_xor.reduce(other, axis=1))
            fine = np.ones(len(at_), dtype=bool)
            fine[both] = apart <= n[a] + n[b] - 2 * np.ceil(similarity / (1 + similarity) * (n[a] + n[b]) - 1e-9)
            live[at_[fine]] = live[on_[fine]] = True
        return tuple(c[live] for c in (word, k, marks, n, place))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []

        def made() -> pa.RecordBatch:
            word, k, marks, n, place = (compared(*passed(blobs)) if bucket < buckets else passed(blobs)[:5])
            full = pa.array(np.full(len(word), bucket >= buckets))
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(k), full, pa.array(marks.view(np.int64)), pa.array(n), pa.array(place)], ["word", "k1", "frequent", "marks", "n", "place"])

        for b in batches:
            for x, rows, data in zip(*[b.column(c).to_pylist() for c in ("bucket", "rows", "data")], strict=True):
                if x != bucket and blobs:
                    yield made()
                    blobs = []
                bucket = x
                blobs.append((rows, data))
        if blobs:
            yield made()

    return run


def _filtered_blocks(similarity: float):
    """The same for postings of frequent words, in cells of one block or two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["cell"]):
            if g.num_rows > 1:
                rows = tuple(g.column(c).to_numpy() for c in ("k1", "marks", "n", "place"))
                live = _alike(similarity, tuple(c[:, None] for c in rows), tuple(c[None, :] for c in rows))
                some = np.flatnonzero(live.any(axis=1))
                if len(some):
                    yield g.combine_chunks().to_batches()[0].take(pa.array(some)).select(["cell", "word", "k1", "own", "other"])

    return run


def _bloom(keys: DataFrame) -> np.ndarray:
    """A bit for each class that is wanted, from all tasks; of fixed size, and wrong only towards wanting more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << BLOOM_BITS, dtype=bool)
        for b in batches:
            bits[b.column("k1").to_numpy() & ((1 << BLOOM_BITS) - 1)] = True
        packed = np.packbits(bits).reshape(256, -1)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed[i].tobytes() for i in some], pa.binary())], ["block", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bits = None, None
        for b in batches:
            for k, x in zip(b.column("block").to_pylist(), b.column("bits").to_pylist(), strict=True):
                if k != block:
                    if block is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])
                    block, bits = k, np.zeros(len(x), dtype=np.uint8)
                bits |= np.frombuffer(x, dtype=np.uint8)
        if block is not None:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["block", "bits"])

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = keys.select("k1").coalesce(parts).mapInArrow(run, "block int, bits binary").repartition(parts, "block").sortWithinPartitions("block").mapInArrow(join, "block int, bits binary")
    whole = np.zeros((256, (1 << BLOOM_BITS) // 8 // 256), dtype=np.uint8)
    for r in blocks.toLocalIterator():
        whole[r["block"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return whole.reshape(-1)


def _shorter(words: np.ndarray) -> bytes:
    """Six bytes a word."""
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _longer(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    whole = np.zeros((len(six), 8), dtype=np.uint8)
    whole[:, :6] = six
    return whole.reshape(-1).view("<i8")


def _payload(rarity, wanted):
    """Places of the lines whose classes are wanted; with their words where the class is new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for part, data, totals in chunks(batches):
            docs, ends = part.column("doc_id"), np.cumsum(totals)
            for first, packed in pieces(data):
                if not len(packed):
                    continue
                words, _, starts, k1, k2 = _ordered(packed, rarity.value)
                bit = k1 & ((1 << BLOOM_BITS) - 1)
                some = np.flatnonzero(wanted.value[bit >> 3] >> (7 - (bit & 7)) & 1)
                if not len(some):
                    continue
                line = (packed[starts[some]] >> SHIFT).astype(np.int64) + first
                doc = np.searchsorted(ends, line, "right")
                number = line - (ends[doc] - totals[doc])
                stops = np.append(starts[1:], len(words))
                sets = []
                for i in some.tolist():
                    key = int(k1[i])
                    sets.append(None if key in done else _shorter(words[starts[i] : stops[i]]))
                    done.add(key)
                if len(done) > 250_000:
                    done.clear()
                columns = [pa.array(k1[some]), pa.array(k2[some]), docs.take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc", "line", "words"])

    return run


#: Columns of words that two blocks of a cell are compared over at once.
COLUMNS = 4_096


def _verified(similarity: float):
    """Links and earliest linked line of each class of a cell, over the pairs whose first shared word is the cell's."""

    def few(rows: list[tuple], words: list[np.ndarray], at: list[int]) -> Iterator[tuple[int, int]]:
        sets = [(frozenset(w.tolist()), frozenset(w[:k].tolist())) for w, k in zip(words, at, strict=True)]
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][4] == rows[i][5] or rows[i][4] != rows[j][4]:
                    (a, x), (b, y) = sets[i], sets[j]
                    shared = len(a & b)
                    if shared >= similarity * (len(a) + len(b) - shared) - 1e-6 and x.isdisjoint(y):
                        yield i, j

    def blocks(rows: list[tuple], words: list[np.ndarray], at: list[int]) -> Iterator[tuple[slice, slice, np.ndarray]]:
        """Links between two blocks of rows at a time, over the words that both have, some columns at a time."""
        sizes = np.array([len(w) for w in words])
        ends = np.append(0, np.cumsum(sizes))
        flat, row = np.concatenate(words), np.repeat(np.arange(len(words)), sizes)
        early = np.arange(len(flat)) - np.repeat(ends[:-1], sizes) < np.repeat(at, sizes)  # words that come before the cell's in their set
        own = np.array([r[4] for r in rows])

        def dense(block: slice, columns: np.ndarray, first_only: bool) -> np.ndarray:
            inside = slice(ends[block.start], ends[min(block.stop, len(sizes))])
            column = np.searchsorted(columns, flat[inside])
            column[column == len(columns)] = 0
            some = columns[column] == flat[inside]
            if first_only:
                some &= early[inside]
            found = np.zeros((min(block.stop, len(sizes)) - block.start, len(columns)), dtype=np.float32)
            found[row[inside][some] - block.start, column[some]] = 1
            return found

        for i in range(0, len(rows), BLOCK):
            for j in range(i, len(rows), BLOCK):
                a, b = slice(i, i + BLOCK), slice(j, j + BLOCK)
                both = [flat[ends[x.start] : ends[min(x.stop, len(sizes))]] for x in (a, b)]
                known = np.intersect1d(*both) if i != j else np.unique(both[0])
                shared = np.zeros((len(sizes[a]), len(sizes[b])), dtype=np.float32)
                before = np.zeros_like(shared)
                for c in range(0, len(known), COLUMNS):
                    some = known[c : c + COLUMNS]
                    shared += dense(a, some, False) @ dense(b, some, False).T
                    before += dense(a, some, True) @ dense(b, some, True).T
                linked = (shared >= similarity * (sizes[a, None] + sizes[None, b] - shared) - 1e-6) & (before == 0)
                if i == j:
                    np.fill_diagonal(linked, False)
                if rows[0][4] != rows[0][5]:
                    linked &= own[a, None] != own[None, b]
                yield a, b, linked

    def found(rows: list[tuple]) -> Iterator[tuple]:
        words = [_longer(r[6]) for r in rows]
        at = [np.flatnonzero(w == r[1]) for w, r in zip(words, rows, strict=True)]
        good = [i for i, k in enumerate(at) if len(k)]  # a row whose class only shares its short name with the posted one has not the word
        rows, words, at = [rows[i] for i in good], [words[i] for i in good], [int(at[i][0]) for i in good]
        if len(rows) < 2:
            return
        places = [(r[7] is not None, r[7], r[8]) for r in rows]
        if len(rows) <= 8:
            count, least = [0] * len(rows), [None] * len(rows)
            for i, j in few(rows, words, at):
                for a, b in ((i, j), (j, i)):
                    count[a] += 1
                    least[a] = places[b] if least[a] is None else min(least[a], places[b])
        else:
            order = sorted(range(len(rows)), key=places.__getitem__)
            rank = np.empty(len(rows), dtype=np.int64)
            rank[order] = np.arange(len(rows))
            counts, first = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), len(rows))
            for a, b, linked in blocks(rows, words, at):
                counts[a] += linked.sum(axis=1)
                first[a] = np.minimum(first[a], np.where(linked, rank[None, b], len(rows)).min(axis=1))
                if a != b:
                    counts[b] += linked.sum(axis=0)
                    first[b] = np.minimum(first[b], np.where(linked, rank[a, None], len(rows)).min(axis=0))
            count = counts.tolist()
            least = [places[order[f]] if f < len(rows) else None for f in first.tolist()]
        for r, n, p in zip(rows, count, least, strict=True):
            if n:
                yield r[2], r[3], n, p[1], p[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[tuple] = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["k1", "k2", "links", "doc", "line"])
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("cell", "word", "k1", "k2", "own", "other", "words", "doc", "line")], strict=True):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        out += found(held)
                    held = []
                held.append(row)
            if len(out) > 20_000:
                yield made()
                out = []
        if len(held) > 1:
            out += found(held)
        if out:
            yield made()

    return run


def line_matches(docs: DataFrame, similarity: float = 0.8, block: int = BLOCK, most: int = FREQUENT) -> DataFrame:
    """``doc_id, line, kept, links, class_doc, class_line, near_doc, near_line``: one row per line of ``docs``, split at
    line ends, numbered from 0.

    A line is removed if an earlier line, by doc_id and number, has a word set of Jaccard similarity ``similarity``
    or more. ``class_doc, class_line`` name the first line with its word set, ``links`` is the number of different word
    sets so near its own, and ``near_doc, near_line`` the first line of any of these. Words are parted by white space,
    A-Z lower-cased. Lines without words are kept, have no class and link with nothing; null texts are one empty line.
    Rows with null ids come first; rows that repeat an id and a line count as one place. Lines and texts of any length
    are read whole. An empty table gives an empty result; other columns are not read. ``block`` and ``most`` (BLOCK,
    FREQUENT) only deal out the work.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = materialize(rows.mapInArrow(_scan, "doc_id long, line int, k1 long, k2 long, block int, at binary, n binary"), "lines")
    lines = scanned.where("line is not null").select("doc_id", "line", "k1", "k2")
    table, total = _rarity(scanned.where("block is not null").select("block", "at", "n"))
    rarity = spark.sparkContext.broadcast(table)

    buckets = max(4 * parts, int(total * (1.2 - similarity)) // BUCKET_POSTINGS)
    posted = rows.select("text").mapInArrow(_postings(rarity, similarity, buckets, most), "bucket int, rows int, data binary")
    posted = posted.repartition(parts, "bucket").sortWithinPartitions("bucket")
    posted = materialize(posted.mapInArrow(_filtered(similarity, buckets), "word long, k1 long, frequent boolean, marks long, n long, place long"), "line-postings")
    none = F.lit(-1)
    rare = posted.where("not frequent").select(F.xxhash64("word", none, none).alias("cell"), "word", "k1", none.alias("own"), none.alias("other"))

    frequent = posted.where("frequent").drop("frequent")
    full = frequent.groupBy("word").agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    cells = frequent.join(full.drop("size"), "word").withColumn("own", F.pmod(F.col("k1"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.withColumn("cell", F.xxhash64("word", F.least("own", "other"), F.greatest("own", "other"))).drop("blocks")
    cells = cells.repartition(parts, "cell").sortWithinPartitions("cell")
    common = cells.mapInArrow(_filtered_blocks(similarity), "cell long, word long, k1 long, own int, other int")
    live = materialize(rare.union(common), "line-candidates")

    wanted = spark.sparkContext.broadcast(_bloom(live))
    sets = rows.mapInArrow(_payload(rarity, wanted), "k1 long, k2 long, doc long, line int, words binary")
    sets = sets.groupBy("k1", "k2").agg(F.min(F.struct("doc", "line")).alias("first"), F.max("words").alias("words"))
    sets = sets.select(F.col("k1").bitwiseAND((1 << CLASS_BITS) - 1).alias("k"), F.col("k1").alias("whole"), "k2", "first.doc", "first.line", "words")
    ready = live.withColumnRenamed("k1", "k").join(sets, "k").select("cell", "word", F.col("whole").alias("k1"), "k2", "own", "other", "words", "doc", "line")
    ready = ready.repartition(parts, "cell").sortWithinPartitions("cell")
    found = ready.mapInArrow(_verified(similarity), "k1 long, k2 long, links long, doc long, line int")
    found = found.groupBy("k1", "k2").agg(F.sum("links").alias("links"), F.min(F.struct("doc", "line")).alias("near"))
    found = materialize(found, "line-links")

    place = F.min(F.struct(F.col("doc_id").alias("doc"), "line")).alias("first")
    known = lines.where("k1 is not null").groupBy("k1", "k2").agg(place).join(found, ["k1", "k2"], "left")
    out = lines.join(known, ["k1", "k2"], "left")
    here = F.struct(F.col("doc_id").alias("doc"), F.col("line"))
    kept = F.col("k1").isNull() | here.eqNullSafe(F.coalesce(F.least("first", "near"), "first"))
    return out.select(
        "doc_id", "line", kept.alias("kept"), F.coalesce("links", F.lit(0)).alias("links"),
        F.col("first.doc").alias("class_doc"), F.col("first.line").alias("class_line"), F.col("near.doc").alias("near_doc"), F.col("near.line").alias("near_line"),
    )


def summary(matches: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, n_lines, n_kept, n_links``, a digest of the kept lines' numbers, and one of every
    line's class, links and nearest earlier-or-later line: ``line:class_doc:class_line:links:near_doc:near_line``."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = F.concat_ws(":", *map(text, ("line", "class_doc", "class_line", "links", "near_doc", "near_line")))
    each = F.array_sort(F.collect_list(F.struct("line", "kept", named.alias("named"))))
    digest = lambda xs: F.sha2(F.array_join(xs, ","), 256)
    return matches.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count(F.when(F.col("kept"), 1)).alias("n_kept"), F.sum("links").alias("n_links"),
        digest(F.transform(F.filter(each, lambda x: x["kept"]), lambda x: x["line"].cast("string"))).alias("kept_sha256"),
        digest(F.transform(each, lambda x: x["named"])).alias("classes_sha256"),
    )


def dedup(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the removed lines taken out of their texts; texts without a removed line are as they were."""
    gone = line_matches(docs, similarity).where("not kept").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line").alias("__gone"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("__gone", i))
    joined = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col("__id")), "left")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).select(*docs.columns)
