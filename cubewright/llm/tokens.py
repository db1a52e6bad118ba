"""Token-id output: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

Format, one row a segment in Parquet files: ``bucket`` and ``at`` (ids of the bucket before the segment) order the
segments; ``doc_ids`` and ``counts`` list its documents; ``control`` and ``data`` hold their codes, document after
document. An id is replaced by its rank by frequency; a rank takes 1 to 4 little-endian bytes in ``data``, and its
length less one is two bits of ``control``, four ranks to a byte, each document padded to whole control bytes.
The ranks' ids are written beside the segments.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import discard, materialize, new_path

END_ID = 2
#: Pieces of text whose ids a task remembers, and documents or ids of a segment.
MAX_PIECES, SEGMENT_DOCS, SEGMENT_IDS = 320_000, 2_000, 1_000_000

#: Lengths of the four ranks of a control byte.
LENGTHS = np.stack([(np.arange(256) >> (2 * i) & 3) + 1 for i in range(4)], axis=1).astype(np.uint8)
#: What keeps a text from being cut at its blanks: white space beside white space, and special tokens' marks.
UNSPLIT = re.compile(r"\s\s|<\|")
DOUBLED, OTHER_BLANKS = ("  ", "\n\n", " \n", "\n ", "<|"), [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def unsplit(text: str) -> bool:
    """Whether ``UNSPLIT`` is in the text; the pattern itself is needed only where there is white space of a rarer kind."""
    return any(x in text for x in DOUBLED) or any(x in text for x in OTHER_BLANKS) and UNSPLIT.search(text) is not None


class _Pieces(dict):
    """Ids of known pieces; a new piece is encoded when it is first looked up."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.encode(piece)
        return found


class Encoder:
    """Whole texts to ids with a byte-level BPE tokenizers file, remembering the ids of pieces between single blanks.

    A byte-level tokenizer starts a new word at a blank between two other characters, so pieces cut there have the
    same ids alone as in the text; texts with other white space or with special tokens' marks are encoded whole.
    Of new pieces in Latin letters, the words that the tokenizer's own pattern cuts go to its model directly.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):
            model._resize_cache(0)  # pieces are remembered here; the model only gets new ones
        self.tokenize = model.tokenize
        self.width = "<u2" if self.size <= 1 << 16 else "<u4"
        self.code = {"<u2": "H", "<u4": "I"}[self.width]
        self.end = np.array([END_ID], dtype=self.width).tobytes()
        self.words = regex.compile(public_tokenizers.PATTERN).findall
        # each character as the printable ones that stand for its bytes, which is what the tokenizer's model takes
        shown = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.shown = {c: shown(chr(c))[0][0] for c in range(0x250)}
        self.blank, self.line_end = self.shown[32], self._whole("\n")
        self.marks = {m: self._whole(m) for m in ".,;:!?"}
        self.known, self.older = _Pieces(self._piece), {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that isn't known, with the blank or line end before it."""
        found = self.older.get(piece)
        if found is not None:
            return found
        if piece.isalpha():
            return self._word(self.blank, piece)
        # a line end, a word and a mark after it are words of their own to the tokenizer
        first, word, last = (self.line_end, piece[1:], b"") if piece[:1] == "\n" else (b"", piece, b"")
        if word[-1:] in self.marks:
            word, last = word[:-1], self.marks[word[-1]]
        if word.isalpha():
            return first + self._word("", word) + last if first else self.known[word] + last
        text = piece if first else " " + piece
        if text.isascii() or max(text) < "\u0250":
            return array(self.code, [t.id for w in self.words(text) for t in self.tokenize(w.translate(self.shown))]).tobytes()
        return self._whole(text)

    def _word(self, before: str, word: str) -> bytes:
        if not word.isascii():
            if max(word) >= "\u0250":
                return self._whole((" " if before else "") + word)
            word = word.translate(self.shown)
        return array(self.code, [t.id for t in self.tokenize(before + word)]).tobytes()

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of the text, the end id included."""
        if not text:
            return np.frombuffer(self.end, dtype=self.width)
        if text[0].isspace() or text[-1].isspace() or unsplit(text):
            return np.frombuffer(self._whole(text) + self.end, dtype=self.width)
        # each piece starts at a blank or a line end; the first line end is put there and its id dropped
        pieces = ("\n" + text).replace("\n", " \n").split(" ")[1:]
        if len(self.known) >= MAX_PIECES:
            self.known, self.older = _Pieces(self._piece), self.known
        ids = b"".join(map(self.known.__getitem__, pieces))
        return np.frombuffer(ids + self.end, dtype=self.width)[1:]


@functools.lru_cache(maxsize=1)
def encoder_for(path: str) -> Encoder:
    """One encoder a process, so that what a task has learned serves the next."""
    return Encoder(path)


def _padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes of each document, and where in them, in steps of two bits, each rank's code stands."""
    widths = -(-counts // 4)
    skipped = np.cumsum(widths * 4 - counts) - (widths * 4 - counts)
    return widths, np.arange(counts.sum()) + np.repeat(skipped, counts)


def encode(ranks: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of the documents whose ranks stand one after another."""
    values = ranks.astype("<u4")
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    widths, places = _padded(counts)
    padded = np.zeros(int(widths.sum()) * 4, dtype=np.uint8)
    padded[places] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8).tobytes()
    if values.max(initial=0) <= 0xFFFF:
        values = values.astype("<u2")
    width = values.dtype.itemsize
    data = values.view(np.uint8).reshape(-1, width)[np.arange(width, dtype=np.uint8)[None, :] <= code[:, None]].tobytes()
    return control, data


def decode(control: bytes, data: bytes, counts: np.ndarray) -> np.ndarray:
    """The ranks of all documents, one after another."""
    _, places = _padded(counts)
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[places]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for i in (1, 2, 3):
        long = np.flatnonzero(lengths > i)
        ranks[long] |= raw[starts[long] + i].astype(np.uint32) << np.uint32(8 * i)
    return ranks


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """Document ids that cut ``docs`` into ranges of about equal numbers of rows."""
    if parts < 2:
        return []
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return sorted(set(cuts or []))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` documents and, but for a longer document, ``most`` bytes of text."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text").cast(pa.binary())), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < b.num_rows:
            stop = min(at + rows, max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right"))))
            yield b.slice(at, stop - at)
            at = stop


def _tokenized(docs: DataFrame, tokenizer: str, bounds: np.ndarray) -> DataFrame:
    """``bucket, doc_id, ids`` of every row, and each task's count ``n`` of every ``id``, with null ``ids``."""
    kinds = {"bucket": pa.int32(), "doc_id": pa.int64(), "ids": pa.binary(), "id": pa.int32(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer)
        total = np.zeros(encoder.size, dtype=np.int64)
        made = lambda rows, **c: pa.RecordBatch.from_arrays([pa.array(c[k], t) if k in c else pa.nulls(rows, t) for k, t in kinds.items()], list(kinds))
        for b in slices(batches):
            ids = [encoder(t) for t in b.column("text").to_pylist()]
            total += np.bincount(np.concatenate(ids), minlength=encoder.size)
            keys = b.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
            yield made(len(ids), bucket=np.searchsorted(bounds, keys, side="left"), doc_id=b.column("doc_id"), ids=[x.tobytes() for x in ids])
        seen = np.flatnonzero(total)
        yield made(len(seen), id=seen, n=total[seen])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "bucket int, doc_id long, ids binary, id int, n long")


def tokenize(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, ids`` (little-endian, 2 or 4 bytes each by the vocabulary's size) of every row; null texts are empty."""
    return _tokenized(docs, tokenizer, np.zeros(0, dtype=np.int64)).where("ids is not null").select("doc_id", "ids")


def frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """Ids by falling frequency, ties by id; as long as the vocabulary, which bounds what the driver gets."""
    count = np.zeros(size, dtype=np.int64)
    for r in counts.groupBy("id").agg(F.sum("n").alias("n")).collect():
        count[r["id"]] = r["n"]
    return np.lexsort((np.arange(size), -count)).astype(np.int32)


def write(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Write the ids of ``docs`` in ascending doc_id order to ``path``, in the format above.

    Every text is encoded whole; null texts are empty; each document ends with id 2. Null ids come first; rows that
    share a doc_id are ordered by their ids' bytes. An empty table gives no segments; other columns are not read.
    """
    spark = docs.sparkSession
    encoder = Encoder(tokenizer)
    size, width = encoder.size, encoder.width
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tokens = materialize(_tokenized(docs, tokenizer, np.array(_bounds(docs, parts), dtype=np.int64)), "token-ids-unranked")
    order = frequencies(tokens.where("id is not null").select("id", "n"), size)
    spark.createDataFrame([(order.astype("<i4").tobytes(),)], "ids binary").write.parquet(f"{path}/ranks")
    rank = np.empty(len(order), dtype=np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    shared = spark.sparkContext.broadcast(rank)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, at, size, docs, held = None, 0, 0, [], []

        def segment() -> pa.RecordBatch:
            counts = np.array([len(x) for x in held], dtype=np.int64) // np.dtype(width).itemsize
            control, data = encode(shared.value[np.frombuffer(b"".join(held), dtype=width)], counts)
            long = pa.list_(pa.int64())
            columns = [([bucket], pa.int32()), ([at], pa.int64()), ([size], pa.int64()), ([docs], long), ([counts], long), ([control], pa.binary()), ([data], pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["bucket", "at", "ids", "doc_ids", "counts", "control", "data"])

        for b in batches:
            for k, doc, ids in zip(b.column("bucket").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                if held and (k != bucket or len(held) >= SEGMENT_DOCS or size >= SEGMENT_IDS):
                    yield segment()
                    at, size, docs, held = at + size, 0, [], []
                if k != bucket:
                    bucket, at = k, 0
                docs.append(doc)
                held.append(ids.as_py())
                size += len(held[-1]) // np.dtype(width).itemsize
        if held:
            yield segment()

    rows = tokens.where("ids is not null").select("bucket", "doc_id", "ids")
    rows = rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    rows = rows.mapInArrow(packed, "bucket int, at long, ids long, doc_ids array<long>, counts array<long>, control binary, data binary")
    rows.write.option("compression", "zstd").parquet(f"{path}/segments")
    discard(tokens)


def _decoded(spark, path: str, name: str, kind: pa.DataType, of) -> DataFrame:
    """``doc_id, start, n_tokens`` and what ``of`` makes of the bytes of a document's ids, for every document under ``path``."""
    segments = spark.read.parquet(f"{path}/segments")
    order = spark.sparkContext.broadcast(np.frombuffer(bytes(spark.read.parquet(f"{path}/ranks").first()["ids"]), dtype="<i4").astype("<u4"))
    base, total = {}, 0  # one entry a bucket: as many as the writer had partitions
    for r in segments.groupBy("bucket").agg(F.sum("ids").alias("ids")).orderBy("bucket").collect():
        base[r["bucket"]] = total
        total += r["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {k: b.column(k)[i] for k in b.schema.names}
                counts = row["counts"].values.to_numpy()
                ids = memoryview(order.value[decode(row["control"].as_py(), row["data"].as_py(), counts)].view(np.uint8))
                ends = np.cumsum(counts)
                starts = base[row["bucket"].as_py()] + row["at"].as_py() + ends - counts
                found = [of(ids[4 * a : 4 * e]) for a, e in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(starts), row["counts"].values, pa.array(found, kind)], ["doc_id", "start", "n_tokens", name])

    return segments.select("bucket", "at", "doc_ids", "counts", "control", "data").mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'binary' if kind == pa.binary() else 'long'}")


def read(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian unsigned 32-bit) of every document in the files under ``path``."""
    return _decoded(spark, path, "ids", pa.binary(), bytes)


def read_digests(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``: the files read like ``read`` does, with the CRC-32 of each document's ids."""
    return _decoded(spark, path, "ids_crc32", pa.int64(), zlib.crc32)


def write_and_read(docs: DataFrame, tokenizer: str, of=read) -> DataFrame:
    """Write ``docs`` to a new folder in the shared storage and read the files back, by ``read`` or ``read_digests``."""
    path = new_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer)
    return of(docs.sparkSession, path)
