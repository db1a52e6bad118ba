"""Secret scanning: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

The patterns find the base spans. Other strings are rated by the log-likelihood ratio of two second-order Markov
chains over their characters, one of secret values and one of ordinary words, both counted on labelled samples:
values inside base spans, and words outside them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialize

#: Kinds in the order of the report; what only the models find is listed last.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
NAMES = re.compile(r"pass|secret|token|api", re.I | re.A)
DIGIT = re.compile(r"[0-9]")
#: Candidates are whole runs of these characters, at least LEAST of them.
CLASS = np.array([chr(c).isalnum() or chr(c) in "+/_=-" for c in range(128)] + [False])
LEAST = 16
#: Symbols of the chains: letters, digits, four marks, and the rest together.
SYMBOLS = 67
#: Documents that the chains are counted on, chosen by a hash; share of ordinary words that may pass; smoothing.
MAX_TEXTS, PASSING, SMOOTH = 20_000, 1e-5, 0.1


def _symbol_table() -> np.ndarray:
    table = np.full(128, SYMBOLS - 1, dtype=np.int64)
    for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_="):
        table[ord(c)] = i
    return table


SYMBOL_OF = _symbol_table()


def symbols(text: str) -> np.ndarray:
    return SYMBOL_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 127)]


def triples(text: str) -> np.ndarray:
    s = symbols(text)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def base(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base spans in the order of the report, code points."""
    found = []
    if ("=" in text or ":" in text) and NAMES.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def undecided(word: str) -> bool:
    return DIGIT.search(word) is not None and any(c.isalpha() for c in word)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Whole runs of LEAST or more characters of CLASS, of any length; of a run that meets spans, what they leave of it on
    each side and between them, where that is as long."""
    if len(text) < LEAST:
        return
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edge = np.flatnonzero(np.diff(CLASS[np.minimum(points, 128)], prepend=False, append=False))
    long = np.flatnonzero(edge[1::2] - edge[::2] >= LEAST)
    merged: list[list[int]] = []  # the spans' union, from left to right
    for s, _, e in spans:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    at = 0
    for start, end in zip(edge[::2][long].tolist(), edge[1::2][long].tolist(), strict=True):
        while at < len(merged) and merged[at][1] <= start:
            at += 1
        k = at
        while k < len(merged) and merged[k][0] < end:
            if merged[k][0] - start >= LEAST:
                yield start, merged[k][0]
            start = max(start, merged[k][1])
            k += 1
        if end - start >= LEAST:
            yield start, end


class Chains:
    """Log-likelihood ratio of each triple, and the ratio a character that a string must exceed."""

    def __init__(self, counts: np.ndarray, threshold: float = np.inf):
        # what a triple lacks in counts it takes from its pair's, and that from the single symbols'
        logs = []
        for c in counts.reshape(2, SYMBOLS, SYMBOLS, SYMBOLS).astype(float):
            single = (c.sum(axis=(0, 1)) + SMOOTH) / (c.sum() + SMOOTH * SYMBOLS)
            pair = (c.sum(axis=0) + 5 * single) / (c.sum(axis=(0, 2))[:, None] + 5)
            triple = (c + 5 * pair[None]) / (c.sum(axis=2, keepdims=True) + 5)
            logs.append(np.log(triple))
        self.ratio = (logs[0] - logs[1]).astype(np.float32).reshape(-1)
        self.threshold = threshold

    def rate(self, text: str) -> float:
        """Mean log-likelihood ratio a character; positive where the string looks random."""
        t = triples(text)
        return float(self.ratio[t].mean()) if len(t) else -np.inf

    def find(self, text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        return [(s, 3, e) for s, e in candidates(text, spans) if self.rate(text[s:e]) > self.threshold]


#: How words are joined to identifiers, and what may follow them. Fixed values.
STYLES = ("_".join, "-".join, "/".join, lambda w: w[0] + "".join(map(str.title, w[1:])), lambda w: "_".join(w).upper(), lambda w: "".join(map(str.title, w)))
ENDINGS = ("", "", "_id", "-2024-05-17", ".v2", "_0042", "-1-2", "=1", "/index", "")


def identifiers(words: list[str]) -> Iterator[str]:
    """Identifiers such as programs and paths have, made of a text's own words, two to four of them at a time; and numbers."""
    at = turn = 0
    while at + 1 < len(words):
        size = 2 + turn % 3
        yield STYLES[turn % len(STYLES)](words[at : at + size]) + ENDINGS[turn % len(ENDINGS)]
        if turn % 4 == 0:
            yield "".join(str(zlib.crc32(w.encode())) for w in words[at : at + 2])
        at, turn = at + size, turn + 1


def _samples(text: str) -> Iterator[tuple[int, str]]:
    """Labelled strings of a text: 0 secret values, 1 ordinary words outside base spans, 2 identifiers made of them.

    Long words of digits and letters are what the chains are to decide, so they are neither.
    """
    spans = base(text)
    rest, at = [], 0
    for start, kind, end in spans:
        match = text[start:end]
        yield 0, ASSIGN.fullmatch(match).group(2) if kind == 0 else match
        if start > at:
            rest.append(text[at:start])
        at = max(at, end)
    rest.append(text[at:])
    for piece in rest:
        words = [w for w in re.split(r"[^A-Za-z0-9+/_=-]+", piece) if len(w) >= 4 and (len(w) < LEAST or not undecided(w))]
        yield from ((1, w) for w in words)
        yield from ((2, w) for w in identifiers([w for w in words if w.isalpha() and len(w) < LEAST]))


def train(docs: DataFrame) -> Chains:
    """Count both chains on about MAX_TEXTS texts and set the threshold above ordinary words of candidate length.

    The sample is only what the chains learn from; distinct texts count once. Without a secret in it nothing
    random is reported.
    """
    total = docs.count()
    part = min(1.0, MAX_TEXTS / max(total, 1))
    some = docs.select(F.coalesce("text", F.lit("")).alias("text")).where(F.pmod(F.xxhash64("text", F.lit("chains")), F.lit(1_000_000)) < int(part * 1_000_000))
    some = materialize(some.dropDuplicates(["text"]), "secret-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SYMBOLS**3), dtype=np.int64)
        for b in batches:
            for t in b.column("text"):
                words: tuple[list[str], list[str]] = ([], [])
                for label, word in _samples(t.as_py()):
                    words[min(label, 1)].append(word)
                for label in (0, 1):
                    if words[label]:
                        s = symbols(" ".join(words[label]))
                        t3 = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                        total[label] += np.bincount(t3[(s[:-2] < SYMBOLS - 1) & (s[1:-1] < SYMBOLS - 1) & (s[2:] < SYMBOLS - 1)], minlength=SYMBOLS**3)
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flat[at], pa.int64())], ["cell", "n"])

    cells = some.mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most 2 x 67^3
    counts = np.zeros(2 * SYMBOLS**3, dtype=np.int64)
    for r in cells:
        counts[r["cell"]] = r["n"]
    chains = Chains(counts)
    if not counts[: SYMBOLS**3].sum():
        return chains

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [chains.rate(w) for t in b.column("text") for label, w in _samples(t.as_py()) if label == 1 and len(w) >= LEAST]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.float64())], ["rate"])

    high = some.mapInArrow(rate, "rate double").agg(F.percentile_approx("rate", F.lit(1 - PASSING), F.lit(1_000_000))).first()[0]
    chains.threshold = max(0.5, (high if high is not None else 0.0) + 0.1)
    return chains


def find(docs: DataFrame, chains: Chains) -> DataFrame:
    """``doc_id, base, found`` of every row: base spans, and those with what the chains add, as arrays of (start, kind, end).

    Null and empty texts have none; whole texts are read; repeated rows are searched each; an empty table gives an
    empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chains)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = lambda spans: [{"start": s, "kind": k, "end": e} for s, k, e in spans]
        for b in batches:
            plain, every = [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                spans = base(text)
                plain.append(shape(spans))
                every.append(shape(sorted(spans + shared.value.find(text, spans))))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(plain, kind), pa.array(every, kind)], ["doc_id", "base", "found"])

    spans = "array<struct<start:int,kind:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {spans}, found {spans}")
