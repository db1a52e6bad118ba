"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel compares two words by the three-letter subsequences they share, each weighted by DECAY to the length it
spans (at most SPAN), so an insult still matches with letters inserted, dropped or set apart by marks. Words are
the instances: a word is learned as an insult where toxic sentences hold it in too many different contexts for
chance, and words of clean sentences are the other class. As the kernel's features are finite, the machine's
landmark expansion folds into one weight a subsequence, and a text is scored by table lookups over its letters.
A text's score is a logistic function, fitted on the labelled texts, of its words' decision values.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

DECAY, SPAN = 0.6, 6
#: Letters a-z are 1-26, other letters fold into 27-39; 0 is a word's end.
LETTERS = 40
GAPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
WORD = r"[^\x20\x09-\x0D]+"
#: Longest word that is learned from.
MAX_LETTERS = 24
#: Bounds of what is learned from: labelled texts, words of either class, ordinary words that look like insults, landmarks.
MAX_TEXTS, MAX_INSULTS, MAX_ORDINARY, MAX_HARD, LANDMARKS = 20_000, 1_500, 4_000, 2_000, 384
#: An insult's contexts in toxic texts must be this unlikely by chance (as a negative power of ten).
EVIDENCE = 5.0
NOTHING = -3.0


def _letter_table() -> np.ndarray:
    table = np.zeros(0x10000, dtype=np.int32)
    for c in range(0x250):
        ch = chr(c).lower()
        if len(ch) == 1 and ch.isalpha():
            table[c] = ord(ch) - 96 if "a" <= ch <= "z" else 27 + ord(ch) % 13
    for c in range(0x250, 0x10000):
        if chr(c).isalpha():
            table[c] = 27 + c % 13
    for mark, letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "@": "a", "$": "s"}.items():
        table[ord(mark)] = ord(letter) - 96
    return table


#: -1 for characters that are left out.
CODE_OF = np.where(_letter_table() > 0, _letter_table(), -1)
CODE_OF[[9, 10, 11, 12, 13, 32]] = 0


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of a text, other characters left out, with 0 for white space; and where those zeros are."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = CODE_OF[np.minimum(points, 0xFFFF)]
    codes = codes[codes >= 0]
    return codes, codes == 0


def norm(lengths: np.ndarray) -> np.ndarray:
    """A word's norm by its length, both ends counted, as if none of its subsequences occurred twice; 1 where it has none."""
    total = sum(np.maximum(lengths - b, 0) * DECAY ** (2 * (b + 1)) for _, b in GAPS)
    return np.sqrt(np.where(total > 0, total, 1.0))


@functools.lru_cache(maxsize=8_000)
def features(word: str) -> dict[int, float]:
    """The subsequences of the word with its ends marked, and their normalised weights."""
    c = np.concatenate(([0], _codes(word)[0], [0]))
    found: dict[int, float] = {}
    for a, b in GAPS:
        for i in range(len(c) - b):
            if c[i] or c[i + b]:
                key = (int(c[i]) * LETTERS + int(c[i + a])) * LETTERS + int(c[i + b])
                found[key] = found.get(key, 0.0) + DECAY ** (b + 1)
    size = float(norm(np.array([len(c)]))[0])
    return {k: v / size for k, v in found.items()}


class Machine:
    """A trained classifier: weights of subsequences, the words' bias, and the logistic function of a text."""

    def __init__(self, weights: np.ndarray, bias: float, logistic: np.ndarray):
        self.weights, self.bias, self.logistic = weights.astype(np.float32), bias, logistic

    def words(self, text: str) -> np.ndarray:
        """Decision value of every word, NOTHING for those of fewer than three letters; n + 1 words for n blanks."""
        c, blank = _codes(f" {text} ")
        n = len(c)
        word = np.cumsum(blank, dtype=np.int32)  # a blank counts with the word after it
        total = np.zeros(n, dtype=np.float32)
        for b in range(2, min(SPAN, n)):
            crossed = word[b:] - word[:-b]
            last = c[b:]
            at = np.flatnonzero(((crossed == 0) & (last > 0)) | ((crossed == 1) & (last == 0) & (c[:-b] > 0)))
            part = np.zeros(len(at), dtype=np.float32)
            key = c[at] * (LETTERS * LETTERS) + c[at + b]
            for a in range(1, b):
                part += self.weights[key + c[at + a] * LETTERS]
            total[at] += part * np.float32(DECAY ** (b + 1))
        starts = np.flatnonzero(blank)
        lengths = np.diff(starts) - 1
        sums = np.add.reduceat(total, starts)[:-1]
        return np.where(lengths >= 3, sums / norm(lengths + 2) + self.bias, NOTHING)

    def describe(self, text: str | None) -> tuple[float, float]:
        """The largest decision value of the text's words, spaced-out letters joined, and how many are positive."""
        values = self.words(joined(text or ""))
        return float(np.clip(values.max(), NOTHING, 1.0)), float(np.log1p((values > 0).sum()))

    def score(self, text: str | None) -> float:
        high, count = self.describe(text)
        return float(1 / (1 + math.exp(-float(self.logistic @ np.array([1.0, high, count])))))


def joined(text: str) -> str:
    """The text with runs of three or more single letters between blanks written as one word."""
    import re

    return re.sub(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)", lambda m: m.group(0).replace(" ", ""), text)


def sampled(rows: DataFrame, key: str) -> DataFrame:
    """About MAX_TEXTS of ``rows``, chosen by a hash of ``key``, whatever their number; all where there are fewer."""
    keep = min(1.0, MAX_TEXTS / max(rows.count(), 1))
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1_000_000)) < int(keep * 1_000_000)) if keep < 1 else rows


def train(labelled: DataFrame) -> Machine:
    """Learn from rows ``text, toxic``; at most about MAX_TEXTS of them, chosen by a hash of the text.

    Exact copies count once, null texts are empty, rows without a label are left out. With no toxic or no clean row, as in
    an empty table, the score is the share of toxic rows. Words of more than MAX_LETTERS characters are not learned from;
    texts are scored whole, whatever their words.
    """
    rows = labelled.where("toxic is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    rows = sampled(materialize(rows.dropDuplicates(["text"]), "toxic-train"), "text")
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = count.get(1, 0), count.get(0, 0)
    base = (bad + 1) / (bad + good + 2)
    prior = np.array([math.log(base / (1 - base)), 0.0, 0.0])
    if not bad or not good:
        return Machine(np.zeros(LETTERS**3), -1.0, prior)

    # contexts, the word before, stand for occurrences: text that is copied from toxic text has one context a word
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda x: F.length(x) >= 3)
    pairs = F.array_distinct(F.transform("w", lambda x, i: F.concat(F.when(i > 0, F.get("w", i - 1)).otherwise(""), F.lit(" "), x)))
    seen = rows.select("toxic", words.alias("w")).select("toxic", F.explode(pairs).alias("p"))
    word, before = F.substring_index("p", " ", -1), F.substring_index("p", " ", 1)
    clean = F.regexp_replace(word, r"^[^\p{L}\p{N}@$]+|[^\p{L}\p{N}@$]+$", "")
    seen = seen.select(clean.alias("word"), before.alias("before"), "toxic").where(F.length("word").between(3, MAX_LETTERS)).distinct()
    table = seen.groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    chance = F.col("bad") * -math.log10(base)
    table = materialize(table.where((F.col("n") > F.col("bad")) | (chance >= 2)).withColumn("evidence", chance), "toxic-words")
    insults = table.where((F.col("bad") >= 0.9 * F.col("n")) & (F.col("evidence") >= EVIDENCE)).orderBy(F.desc("evidence"), "word").limit(MAX_INSULTS)
    positive = [r["word"] for r in insults.collect()]
    if not positive:  # a small set of texts: the words with most evidence
        few = table.where("bad >= 2 and bad = n").orderBy(F.desc("evidence"), "word").limit(20)
        positive = [r["word"] for r in few.collect()]
    ordinary = table.where("bad <= 0.5 * n")
    common = ordinary.orderBy(F.desc("n"), "word").limit(MAX_ORDINARY // 2)
    other = ordinary.orderBy(F.xxhash64("word"), "word").limit(MAX_ORDINARY // 2)
    negative = sorted({r["word"] for r in common.union(other).select("word").collect()} - set(positive))
    if not positive or not negative:
        return Machine(np.zeros(LETTERS**3), -1.0, prior)
    hard: list[str] = []
    insult = set(positive)
    for _ in range(3):
        machine = Machine(*fit_words(positive, hard, negative), prior)
        alike = ordinary.select("word").mapInArrow(_word_run(machine), "word string, value double").where("value > -0.6")
        worst = [r["word"] for r in alike.orderBy(F.desc("value"), "word").limit(MAX_HARD).collect()]
        known = set(hard)
        hard = (hard + [w for w in worst if w not in known and w not in insult])[: 3 * MAX_HARD]
        if len(hard) == len(known):
            break

    features.cache_clear()  # the driver keeps nothing of the words
    described = rows.select("text", "toxic").mapInArrow(_run(machine, ["toxic"]), "toxic int, high double, count double").collect()
    x = np.array([[1.0, r["high"], r["count"]] for r in described])
    y = np.array([r["toxic"] for r in described], dtype=float)
    machine.logistic = fit_logistic(x, y)
    return machine


def _word_run(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = machine.words(" ".join(b.column("word").to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(values, pa.float64())], ["word", "value"])

    return run


def fit_words(positive: list[str], hard: list[str], other: list[str], cost: float = 30.0) -> tuple[np.ndarray, float]:
    """Weights of subsequences and bias of a squared-hinge machine in the Nyström space of the landmarks.

    A third of the landmarks are insults, up to half of the rest the hard ordinary words, the others ordinary words.
    """
    taken = set(hard)
    negative = hard + [w for w in other if w not in taken]
    words = positive + negative
    spread = lambda xs, n: [xs[i] for i in sorted({int(k) for k in np.linspace(0, len(xs) - 1, min(n, len(xs)))})]
    third = LANDMARKS // 3
    marks = spread(positive, third) + hard[:third] + spread(negative[len(hard) :], third)
    table = np.zeros((LETTERS**3, len(marks)), dtype=np.float32)
    for j, m in enumerate(marks):
        for k, v in features(m).items():
            table[k, j] += v
    values, vectors = np.linalg.eigh((table.T @ table).astype(float) + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-4))
    kernel = np.zeros((len(words), len(marks)))
    for i, w in enumerate(words):
        f = features(w)
        if f:
            kernel[i] = np.fromiter(f.values(), float) @ table[list(f)]
    x = np.hstack([kernel @ root, np.ones((len(words), 1))])
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    share = np.where(y > 0, len(words) / (2 * len(positive)), len(words) / (2 * len(negative))) * cost / len(words)
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 2e-3
    ridge[-1, -1] = 1e-6
    for _ in range(30):  # Newton's method on the squared hinge
        on = 1 - y * (x @ w) > 0
        h = (x[on] * share[on, None]).T @ x[on] + ridge
        step = np.linalg.solve(h, (x[on] * share[on, None]).T @ y[on])
        if np.allclose(step, w, atol=1e-8):
            break
        w = step
    return table @ (root @ w[:-1]), float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [1e-2] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge @ w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge
        step = np.linalg.solve(h, gradient)
        w = w - step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def _run(machine: Machine, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [machine.describe(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], *[pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]], [*keep, "high", "count"])

    return run


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id, score`` of every row; every whole text is read, null and empty texts get the score of no words.

    Rows that repeat are scored each; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shared.value.score(t.as_py()) for t in b.column("text")], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Whether a row's labels are kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def reject(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, with their own columns; texts are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t.as_py()) < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
