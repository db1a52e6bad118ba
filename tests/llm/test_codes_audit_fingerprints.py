"""Vector codes, divergence audit and fingerprints against plain versions, and their edge cases."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from cubewright.llm import divergence, fingerprints, vectorcodes

VECTORS = "vec_id long, embedding array<float>, label int"


# --- vector codes ---------------------------------------------------------------------------------------------------


def plain_codes(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // 4
    cut = lambda v, p: v[p * width : (p + 1) * width]
    ordered = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[cut(v, p) for _, v, _ in ordered[:entries]] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            mine = {}
            for _, v, _ in kept:
                mine.setdefault(nearest(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, xs in mine.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = []
    for i, v, label in kept:
        best = [nearest(cut(v, p), books[p]) for p in range(4)]
        found.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
    sums = Counter()
    for _, label, _, e in found:
        sums[label] += e
    whole = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted([(i, label, c, e, sums[label]) for i, label, c, e in found], key=repr), whole


def test_codes_equal_a_plain_version_with_ties_repeats_and_nulls(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 0.25, -0.5, rng.gauss(0, 0.3)]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(300)]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    rows += [(7, rows[7][1], 1), (7, rows[9][1], 2), (None, rows[3][1], None)] + [(1000 + k, rows[11][1], 1) for k in range(60)]
    bad = [(2000, None, 1), (2001, [float("nan")] * 8, 1), (2002, [None] + [0.0] * 7, 2), (2003, [float("-inf")] + [0.0] * 7, None)]
    rng.shuffle(rows)
    codes, books = vectorcodes.compress(spark.createDataFrame(rows + bad, VECTORS), entries=64)
    expected, whole = plain_codes(rows, 64)
    assert sorted(map(tuple, codes.collect()), key=repr) == expected
    assert books.sha256() == whole


@pytest.mark.parametrize("radius", [1, 3, 1000])
@pytest.mark.parametrize("n", [1, 63, 64, 65, 256])
def test_slices_find_the_nearest_entry_at_any_radius(radius, n):
    rng = np.random.default_rng(n)
    entries, x = rng.integers(-40, 40, (n, 3)), rng.integers(-60, 60, (1500, 3))
    distance = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    code, best = vectorcodes.SliceIndex(entries, radius).nearest(x)
    assert (code == distance.argmin(axis=1)).all() and (best == distance.min(axis=1)).all()  # argmin takes the lower index


def test_slices_are_the_box_around_a_row():
    rng = np.random.default_rng(0)
    entries, x = rng.integers(-9, 9, (100, 4)), rng.integers(-9, 9, (50, 4))
    masks = vectorcodes.SliceIndex(entries).within(x, np.full(50, 5))
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :100]
    assert (bits == (np.abs(x[:, None] - entries[None]) <= 5).all(axis=2)).all()


def test_codes_of_odd_tables(spark):
    codes, books = vectorcodes.compress(spark.createDataFrame([], VECTORS))
    assert codes.collect() == [] and books.sha256() == hashlib.sha256(b"").hexdigest()
    codes, _ = vectorcodes.compress(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert codes.collect() == []
    mixed = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0], 1, "z"), (2, [], 1, "z"), (3, [1e30] * 3, None, "z")], f"{VECTORS}, code string")
    codes, books = vectorcodes.compress(mixed)
    assert {r["vec_id"]: r["error"] for r in codes.collect()} == {1: 0, 2: 0, 3: 0} and books.width == 8
    first = next(r for r in codes.collect() if r["vec_id"] == 1)
    assert books.decode(first["code"]).tolist() == [1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0, 0.0]


# --- divergence audit -----------------------------------------------------------------------------------------------


def plain_audit(docs, least=10, top=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, within = {}, Counter()
    for text, lang, source in docs:
        clean = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in (text or "").translate(lower))
        words = [w for w in clean.split(" ") if w]
        groups.setdefault((lang or "", source or ""), Counter()).update(words)
        within.update((lang or "", w) for w in set(words))
    found = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted(w for (of, w), n in within.items() if of == lang and n >= least)
        mine = {s: c for (of, s), c in groups.items() if of == lang}
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for w in kept} for s, c in mine.items()}
        whole = sum(mine.values(), Counter())
        q = {w: 1 + 10**9 * (whole[w] + 2) // (sum(whole[k] for k in kept) + 2 * len(kept)) for w in kept}
        for s in mine:
            pairs = [(t, sum(f(p[s][w], p[t][w]) for w in kept)) for t in mine if t != s]
            terms = [(w, f(p[s][w], q[w])) for w in kept if mine[s][w] and p[s][w] > q[w]]
            for part, values, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:limit]
                found += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return sorted(found)


DOCS = "text string, lang string, source string"


def test_audit_equals_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)  # many blocks, with sources cut in two
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "BUCKET", 40)
    rng = random.Random(3)
    words = [f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(100)] + ["Straße", "ÉTÉ", "x1y", "\x7f"]
    docs = []
    for k in range(400):
        text = " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randrange(40)))
        docs.append((text, rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None])))
    docs += [("the same line of it " * 50, "en", "hot")] * 150 + [(None, "en", "silent"), ("", "fr", "only"), ("rare words", "it", "a"), ("others", "it", "b")]
    found = sorted(map(tuple, divergence.audit(spark.createDataFrame(docs, DOCS)).collect()))
    assert found == plain_audit(docs)
    assert ("it", "a", "pair", "b", 0, 1) in found and not any(r[0] == "fr" for r in found)


def test_audit_of_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).collect() == []
    docs = [("word " * 300_000, "en", "a")] * 10 + [("word", "en", "b")]
    wide = spark.createDataFrame([(*d, 1, 2) for d in docs], f"{DOCS}, term int, value int")
    assert sorted(map(tuple, divergence.audit(wide).collect())) == plain_audit(docs)


# --- fingerprints ---------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    """A byte at a time."""
    F = fingerprints
    data, mask = text.encode("utf-8", "surrogatepass"), (1 << 64) - 1
    if not data:
        return "0::"

    def mixed(h):
        h = (h ^ (h >> 33)) * F.MIX & mask
        return h ^ (h >> 29)

    def rolled(i):
        return mixed(sum((data[i - j] + 1 if i >= j else 1) * pow(F.ROLL, j + 1, 1 << 64) for j in range(F.WINDOW)) & mask)

    hashes = [rolled(i) for i in range(len(data))]
    low_ones = lambda h: (~h & (h + 1)).bit_length() - 1
    bits = 0
    while sum(low_ones(h) >= bits for h in hashes) > F.CUTS:
        bits += 1

    def signature(b):
        out, total, at, context = "", 0, 0, 0
        for i, h in enumerate(hashes):
            total = (total + (data[i] + 1) * pow(F.MULTIPLY, at, 1 << 64)) & mask
            at += 1
            if low_ones(h) >= b or i == len(data) - 1:
                out += F.ALPHABET[mixed(total ^ context) >> 58]
                total, at, context = 0, 0, h
        return out

    return f"{bits}:{signature(bits)}:{signature(bits + 1)}"


@pytest.mark.parametrize("text", ["", "a", "ab", "aaaa" * 100, "été 漢字 " * 30, "the quick brown fox jumps over the lazy dog. " * 3])
def test_fingerprint_equals_a_byte_at_a_time(text):
    assert fingerprints.fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_of_texts_over_block_edges(monkeypatch):
    rng = random.Random(2)
    for n in (255, 256, 257, 511, 512, 3000):
        text = "".join(rng.choices("abcde fgh", k=n))
        whole = fingerprints.fingerprint(text)
        with monkeypatch.context() as m:
            m.setattr(fingerprints, "BLOCK", 256)
            assert fingerprints.fingerprint(text) == whole == slow_fingerprint(text)


def test_common_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd", k=rng.randrange(20))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert fingerprints.common(a, b) == table[-1][-1]


def test_likeness_follows_what_texts_share():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    half, other, small = [], [], []
    for _ in range(60):
        n = rng.choice([20, 100, 400, 3000])
        a, b = text(n), text(n)
        own = fingerprints.fingerprint(a)
        half.append(fingerprints.likeness(own, fingerprints.fingerprint(fingerprints.edited(a, b))))
        other.append(fingerprints.likeness(own, fingerprints.fingerprint(b)))
        small.append(fingerprints.likeness(own, fingerprints.fingerprint(a.replace(" ", "  ", 1))))
    assert max(other) < 0.2 and min(half) > 0.3 and sum(small) / len(small) > 0.9
    assert fingerprints.likeness("5:abcdef:abc", "9:abcdef:abc") == 0.0  # no block size in common
    assert fingerprints.likeness("0::", "0::") == 1.0 and fingerprints.likeness("0::", "0:a:a") == 0.0


IDS = "doc_id long, text string"


def plain_against_next(docs):
    rows = sorted(((i, t or "") for i, t in docs), key=lambda r: (r[0] is None, r[0] or 0))
    found = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(text) // 2
        new = text[: len(text) - n] + following[:n]
        marks = [slow_fingerprint(t) for t in (text, new, following)]
        found.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), marks[0], marks[1], fingerprints.likeness(*marks[:2]), fingerprints.likeness(marks[0], marks[2])))
    return sorted(found, key=repr)


def test_against_next_equals_a_plain_version(spark):
    rng = random.Random(9)
    words = "ein zwei drei vier fünf sechs sieben été 漢字 \n".split(" ")
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60])))) for i in rng.sample(range(10_000), 150)] + [(20_000, None), (20_001, "x"), (None, "no id")]
    rng.shuffle(docs)
    found = fingerprints.against_next(spark.createDataFrame([(*d, "z") for d in docs], f"{IDS}, at string").repartition(7))
    assert sorted(map(tuple, found.collect()), key=repr) == plain_against_next(docs)


def test_against_next_of_odd_tables(spark):
    assert fingerprints.against_next(spark.createDataFrame([], IDS)).collect() == []
    alone = fingerprints.against_next(spark.createDataFrame([(3, "a text by itself")], IDS)).collect()
    assert [(r["doc_id"], r["near_next"]) for r in alone] == [(3, 1.0)]
    same = fingerprints.against_next(spark.createDataFrame([(1, "again and again")] * 50 + [(None, None)] * 50, IDS)).collect()
    assert len(same) == 100 and len({r["fingerprint"] for r in same}) == 2
    long = fingerprints.against_next(spark.createDataFrame([(1, "many words of it " * 300_000), (2, "short")], IDS)).collect()
    assert {r["doc_id"]: r["n_chars"] for r in long} == {1: 5_100_000, 2: 5}
