"""Corpus operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cubewright.llm import decontaminate, embeddings, lines, mixing, pages, pii, queries, secrets, simhash, tokens, toxicity

DOCS = "doc_id long, text string, source string, lang string, size long, key string, aligned string"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "en", 7, "k", "a") for i, t, s in rows], DOCS)


MIXED = [
    (0, None, "a"), (1, "", "a"), (2, "one two three four five six", "a"), (3, "one two three four five six", "a"), (4, "x " * 5000, None),
    (5, "Ünï côde wörds here and  there\nline two", "b"), (5, "again the same id", "b"), (None, "no id at all here", None), (7, "é😀 mixed 漢字 text", "b"),
]


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}" if i % 5 else None) for i in range(300)]
    got = mixing.mix(docs(spark, rows)).toPandas()
    by = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert len(got) == 300 and (abs(by.taken - by.target) <= 1).all() and (by.target <= 2 * by["size"] + 1e-6).all()
    assert abs(by.target.sum() - 1.5 * by["size"].sum()) < 1e-6 and (got.taken <= 2 * got["size"]).all()
    again = mixing.mix(docs(spark, rows).repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))
    kept = mixing.apply_mix(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() > 300


def test_mix_edges(spark):
    got = mixing.mix(docs(spark, MIXED)).toPandas()
    assert len(got) == len(MIXED) and (got[got["size"] == 0].taken == 0).all()
    assert mixing.mix(docs(spark, [])).count() == 0
    twins = mixing.mix(docs(spark, [(1, "a b c d", "x")] * 6 + [(2, "a", "y")])).toPandas()
    assert (twins.taken <= 2 * twins["size"]).all()


def brute_simhash(text):
    w = (text or "").encode().translate(simhash.LOWER).split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_masks_cover_the_radius():
    rng = np.random.default_rng(1)
    for _ in range(300):
        bits = rng.choice(64, size=rng.integers(1, 5), replace=False)
        diff = sum(1 << int(b) for b in bits)
        assert any(diff & (m & (1 << 64) - 1) == 0 for m in simhash.masks(4))


@pytest.mark.parametrize("block", [1024, 3])
def test_simhash_against_brute_force(spark, block):
    rng = np.random.default_rng(2)
    base = [" ".join(rng.choice(list("abcdefghij"), 40)) for _ in range(6)]
    texts = [None, "", "A b", "a B"] + base + [b.replace("a", "q", int(k)) for b in base for k in (1, 2)] + base[:3]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    fps = [brute_simhash(t) for t in texts]
    label = components(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 4)
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i]["component_id"] for i in range(len(texts))] == [min(j for j in range(len(texts)) if label[j] == label[i]) for i in range(len(texts))]
    rows = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(set(fps))], "fp long")


def test_close_fingerprints_in_one_bucket(spark):
    """Many fingerprints around one point come out as one component, in blocks as well."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = sorted({centre} | {signed(centre ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 64, (60, 2))})
    pairs = {(a, b) for a, b in simhash._forest(np.array([5, signed((1 << 63) ^ 5), -6, 5 ^ 31 << 8]), 4)}
    assert pairs == {(signed((1 << 63) ^ 5), 5)}
    from cubewright.llm.common import connected_components

    found = connected_components(simhash.links(spark.createDataFrame([(x,) for x in near], "fp long"), 4, 8))
    assert found.select("component").distinct().count() == 1 and found.count() == len(near)
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_components_of_a_long_path_take_few_rounds(spark, monkeypatch):
    from cubewright.llm import common

    rounds, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    edges = [(i, i + 1) for i in range(1, 4096)] + [(9000, 9001), (7, 7), (9001, 9000), (None, 3)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 4097)} | {9000: 9000, 9001: 9000} and rounds.count("best") <= 14
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_lines(rows, similarity=0.8):
    places = []
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            places.append((((i is not None, i or 0), n), frozenset(line.encode().translate(lines.LOWER).split())))
    places.sort(key=lambda x: x[0])
    sets = {s for _, s in places if s}
    near = {s: [o for o in sets if o != s and len(s & o) / len(s | o) >= similarity] for s in sets}
    first = {}
    for p, s in places:
        first.setdefault(s, p)
    plain = lambda p: (p[0][1] if p[0][0] else None, p[1])
    found = {}
    for p, s in places:
        others = [first[o] for o in near[s]] if s else []
        row = (not s or p == min([first[s], *others]), len(others), plain(first[s]) if s else (None, None), plain(min(others)) if others else (None, None))
        found.setdefault(plain(p), set()).add(row)
    return found


def line_rows(rng):
    words = [f"w{i}" for i in range(60)]
    base = [list(rng.choice(words, 12, replace=False)) for _ in range(15)]
    rows = []
    for i in range(40):
        own = []
        for _ in range(4):
            line = list(base[rng.integers(15)])
            if rng.random() < 0.6:
                line[rng.integers(12)] = str(rng.choice(words))
            own.append(" ".join(line))
        rows.append((i, "\n".join(own)))
    return [*rows, (100, None), (101, ""), (102, "a b c d\n\na b c d e\nA  B c d"), (103, " ")]


@pytest.mark.parametrize(("block", "most"), [(512, 8192), (2, 3)])
def test_lines_against_brute_force(spark, block, most):
    rows = line_rows(np.random.default_rng(4))
    long = " ".join(f"v{i % 20_000}" for i in range(60_000))  # one line of over 256 KB, and a near copy
    rows += [(None, "p q r s t\nu"), (7, "a repeated id\np q r s t"), (7, "a repeated id\nx"), (-5, long + " end"), (104, "other\n" + long), (105, "\n".join(f"l{i % 9} m n o p" for i in range(9_000)))]
    wide = [[f"u{k}-{i}" for i in range(140)] for k in range(3)]  # lines of 100 to 200 words, near each other and not
    rows += [(200 + i, "\n".join(" ".join([*w[: 140 - 9 * i], *(f"q{i}-{k}-{j}" for j in range(i))]) for k, w in enumerate(wide))) for i in range(5)]
    got = lines.line_matches(docs(spark, [(i, t, "s") for i, t in rows]), block=block, most=most).collect()
    found = {}
    for r in got:
        found.setdefault((r["doc_id"], r["line"]), set()).add((r["kept"], r["links"], (r["class_doc"], r["class_line"]), (r["near_doc"], r["near_line"])))
    assert found == brute_lines(rows) and len(got) == sum((t or "").count("\n") + 1 for _, t in rows)


def test_lines_empty_and_rewritten(spark):
    assert lines.line_matches(docs(spark, [])).count() == 0
    out = lines.dedup(docs(spark, [(1, "a b c\nd", "s"), (2, "x\nA b c", "s"), (3, None, "s")])).select("doc_id", "text").collect()
    assert {r["doc_id"]: r["text"] for r in out} == {1: "a b c\nd", 2: "x", 3: None}


def test_tokens_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    rows = MIXED + [(9, "a  b\t c\n\n d <|endoftext|> e ", "a"), (8, "it's 12ab — naïve. Ça,va", "b"), (10, "First\nSecond, third\nÉté. a-b 7x\n漢字, déjà\n", "b"), (11, "one\ntwo;three\n'quoted' we'll", "b")]
    got = sorted(tokens.write_and_read(docs(spark, rows), queries.tokenizer_path()).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted(r[0] for r in rows if r[0] is not None)]
    want = {}
    for i, t, _ in rows:
        want.setdefault(i, []).append(plain.encode(t or "", add_special_tokens=False).ids + [2])
    at = 0
    for r in got:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert r["start"] == at and r["n_tokens"] == len(ids) and ids in want[r["doc_id"]]
        at += len(ids)
    shown = tokens.write_and_read(docs(spark, [(3, "x", "s")]), queries.tokenizer_path(), tokens.read_digests).first()
    assert shown["ids_crc32"] == zlib.crc32(np.array(want_ids(plain, "x"), dtype="<u4").tobytes())
    assert tokens.write_and_read(docs(spark, []), queries.tokenizer_path()).count() == 0


def test_pieces_are_encoded_as_whole_texts(spark):
    from tokenizers import Tokenizer

    plain, encoder = Tokenizer.from_file(queries.tokenizer_path()), tokens.Encoder(queries.tokenizer_path())
    rng = np.random.default_rng(12)
    parts = ["word", "Word,", "été", "ünï.", "漢字", "12", "a1", "don't", "x-y", "\n", " ", "\n", " ", "😀", "end!", "'s", "<|endoftext|>", "\t", "É;", "ǅ"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts, rng.integers(1, 12)))
        assert encoder(text).tolist() == want_ids(plain, text), text


def want_ids(plain, text):
    return plain.encode(text, add_special_tokens=False).ids + [2]


def test_codec():
    rng = np.random.default_rng(5)
    for top in (0, 1, 300, 70_000, 20_000_000):
        counts = rng.integers(0, 9, 40)
        ranks = rng.integers(0, top + 1, counts.sum())
        control, data = tokens.encode(ranks, counts)
        assert (tokens.decode(control, data, counts) == ranks).all()


def brute_kernel(a, b):
    """Weights of all common three-letter subsequences of two words, ends marked, by enumeration."""

    def weights(word):
        c = [0, *toxicity._codes(word)[0].tolist(), 0]
        found = {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    if c[i] or c[k]:
                        found[c[i], c[j], c[k]] = found.get((c[i], c[j], c[k]), 0.0) + toxicity.DECAY ** (k - i + 1)
        return found

    x, y = weights(a), weights(b)
    size = lambda w: sum(max(len(w) + 2 - (g - 1), 0) * toxicity.DECAY ** (2 * g) * (g - 2) for g in range(3, toxicity.SPAN + 1))
    return sum(v * y.get(k, 0.0) for k, v in x.items()) / np.sqrt(size(a) * size(b))


def test_subsequence_kernel_against_enumeration():
    words = ["idiot", "id1ot", "i-d-i-o-t", "idxiot", "banana", "abab", "été", "abc", "zzzzzz"]
    for a in words:
        for b in words:
            x, y = toxicity.features(a), toxicity.features(b)
            plain = ["".join(ch for ch in w if toxicity.CODE_OF[min(ord(ch), 0xFFFF)] > 0) for w in (a, b)]
            assert abs(sum(v * y.get(k, 0.0) for k, v in x.items()) - brute_kernel(*plain)) < 1e-9
    rng = np.random.default_rng(15)  # a text's word values are its words' kernel expansions
    machine = toxicity.Machine(rng.standard_normal(toxicity.LETTERS**3), 0.25, np.zeros(3))
    want = [sum(v * machine.weights[k] for k, v in toxicity.features(w).items()) + 0.25 for w in words]
    assert np.allclose(machine.words(" ".join(words))[: len(words)], want, atol=1e-4) or np.allclose(machine.words(" ".join(words))[-len(words) - 1 : -1], want, atol=1e-4)


def test_toxicity_learns_gapped_insults(spark):
    rng = np.random.default_rng(6)
    syllables = ["tha", "ner", "ion", "ble", "sto", "wer", "ing", "ou", "re", "li"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = []
    for i in range(400):
        text = [word() for _ in range(30)]
        if i % 4 == 0:
            for _ in range(2):
                text[rng.integers(30)] = str(rng.choice(["zukkop", "grumfak", "vlapp"]))
        rows.append((" ".join(text), int(i % 4 == 0)))
    machine = toxicity.train(spark.createDataFrame(rows, "text string, toxic int"))
    assert np.mean([(machine.score(t) >= 0.7) == bool(y) for t, y in rows]) > 0.97
    for bad in ("zukkop", "ZUK.KOP", "z u k k o p", "grumxfak"):
        assert machine.score(f"the ner ion {bad} wer ing sto {bad}") > machine.score("the ner ion ble wer ing sto")
    scored = toxicity.score(docs(spark, MIXED), machine).collect()
    assert len(scored) == len(MIXED) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.reject(docs(spark, MIXED), machine).columns == docs(spark, []).columns
    assert toxicity.train(spark.createDataFrame([("a", 0)], "text string, toxic int")).score("a") < 0.7
    assert 0 <= toxicity.train(spark.createDataFrame([], "text string, toxic int")).score(None) <= 1


ITEM = "item_id long, text string, doc_id long"


def brute_hits(text, items, width=10):
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = split(text), set(), set()
    for i, t in items:
        w = split(t)
        size = min(width, len(w))
        windows = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if w else set()
        for p in range(len(own) - size + 1):
            if size and tuple(own[p : p + size]) in windows:
                hit |= set(range(p, p + size))
                found.add(str(i))
    return len(own), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([30, 12, 10, 3, 1])] + [(9, "the the the the the the the the the the the the"), (10, None), (11, "...")]
    rows = list(MIXED)
    for i in range(30):
        w = list(rng.choice(vocabulary, 40))
        source = items[rng.integers(5)][1].split()
        cut = int(rng.integers(len(source)))
        rows.append((100 + i, " ".join(w[:20]) + ", " + " ".join(source[cut:]).upper() + " " + " ".join(w[20:]), "a"))
    rows.append((200, "the " * 30, "a"))
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], ITEM)
    got = decontaminate.matches(docs(spark, rows), bench).collect()
    want = sorted((i if i is not None else -1, *brute_hits(t, items)) for i, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    clean = {r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()}
    assert clean == {i for i, t, _ in rows if not brute_hits(t, items)[1]}
    assert decontaminate.near_matches(docs(spark, rows), bench).columns == ["item_id", "doc_id", "share"]
    none = spark.createDataFrame([], ITEM)
    assert decontaminate.matches(docs(spark, []), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.matches(docs(spark, rows), none).collect()} == {0}


def test_decontamination_of_repeated_shared_and_null_items(spark):
    texts = [" ".join(f"{c}{i}" for i in range(14)) for c in "pqrstu"]
    items = [("1", texts[0]), ("1", texts[0]), ("2", texts[1]), ("2", texts[2]), (None, texts[3]), (None, texts[4]), ("3", texts[0]), ("5", None)]
    rows = [(i, "a b " + t[4:] + " c d", "a") for i, t in enumerate(texts)] + [(10, " ".join(texts), "a"), (11, "a b c", "a")]
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id string, text string, doc_id long")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.matches(docs(spark, rows), bench).collect()}
    want = {i: brute_hits(t, items) for i, t, _ in rows}
    assert got == {i: (n, h, [None if x == "None" else x for x in f]) for i, (n, h, f) in want.items()}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()} == {5, 11}
    near = decontaminate.near_matches(docs(spark, rows), bench).where("doc_id = 10").collect()
    assert sorted((r["item_id"] or "", r["share"]) for r in near) == [("", 1.0)] * 2 + [("1", 1.0)] + [("2", 1.0)] * 2 + [("3", 1.0)]


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def brute_pii(text):
    found = []
    for k, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group(0))
            if {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in m.group(0).split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))


PII_TEXTS = [
    None, "", "a@b.com_x@c.de a@b..c 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111-2 41111111111111111111 4111  1111", "5 4111111111111111, 4111111111111112",
    "+1 (532) 555-7857 +12 3 (532) 555-7857 (532) 555-7857", "é😀 a@b.co 😀 +44 20 7946 0958", "a" * 5000 + "@" + "b" * 50 + ".c", "1" * 20000, "no data", "x@y",
]


def test_pii_base_against_brute_force(spark):
    frame = docs(spark, [(i, t, "s") for i, t in enumerate(PII_TEXTS)])
    got = {r["doc_id"]: r["b"] for r in pii.find(frame, None).select("doc_id", pii.report(F.col("base")).alias("b")).collect()}
    assert got == {i: brute_pii(t) for i, t in enumerate(PII_TEXTS)}
    assert pii.find(docs(spark, []), None).count() == 0


def pii_rows(rng, n=300):
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    rows = []
    for i in range(n):
        number = f"4{digits(14)}"
        card = number + next(c for c in "0123456789" if luhn(number + c))
        parts = [f"call +1 ({digits(3)}) 555-{digits(4)}", f"write ab.{digits(2)}@mail{i % 9}.example.com", f"server 10.{i % 200}.3.{i % 90}", f"card {card}"]
        rows.append((i, f"{parts[i % 4]} or {parts[(i + 1) % 4]}, part {digits(3)}-{digits(4)}-{digits(9)} and {digits(4)}.{digits(3)}.{digits(3)}.{digits(4)}.{digits(3)}", "s"))
    return rows


def test_pii_adds_what_the_base_patterns_miss(spark):
    """Held-out rows: forms that the base rules don't know are found, base spans stay, numbers of other meaning stay out."""
    frame = docs(spark, pii_rows(np.random.default_rng(8)))
    model = pii.train(frame)
    assert model is not None
    private = ["write to ann.lee (at) mail (dot) example now", "server 10[.]20[.]30[.]40 is down", "card 4539.1488.0343.6467 please", "phone 0044 20 7946 0018 today", "mail bob[at]mail[dot]example, thanks"]
    plain = ["order 1042-55310-77812 came", "isbn 978-3-16-148410-0 is out", "on 2019-04-17 08:15 it rained", "", None]
    rows = [(i, t, "s") for i, t in enumerate(private + plain)]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows), model).collect()}
    hit = [i for i in range(len(private)) if len(got[i]["found"]) > len(got[i]["base"])]
    wrong = [i for i in range(len(private), len(rows)) if got[i]["found"] != got[i]["base"]]
    assert len(hit) >= 4 and not wrong
    found = pii.find(frame, model).select("doc_id", pii.report(F.col("base")).alias("b"), pii.report(F.col("found")).alias("f")).collect()
    texts = {r[0]: r[1] for r in pii_rows(np.random.default_rng(8))}
    for r in found:
        assert r["b"] == brute_pii(texts[r["doc_id"]]) and set(r["b"].split(",")) <= set(r["f"].split(","))


def test_pii_learns_from_every_candidate(spark, monkeypatch):
    """No bound on texts or candidates: 4,200 of each label and more all reach the trees or the threshold."""
    rows = [(i, f"write to u{i}@host{i % 50}.com today", "a") for i in range(4_200)]
    frame, seen, own = docs(spark, rows + rows[:9]), [], pii.assembled
    monkeypatch.setattr(pii, "assembled", lambda rows: seen.append(rows.count()) or own(rows))
    assert pii.train(frame) is not None
    expected = pii.labelled(docs(spark, rows)).groupBy("label").count().collect()
    assert sum(seen) == sum(r["count"] for r in expected) and max(r["count"] for r in expected) > 4_000


def test_pii_redacts_every_row_by_its_own_text(spark):
    rows = [(1, "mail a@b.com now", "s"), (1, "nothing but long words here", "s"), (None, "call x@y.org", "s"), (None, None, "s"), (2, "", "s"), (3, "x@y.org" + " a@b.com" * 3_000, "s")]
    got = sorted(((r["doc_id"], r["text"]) for r in pii.redact(docs(spark, rows), None).collect()), key=str)
    want = [(1, "mail <email> now"), (1, "nothing but long words here"), (None, "call <email>"), (None, None), (2, ""), (3, "<email>" + " <email>" * 3_000)]
    assert got == sorted(want, key=str)
    assert pii.redact(docs(spark, []), None).count() == 0 and pii.train(docs(spark, [])) is None


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((12, 16))
    vectors = [(i, (base[i % 12] + 0.03 * rng.standard_normal(16) * (i > 11)).tolist(), i % 2) for i in range(90)]
    vectors += [(200 + i, vectors[0][1], 0) for i in range(5)] + [(300, None, 0), (301, [0.0] * 16, 0), (302, [float("nan")] * 16, 0), (303, [], 0), (304, vectors[0][1], None), (305, [1.0, 2.0], 0), (306, [None] * 16, 0)]
    for block in (512, 4):
        got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(vectors, "vec_id long, embedding array<double>, label int"), block=block).collect()}
        assert len(got) == len(vectors)
        good = lambda v: v[1] and v[2] is not None and None not in v[1] and np.isfinite(v[1]).all() and any(v[1])

        def linked(i, j):
            a, b = vectors[i], vectors[j]
            if not good(a) or not good(b) or a[2] != b[2] or len(a[1]) != len(b[1]):
                return False
            x, y = np.array(a[1]), np.array(b[1])
            return x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98

        n = len(vectors)
        count = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
        label = components(n, linked)
        assert [got[v[0]]["n_links"] for v in vectors] == count
        least = [min(vectors[j][0] for j in range(n) if label[j] == label[i]) for i in range(n)]
        assert [got[v[0]]["component_id"] for v in vectors] == least
        assert all(got[v[0]]["kept"] == (got[v[0]]["component_id"] == v[0]) for v in vectors)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embeddings_of_repeated_ids_and_extreme_sizes(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 1.001], 0), (None, [1.0, 0.001], 0), (4, [1e200, 1e200], 1), (5, [2e200, 2e200], 1), (6, [1e-200, 1e-200], 1), (7, [1e308, -1e308], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, 1, False), (4, 2, 4, True), (5, 2, 4, False), (6, 2, 4, False), (7, 0, 7, True)]
    assert sorted(map(str, want)) == sorted(str((r["vec_id"], r["n_links"], r["component_id"], r["kept"])) for r in got)


def test_pages(spark):
    body = lambda i: f"<nav><a>Home</a></nav><div class='ad'>Buy</div><article><h1>Title {i}</h1><p>Text&nbsp;&amp; more {i}<ul><li>one<li>two</ul><div class='comments'>no</div></article><footer>f</footer>"
    plain = lambda i: f"<html><body><header>Head</header><div id='x'><p>Long text of page {i} with many words in it</p><p>And more {i}</p></div><aside>side</aside><div class='cookie-notice'>ok?</div></body>"
    rows = [(i, "http://a.example/1", body(i), "h") for i in range(5)] + [(10 + i, "http://b.example/2?x", plain(i), "h") for i in range(5)] + [(20, None, "<p>a<br>b", "h"), (21, "x", None, "h"), (22, "http://a.example/", "", "h"), (23, "http://a.example/", "<div", "h")]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()}
    assert got[3] == "Title 3\nText & more 3\none\ntwo"
    assert got[12] == "Long text of page 2 with many words in it\nAnd more 2"
    assert (got[20], got[21], got[22]) == ("a b", "", "") and len(got) == len(rows)
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def main_texts(spark, pages_of):
    """Texts by page number of hosts' pages."""
    rows = [(1000 * h + i, f"http://h{h}.example/{i}", page) for h, found in enumerate(pages_of) for i, page in enumerate(found)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows)
    return [[got[1000 * h + i] for i in range(len(found))] for h, found in enumerate(pages_of)]


def test_pages_that_are_copies_or_open_alike(spark):
    menu = "<nav><ul><li>Home<li>News</ul></nav>"
    page = lambda text: f"<html><body>{menu}<div id='x'><p>{text}</p></div></body></html>"
    alike = ["same opening words " * 20 + f"and then page {i}" for i in range(5)]
    copies, opened, adverts = main_texts(spark, [
        [page("A whole article, copied.")] * 4, [page(t) for t in alike],
        [page("A whole article, copied.").replace("<div", f"<div class='ad'>Buy {i} now</div><div") for i in range(4)],
    ])
    assert copies == adverts == ["A whole article, copied."] * 4
    assert opened == alike


def test_pages_whose_containers_are_named_like_menus(spark):
    text = lambda i: f"Some article text of page {i}, number {i * 7}, which is long enough"
    inner = lambda i: f"<h1>Title {i}</h1><p>{text(i)}</p><p class='notice-of-appeal'>Appeal {i}</p><div class='search-results'>Found {i}</div><section class='related-work'><p>Prior work {i}</p></section><div class='related-posts'>Old {i}</div><div class='ad'>Buy {i}</div>"
    want = lambda i: f"Title {i}\n{text(i)}\nAppeal {i}\nFound {i}\nPrior work {i}"
    around = [
        "<body class='right-sidebar'><article>%s</article>", "<body class='no-sidebar'><div id='x'>%s</div><footer>f</footer>",
        "<body><div id='content-sidebar-wrap'><div id='x'>%s</div><div class='sidebar'>Menu</div></div><p>End</p>",
        "<body><main class='has-share'>%s</main><div class='sidebar'>Menu</div>", "<body><div class='sidebar'><article>%s</article></div>",
        "<body><article>%s</article><article class='comment'>" + "A long comment. " * 20 + "</article>",
    ]
    assert main_texts(spark, [[a.replace("%s", inner(i)) for i in range(4)] for a in around]) == [[want(i) for i in range(4)]] * len(around)
    assert main_texts(spark, [[a.replace("%s", inner(5))] for a in around]) == [[want(5)]] * len(around)


def test_pages_with_template_texts_in_the_article(spark):
    page = lambda i: f"<article><h1>Title {i}</h1><p class='lead'>Follow <b>us</b></p><p><b>Note</b> Own text of page {i}</p><p>More {i}</p><div class='x'>All rights reserved</div></article>"
    whole = lambda i: f"Title {i}\nFollow us\nNote Own text of page {i}\nMore {i}\nAll rights reserved"
    many, two, copies = main_texts(spark, [[page(i) for i in range(4)], [page(i) for i in range(2)], [page(1)] * 4])
    assert many == [f"Title {i}\nNote Own text of page {i}\nMore {i}" for i in range(4)]
    assert two == [whole(i) for i in range(2)] and copies == [whole(1)] * 4


def test_pages_of_any_depth_and_with_own_ids(spark):
    text = lambda i: f"Own text of page {i}, number {i * 7}, which is long enough to be the article's"
    deep = lambda i: "<html><body><div id='x'>" + "<div>" * 5_000 + f"<p>{text(i)}</p><nav>Menu</nav>one {i}<b> two</b><div class='ad'>Buy</div><div>three {i}</div>" + "</div>" * 5_000 + "</div><footer>f</footer></body></html>"
    own = lambda i: f"<body><div class='menu'>Home</div><div id='post-{i}'><p id='p{i}-1'>{text(i)}</p><p id='p{i}-2'>More {i}</p></div><div>Imprint</div></body>"
    stray = "</div>" * 3_000 + "<p>" * 3_000 + "alone" + "<span>" * 3_000
    deeps, owns, strays = main_texts(spark, [[deep(i) for i in range(4)], [own(i) for i in range(300)], [stray]])
    assert deeps == [f"{text(i)}\none {i} two\nthree {i}" for i in range(4)]
    assert owns == [f"{text(i)}\nMore {i}" for i in range(300)] and strays == ["alone"]
    whole = None
    for i in range(300):
        one = pages.shape(pages.parse(own(i)), i)
        whole = pages.merged(whole, one) if whole else one
    assert len(str(whole)) < 3_000  # ids don't make it grow


def test_alignment_against_brute_force():
    rng = np.random.default_rng(13)
    lengths = lambda a, b: [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for _ in range(200):
        a, b = ([{"k": str(x)} for x in rng.integers(0, 4, rng.integers(0, 9))] for _ in range(2))
        best = lengths(a, b)
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i]["k"] == b[j]["k"] else max(best[i][j + 1], best[i + 1][j])
        found = list(pages.aligned(a, b))
        assert [x for x, _ in found if x] == a and [y for _, y in found if y] == b
        assert sum(x is not None and y is not None for x, y in found) == best[-1][-1]
        assert all(x["k"] == y["k"] for x, y in found if x and y)
    long = [[{"k": str(x)} for x in rng.integers(0, top, 3_000)] for top in (10_000, 10_000, 3, 3)]
    for a, b in ((long[0], long[1]), (long[2], long[3])):  # beyond the table's bound
        found = list(pages.aligned(a, b))
        assert [x for x, _ in found if x] == a and [y for _, y in found if y] == b and all(x["k"] == y["k"] for x, y in found if x and y)


def brute_secrets(text):
    """The contract's patterns, on their own."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group(0)) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group(0)) >= 32]
    return sorted(found)


def secret_docs(rng, n=120):
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    mixed = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    words = "configuration ordinary sentence about several interesting questions without answers before another morning internationalization".split()
    line = lambda: " ".join(rng.choice(words, 30))
    return [(i, f"{line()} password={mixed(18)} and API_Key: '{mixed(20)}' then {hexes(40)} AKIA{'A1B2' * 4}, token=short {line()}", "s") for i in range(n)], mixed


def test_secrets_base_against_brute_force(spark):
    rng = np.random.default_rng(14)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", " = ", "'", '"', "abc123XY", "0123456789abcdef", "AKIA", "ABCD1234", "é", "😀", ".", "secret", "\n", "-", "x"]
    rows = [(i, "".join(rng.choice(parts, rng.integers(0, 30))), "s") for i in range(400)] + [(900, None, "s"), (900, "", "s"), (None, "token=abcdefgh", "s")]
    got = secrets.find(docs(spark, rows), secrets.Chains(np.zeros(2 * secrets.SYMBOLS**3))).collect()
    shown = lambda spans: [(x["start"], x["kind"], x["end"]) for x in spans]
    want = sorted(str((i, brute_secrets(t or ""))) for i, t, _ in rows)
    assert sorted(str((r["doc_id"], shown(r["base"]))) for r in got) == want and all(r["found"] == r["base"] for r in got)


def test_secrets_without_a_name_are_found(spark):
    """Planted in texts that weren't trained on: recall and precision of what the chains add, and whole runs of any length."""
    rng = np.random.default_rng(10)
    rows, mixed = secret_docs(rng)
    chains = secrets.train(docs(spark, rows))
    names = ["getUserNameFromConfiguration", "ordinary_sentence_about_answers", "internationalization", "several/interesting/questions", "ANOTHER_MORNING_BEFORE_QUESTIONS"]
    held = [(i, f"see {mixed(rng.integers(20, 41))} and {names[i % 5]}", "s") for i in range(100)] + [(200, "see " + re.sub("[0-9]", "Q", mixed(300)) + mixed(99) + "9xZ", "s"), (201, None, "s"), (202, "", "s"), (203, mixed(15), "s")]
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["found"]] for r in secrets.find(docs(spark, held), chains).collect()}
    right = sum((4, held[i][1].index(" and")) in got[i] for i in range(100))
    added = sum(len(got[i]) for i in range(100))
    assert right >= 95 and right / added >= 0.95
    assert got[200] == [(4, 406)] and got[201] == got[202] == got[203] == []
    assert secrets.find(docs(spark, []), secrets.train(docs(spark, []))).count() == 0


def test_very_long_texts_and_null_ids(spark):
    """A text of 300,000 words and rows without ids go through every operator on texts whole."""
    long = " ".join(f"w{i % 997}" for i in range(300_000))
    rows = [(1, long, "a"), (None, long, "a"), (None, None, None), (2, long + " the end of it all with password=Zx9Kq2Lm8Pw3", "b"), (2, "short", "b"), (3, "", None)]
    frame = docs(spark, rows)
    near = simhash.near_duplicates(frame).collect()
    assert len(near) == len(rows) and sorted(str(r["doc_id"]) for r in near) == sorted(str(r[0]) for r in rows)
    assert {r["fingerprint"] for r in near if r["doc_id"] == 1} == {f"{brute_simhash(long):016x}"}
    bench = spark.createDataFrame([("x", "of it all with password zx9kq2lm8pw3"), (None, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14")], "item_id string, text string")
    hit = decontaminate.matches(frame, bench).collect()
    assert len(hit) == len(rows) and max(r["n_words"] for r in hit) == 300_000 + 8 and sum(r["n_hit"] > 0 for r in hit) == 3
    found = secrets.find(frame, secrets.Chains(np.zeros(2 * secrets.SYMBOLS**3))).collect()
    assert sorted(len(r["base"]) for r in found) == [0] * 5 + [1]
    scored = toxicity.score(frame, toxicity.Machine(np.zeros(toxicity.LETTERS**3), -1.0, np.array([0.0, 1.0, 0.0]))).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    assert len(tokens.tokenize(frame, queries.tokenizer_path()).collect()) == len(rows) and len(mixing.mix(frame).collect()) == len(rows)


def test_shared_folder_of_sessions_that_name_none():
    from types import SimpleNamespace

    from cubewright.llm.common import shared_dir

    def session(master, app):
        unset = SimpleNamespace(get=lambda *_: None)
        return SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: unset, master=master, applicationId=app), conf=unset)

    assert shared_dir(session("local[2]", "a")) == shared_dir(session("local[2]", "a")) != shared_dir(session("local", "b"))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077", "c"))


def test_unsplit_is_its_pattern():
    import itertools

    for parts in itertools.product(["a", " ", "\n", "\t", " ", "　", " ", "<", "|"], repeat=4):
        text = "".join(parts)
        assert tokens.unsplit(text) == (tokens.UNSPLIT.search(text) is not None)
