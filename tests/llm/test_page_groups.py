"""Repeated groups of several elements, and adverts and comments with names that no list has."""

import random

from cubewright.llm import pages, secrets

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "") for c in ("r", "l", "m", "nd")]


def prose(rng, n):
    return " ".join(rng.choices(WORDS, k=n)).capitalize() + "."


def keys(w):
    return [(c["k"], c["r"]) for c in w["ch"]]


def test_sequences_of_elements_fold_into_one_group():
    rng = random.Random(1)
    whole = None
    for n in (1, 3, 5, 8):
        body = "".join(f"<h3>{prose(rng, 3)}</h3><p>{prose(rng, 20)}</p>" for _ in range(n))
        one = pages.shape(pages.parse(f"<article>{body}</article>"), n)["ch"][0]
        assert keys(one) == [("h0", int(n > 1)), ("p", int(n > 1))]
        whole = pages.merged(whole, one) if whole else one
    assert keys(whole) == [("h0", 1), ("p", 1)] and whole["n"] == 4
    three = pages.shape(pages.parse("<main>" + "<h2>a</h2><ul><li>x</li></ul><p>b</p>" * 4 + "<h2>a</h2></main>"))["ch"][0]
    assert keys(three) == [("h0", 1), ("ul", 1), ("p", 1), ("h0", 0)]
    inline = pages.shape(pages.parse("<p>By <a>one</a> in <a>two</a></p>"))["ch"][0]
    assert [c["k"] for c in inline["ch"]] == ["#", "a", "#", "a"]  # texts are not folded into a sequence


def site(rng, n, style):
    """Pages of a host and the text that each should give; adverts, notices and comments are named as no list knows."""
    made = []
    for k in range(n):
        title, paragraphs = prose(rng, 5), [prose(rng, rng.randrange(15, 60)) for _ in range(rng.randrange(2, 9))]
        blocks = [f"<h1>{title}</h1>"] + [f"<p>{p}</p>" for p in paragraphs]
        if style != "tail" and k % 3:
            blocks.insert(rng.randrange(2, len(blocks)), f"<div class='{style}'>{prose(rng, 4)}</div>")
        if k % 2 or style == "tail":
            blocks.append("<section class='discussion'>" + "".join(f"<div class='reply'><p>{prose(rng, 6)}</p></div>" for _ in range(rng.randrange(1, 6))) + "</section>")
        made.append((k, f"http://{style}.example/{k}", f"<html><body><nav><a>Home</a></nav><article>{''.join(blocks)}</article><footer>f</footer></body></html>", "\n".join([title, *paragraphs])))
    return made


def test_planted_adverts_and_comments_leave_and_articles_stay(spark):
    rng = random.Random(7)
    planted = [p for style in ("partner", "zq-slot", "Offer", "tail") for p in site(rng, 24, style)]
    planted = [(i, url, page, text) for i, (_, url, page, text) in enumerate(planted)]
    found = pages.main_text(spark.createDataFrame([p[:3] for p in planted], "page_id long, url string, html string")).collect()
    expected = {p[0]: p[3] for p in planted}
    assert all(r["text"] == expected[r["page_id"]] for r in found) and len(found) == len(planted)


def test_boxes_of_prose_and_other_markup_stay(spark):
    """A box with paragraphs, an article set in classed divisions, a long bare box, and hosts of two pages lose nothing."""
    rng = random.Random(8)
    rows, expected = [], {}

    def add(host, blocks, texts):
        rows.append((len(rows), f"http://{host}/{len(rows)}", f"<body><article>{''.join(blocks)}</article></body>"))
        expected[len(expected)] = "\n".join(texts)

    for _ in range(10):
        t = [prose(rng, 40) for _ in range(5)]
        add("box", [*(f"<p>{x}</p>" for x in t[:4]), f"<div class='inset'><p>{t[4]}</p></div>"], t)
        t = [prose(rng, 40) for _ in range(5)]
        add("divisions", [f"<div class='para'>{x}</div>" for x in t], t)
        t = [prose(rng, 30) for _ in range(5)]
        add("long", [*(f"<p>{x}</p>" for x in t[:3]), f"<div class='quote'>{t[3]}</div>", f"<p>{t[4]}</p>"], t)
    for _ in range(2):
        t = [prose(rng, 40), prose(rng, 3)]
        add("two", [f"<p>{t[0]}</p>", f"<div class='sidenote'>{t[1]}</div>"], t)
    found = pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == expected


def test_what_spans_leave_of_a_run_is_rated():
    value = "q7Zk2mPx9Lw4Tn8Rb3Vy6Hd1Sc5Gf0Jj2Kq8Wz4"
    access, hexadecimal = "AKIA" + "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2
    n = len(value)
    for text, expected in [(f"x {access}{value.lower()} y", [(22, 22 + n)]), (f"{value}_{hexadecimal}", [(0, n + 1)]), (f"{access} {value}", [(21, 21 + n)]), (f"{access}short", []), (value + access + value, [(0, n), (n + 20, 2 * n + 20)])]:
        spans = [s for s in secrets.base(text) if s[1] > 0]
        assert list(secrets.candidates(text, spans)) == expected, text
