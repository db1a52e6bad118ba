"""Main text of web pages by wrappers inferred per host: union-free regular expressions over pages' trees.

A page is a tree of elements; siblings that repeat, one by one or as a sequence of several, fold into a repeated group. Pages of a host are aligned one
after another: equal elements match, an element that only one side has becomes optional, texts that differ become a
slot, and repeats stay repeated. Elements are equal by tag, class and role, digits aside; ids are a page's own. The
result, a wrapper, tells the template (texts that never change) from the slots, and where most slot text lies: the
descent from the root to that element, which ends at an article or main element on its way, is the host's main
container. Only where no element holds most of it, or a host has a single page, do tags alone name the container.
A page's text is read from there, without the blocks that hold only the template's texts. Menus, headers, footers,
sidebars, notices, adverts, forms and comments inside it are left out by their element, or by a class, id or role that
names nothing else where they hold less than half of the container's text. Names never hide an element that has the
container in it. Elements with other names are decided by what the host's pages have in them (``odd_groups``).
"""

from __future__ import annotations

import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_broadcast, groups, materialize

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
# Elements by their role in HTML, and words that name what is not an article's text.
RAW = frozenset(["script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "textarea", "select", "title"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"])
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LEFT_OUT = frozenset(["nav", "aside", "footer", "form", "menu", "dialog", "button", "head"])
OUTSIDE = LEFT_OUT | {"header"}
WORDS = frozenset(["ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "related", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"])
#: Words that only say how an element named by WORDS is laid out; elements that their names never leave out.
LAYOUT = frozenset(["area", "bar", "block", "body", "box", "button", "buttons", "container", "inner", "item", "items", "link", "links", "list", "outer", "section", "slot", "top", "bottom", "unit", "wrap", "wrapper", "post", "posts"])
KEPT = frozenset(["html", "body", "main", "article"])
#: Share of an element's slot text below which its children without (also with) names of WORDS count for nothing.
FEW = {1: 0.2, 2: 0.1}
#: Depth from which a page's elements are read as blocks of the one at that depth; cells of an alignment's table.
DEPTH, CELLS = 200, 1 << 20
#: Distinct pages that must agree on a text before it counts as the template's; partial wrappers of a host merged by one task.
AGREE, FAN_IN = 3, 64
#: Elements that a repeated sequence may have; elements that hold an article's prose, digits aside.
GROUP = 6
FLOW = frozenset(["p", "h0", "ul", "ol", "dl", "pre", "blockquote", "table", "figure"])
#: Shares of the container's text: what prose must have for others to be judged, and what a judged group may have at most, all
#: pages' and a page's that has it.
PROSE, SMALL, SHORT = 0.5, 0.3, 0.15


class Node:
    """An element: ``key`` (tag, classes, role) is what alignment compares, ``named`` says how plainly its names say that it
    is a menu, advert and so on."""

    __slots__ = ("children", "key", "named")

    def __init__(self, key: str, named: int = 0):
        self.key, self.named, self.children = key, named, []

    @property
    def tag(self) -> str:
        return self.key.split(".", 1)[0]


@lru_cache(maxsize=100_000)
def names_of(key: str) -> int:
    """2 where a class, id or role says nothing but that it is a menu, advert and so on, 1 where only a part of one says so, else 0."""
    parts = [{w for w in re.split(r"[^a-z]+", n) if w} for v in key.lower().split(".")[1:] for n in v.split()]
    return max((2 if p <= WORDS | LAYOUT else 1 for p in parts if p & WORDS), default=0)


def named(key: str, kept: frozenset = KEPT) -> int:
    return 0 if key.split(".", 1)[0] in kept else names_of(key)


@lru_cache(maxsize=100_000)
def key_of(tag: str, attributes: str) -> tuple[str, int]:
    """What names an element in a wrapper: tag, classes and role with digits aside; and ``named`` of these and its id."""
    names = sorted((k.lower(), v.strip("\"'")) for k, v in NAMED.findall(attributes))
    own = ".".join([tag, *(v for k, v in names if k != "id")])
    return re.sub(r"[0-9]+", "0", own), named(".".join([tag, *(v for _, v in names)]))


def parse(page: str) -> Node:
    """The page's tree; children are nodes and decoded texts. Unclosed and stray tags are tolerated.

    Below DEPTH, blocks are marked by empty nodes around their texts, in the element at that depth; what is left out still
    has a node of its own. So a tree is never deeper, whatever the page is.
    """
    root = Node("#page")
    stack = [("#page", root)]  # open elements, each with the node that its content goes to
    opened = Counter()
    at = 0

    def close(i: int) -> None:
        for k in range(len(stack) - 1, i - 1, -1):
            tag, node = stack.pop()
            opened[tag] -= 1
            if node is stack[-1][1] and tag in BLOCKS:
                node.children.append(Node("div"))

    while m := TOKEN.search(page, at):
        if m.start() > at:
            stack[-1][1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = m.group(2) or m.group(5)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1) or m.group(4):
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag))
            continue
        attributes = m.group(3) or m.group(6) or ""
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not attributes.endswith("/"):
                at = end.end() if end else len(page)
            continue
        if tag in BLOCKS:
            shut = {"p"} | CLOSES.get(tag, set())
            if any(opened[t] for t in shut):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in shut:
                        close(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
        key, level = key_of(tag, attributes)
        node, parent = Node(key, level), stack[-1][1]
        deep = len(stack) > DEPTH
        out = tag in LEFT_OUT or level > 1
        if not deep or tag in VOID or (out and not (parent.tag in LEFT_OUT or parent.named > 1)):
            parent.children.append(node)
        elif tag in BLOCKS:
            parent.children.append(Node("div"))
            node = parent
        else:
            node = parent
        if tag not in VOID and not attributes.endswith("/"):
            stack.append((tag, node))
            opened[tag] += 1
    if at < len(page):
        stack[-1][1].children.append(entities.unescape(page[at:]))
    return root


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def named_text(text: str) -> str:
    return f"{len(text)}:{digest(text):x}"


def identity(page: Node) -> int:
    """What copies of a page have in common: a digest of its texts outside menus, adverts and the like."""

    def texts(node: Node, test) -> Iterator[str]:
        for c in node.children:
            if isinstance(c, str):
                yield from c.split()
            elif c.tag not in LEFT_OUT and test(c):
                yield from texts(c, test)

    return digest(" ".join(texts(page, lambda c: c.named < 2)) or " ".join(texts(page, lambda c: True)))


def fold(children: list[dict], one: dict, pages: int = 0) -> None:
    """Add an element after its siblings. Where the last elements repeat the ones before them, one by one or as a sequence
    of up to GROUP, they are one group with these, whose elements are marked as repeated; a sequence holds no bare texts."""
    children.append(one)
    while True:
        for size in range(1, min(GROUP, len(children) // 2) + 1):
            tail, before = children[-size:], children[-2 * size : -size]
            if all(x["k"] == y["k"] for x, y in zip(tail, before, strict=True)) and (size == 1 or all(x["k"] != "#" for x in tail)):
                break
        else:
            return
        del children[-size:]
        for k, (x, y) in enumerate(zip(before, tail, strict=True)):
            children[k - size] = merged(x, y, pages or max(x["n"], y["n"])) | {"r": 1}


def shape(node: Node, page: int = 0) -> dict:
    """A page's own wrapper: key k, how plainly named m, pages n, slot characters t, length and digest of constant text c, up to AGREE
    identities of pages with a text d, repeated r, children ch."""
    found = {"k": node.key, "m": node.named, "n": 1, "t": 0, "c": "", "d": [], "r": 0, "ch": []}
    for child in node.children:
        if isinstance(child, str):
            text = " ".join(child.split())
            if not text:
                continue
            one = {"k": "#", "m": 0, "n": 1, "t": len(text), "c": named_text(text), "d": [page], "r": 0, "ch": []}
        elif child.tag in LEFT_OUT:
            one = {"k": child.key, "m": child.named, "n": 1, "t": 0, "c": "", "d": [], "r": 0, "ch": []}
        else:
            one = shape(child, page)
        fold(found["ch"], one, pages=1)
    found["t"] = sum(c["t"] for c in found["ch"])
    return found


def aligned(a: list[dict], b: list[dict]) -> Iterator[tuple[dict | None, dict | None]]:
    """Pairs of equal keys in the order of both lists, the longest such alignment, and what only one has.

    Where its table would have more than CELLS cells, keys that both lists have once are matched first, as many as keep
    their order, and the longest alignment is found between them.
    """
    first, end = 0, 0
    while first < min(len(a), len(b)) and a[first]["k"] == b[first]["k"]:
        first += 1
    while end < min(len(a), len(b)) - first and a[-1 - end]["k"] == b[-1 - end]["k"]:
        end += 1
    yield from zip(a[:first], b[:first], strict=True)
    yield from _between(a[first : len(a) - end], b[first : len(b) - end])
    if end:
        yield from zip(a[-end:], b[-end:], strict=True)


def _between(a: list[dict], b: list[dict]) -> Iterator[tuple[dict | None, dict | None]]:
    if len(a) * len(b) > CELLS:
        once = [{k for k, n in Counter(x["k"] for x in xs).items() if n == 1} for xs in (a, b)]
        place = {x["k"]: j for j, x in enumerate(b) if x["k"] in once[0] & once[1]}
        tops: list[int] = []  # longest rising run of places, by its last places
        links: list[tuple[int, int, int]] = []
        for i, x in enumerate(a):
            if x["k"] in place:
                j = place[x["k"]]
                n = bisect_left(tops, j, key=lambda t: links[t][1])
                links.append((i, j, tops[n - 1] if n else -1))
                tops[n : n + 1] = [len(links) - 1]
        chain, t = [], tops[-1] if tops else -1
        while t >= 0:
            chain.append(links[t][:2])
            t = links[t][2]
        if not chain:  # nothing to hold on to: matched greedily, in order
            j = 0
            later = {}
            for k, y in enumerate(b):
                later.setdefault(y["k"], []).append(k)
            for x in a:
                spots = later.get(x["k"], [])
                n = bisect_left(spots, j)
                if n < len(spots):
                    yield from ((None, y) for y in b[j : spots[n]])
                    yield x, b[spots[n]]
                    j = spots[n] + 1
                else:
                    yield x, None
            yield from ((None, y) for y in b[j:])
            return
        i = j = 0
        for x, y in reversed(chain):
            yield from _between(a[i:x], b[j:y])
            yield a[x], b[y]
            i, j = x + 1, y + 1
        yield from _between(a[i:], b[j:])
        return
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["k"] == b[j]["k"] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i]["k"] == b[j]["k"]:
            yield a[i], b[j]
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            yield a[i], None
            i += 1
        else:
            yield None, b[j]
            j += 1


def merged(a: dict, b: dict, pages: int = 0) -> dict:
    """One wrapper for what both describe; ``pages`` fixes the count where both come from one page."""
    children = []
    for x, y in aligned(a["ch"], b["ch"]):
        fold(children, merged(x, y, pages) if x and y else (x or y))  # optional elements next to their like repeat
    seen = sorted({*a["d"], *b["d"]})[:AGREE]
    return {"k": a["k"], "m": max(a["m"], b["m"]), "n": pages or a["n"] + b["n"], "t": a["t"] + b["t"], "c": a["c"] if a["c"] == b["c"] else "", "d": seen, "r": a["r"] | b["r"], "ch": children}


def constant(w: dict) -> bool:
    """Whether a text is the template's: the same on distinct pages of the host."""
    return bool(w["c"]) and len(w["d"]) >= AGREE


def place(path: tuple[str, ...], text: str) -> int:
    """A digest of a text's length and digest with the keys from the page's root to it."""
    return digest("\0".join((*path, text)))


def template(wrapper: dict, path: list[str]) -> list[int]:
    """Places of the template's texts within the host's main container."""

    def texts(w: dict, at: tuple[str, ...]) -> Iterator[int]:
        for c in w["ch"]:
            here = (*at, c["k"])
            if c["k"] == "#":
                if constant(c):
                    yield place(at, c["c"])
            elif here[: len(path)] == tuple(path[: len(here)]):
                yield from texts(c, here)

    return sorted(set(texts(wrapper, ())))


def odd_groups(wrapper: dict, path: list[str]) -> list[int]:
    """Places of the container's groups that are not its article's, whatever their names: adverts, notices, readers' comments.

    Judged are children that are no prose elements and have a class or role without any of WORDS (what names say with these
    is decided by the names), on hosts of AGREE pages or more where prose
    elements that stand in the container hold PROSE of its text, and that have less than SMALL of it themselves. Such a
    group is left out where its own text is not in prose elements and, on a page that has it, is less than SHORT of the
    mean page's; or where it follows the last prose element and is a list of repeated elements of its own.
    """
    here = wrapper
    for key in path:
        here = next((c for c in here["ch"] if c["k"] == key), None)
        if here is None:
            return []
    if here["n"] < AGREE or not here["t"]:
        return []
    flows = [i for i, c in enumerate(here["ch"]) if c["k"].split(".", 1)[0] in FLOW]
    if sum(here["ch"][i]["t"] for i in flows) < PROSE * here["t"]:
        return []

    def prose(w: dict) -> int:
        return sum(c["t"] if c["k"].split(".", 1)[0] in FLOW else prose(c) for c in w["ch"])

    def lists(w: dict) -> bool:
        return any(c["k"].split(".", 1)[0] in ("div", "section", "article", "li") and (c["r"] or lists(c)) or c["k"].split(".", 1)[0] in ("ul", "ol") and lists(c) for c in w["ch"])

    found = []
    for i, c in enumerate(here["ch"]):
        if "." in c["k"] and not c["m"] and c["k"].split(".", 1)[0] in BLOCKS - FLOW and 0 < c["t"] < SMALL * here["t"]:
            bare = 2 * prose(c) < c["t"] and c["t"] * here["n"] < SHORT * here["t"] * c["n"]
            if bare or (i > flows[-1] and lists(c)):
                found.append(place((*path, c["k"]), "group"))
    return found


def main_path(wrapper: dict) -> list[str]:
    """Keys from the page's root to the host's main container."""

    def slots(w: dict) -> int:  # text that isn't the template's
        if w["k"] == "#":
            return 0 if constant(w) else w["t"]
        sizes = [0, 0, 0]
        for c in w["ch"]:
            sizes[c["m"]] += slots(c)
        return sum(sizes[: 1 + least(sizes)])

    def least(sizes: list[int]) -> int:  # how plainly a child may be named by WORDS to count beside the others
        if sizes[0] < FEW[1] * (sizes[0] + sizes[1]):
            return 1 if sizes[0] + sizes[1] >= FEW[2] * sum(sizes) else 2
        return 0 if sizes[0] >= FEW[2] * sum(sizes) else 2

    def tagged(w: dict, test, path: list[str]) -> Iterator[tuple[int, int, list[str]]]:
        for c in w["ch"]:
            if c["k"] != "#":
                here = [*path, c["k"]]
                if test(c["k"]):
                    if c["t"]:
                        yield -max(named(k, KEPT - {"article"}) for k in here), c["t"], here
                else:
                    yield from tagged(c, test, here)

    names = lambda k: k.split(".")
    article = lambda k: names(k)[0] == "article"
    main = lambda k: names(k)[0] == "main" or "main" in names(k)[1:]

    def by_slots() -> list[str]:  # down to the last element that holds most of the slot text
        path, here = [], wrapper
        while True:
            total = slots(here)
            sizes = [sum(slots(c) for c in here["ch"] if c["m"] == k) for k in range(3)]
            inner = [(slots(c) if c["m"] <= least(sizes) else 0, c) for c in here["ch"] if c["k"] != "#" and names(c["k"])[0] in BLOCKS - OUTSIDE]
            size, best = max(inner, key=lambda x: x[0], default=(0, None))
            if not total or not best or size < 0.6 * total or best["r"] or names(best["k"])[0] in ("p", "li", "td", "h1", "h2", "h3"):
                return path
            path.append(best["k"])
            here = best
            if article(best["k"]) or main(best["k"]):
                return path

    def by_tags() -> list[str] | None:
        for test in (article, main):
            found = max(tagged(wrapper, test, []), key=lambda x: x[:2], default=None)
            if found:
                return found[2]
        return None

    path = by_slots()
    if wrapper["n"] > 1 and path and names(path[-1])[0] not in ("html", "body"):
        return path
    return by_tags() or path


def text_of(page: Node, path: list[str], constants: frozenset = frozenset()) -> str | None:
    """Blocks of the elements at ``path``, one a line; None where the page has no such element.

    Blocks of which all texts are among the template's ``constants`` are left out, unless that leaves none; and so are the
    container's groups whose place is among them.
    """
    found = [page]
    for key in path:
        found = [c for n in found for c in n.children if isinstance(c, Node) and c.key == key]
    if not found:
        return None
    left_out = LEFT_OUT if path and path[-1].split(".")[0] in ("article", "main") else OUTSIDE
    blocks: list[list[str]] = [[]]

    def size(node: Node) -> int:
        return sum(len(c.strip()) if isinstance(c, str) else size(c) for c in node.children if isinstance(c, str) or c.tag not in left_out)

    whole = sum(map(size, found))

    varied: set[int] = set()  # blocks with a text of the page's own

    def walk(node: Node, at: tuple[str, ...]) -> None:
        for c in node.children:
            if isinstance(c, str):
                blocks[-1].append(c)
                if constants and len(blocks) not in varied and (text := " ".join(c.split())) and place(at, named_text(text)) not in constants:
                    varied.add(len(blocks))
            elif c.tag in left_out or c.named > 1 and 2 * size(c) < whole:
                blocks[-1].append(" ")
            elif constants and len(at) == len(path) and place((*at, c.key), "group") in constants:
                blocks.append([])
            elif c.tag == "br":
                blocks[-1].append(" ")
            elif c.tag in BLOCKS:
                blocks.append([])
                walk(c, (*at, c.key))
                blocks.append([])
            else:
                walk(c, (*at, c.key))

    for n in found:
        blocks.append([])
        walk(n, tuple(path))
    if varied:
        blocks = [b for i, b in enumerate(blocks, 1) if i in varied]
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, path, template``: the main container of every host, and the places of the template's texts and of odd groups in
    it, from the wrapper over all of its pages.

    Each task aligns its own pages of a host first; partial wrappers are then merged FAN_IN at a time, so that a
    host with most of the pages never comes to one task whole.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, dict] = {}
        for b in batches:
            for h, page in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                tree = parse(page.as_py() or "")
                one = shape(tree, identity(tree))
                found[h] = merged(found[h], one) if h in found else one
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()], pa.string())], ["host", "wrapper"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["host", "salt"]):
            whole = None
            for w in g.column("wrapper").to_pylist():
                one = json.loads(w)
                whole = merged(whole, one) if whole else one
            yield pa.RecordBatch.from_arrays([g.column("host").slice(0, 1).combine_chunks(), pa.array([json.dumps(whole)], pa.string())], ["host", "wrapper"])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole = [json.loads(w) for w in b.column("wrapper").to_pylist()]
            found = [main_path(w) for w in whole]
            fixed = [template(w, p) + odd_groups(w, p) for w, p in zip(whole, found, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(found, pa.list_(pa.string())), pa.array(fixed, pa.list_(pa.int64()))], ["host", "path", "template"])

    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = materialize(pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(local, "host string, wrapper string"), "wrappers")
    most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    while most > 1:
        salts = -(-most // FAN_IN)
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts)).cast("int"))
        salted = salted.repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "wrapper")
        rows = materialize(salted.select("host", "salt", "wrapper").mapInArrow(merge, "host string, wrapper string"), "wrappers")
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0]
    return rows.mapInArrow(paths, "host string, path array<string>, template array<long>")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages`` (``page_id, url, html``).

    A page without its host's main container is read by its own. Character references are decoded, white space in
    a block is one blank, blocks are joined in page order by line ends. Null and empty pages have the empty text;
    null urls form one host; repeated rows are read each; an empty table gives an empty result; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for page, path, fixed in zip(b.column("html"), b.column("path").to_pylist(), b.column("template").to_pylist(), strict=True):
                tree = parse(page.as_py() or "")
                text = text_of(tree, path, frozenset(fixed)) if path else None
                found.append(text or text_of(tree, main_path(shape(tree))) or "")
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(found, pa.string())], ["page_id", "url", "text"])

    paths = bounded_broadcast(materialize(wrappers(pages), "main-paths").withColumnRenamed("host", "__host"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").join(paths, host(F.col("url")) == F.col("__host"), "left")
    return rows.select("page_id", "url", "html", "path", "template").mapInArrow(run, "page_id long, url string, text string")
