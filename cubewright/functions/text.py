"""Scalar functions on codes, labels and units."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

_DGUID = r"\A(\d{4})([AS])(\d{4})(\S+)\z"


def parse_dguid(text: Column) -> Column:
    """``struct(vintage, geo_type, schema, geo_code)``, null where the id is not well-formed."""
    part = lambda i: F.regexp_extract(F.coalesce(text, F.lit("")), _DGUID, i)
    found = F.struct(part(1).try_cast("int").alias("vintage"), part(2).alias("geo_type"), part(3).alias("schema"), part(4).alias("geo_code"))
    return F.when(part(1) != "", found)


def place_level(schema: Column) -> Column:
    return F.when(schema == "0000", "country").when(schema == "0002", "province").otherwise(F.concat(F.lit("schema:"), schema))


def bracket_code(text: Column) -> Column:
    """``[35]`` as ``35``; empty where there are no brackets."""
    return F.regexp_extract(F.coalesce(text, F.lit("")), r"\[([^\]]*)\]", 1)


def table_number(pid: Column) -> Column:
    """``18100006`` as ``18-10-0006-01``."""
    return F.concat(F.substring(pid, 1, 2), F.lit("-"), F.substring(pid, 3, 2), F.lit("-"), F.substring(pid, 5, 4), F.lit("-01"))


def table_pid(number: Column) -> Column:
    """The inverse; null for another shape or suffix."""
    return F.when(number.rlike(r"\A\d{2}-\d{2}-\d{4}-01\z"), F.translate(F.substring(number, 1, 10), "-", ""))


def scale_value(value: Column, scalar: Column) -> Column:
    return value * F.pow(F.lit(10.0), scalar)


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", " ")


def note_ids(text: Column) -> Column:
    """``1;2;3`` as positive integers; other parts are dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x).try_cast("int")), lambda x: x > 0)


def short_place(name: Column) -> Column:
    """The part before `` (``, with en dashes for hyphens that stand between blanks."""
    return F.replace(F.substring_index(name, " (", 1), F.lit(" - "), F.lit(" – "))


def unique_parts(text: Column) -> Column:
    """Parts of a `` | `` list, trimmed, without blanks and repeats, in order."""
    return F.filter(F.array_distinct(F.transform(F.split(F.coalesce(text, F.lit("")), r" \| "), lambda x: F.trim(x))), lambda x: x != "")


def dimension_band(count: Column) -> Column:
    return F.when(count <= 2, "1-2").when(count <= 4, "3-4").otherwise("5+")


def strict_length(text: Column) -> Column:
    """A content length of ASCII digits only, else null."""
    return F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("long"))


def parse_value(text: Column) -> Column:
    """A published number as a double: plain decimals only, blank is null."""
    return F.when(text.rlike(r"\A-?\d+(\.\d+)?\z"), text.try_cast("double"))


def value_error(text: Column) -> Column:
    return (text != "") & ~text.rlike(r"\A-?\d+(\.\d+)?\z")


def split_marks(marks: Column) -> Column:
    """``struct(status, symbol)`` of comma-joined marks; p and r are symbols, the rest statuses."""
    parts = F.filter(F.transform(F.split(F.coalesce(marks, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        F.array_join(F.filter(parts, lambda x: ~x.isin("p", "r")), ",").alias("status"),
        F.array_join(F.filter(parts, lambda x: x.isin("p", "r")), ",").alias("symbol"),
    )


def words(text: Column, stop: list[str]) -> Column:
    """Lower-case tokens of more than two characters without stop words and years, in order."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-zà-ÿ0-9]+"), F.lit(0))
    return F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*stop) & ~t.rlike(r"\A(?:19|20)\d\d\z"))


def singular(word: Column) -> Column:
    """A word without its plural's ending."""
    short = F.when(word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(?:sses|xes|ches|shes)$"), F.regexp_replace(word, "es$", ""))
    return short.when((F.length(word) > 3) & word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)


def token_hits(label: Column, tokens: Column) -> Column:
    """How many of the tokens are whole words of a label; repeated tokens count each."""
    own = F.regexp_extract_all(F.lower(label), F.lit(r"\w+"), F.lit(0))
    return F.size(F.filter(tokens, lambda t: F.array_contains(own, t)))


def compact_document(title: Column, lists: dict[str, Column], details: dict[str, Column], limit: int) -> Column:
    """A titled text of bounded length: lines of ``lists`` whole, then of ``details`` as far as they fit, each list's
    parts once."""
    once = lambda c: F.array_join(F.filter(F.array_distinct(F.transform(F.split(F.coalesce(c, F.lit("")), r" \| "), lambda x: F.trim(x))), lambda x: x != ""), "; ")
    text = F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce(title, F.lit(""))), *[F.concat(F.lit(f"{k}: "), once(c)) for k, c in lists.items()])
    for name, c in details.items():
        rest = F.lit(limit - len(name) - 3) - F.length(text)
        content = F.when(rest > 0, F.substring(once(c), F.lit(1), F.greatest(rest, F.lit(0)))).otherwise("")
        text = F.when(content != "", F.concat(text, F.lit(f"\n{name}: "), content)).otherwise(text)
    return F.substring(text, 1, limit)


def _plain_letters() -> tuple[str, str]:
    """Letters that are a letter with marks, and those letters, by their Unicode decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x2000)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.combining(m) for m in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def fold_accents(text: Column) -> Column:
    """Lower case, without the marks of letters, whether written apart or with them."""
    return F.lower(F.regexp_replace(F.translate(text, *_PLAIN), r"\p{Mn}", ""))


def view_hash(spec: Column, length: int = 10) -> Column:
    """A short name of a resolved specification, given as a structure: its JSON's SHA-256."""
    return F.substring(F.sha2(F.to_json(spec), 256), 1, length)


def content_hash(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


_PLAIN = _plain_letters()
