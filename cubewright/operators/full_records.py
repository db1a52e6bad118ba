"""Records with all that their rules join: observations, notes of a selection, nested tables, place matches with reasons,
published alternatives and highlight cards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cubewright.functions.periods import pct
from cubewright.functions.text import parse_dguid, place_level
from cubewright.sources.storage import handed_out, stored

from .cues import padded, says


def observation_records(page: DataFrame, dimensions: int, member: DataFrame, period: DataFrame, member_place: DataFrame, unit_family: DataFrame, meanings: DataFrame) -> DataFrame:
    """A page of observations with period, labels, place, family of units and what their marks mean.

    ``page`` has ``pid, ref_date, member_id_1 ..., uom_id, status, symbol``; an observation of a period that ``period`` lacks
    is left out, all else may be missing. ``meanings`` has ``kind (status or symbol), code, meaning``; no mark means nothing.
    """
    rows = page.join(period.select("pid", "ref_date", "period_start", "period_end", "period_kind"), ["pid", "ref_date"])
    for k in range(1, dimensions + 1):
        own = member.where(F.col("dimension_id") == k).select("pid", F.col("member_id").alias(f"member_id_{k}"), F.col("member_name").alias(f"label_{k}"))
        rows = rows.join(own, ["pid", f"member_id_{k}"], "left")
    places = member_place.where("dimension_id = 1").select("pid", F.col("member_id").alias("member_id_1"), "place_id")
    rows = rows.join(places, ["pid", "member_id_1"], "left").join(unit_family.select(F.col("uom_code").alias("uom_id"), F.col("family").alias("unit_family")), "uom_id", "left")
    for kind in ("status", "symbol"):
        own = meanings.where(F.col("kind") == kind).select(F.col("code").alias(kind), F.col("meaning").alias(f"{kind}_meaning"))
        rows = rows.join(own, kind, "left").withColumn(f"{kind}_meaning", F.when(F.col(kind) != "", F.col(f"{kind}_meaning")))
    return rows


def selected_notes(notes: DataFrame, references: DataFrame, selected: DataFrame) -> DataFrame:
    """``pid, note_id, scope, dimension_id, member_id`` of the notes that belong to a selection, each once, widest first.

    ``references`` has ``pid, scope (dimension or member), dimension_id, member_id, note_ids``. A note that nothing refers to
    is its table's; dimensions' notes belong to any selection, members' only where ``selected`` (``pid, dimension_id,
    member_id``) has the member. Of several the first dimension's counts, then the first member's.
    """
    each = references.select("pid", "scope", "dimension_id", "member_id", F.explode(F.split("note_ids", ";")).alias("note_id")).where("note_id <> ''")
    mine = each.where("scope = 'dimension'").unionByName(each.where("scope = 'member'").join(selected, ["pid", "dimension_id", "member_id"], "left_semi"))
    first = F.min(F.struct((F.col("scope") == "member").alias("narrow"), "dimension_id", "member_id", "scope")).alias("s")
    scoped = mine.groupBy("pid", "note_id").agg(first).select("pid", "note_id", "s.scope", "s.dimension_id", "s.member_id")
    whole = notes.select("pid", "note_id").join(each.select("pid", "note_id"), ["pid", "note_id"], "left_anti")
    whole = whole.select("pid", "note_id", F.lit("table").alias("scope"), F.lit(None).cast("int").alias("dimension_id"), F.lit(None).cast("int").alias("member_id"))
    return whole.union(scoped.join(notes.select("pid", "note_id"), ["pid", "note_id"], "left_semi"))


def nested_tables(tables: DataFrame, dimension: DataFrame, member: DataFrame, lists: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """One record a table: its dimensions in order, each with its members in order, and further lists by name.

    ``dimension`` has ``pid, dimension_id`` and more, ``member`` also ``member_id``; each of ``lists`` is a frame with ``pid``
    and the columns that order it. What a table lacks is an empty list. Members are gathered within their dimension, so a
    record is as large as its table's metadata.
    """
    def gathered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
        columns = [*order, *[c for c in df.columns if c not in keys and c not in order]]
        return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    members = gathered(member, ["pid", "dimension_id"], ["member_id"], "members")
    nested = dimension.join(members, ["pid", "dimension_id"], "left")
    empty = F.array().cast(members.schema["members"].dataType)
    frames = {"dimensions": (nested.withColumn("members", F.coalesce("members", empty)), ["dimension_id"]), **lists}
    out = tables
    for name, (frame, order) in frames.items():
        one = gathered(frame, ["pid"], order, name)
        out = out.join(one, "pid", "left").withColumn(name, F.coalesce(name, F.array().cast(one.schema[name].dataType)))
    return out


def table_places(tables: DataFrame, matched: DataFrame) -> DataFrame:
    """``tables`` with ``n_places, n_unplaced, levels``: a table's members with and without a place (``pid, place_id``) and the
    distinct levels of their places, in order."""
    level = place_level(F.coalesce(parse_dguid(F.col("place_id"))["schema"], F.regexp_extract("place_id", "^code:([^:]*):", 1)))
    facts = matched.groupBy("pid").agg(F.count_distinct("place_id").alias("n_places"), F.count_if(F.col("place_id").isNull()).alias("n_unplaced"), F.array_sort(F.collect_set(level)).alias("levels"))
    none = F.array().cast("array<string>")
    return tables.join(facts, "pid", "left").withColumn("n_places", F.coalesce("n_places", F.lit(0))).withColumn("n_unplaced", F.coalesce("n_unplaced", F.lit(0))).withColumn("levels", F.coalesce("levels", none))


def place_matches(members: DataFrame, alias: DataFrame) -> DataFrame:
    """``pid, member_id, place_id, match, reasons``: a geography member's place and how it was found, and what spoke against
    the ways before.

    ``members`` has ``pid, member_id, member_name, code, dguids``, the different ids on a member's observations; ``alias`` has
    ``code, schema, geo_code``. First, exactly one id, well-formed, whose code agrees with the bracketed one if there is one;
    then the code's alias; then the name of just one country or province that these found; else none.
    """
    ids = F.array_sort(F.coalesce("dguids", F.array().cast("array<string>")))
    rows = members.select("pid", "member_id", "member_name", F.coalesce("code", F.lit("")).alias("code"), ids.alias("ids"))
    rows = rows.withColumn("id", F.when(F.size("ids") == 1, F.col("ids")[0])).withColumn("d", parse_dguid(F.col("id"))).withColumn("inner", F.regexp_extract("code", r"\A\[(.+)\]\z", 1))
    differs = F.col("d").isNotNull() & (F.col("inner") != "") & (F.col("inner") != F.col("d.geo_code"))
    against = (
        F.when(F.size("ids") == 0, "member has no observations").when(F.size("ids") > 1, F.concat(F.lit("several ids on observations: "), F.array_join("ids", ", "))).when(F.col("id") == "", "no id on observations")
        .when(F.col("d").isNull(), F.concat(F.lit("not a well-formed id: "), "id")).when(differs, F.concat("id", F.lit(" disagrees with code "), "code"))
    )
    rows = rows.withColumn("against", against).join(handed_out(alias.select("code", F.col("schema").alias("a_schema"), F.col("geo_code").alias("a_geo"))), "code", "left")
    coded = F.when(F.col("a_schema").isNull(), F.when(F.col("code") == "", "no classification code").otherwise(F.concat(F.lit("no alias of code "), "code")))
    by_id = F.col("against").isNull()
    rows = rows.withColumn("schema", F.when(by_id, F.col("d.schema")).otherwise(F.col("a_schema"))).withColumn("geo", F.when(by_id, F.col("d.geo_code")).otherwise(F.col("a_geo")))
    rows = rows.withColumn("match", F.when(by_id, "dguid").when(F.col("a_schema").isNotNull(), "code")).withColumn("uncoded", F.when(~by_id, coded))
    named = rows.where(F.col("match").isNotNull() & place_level(F.col("schema")).isin("country", "province")).groupBy("member_name").agg(F.collect_set(F.struct("schema", "geo")).alias("places"))
    rows = rows.join(handed_out(stored(named, "named-places")), "member_name", "left").withColumn("n", F.coalesce(F.size("places"), F.lit(0)))
    by_name = F.col("match").isNull() & (F.col("n") == 1)
    code_id = lambda p: F.concat_ws(":", F.lit("code"), p["schema"], p["geo"])
    place = F.when(F.col("match") == "dguid", F.col("id")).when(F.col("match") == "code", F.concat_ws(":", F.lit("code"), "schema", "geo")).when(by_name, code_id(F.get("places", F.lit(0))))
    unnamed = F.when(F.col("match").isNull() & ~by_name, F.when(F.col("n") > 1, F.concat(F.lit("name of "), F.col("n").cast("string"), F.lit(" countries or provinces"))).otherwise("name of no country or province"))
    return rows.select("pid", "member_id", place.alias("place_id"), F.coalesce("match", F.when(by_name, "name"), F.lit("none")).alias("match"), F.array_compact(F.array("against", "uncoded", unnamed)).alias("reasons"))


#: Dimensions of which a view may take another basis, and what a question says if it wants its own.
BASES = {"Seasonal adjustment": ["seasonally adjusted", "unadjusted"], "Prices": ["current prices", "constant prices"]}
MOST_BASES = 3


def published_basis(chosen: DataFrame, member: DataFrame, published: DataFrame) -> DataFrame:
    """``question_id, pid, dimension_id, member_id, alternative``: where a question's chosen member of a basis publishes nothing,
    the first other one of its dimension that does, null if none.

    ``chosen`` has ``question_id, question, pid, dimension_id, dimension_name, member_id``. Dimensions of BASES with at most
    MOST_BASES members are considered, unless the question names a basis of that kind itself.
    """
    small = member.groupBy("pid", "dimension_id").agg(F.count("*").alias("n")).where(F.col("n") <= MOST_BASES)
    text = padded(F.col("question"))
    free = reduce(lambda a, b: a | b, [(F.col("dimension_name") == name) & ~says(text, said) for name, said in BASES.items()])
    rows = chosen.where(free).join(small.select("pid", "dimension_id"), ["pid", "dimension_id"], "left_semi").join(published, ["pid", "dimension_id", "member_id"], "left_anti")
    others = member.select("pid", "dimension_id", F.col("member_id").alias("other")).join(published.withColumnRenamed("member_id", "other"), ["pid", "dimension_id", "other"], "left_semi")
    met = rows.join(others, ["pid", "dimension_id"], "left")
    return met.groupBy("question_id", "pid", "dimension_id", "member_id").agg(F.min(F.when(F.col("other") != F.col("member_id"), F.col("other"))).alias("alternative"))


#: How each kind of headline is named; the others compare with the period before.
KINDS = {"yoy": "12-month change", "qoq": "quarterly change", "mom": "monthly change", "mom_pts": "monthly change"}


def highlight_cards(points: DataFrame, cards: DataFrame, keep: int = 60) -> DataFrame:
    """``card, value, period_label, change, change_unit, change_kind, direction, spark`` of each card's latest published point.

    ``points`` has ``card, period_start, value`` at every date of a card's view, ``cards`` ``card, headline (yoy, qoq, mom,
    mom_pts), quarterly``. The change is against the same day a year before, or the date before, in percent or, for
    ``mom_pts``, in points; null where that isn't published, or is zero for a percentage. ``spark`` has the last ``keep``
    published points. A card without a published point has no row.
    """
    own = Window.partitionBy("card").orderBy("period_start")
    rows = points.join(cards, "card").withColumn("previous", F.lag("value").over(own))
    year = F.try_to_date(F.concat((F.year("period_start") - 1).cast("string"), F.date_format("period_start", "-MM-dd")))
    there = rows.where("value is not null").withColumn("back", F.row_number().over(Window.partitionBy("card").orderBy(F.desc("period_start"))))
    latest = there.where("back = 1").withColumn("year_ago", year).join(points.select("card", F.col("period_start").alias("year_ago"), F.col("value").alias("yearly")), ["card", "year_ago"], "left")
    spark = there.where(F.col("back") <= keep).groupBy("card").agg(F.array_sort(F.collect_list(F.struct("period_start", "value"))).alias("spark"))
    earlier = F.when(F.col("headline") == "yoy", F.col("yearly")).otherwise(F.col("previous"))
    change = F.when(F.col("headline") == "mom_pts", F.col("value") - earlier).otherwise(pct(F.col("value"), earlier))
    label = F.when(F.col("quarterly") | (F.col("headline") == "qoq"), F.concat(F.lit("Q"), F.quarter("period_start").cast("string"), F.date_format("period_start", " yyyy"))).otherwise(F.date_format("period_start", "MMM yyyy"))
    way = F.when(change > 0, "up").when(change < 0, "down").when(change == 0, "flat")
    kind = reduce(lambda c, kv: c.when(F.col("headline") == kv[0], kv[1]), list(KINDS.items())[1:], F.when(F.col("headline") == "yoy", KINDS["yoy"]))
    unit = F.when(F.col("headline") == "mom_pts", "pts").otherwise("%")
    return latest.join(spark, "card").select("card", "value", label.alias("period_label"), change.alias("change"), unit.alias("change_unit"), kind.alias("change_kind"), way.alias("direction"), "spark")
