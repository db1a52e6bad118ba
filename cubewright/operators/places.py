"""Places and hierarchies of a cube's members.

Members are a catalogue: small beside the observations, but any number of tables may share one frame, so everything is
grouped by ``pid`` and walked by joins, never by a driver loop over rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cubewright.functions.text import bracket_code, fold_accents, parse_dguid, place_level
from cubewright.sources.storage import stored

from .matching import contained

MAX_DEPTH = 50


def map_places(members: DataFrame, alias: DataFrame) -> DataFrame:
    """``pid, member_id, place_id, match``: by one well-formed id that agrees with the code, by an alias of the code, by a
    unique country or province name that the first two rules found, else none."""
    d = parse_dguid(F.col("dguid"))
    code = bracket_code(F.col("code"))
    base = members.withColumn("d", d).withColumn("c", code)
    by_id = F.col("d").isNotNull() & ((F.col("c") == "") | (F.col("c") == F.col("d.geo_code")))
    first = base.join(alias, F.col("c") == F.col("alias_code"), "left").withColumn(
        "place_id", F.when(by_id, F.col("dguid")).when(F.col("alias_code").isNotNull(), F.concat_ws(":", F.lit("code"), "alias_schema", "alias_geo"))
    ).withColumn("match", F.when(by_id, "dguid").when(F.col("alias_code").isNotNull(), "code"))
    schema = F.coalesce(F.col("d.schema"), F.col("alias_schema"))
    named = first.where(F.col("place_id").isNotNull() & place_level(schema).isin("country", "province")).groupBy(F.lower("member_name").alias("name_key"))
    named = named.agg(F.collect_set("place_id").alias("ids")).where(F.size("ids") == 1).select("name_key", F.col("ids")[0].alias("name_place"))
    joined = first.join(named, F.lower("member_name") == F.col("name_key"), "left")
    return joined.select("pid", "member_id", "member_name", "parent_member_id", F.coalesce("place_id", "name_place").alias("place_id"), F.coalesce("match", F.when(F.col("name_place").isNotNull(), "name"), F.lit("none")).alias("match"))


def most_common(df: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, ties to the least; nulls don't count."""
    counted = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).count()
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias(value))


def place_names(mapped: DataFrame) -> DataFrame:
    return most_common(mapped, "place_id", "member_name")


def parent_candidates(mapped: DataFrame) -> DataFrame:
    """Each place with the places of its members' parents, itself left out."""
    up = mapped.select("pid", F.col("member_id").alias("parent_member_id"), F.col("place_id").alias("parent_place"))
    return mapped.join(up, ["pid", "parent_member_id"]).where("parent_place is not null and place_id is not null and parent_place <> place_id").select("place_id", "parent_place")


def place_parents(mapped: DataFrame) -> DataFrame:
    return most_common(parent_candidates(mapped), "place_id", "parent_place")


def parent_conflicts(mapped: DataFrame) -> DataFrame:
    several = parent_candidates(mapped).groupBy("place_id").agg(F.count_distinct("parent_place").alias("n")).where("n > 1")
    return several.agg(F.count("*").alias("conflicts"))


def match_counts(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("match").agg(F.count("*").alias("n"))


def place_levels(mapped: DataFrame) -> DataFrame:
    """Mapped and unmapped members of each table, and its distinct levels, an empty list where there are none."""
    level = place_level(parse_dguid(F.col("place_id"))["schema"])
    return mapped.groupBy("pid").agg(
        F.count_if(F.col("place_id").isNotNull()).alias("mapped"), F.count_if(F.col("place_id").isNull()).alias("unmapped"), F.array_join(F.array_sort(F.collect_set(level)), ",").alias("levels")
    )


def ancestors(members: DataFrame) -> DataFrame:
    """``pid, dimension_id, member_id, ancestor, distance``: each member with itself and all above it.

    Doubling joins: each round composes the paths found so far, so a tree of depth d takes log d rounds; loops end at
    MAX_DEPTH. Each round is stored, so that the next one reads it and no plan grows with the depth. A parent that isn't a
    member counts as none.
    """
    key = ["pid", "dimension_id"]
    known = members.select(*key, F.col("member_id").alias("parent_member_id"))
    step = members.join(known, [*key, "parent_member_id"], "left_semi").select(*key, "member_id", F.col("parent_member_id").alias("ancestor"))
    paths = members.select(*key, "member_id", F.col("member_id").alias("ancestor"), F.lit(0).alias("distance")).union(step.withColumn("distance", F.lit(1)))
    paths, reach = stored(paths, "ancestors"), 1
    while reach < MAX_DEPTH:
        low = paths.select(*key, "member_id", F.col("ancestor").alias("mid"), F.col("distance").alias("d1"))
        high = paths.select(*key, F.col("member_id").alias("mid"), "ancestor", F.col("distance").alias("d2"))
        longer = low.join(high, [*key, "mid"]).groupBy(*key, "member_id", "ancestor").agg(F.min(F.col("d1") + F.col("d2")).alias("distance"))
        before, paths = reach, stored(longer, "ancestors")
        reach *= 2
        if paths.where(F.col("distance") > before).isEmpty():
            break
    return paths


def member_depth(members: DataFrame) -> DataFrame:
    """Steps to the root of each member; an orphan is a root."""
    return ancestors(members).groupBy("pid", "dimension_id", "member_id").agg(F.max("distance").alias("depth"))


def descendants(members: DataFrame, start: DataFrame) -> DataFrame:
    """All below the members ``start`` (``pid, dimension_id, member_id``), the start left out."""
    own = start.select("pid", "dimension_id", F.col("member_id").alias("ancestor"))
    below = ancestors(members).where("distance > 0").join(own, ["pid", "dimension_id", "ancestor"], "left_semi")
    return below.select("pid", "dimension_id", "member_id").distinct().join(start, ["pid", "dimension_id", "member_id"], "left_anti")


def nearest_published(members: DataFrame, published: DataFrame) -> DataFrame:
    """For members without published values the nearest one above that has some, null where there is none."""
    bare = members.join(published, ["pid", "dimension_id", "member_id"], "left_anti").select("pid", "dimension_id", "member_id")
    up = ancestors(members).join(published.withColumnRenamed("member_id", "ancestor"), ["pid", "dimension_id", "ancestor"])
    best = up.groupBy("pid", "dimension_id", "member_id").agg(F.min_by("ancestor", "distance").alias("ancestor"))
    return bare.join(best, ["pid", "dimension_id", "member_id"], "left")


def group_coverage(regions: DataFrame, members: DataFrame) -> DataFrame:
    """How many of a region's codes a table has, and which it lacks."""
    tables = members.select("pid").distinct()
    wanted = regions.join(tables)  # regions are a short list
    have = members.select("pid", F.col("code"), F.lit(True).alias("there")).distinct()
    found = wanted.join(have, ["pid", "code"], "left").groupBy("pid", "region")
    return found.agg(F.count("*").alias("n_codes"), F.count("there").alias("n_present"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("code")))), ",").alias("missing"))


def place_search(places: DataFrame, query: str, most: int = 1000) -> DataFrame:
    """Places whose name holds every term, or whose id or code is the query: countries, provinces, then the rest, newest
    vintage first, with their position; at most ``most``, as a page has. Spark keeps only so many a task."""
    name = fold_accents(F.col("name"))
    every = F.lit(True)
    for term in query.lower().split():
        every &= name.contains(term)
    rank = F.when(F.col("level") == "country", 0).when(F.col("level") == "province", 1).otherwise(2)
    order = [rank, F.col("name"), F.col("vintage").desc_nulls_last(), F.col("place_id")]
    hit = places.where(every | (F.col("place_id") == query) | (F.col("geo_code") == query)).orderBy(*order).limit(most)
    return hit.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # one page


def place_table_counts(places: DataFrame, mapped: DataFrame) -> DataFrame:
    """Each place with the number of tables that map to it, 0 if none."""
    counted = mapped.where("place_id is not null").groupBy("place_id").agg(F.count_distinct("pid").alias("n"))
    return places.join(counted, "place_id", "left").select("place_id", F.coalesce("n", F.lit(0)).alias("n_tables"))


def mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Place names found in texts at word boundaries, with their first position."""
    forms = names.select("name", fold_accents(F.col("name")).alias("pattern"))
    met = contained(texts.select("text_id", fold_accents(F.col("text")).alias("text")), ["text_id"], forms).join(forms, "pattern")
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("pattern"), F.lit(r"\E(?![\p{L}\p{N}])"))
    return met.select("text_id", "name", F.regexp_instr("text", pattern).alias("at")).where("at > 0")


def table_place_join(series: DataFrame, mapped: DataFrame) -> DataFrame:
    """Observations or series with the place of their first dimension's member."""
    own = mapped.select("pid", F.col("member_id").alias("m1"), "place_id")
    return series.join(own, ["pid", "m1"], "left")
