"""Records of tables and places with all that belongs to them, and checks and samples over the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.functions.text import fold_accents, parse_dguid, table_number

from .matching import contained
from .search import stable_rank


def label_codes(df: DataFrame, sets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with ``<column>_label`` of each of ``columns`` (column to code set), null where the set lacks the code.

    ``sets`` has ``set, code, en, representation``. Statuses and symbols are printed marks, so they are looked up by
    representation; the mark x is a level of the set ``security``.
    """
    out = df
    for column, name in columns.items():
        marks = name in ("status", "symbol")
        own = sets.where(F.col("set") == name).select((F.col("representation") if marks else F.col("code")).alias(column), F.col("en").alias(f"{column}_label"))
        if marks:
            own = own.where(F.col(column) != "x").union(sets.where("set = 'security' and representation = 'x'").select("representation", "en"))
        out = out.join(own.where(F.col(column).isNotNull()).dropDuplicates([column]), column, "left")
    return out


def code_counts(used: DataFrame, family: DataFrame) -> DataFrame:
    """``family, n_codes, missing``: distinct used codes of each family of units; those without a family under ``none``."""
    joined = used.select("uom_id").distinct().join(family.select(F.col("uom_code").alias("uom_id"), "family"), "uom_id", "left")
    lost = F.col("family").isNull()
    return joined.groupBy(F.coalesce("family", F.lit("none")).alias("family")).agg(F.count("*").alias("n_codes"), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(lost, F.col("uom_id")))), lambda x: x.cast("string")), ",").alias("missing"))


def profiles(obs: DataFrame, columns: tuple[str, ...] = ("status", "symbol", "terminated")) -> DataFrame:
    """``pid, column, mark, n, n_blank``: histograms of the marks of each column, and how many values are blank under each."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit("")).alias("mark")) for c in columns]))
    return obs.select("pid", "value", each.alias("m")).groupBy("pid", "m.column", "m.mark").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("n_blank"))


def limits(points: DataFrame, series: DataFrame, categories: DataFrame, sizes: list[DataFrame], most: tuple[int, int, int, int] = (200_000, 50, 500, 200_000)) -> DataFrame:
    """``limit, refused``: more points, series, categories of a census table or coordinates than a view may have.

    Each is found without counting further than its limit; coordinates are the product of the selections' sizes.
    """
    over = lambda df, n, name: df.limit(n + 1).agg((F.count("*") > n).alias("refused")).select(F.lit(name).alias("limit"), "refused")
    product = reduce(lambda a, b: a.crossJoin(b).select((F.col("n") * F.col("m")).alias("n")), [s.agg(F.count("*").cast("double").alias("n" if i == 0 else "m")) for i, s in enumerate(sizes)])  # one row each
    return over(points, most[0], "points").union(over(series, most[1], "series")).union(over(categories, most[2], "categories")).union(product.select(F.lit("coordinates"), F.col("n") > most[3]))


def place_records(places: DataFrame, parents: DataFrame, mapped: DataFrame, tables: DataFrame, series: DataFrame) -> DataFrame:
    """A record a place: all vintages of its schema and code, its parent, the tables that cover it by first subject, and
    how many series they have there."""
    d = parse_dguid(F.col("place_id"))
    keyed = places.withColumn("d", d)
    vintages = keyed.where("d is not null").groupBy("d.schema", "d.geo_code").agg(F.array_join(F.array_sort(F.collect_set(F.col("d.vintage").cast("string"))), ",").alias("vintages"))
    covered = mapped.where("place_id is not null").select("place_id", "pid").distinct().join(tables, "pid")
    counted = covered.groupBy("place_id", "subject").agg(F.count("*").alias("n"))
    subjects = counted.groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "subject", F.col("n").cast("string")))), ",").alias("subjects"))
    n = series.where("place_id is not null").groupBy("place_id").agg(F.count("*").alias("n_series"))
    rows = keyed.join(vintages, (F.col("d.schema") == F.col("schema")) & (F.col("d.geo_code") == F.col("geo_code")), "left").join(parents, "place_id", "left").join(subjects, "place_id", "left").join(n, "place_id", "left")
    return rows.select("place_id", "name", "vintages", F.col("parent_place").alias("parent"), "subjects", F.coalesce("n_series", F.lit(0)).alias("n_series"))


def table_records(tables: DataFrame, parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One record a table with its lists as JSON: for each name a frame, the column that orders it, and its text."""
    out = tables
    for name, (frame, order, text) in parts.items():
        lists = frame.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("order"), F.col(text).alias("text")))), lambda x: x["text"]).alias(name))
        out = out.join(lists, "pid", "left").withColumn(name, F.to_json(F.coalesce(name, F.expr("cast(array() as array<string>)"))))
    return out


def reconcile_queryable(inventory: DataFrame, captured: DataFrame, built: DataFrame, queryable: DataFrame, failures: DataFrame) -> DataFrame:
    """Tables by family along the chain from inventory to queryable, and the gaps: how many, their attempts, and the
    reasons of their last failures."""
    flag = lambda df, name: df.select("pid").distinct().withColumn(name, F.lit(1))
    last = failures.groupBy("pid").agg(F.max_by("reason", "attempt").alias("reason"), F.count("*").alias("attempts"))
    rows = inventory
    for df, name in ((captured, "captured"), (built, "built"), (queryable, "queryable")):
        rows = rows.join(flag(df, name), "pid", "left")
    gap = F.col("queryable").isNull()
    return rows.join(last, "pid", "left").groupBy("family").agg(
        F.count("*").alias("inventory"), *[F.count(c).alias(c) for c in ("captured", "built", "queryable")], F.count_if(gap).alias("gaps"),
        F.coalesce(F.sum(F.when(gap, F.col("attempts"))), F.lit(0)).alias("attempts"), F.array_join(F.array_sort(F.collect_set(F.when(gap, F.col("reason")))), ",").alias("reasons"),
    )


def single_ids(ids: DataFrame) -> DataFrame:
    """``pid, member_id, dguid``: the id of members that have exactly one well-formed one among all that rows give them."""
    good = F.when(parse_dguid(F.col("dguid")).isNotNull(), F.col("dguid"))
    found = ids.groupBy("pid", "member_id").agg(F.collect_set(good).alias("ids"))
    return found.select("pid", "member_id", F.when(F.size("ids") == 1, F.get("ids", F.lit(0))).alias("dguid"))


def city_proxies(territories: DataFrame, cities: DataFrame, capitals: dict[str, str]) -> DataFrame:
    """For a territory's code its capital among the cities that have data, else its only city, else none.

    A city's territory is the first two digits of its place id's code.
    """
    code = F.substring(parse_dguid(F.col("place_id"))["geo_code"], 1, 2)
    rows = cities.withColumn("code", code).withColumn("is_capital", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in capitals.items() for x in kv]), F.col("code")) == F.col("city"), F.lit(False)))
    counted = rows.groupBy("code").agg(F.min(F.when(F.col("is_capital"), F.col("city"))).alias("capital"), F.count("*").alias("n"), F.min("city").alias("only"))
    return territories.join(counted, "code", "left").select("code", F.coalesce("capital", F.when(F.col("n") == 1, F.col("only"))).alias("proxy"))


def place_mentions(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Places named in texts, whole or by a part between hyphens, at word boundaries and without accents: by position,
    longer ones first. A part counts where it has four letters or more."""
    parts = F.filter(F.split("name", r"\s*[-–]\s*"), lambda p: F.length(p) >= 4)
    written = names.select("name", F.explode(F.array_distinct(F.concat(F.array("name"), parts))).alias("form")).withColumn("form", fold_accents(F.col("form")))
    folded = texts.select("text_id", fold_accents(F.col("text")).alias("text"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("form"), F.lit(r"\E(?![\p{L}\p{N}])"))
    met = contained(folded, ["text_id"], written, pattern="form").withColumnRenamed("pattern", "form").join(written, "form").withColumn("at", F.regexp_instr("text", pattern)).where("at > 0")
    return met.groupBy("text_id", "name").agg(F.min(F.struct("at", (-F.length("form")).alias("short"))).alias("m")).select("text_id", "name", "m.at", (-F.col("m.short")).alias("length"))


def cohort(df: DataFrame, key: str, categories: dict[str, tuple[Column, list[Column]]], seed: str, size: int, top: int = 3) -> DataFrame:
    """Edge cases and a hash-ordered rest: the first ``top`` rows of each category (a test and an order, ties by hash), each
    row once with its labels, filled by hash to ``size``."""
    rank = stable_rank(seed, F.col(key))
    edges = reduce(DataFrame.union, [df.where(test).orderBy(*order, rank, key).limit(top).select(key, F.lit(name).alias("label")) for name, (test, order) in categories.items()])
    chosen = edges.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    rest = df.select(key).distinct().join(chosen, key, "left_anti").orderBy(rank, key).limit(size).select(key, F.lit("").alias("labels"))
    own = Window.orderBy(F.col("labels") == "", rank, key)  # at most size and the edges
    return chosen.union(rest).withColumn("n", F.row_number().over(own)).where((F.col("n") <= size) | (F.col("labels") != "")).drop("n")


def series_points(series: DataFrame, points: DataFrame) -> DataFrame:
    """A series' record with its points as ``date=value`` in order, and whether their number is the record's."""
    text = F.concat_ws("=", "ref_date", F.coalesce("value", F.lit("")))
    listed = points.groupBy("series_key").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("points"), F.count("*").alias("n_seen"))
    return series.join(listed, "series_key", "left").select("series_key", "n_obs", "points", F.col("n_obs").eqNullSafe(F.col("n_seen")).alias("consistent"))


def table_list(tables: DataFrame, stats: DataFrame, key: str = "pid") -> DataFrame:
    """Queryable tables with number, bounds, family and families of units. ``key`` names a table in both frames, where its
    published id may be another's too."""
    family = F.when(F.col("pid").startswith("98"), "census").otherwise("ordinary")
    return tables.where("queryable").join(stats, key, "left").select("pid", table_number(F.col("pid")).alias("number"), "title", family.alias("family"), "period_min", "period_max", "families")


def plan_scores(results: DataFrame) -> DataFrame:
    """By split: questions, how many have the right status, table and behaviour, and nearest-rank latencies."""
    right = [F.avg(F.col(f"{c}_ok").cast("double")).alias(c) for c in ("status", "table", "behaviour")]
    return results.groupBy("split").agg(F.count("*").alias("n"), *right, *[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY latency)").alias(f"p{p}") for p in (50, 95, 99)])


def source_rank(sources: list[DataFrame], tables: DataFrame, terms: DataFrame, current_year: int, top: int) -> DataFrame:
    """Candidate tables of each question over several sources, best first: curated and semantic ones, then by score.

    A score is three for each title hit, one for each member hit, two for each of the question's words in the title, two
    for a current table and one for one with periods; a table counts once, with its best. Tables are active where they
    are current and their periods reach the last three years, and come before the others.
    """
    whole = reduce(DataFrame.unionByName, sources).join(tables, "pid")
    word_hits = terms.join(whole.select("question_id", "pid", F.lower("title").alias("low")).distinct(), "question_id").where(F.col("low").contains(F.col("word"))).groupBy("question_id", "pid").agg(F.count("*").alias("words"))
    rows = whole.join(word_hits, ["question_id", "pid"], "left")
    score = 3 * F.col("title_hits") + F.col("member_hits") + 2 * F.coalesce("words", F.lit(0)) + F.when(F.col("current"), 2).otherwise(0) + F.when(F.col("period_max").isNotNull(), 1).otherwise(0)
    best = rows.groupBy("question_id", "pid").agg(F.max(score).alias("score"), F.max(F.col("preferred").cast("int")).alias("preferred"), F.max((F.col("current") & (F.year("period_max") >= current_year - 3)).cast("int")).alias("active"))
    own = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("active"), F.desc("preferred"), F.desc("score"), "pid")
    return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top).select("question_id", "pid", "score", "rank")


def find_series(series: DataFrame, tables: DataFrame, words: list[str], vectors: list[str], filters: dict[str, str], top: int, least: int = 2) -> DataFrame:
    """Series with at least ``least`` published points that have every word in their table's title or in a label, every
    vector, and the given place, table or unit family; by phrase, a title's word, points, recency, not terminated, key.

    Tables are cut down first: queryable, two periods or more, and every word somewhere in their search text.
    """
    low = F.lower("search_text")
    known = reduce(DataFrame.where, [low.contains(w) for w in words], tables.where("queryable and n_periods >= 2"))
    if "pid" in filters:
        known = known.where(F.col("pid") == filters["pid"])
    title = F.lower("title")
    phrase, hits = title.contains(" ".join(words)) if words else F.lit(False), [title.contains(w) for w in words]
    known = known.select("pid", phrase.alias("phrase"), *[h.alias(f"w{i}") for i, h in enumerate(hits)])
    rows = series.where(F.col("n_published") >= least)
    for v in vectors:
        rows = rows.where(F.col("vector") == v)
    for column, value in filters.items():
        rows = rows.where(F.col(column) == value)
    rows = rows.join(known, "pid")
    labelled = lambda word: F.exists("labels", lambda x: F.lower(x).contains(word))
    for i, w in enumerate(words):
        rows = rows.where(F.col(f"w{i}") | labelled(w))
    any_title = reduce(Column.__or__, [F.col(f"w{i}") for i in range(len(words))], F.lit(False))
    found = rows.withColumn("in_title", any_title).orderBy(F.desc("phrase"), F.desc("in_title"), F.desc("n_published"), F.desc("period_max"), "terminated", "pid", "series_key").limit(top)
    return found.select("pid", "series_key", "phrase", "in_title", "n_published")


def slice_series(obs: DataFrame, labels: DataFrame, dimensions: int) -> DataFrame:
    """``pid, coordinate, name, kind, n_points, n_published, points``: each coordinate with a name from the labels that
    differ within its table, its kind of period, other where it has several, and its points as ``date=value``.

    ``obs`` has ``m1.., ref_date, value, period_kind``; ``labels`` ``pid, dimension_id, member_id, member_name``.
    """
    rows = obs
    for k in range(1, dimensions + 1):
        own = labels.where(F.col("dimension_id") == k).select("pid", F.col("member_id").alias(f"m{k}"), F.col("member_name").alias(f"label_{k}"))
        rows = rows.join(own, ["pid", f"m{k}"], "left")
    text = F.concat_ws("=", "ref_date", "value")
    each = rows.groupBy("pid", *[f"m{k}" for k in range(1, dimensions + 1)], *[f"label_{k}" for k in range(1, dimensions + 1)]).agg(
        F.count("*").alias("n_points"), F.count_if(F.col("value") != "").alias("n_published"),
        F.when(F.min("period_kind") == F.max("period_kind"), F.min("period_kind")).otherwise("other").alias("kind"), F.array_join(F.array_sort(F.collect_list(text)), ",").alias("points"),
    )
    varies = each.groupBy("pid").agg(*[(F.count_distinct(f"m{k}") > 1).alias(f"v{k}") for k in range(1, dimensions + 1)])
    name = F.concat_ws(" · ", *[F.when(F.col(f"v{k}"), F.col(f"label_{k}")) for k in range(1, dimensions + 1)])
    return each.join(varies, "pid").select("pid", F.concat_ws(".", *[F.col(f"m{k}").cast("string") for k in range(1, dimensions + 1)]).alias("coordinate"), name.alias("name"), "kind", "n_points", "n_published", "points")


def asked_regions(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """``question_id, region, at``: regions that a question names by their longest aliases, each once, without those inside a
    longer one; all regions where it says "by region"; and none where a comparison names just one.

    ``questions`` has ``question_id, question, compares``. Aliases and questions meet on the alias's first word.
    """
    text = F.lower("question")
    tokens = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    every = questions.where(text.rlike(r"\bby region\b")).select("question_id").crossJoin(aliases.select("region").distinct()).select("question_id", "region", F.lit(0).alias("at"))  # a question's own list of all regions
    rows = questions.where(~text.rlike(r"\bby region\b")).select("question_id", "compares", text.alias("t"), F.explode(tokens).alias("word"))
    named = aliases.withColumn("word", F.regexp_extract(F.lower("alias"), r"[\p{L}\p{N}]+", 0)).withColumn("alias", F.lower("alias"))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("alias"), F.lit(r"\E(?![\p{L}\p{N}])"))
    met = rows.join(named, "word").withColumn("at", F.regexp_instr("t", pattern)).where("at > 0").withColumn("end", F.col("at") + F.length("alias"))
    reach = Window.partitionBy("question_id").orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = met.withColumn("covered", F.max("end").over(reach)).where("covered is null or at >= covered")
    once = outer.groupBy("question_id", "compares", "region").agg(F.min("at").alias("at"))
    counted = once.withColumn("n", F.count("*").over(Window.partitionBy("question_id"))).where("not compares or n > 1")
    return counted.select("question_id", "region", F.col("at").cast("int").alias("at")).union(every)


def starter_views(dimensions: DataFrame) -> DataFrame:
    """``pid, view, spec``: starter views of each table by its dimensions' roles, as resolved specifications in JSON.

    ``dimensions`` has ``pid, dimension_id, role, default_member, provinces, parts`` (how many provinces and parts it has):
    a headline line of the defaults over the longest time; a line by province where there are two or more; components where
    a category has two parts or more, and the latest of them as a bar.
    """
    own = F.struct("dimension_id", "role", "default_member", "provinces", "parts")
    tables = dimensions.groupBy("pid").agg(F.array_sort(F.collect_list(own)).alias("d"))
    fixed = lambda d: F.struct(F.lit("fixed").alias("use"), F.struct(d["default_member"].cast("string").alias("eq"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("boolean").alias("all")).alias("members"))
    by = lambda use, role: F.struct(F.lit(use).alias("use"), F.struct(F.lit(None).cast("string").alias("eq"), F.lit(role).cast("string").alias("role"), F.when(F.lit(role is None), True).alias("all")).alias("members"))

    def spec(chosen: Column | None, use: str, role: str | None, preset: str, chart: str) -> Column:
        one = lambda d: F.when(d["dimension_id"] == chosen, by(use, role)).otherwise(fixed(d)) if chosen is not None else fixed(d)
        dims = F.map_from_arrays(F.transform("d", lambda d: d["dimension_id"].cast("string")), F.transform("d", one))
        return F.to_json(F.struct(F.lit(1).alias("v"), F.array(F.struct("pid", dims.alias("dims"))).alias("layers"), F.struct(F.lit(preset).alias("preset")).alias("time"), F.lit("level").alias("transform"), F.struct(F.lit(chart).alias("type")).alias("chart")))

    places = F.get(F.filter("d", lambda d: (d["role"] == "geography") & (d["provinces"] >= 2)), F.lit(0))["dimension_id"]
    category = F.get(F.filter("d", lambda d: (d["role"] == "category") & (d["parts"] >= 2)), F.lit(0))["dimension_id"]
    rows = tables.withColumn("place", places).withColumn("category", category)
    views = [
        ("headline", F.lit(True), spec(None, "", None, "max", "line")), ("by_province", F.col("place").isNotNull(), spec(F.col("place"), "series", "province", "max", "line")),
        ("components", F.col("category").isNotNull(), spec(F.col("category"), "series", "leaf", "max", "line")), ("latest", F.col("category").isNotNull(), spec(F.col("category"), "x", "leaf", "latest", "bar")),
    ]
    each = F.explode(F.array_compact(F.array(*[F.when(test, F.struct(F.lit(name).alias("view"), made.alias("spec"))) for name, test, made in views])))
    return rows.select("pid", each.alias("v")).select("pid", "v.*")
