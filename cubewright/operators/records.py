"""Checks against the catalogue, table records, search over series and the parts of a view's result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.functions.text import strip_html, table_number

from .cues import MONTHS, padded, phrases, says
from .matching import contained
from .view import coverage_bounds, index_rebase, layer_dates, pct_change, window_bounds


def check_labels(rows: DataFrame, member: DataFrame) -> DataFrame:
    """``pid, exact, with_code, loose, wrong``: how labels agree with the catalogue's names.

    A label may be the name, the name and its code, or either once quotes and white space are removed.
    """
    known = member.select("pid", "member_id", "member_name", "code")
    bare = lambda c: F.regexp_replace(c, r'["\s]', "")
    full = F.concat_ws(" ", "member_name", "code")
    label = F.col("label")
    kind = F.when(label == F.col("member_name"), "exact").when(label == full, "with_code").when((bare(label) == bare(F.col("member_name"))) | (bare(label) == bare(full)), "loose").otherwise("wrong")
    counted = rows.join(known, ["pid", "member_id"], "left").withColumn("kind", kind)
    return counted.groupBy("pid").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("exact", "with_code", "loose", "wrong")])


def check_legend(obs: DataFrame, legend: DataFrame) -> DataFrame:
    """Marks that a table's own legend lacks."""
    used = obs.where("status <> ''").select("pid", "status").distinct()
    return used.join(legend, ["pid", "status"], "left_anti")


def table_kind(tables: DataFrame) -> DataFrame:
    """A time series where start and end differ, null-safe; the family by the id's prefix."""
    series = ~F.col("period_min").eqNullSafe(F.col("period_max"))
    return tables.select("pid", F.when(series, "time_series").otherwise("snapshot").alias("kind"), F.when(F.col("pid").startswith("98"), "census").otherwise("ordinary").alias("family"))


def order_check(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key isn't strictly above that of the row before them in their file, by table.

    ``rows`` has ``pid, part, row_index``, where ``part`` numbers a file's pieces in order, such as its byte ranges: rows
    are compared within a piece, and each piece's first key with the last one before it, one row a piece, so that a large
    file is never one window.
    """
    key = F.struct(*keys)
    own = Window.partitionBy("pid", "part").orderBy("row_index")
    inside = rows.withColumn("bad", F.coalesce(F.lag(key).over(own) >= key, F.lit(False))).groupBy("pid", "part").agg(
        F.count_if("bad").alias("n"), F.min_by(key, "row_index").alias("first"), F.max_by(key, "row_index").alias("last")
    )
    between = inside.withColumn("bad", F.coalesce(F.lag("last").over(Window.partitionBy("pid").orderBy("part")) >= F.col("first"), F.lit(False)))
    return between.groupBy("pid").agg((F.sum("n") + F.count_if("bad")).alias("n_bad"))


def corrections(own: DataFrame, inventory: DataFrame) -> DataFrame:
    """A table's corrections from its metadata and then from the inventory, in that order, without tags."""
    first = own.select("pid", F.lit(1).alias("source"), F.col("correction_date").alias("date"), strip_html(F.col("correction_note")).alias("text"))
    second = inventory.select("pid", F.lit(2).alias("source"), F.col("correction_date").alias("date"), strip_html(F.col("note_en")).alias("text"))
    return first.unionByName(second)


def place_detail(places: DataFrame, mapped: DataFrame, tables: DataFrame) -> DataFrame:
    """Each place with the tables that cover it, counted by subject."""
    rows = mapped.where("place_id is not null").select("place_id", "pid").distinct().join(tables, "pid")
    counted = rows.groupBy("place_id", "subject").agg(F.count_distinct("pid").alias("n"))
    lists = counted.groupBy("place_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "subject", F.col("n").cast("string")))), ",").alias("subjects"))
    return places.join(lists, "place_id", "left").select("place_id", "name", "subjects")


def territory_proxy(territories: DataFrame, cities: DataFrame) -> DataFrame:
    """For a territory its capital among the cities that have data, else its only city, else none."""
    counted = cities.groupBy("territory").agg(F.max(F.when(F.col("capital"), F.col("city"))).alias("capital"), F.count("*").alias("n"), F.min("city").alias("only"))
    proxy = F.coalesce("capital", F.when(F.col("n") == 1, F.col("only")))
    return territories.join(counted, "territory", "left").select("territory", proxy.alias("proxy"))


def published_sibling(members: DataFrame, published: DataFrame) -> DataFrame:
    """For members without published values the sibling of the same label, its including or excluding qualifier removed, that has some."""
    plain = F.trim(F.regexp_replace(F.lower("member_name"), r",?\s*\(?\b(?:including|excluding)\b.*$", ""))
    named = members.withColumn("plain", plain)
    key = ["pid", "dimension_id"]
    there = named.join(published, [*key, "member_id"], "left_semi").select(*key, "plain", F.col("member_id").alias("sibling"))
    bare = named.join(published, [*key, "member_id"], "left_anti")
    return bare.join(there, [*key, "plain"], "left").groupBy(*key, "member_id").agg(F.min("sibling").alias("sibling"))


def table_record(tables: DataFrame, stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Inventory, facts and the lower-cased search text of each table."""
    text = labels.groupBy("pid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "label"))), lambda x: x["label"]), " | ").alias("labels"))
    joined = tables.join(stats, "pid", "left").join(text, "pid", "left")
    return joined.withColumn("search_text", F.lower(F.concat_ws(" | ", "title", "labels"))).drop("labels")


def series_search(series: DataFrame, words: list[str], top: int, least: int = 2) -> DataFrame:
    """Series of which every word is in the title or a label, by phrase, title hits, published points and key."""
    hits = [F.lower("title").contains(w) for w in words]
    every = F.lit(True)
    for w, h in zip(words, hits, strict=True):
        every &= h | _in_labels(w)
    phrase = F.lower("title").contains(" ".join(words)).cast("int")
    count = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
    found = series.where(every & (F.col("n_published") >= least)).select("series_key", "title", "n_published", phrase.alias("phrase"), count.alias("title_hits"))
    return found.orderBy(F.desc("phrase"), F.desc("title_hits"), F.desc("n_published"), "series_key").limit(top)


def _in_labels(word: str) -> Column:
    return F.exists("labels", lambda x: F.lower(x).contains(word))


def bounded_candidates(ranked: DataFrame, tables: int, rows: int) -> DataFrame:
    """Ranked tables while at most ``tables`` of them hold at most ``rows`` rows, skipping those too big; a fold over each query's short list."""
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "n_rows"))).alias("l"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr("cast(array() as array<string>)").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        fits = (F.size(state["kept"]) < tables) & (state["used"] + x["n_rows"] <= rows)
        return F.when(fits, F.struct((state["used"] + x["n_rows"]).alias("used"), F.concat(state["kept"], F.array(x["pid"])).alias("kept"))).otherwise(state)

    folded = F.aggregate("l", start, step)
    return lists.select("query_id", F.explode(folded["kept"]).alias("pid"))


def pick_measure(questions: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """The one measure with most of a question's words, at least ``least``; none where two tie. They meet on their words."""
    tokens = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))).alias("word")
    both = questions.select("question_id", tokens("question")).join(members.select("member_id", tokens("member_name")), "word")
    scored = both.groupBy("question_id", "member_id").agg(F.count("*").alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("question_id", "score").agg(F.count("*").alias("n"), F.min("member_id").alias("member_id"))
    top = best.groupBy("question_id").agg(F.max(F.struct("score", "n", "member_id")).alias("b"))
    return top.where("b.n = 1").select("question_id", "b.member_id")


#: Measures of work by what is said of them, the first that a question says.
COUNTED = ["number", "count", "total", "people", "persons", "workers", "employees"]
WORK = [
    (("Employment", "Unemployment"), phrases("employment|unemployment", "vs|versus|and|compared to", "employment|unemployment")),
    (("Unemployment",), phrases("number|count|total|people|persons|workers", "|of", "|the", "unemployed|unemployment")),
    (("Unemployment rate",), ["unemployment", "jobless", "joblessness"]), (("Employment rate",), ["employment rate", "employed share"]),
    (("Participation rate",), ["participation"]), (("Employment",), ["employment", "employed", "job", "jobs"]),
]
WAGES, WAGE_RATE = ["wage", "wages"], "Average hourly wage rate"


def requested_measures(questions: DataFrame, members: DataFrame) -> DataFrame:
    """``question_id, member_id``: measures by the rules for wages and for work, else by ``pick_measure``."""
    q = padded(F.col("question"))
    rule = F.when(says(q, WAGES) & ~says(q, COUNTED), F.array(F.lit(WAGE_RATE)))
    for labels, said in WORK:
        rule = rule.when(says(q, said), F.array(*map(F.lit, labels)))
    ruled = questions.withColumn("labels", rule)
    named = ruled.where("labels is not null").select("question_id", F.explode("labels").alias("member_name")).join(members, "member_name").select("question_id", "member_id")
    return named.union(pick_measure(ruled.where("labels is null").select("question_id", "question"), members))


def region_groups(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Longest aliases named in each question that don't lie inside a longer one."""
    met = contained(questions.select("question_id", F.lower("question").alias("text")), ["question_id"], aliases, pattern="alias").withColumnRenamed("pattern", "alias")
    found = met.join(aliases, "alias").select("question_id", "region", "alias", F.instr("text", F.col("alias")).alias("at"))
    spans = found.withColumn("end", F.col("at") + F.length("alias"))
    reach = Window.partitionBy("question_id").orderBy("at", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("covered", F.max("end").over(reach)).where("covered is null or at >= covered").select("question_id", "region", "at")


def period_label(start: Column, grain: Column) -> Column:
    quarter = F.concat(F.lit("Q"), F.quarter(start).cast("string"), F.lit(" "), F.year(start).cast("string"))
    return F.when(grain == "year", F.date_format(start, "yyyy")).when(grain == "quarter", quarter).when(grain == "month", F.date_format(start, "MMM yyyy")).otherwise(F.date_format(start, "d MMM yyyy"))


#: Letters for the kinds of words that labels of a scale are made of; N is a number, Y a year, q a quarter, w any other word.
SHAPE = {
    "T": ["to", "-", "–", "—", "/"], "F": ["from"], "L": ["under", "below"], "M": ["less", "fewer", "more"], "O": ["over"], "U": ["up"], "B": ["older", "above", "higher"],
    "H": ["than"], "A": ["and", "or"], "+": ["+"], "P": ["%"], "E": ["top", "bottom"], "Q": [f"{q}{s}" for q in ("percentile", "decile", "quintile", "quartile", "tercile") for s in ("", "s")],
}
#: How a label of a scale begins: a range, an open start, an open end.
BEGINS = ["NTN", "FNTN", "NALN", "NLN", "LN", "MHN", "ON", "UTN", "N+", *[f"N{w}A{end}" for w in ("", "w", "ww") for end in "OMBU"]]
PERIODS = ["Y", "YTN", "YTY", "qY", "Yq", "mY"]


def label_shape(label: Column) -> Column:
    """A label as one letter for each number, word or sign, by ``SHAPE``; dollar signs are left out."""
    def letter(t: Column) -> Column:
        found = F.when(t.rlike("^[12][0-9]{3}$"), "Y").when(t.rlike("^[0-9]"), F.when(t.rlike("^[1-4]q$"), "q").otherwise("N")).when(t.rlike("^q[1-4]$"), "q")
        for kind, words in SHAPE.items():
            found = found.when(t.isin(*words), kind)
        return found.when(F.substring(t, 1, 3).isin(*MONTHS), "m").otherwise("w")  # after the words: a decile is no December

    parts = F.regexp_extract_all(F.lower(label), F.lit(r"[1-4]q\b|q[1-4]\b|[0-9][0-9,]*(?:\.[0-9]+)?|\p{L}+|[-–—/+%]"), F.lit(0))
    return F.array_join(F.transform(parts, letter), "")


def ordinal_dimensions(member: DataFrame) -> DataFrame:
    """Dimensions of two or more labels of which at least 70 % read as buckets of a scale: ranges and open ends of numbers,
    quantiles, tops and bottoms in percent, and periods."""
    label = F.trim(F.coalesce("member_name", F.lit("")))
    rows = member.where(label != "").select("pid", "dimension_id", label_shape(label).alias("shape"))
    plain = F.translate("shape", "YP", "N")  # a year is a number, and percent signs don't matter to ranges
    bucket = F.contains("shape", F.lit("Q")) | F.startswith("shape", F.lit("ENP")) | F.startswith("shape", F.lit("EYP")) | F.col("shape").isin(*PERIODS)
    for begin in BEGINS:
        bucket = bucket | F.startswith(plain, F.lit(begin))
    return rows.groupBy("pid", "dimension_id").agg(F.count("*").alias("n"), F.avg(bucket.cast("double")).alias("share")).select("pid", "dimension_id", ((F.col("n") >= 2) & (F.col("share") >= 0.7)).alias("ordinal"))


def parts_only(member: DataFrame) -> DataFrame:
    """A breakdown without its summary members, where two or more parts remain."""
    summary = F.lower("member_name").rlike(r"\b(?:median|average|mean|rate)\b|\(\$\)|\(%\)|^total\b")
    own = Window.partitionBy("pid", "dimension_id")
    flagged = member.withColumn("summary", summary).withColumn("parts", F.count_if(~summary).over(own))
    return flagged.where(~F.col("summary") | (F.col("parts") < 2)).select("pid", "dimension_id", "member_id", "member_name")


def point_status(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The status of a summed point: of a missing one its first missing source's mark, else the first mark there is."""
    order = F.struct("order")
    missing = F.min_by(F.when(F.col("value").isNull(), F.col("status")), F.when(F.col("value").isNull(), order))
    first = F.min_by(F.when(F.col("status") != "", F.col("status")), F.when(F.col("status") != "", order))
    return rows.groupBy(*keys).agg(F.when(F.count("value") < F.count("*"), missing).otherwise(F.coalesce(first, F.lit(""))).alias("status"))


def series_names(series: DataFrame) -> DataFrame:
    """The labels that differ, else the title; names that collide get the table's number."""
    name = F.when(F.col("varying") != "", F.col("varying")).otherwise(F.col("title"))
    own = Window.partitionBy("name")
    named = series.withColumn("name", name)
    return named.withColumn("n", F.count("*").over(own)).select("pid", "series_no", F.when(F.col("n") > 1, F.concat(F.col("name"), F.lit(" ("), table_number(F.col("pid")), F.lit(")"))).otherwise(F.col("name")).alias("name"))


def view_warnings(layers: DataFrame, most_series: int = 40) -> DataFrame:
    """``code`` rows for mixed families, frequencies and units, the cap, and no data."""
    facts = layers.agg(F.count_distinct("family").alias("f"), F.count_distinct("kind").alias("k"), F.count_distinct("unit").alias("u"), F.sum("n_series").alias("s"), F.sum("n_published").alias("p"))
    checks = [("mixed_families", F.col("f") > 1), ("mixed_frequencies", F.col("k") > 1), ("mixed_units", F.col("u") > 1), ("series_cap", F.col("s") > most_series), ("no_data", F.coalesce("p", F.lit(0)) == 0)]
    return facts.select(F.explode(F.array_compact(F.array(*[F.when(test, code) for code, test in checks]))).alias("code"))


def group_notes(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Each shown group with its method and its members' names in order."""
    names = members.groupBy("group_name").agg(F.array_join(F.array_sort(F.collect_list("member_name")), ", ").alias("members"))
    return groups.join(names, "group_name").select("group_name", F.concat(F.col("method"), F.lit(" of "), F.col("members")).alias("note"))


def citations(tables: DataFrame, build: str) -> DataFrame:
    return tables.select("pid", F.concat(F.lit("Table "), table_number(F.col("pid")), F.lit(", "), F.col("title"), F.lit(" (build "), F.lit(build), F.lit(")")).alias("citation"))


def suggest_views(roles: DataFrame) -> DataFrame:
    """Starter views by a table's dimension roles: a headline over time, a bar by place, components by category."""
    by = roles.groupBy("pid").agg(F.max((F.col("role") == "geography").cast("int")).alias("geo"), F.max((F.col("role") == "category").cast("int")).alias("cat"))
    views = F.array_compact(F.array(F.lit("headline"), F.when(F.col("geo") == 1, "by_place"), F.when(F.col("cat") == 1, "components")))
    each = by.select("pid", F.explode(views).alias("view"))
    kind = F.when(F.col("view") == "headline", "line").otherwise("bar")
    return each.select("pid", "view", F.to_json(F.struct(F.lit(1).alias("v"), F.col("pid").alias("pid"), kind.alias("chart"))).alias("spec"))


def run_view(obs: DataFrame, spec: dict) -> DataFrame:
    """``series, period_start, value, unpublished`` of a one-layer view: selection, window, transform, coverage, in one plan.

    ``spec`` has ``where`` (column to members), ``series`` (the columns that make one), ``transform``, and ``from``, ``to``,
    ``years`` or ``index_base``. History that a lookback needs is read and then trimmed.
    """
    chosen = obs
    for column, members in spec["where"].items():
        chosen = chosen.where(F.col(column).isin(*members))
    points = chosen.select(
        F.lit(1).alias("layer"), F.concat_ws(".", *[F.col(c).cast("string") for c in spec["series"]]).alias("series"),
        F.to_date(F.concat("ref_date", F.lit("-01"))).alias("period_start"), F.col("value_num").alias("value"), "status",
    )
    kind = spec.get("transform", "level")
    changes = kind.startswith("pct")
    if kind in ("pct_change_yoy", "pct_change_period"):
        made = pct_change(points, 12 if kind == "pct_change_yoy" else 1)
    elif kind == "index_first":
        made = index_rebase(points, spec.get("index_base"))
    else:
        made = points.select("layer", "series", "period_start", "value")
    shown = window_bounds(made, spec.get("years"), spec.get("from"), spec.get("to"), changes)
    grid = shown.select("layer", "series").distinct().join(layer_dates(shown).drop("position"), "layer")
    full = grid.join(shown, ["layer", "series", "period_start"], "left")
    bare = coverage_bounds(full).select("layer", "series", "unpublished")
    return full.join(bare, ["layer", "series"]).select("series", "period_start", "value", "unpublished")


def series_detail(series: DataFrame, points: DataFrame) -> DataFrame:
    """A series' record beside its points, and whether their number is the record's."""
    counted = points.groupBy("series_key").agg(F.count("*").alias("n_seen"), F.min("ref_date").alias("first"), F.max("ref_date").alias("last"))
    return series.join(counted, "series_key", "left").select("series_key", "n_obs", "first", "last", F.col("n_obs").eqNullSafe(F.col("n_seen")).alias("consistent"))


def candidate_semijoin(tables: DataFrame, series: DataFrame, least_periods: int) -> DataFrame:
    """Tables with a series of at least ``least_periods`` periods: the small side is reduced before series are read."""
    good = series.where(F.col("n_obs") >= least_periods).select("pid").distinct()
    return tables.join(good, "pid", "left_semi")


def member_sets(a: DataFrame, b: DataFrame, every: DataFrame) -> DataFrame:
    """``set, member_id`` of union, intersection and complement."""
    both = a.union(b).distinct()
    named = lambda df, name: df.select(F.lit(name).alias("set"), "member_id")
    return named(both, "union").union(named(a.intersect(b), "intersection")).union(named(every.exceptAll(both), "complement"))


def order_by_mention(questions: DataFrame, members: DataFrame) -> DataFrame:
    """Members named in each question, by first mention."""
    names = members.select("member_name", F.lower("member_name").alias("pattern"))
    met = contained(questions.select("question_id", F.lower("question").alias("text")), ["question_id"], names).join(names, "pattern")
    at = met.select("question_id", "member_name", F.instr("text", F.col("pattern")).alias("at"))
    return at.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "member_name"))), lambda x: x["member_name"]), ",").alias("members"))


def candidate_rank(sources: list[DataFrame], top: int) -> DataFrame:
    """Tables of several sources with their best score: three a title hit, one a member hit, one if curated."""
    whole = sources[0]
    for s in sources[1:]:
        whole = whole.unionByName(s)
    score = 3 * F.col("title_hits") + F.col("member_hits") + F.col("curated").cast("int")
    best = whole.withColumn("score", score).groupBy("question_id", "pid").agg(F.max("score").alias("score"))
    own = Window.partitionBy("question_id").orderBy(F.desc("score"), "pid")
    return best.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)


def read_observations(lines: DataFrame, header: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of a long file by the expected header, and the rows of another width. ``lines`` has ``pid, row_index, line``."""
    schema = ", ".join(f"`{h}` string" for h in header)
    width = F.size(F.split("line", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", -1))
    rows = lines.where("row_index > 1").withColumn("width", width)
    good = rows.where(F.col("width") == len(header))
    cells = good.select("pid", (F.col("row_index") - 1).alias("row_index"), F.from_csv("line", schema, {"escape": '"', "nullValue": "\0"}).alias("c"))
    blank = [F.coalesce(F.col(f"c.`{h}`"), F.lit("")).alias(h.lower()) for h in header]
    return cells.select("pid", "row_index", *blank), rows.where(F.col("width") != len(header)).select("pid", "row_index", "width")
