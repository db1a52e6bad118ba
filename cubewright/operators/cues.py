"""What questions say of time, geography, places, transform, base and chart; and which tables can answer them.

A question becomes tokens and their kinds: a year, a month's name, a quarter, a number, or the word itself. Cues are rows
of a table, a phrase of kinds each; questions meet it on their runs of up to six tokens, and a gazetteer on their runs of
words, both in equi-joins. What the cues mean together is then read from each question's own short list of hits.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cubewright.sources.storage import handed_out, stored

LONGEST = 6
#: Months by their first letters. Fixed values.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
LONG_MONTHS = ("january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december")
TOKEN = r"[\p{L}\p{N}]+|[%=/]|(?<=[0-9])\s*[-–—]\s*(?=[0-9qQ])"


def phrases(*choices: str) -> list[str]:
    """Every phrase that takes one of the ``|``-parted choices after another; an empty choice is left out."""
    return [" ".join(w for w in combo if w) for combo in itertools.product(*[c.split("|") for c in choices])]


#: Phrases of each cue.
CUES: dict[str, list[str]] = {
    "base": phrases("index|index to|indexed|indexed to|rebase to|rebased to", "|<month>", "<year>"),
    "loose_base": phrases("relative to", "|<month>", "<year>"),
    "rate_word": ["percent", "percentage", "pct", "growth", "change", "difference", "%"],
    "index_word": ["indexed", "rebase", "rebased", "as an index", "as a index", "base 100", "= 100"],
    "year_is_100": ["<year> = 100"],
    "range": phrases("<year>", "-|to|through", "<year>"),
    "since": phrases("since|from|starting in|beginning in", "<year>"),
    "in_year": ["in <year>"],
    "year": ["<year>"],
    "past": ["past", "last"],
    "span": phrases("past|last", "<n>", "year|years|month|months"),
    "short_span": [*phrases("<n>", "y|yr|yrs"), "<n>y"],
    "recent_year": ["past year", "last year", "this year"],
    "latest": ["latest", "most recent", "current", "now", "today", "snapshot", "ranking", "rank"],
    "by_region": ["by region"],
    "both": phrases("province|provinces", "vs|versus|and", "territories"),
    "territories": ["territory", "territories"],
    "cities": phrases("by|across|each", "city|cities|cma|cmas|census metropolitan area|census metropolitan areas|census agglomeration|census agglomerations"),
    "provinces": ["province", "provinces", "provincial"],
    "across": ["across canada"],
    "index": ["indexed", "rebase", "rebased", "index to 100", "index first = 100", "index first 100"],
    "change": [*"inflation growth grow grew grown change increase increased yoy".split(), "rate of", "go up", "gone up", "went up", "y / y", "year over year", "annual change", "<n> month change", "% change"],
    "share": ["share", "composition"],
    "breakdown": ["share", "breakdown", "composition"],
    "pie": ["pie"],
    "table": ["as table", "as a table", "table view", "tabular"],
    "stacked_area": ["stacked area"],
    "stacked_bar": phrases("stacked", "bar|bars|column|columns"),
    "bar": ["bar", "column"],
    "area": ["area"],
    "line": ["line"],
    "horizontal": ["horizontal bar"],
    "column": ["column", "column chart"],
    "history": ["all time", "entire history", "full history", "history", "long run"],
    "over_time": ["over time"],
}
CHARTS = ("pie", "table", "stacked_area", "stacked_bar", "bar", "area", "line")
ROUND = (12, 24, 60, 120, 240)


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def tokens(text: Column) -> Column:
    """A text's words, numbers and the signs that cues use, as they stand."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.regexp_replace(F.trim(t), "[–—]", "-"))


def kinds(words: Column) -> Column:
    """What each token is, in lower case where it is a word."""
    def kind(t: Column) -> Column:
        low = F.lower(t)
        month = low.isin(*MONTHS, *LONG_MONTHS)
        return F.when(low.rlike(r"\A(19|20)[0-9]{2}\z"), "<year>").when(month, "<month>").when(low.rlike(r"\Aq[1-4]\z"), "<q>").when(low.rlike(r"\A[0-9]+\z"), "<n>").when(low.rlike(r"\A[0-9]+(y|yr|yrs)\z"), "<n>y").otherwise(low)

    return F.transform(words, kind)


def runs(words: Column, longest: int = LONGEST) -> Column:
    """``at, n, phrase`` of every run of up to ``longest`` tokens, counted from 1."""
    def of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("phrase")))

    return F.concat(*[of(n) for n in range(1, longest + 1)])


def place_hits(questions: DataFrame, places: DataFrame) -> DataFrame:
    """``question_id, places``: the places that a question names, each once, by the gazetteer's order.

    ``questions`` has ``question_id, words``; ``places`` has ``place, form, exact, position``: a form is met without case,
    or with it where it is an abbreviation (``exact``).
    """
    forms = places.select("place", "position", "exact", F.array_join(tokens(F.when(F.col("exact"), F.col("form")).otherwise(F.lower("form"))), " ").alias("phrase"))
    written = lambda exact, words: questions.select("question_id", F.lit(exact).alias("exact"), F.explode(runs(words)["phrase"]).alias("phrase"))
    met = written(True, F.col("words")).union(written(False, F.transform("words", F.lower))).join(forms, ["exact", "phrase"])
    once = met.groupBy("question_id", "place").agg(F.min("position").alias("position"))
    return once.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "place"))), lambda p: p["place"]).alias("places"))


def question_cues(questions: DataFrame, this_year: int, places: DataFrame | None = None) -> DataFrame:
    """``question_id, preset, from_year, to_year, months, geography, places, transform, index_base, chart, horizontal, latest,
    full_history, ranged`` of each question.

    Cues of time are read without the base's phrase. A range of years goes before a year to start from, that before one
    year, and this before spans back from now. ``geography`` is the kind asked for, ``listed`` where places are named, else
    ``one``; ``ranged`` says that a stretch of time was asked for. ``places`` is a gazetteer as in ``place_hits``. Null and
    empty questions say nothing. Each different text is read once, and questions meet what their text says.
    """
    asked = questions.select("question_id", F.coalesce("question", F.lit("")).alias("text"))
    texts = asked.select(F.col("text").alias("question_id"), F.col("text").alias("question")).distinct()
    found = stored(text_cues(texts, this_year, places), "text-cues")
    return asked.join(handed_out(found.withColumnRenamed("question_id", "text")), "text").select("question_id", *found.columns[1:])


def text_cues(questions: DataFrame, this_year: int, places: DataFrame | None = None) -> DataFrame:
    """``question_cues`` of each row of ``questions``, whose question_ids name a question."""
    spark = questions.sparkSession
    words = questions.select("question_id", tokens(F.coalesce("question", F.lit(""))).alias("words")).withColumn("kinds", kinds(F.col("words")))
    table = _rows(spark, [{"cue": c, "phrase": p} for c, ps in CUES.items() for p in ps], "cue: string, phrase: string")
    each = words.select("question_id", F.explode(runs(F.col("kinds"))).alias("r")).select("question_id", "r.*")
    hits = each.join(F.broadcast(table), "phrase")  # a few hundred rows, above
    held = hits.groupBy("question_id").agg(F.collect_list(F.struct("at", "n", "cue")).alias("hits"))
    rows = words.join(held, "question_id", "left").withColumn("hits", F.coalesce("hits", F.expr("array() :: array<struct<at: int, n: int, cue: string>>")))
    token = lambda i: F.lower(F.get("words", i - 1))
    kind = lambda i: F.get("kinds", i - 1)

    # the base: its first phrase, the longest there, and the part of the year that follows
    of = lambda name, cue: F.filter(name, lambda h: h["cue"] == cue)
    has = lambda cue: F.exists("hits", lambda h: h["cue"] == cue)
    bases = F.filter("hits", lambda h: h["cue"].isin("base", "loose_base"))
    rows = rows.withColumn("base", F.array_min(F.transform(bases, lambda h: F.struct(h["at"].alias("at"), (-h["n"]).alias("less"), h["cue"].alias("cue")))))
    rows = rows.withColumn("base_year", F.col("base.at") - F.col("base.less") - 1)
    y = F.col("base_year")
    two = lambda i, most: (kind(i) == "<n>") & token(i).rlike(r"\A[0-9]{2}\z") & token(i).cast("int").between(1, most)
    quarter = (kind(y + 1) == "-") & (kind(y + 2) == "<q>")
    monthly = (kind(y + 1) == "-") & two(y + 2, 12)
    daily = monthly & (kind(y + 3) == "-") & two(y + 4, 31)
    rows = rows.withColumn("base_more", F.when(quarter, 2).when(daily, 4).when(monthly, 2).otherwise(0))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(token(y - 1), 1, 3))
    more = F.when(kind(y - 1) == "<month>", F.concat(F.lit("-"), F.lpad(named.cast("string"), 2, "0"))).when(F.col("base_more") > 0, F.upper(F.array_join(F.slice("words", y + 1, F.col("base_more")), ""))).otherwise("")
    meant = (F.col("base.cue") == "base") | ~has("rate_word") | has("index_word")
    rows = rows.withColumn("index_base", F.when(F.col("base").isNotNull() & meant, F.concat(token(y), more)))

    # time, outside the base's phrase
    end = F.col("base_year") + F.col("base_more")
    hundred = F.transform(of("hits", "year_is_100"), lambda h: h["at"])
    outside = F.filter("hits", lambda h: F.col("base").isNull() | (((h["at"] > end) | (h["at"] + h["n"] <= F.col("base.at"))) & ~F.array_contains(hundred, h["at"])))
    rows = rows.withColumn("time", F.when(F.exists("hits", lambda h: h["cue"] == "year"), outside).otherwise(F.col("hits")))
    first = lambda cue: F.array_min(F.transform(of("time", cue), lambda h: F.struct(h["at"].alias("at"), h["n"].alias("n"))))
    for cue in ("range", "since", "in_year", "year", "span", "short_span"):
        rows = rows.withColumn(cue, first(cue))
    last = lambda cue: token(F.col(f"{cue}.at") + F.col(f"{cue}.n") - 1)
    alone = F.coalesce(last("in_year"), F.when(~has("past"), last("year")))
    ranged, since = F.col("range").isNotNull(), F.col("since").isNotNull()
    now = ~ranged & ~since & (alone == str(this_year))
    past = ~ranged & ~since & alone.isNotNull() & (alone != str(this_year))
    length = F.coalesce(
        token(F.col("span.at") + 1).try_cast("int") * F.when(last("span").startswith("month"), 1).otherwise(12),
        F.regexp_extract(token(F.col("short_span.at")), "[0-9]+", 0).try_cast("int") * 12,
    )
    free = ~ranged & ~since & alone.isNull()
    preset = F.when(now, "1Y").when(free & length.isin(*ROUND), F.concat((length / 12).cast("int").cast("string"), F.lit("Y"))).when(free & length.isNull() & has("recent_year"), "1Y").when(free & length.isNull() & has("latest"), "latest").otherwise("max")
    rows = rows.withColumn("preset", preset).withColumn("months", F.when(free & ~length.isin(*ROUND) & length.between(1, 1199), length))
    rows = rows.withColumn("from_year", F.when(ranged, token(F.col("range.at"))).when(since, last("since")).when(past, alone)).withColumn("to_year", F.when(ranged, last("range")).when(past, alone))

    named_places = place_hits(words, places) if places is not None else words.select("question_id", F.array().cast("array<string>").alias("places")).limit(0)
    rows = rows.join(named_places, "question_id", "left").withColumn("places", F.coalesce("places", F.array().cast("array<string>")))
    geography = F.when(has("by_region"), "regions").when(has("both"), "provinces_and_territories").when(has("territories") & (F.size("places") == 0), "territories").when(has("cities"), "cities").when(has("provinces"), "provinces")
    geography = geography.when(has("across"), "provinces_and_territories").when(F.size("places") > 0, "listed").otherwise("one")
    transform = F.when(F.col("index_base").isNotNull() | has("index"), "index_first").when(has("change"), "pct_change_yoy").when(has("share"), "share_of_x").otherwise("level")
    chart = F.coalesce(*[F.when(has(c), c) for c in CHARTS], F.when(has("breakdown"), "stacked_bar"))
    stretch = ranged | since | F.col("months").isNotNull() | (F.col("from_year").isNotNull() & F.col("to_year").isNull()) | F.col("preset").endswith("Y") | has("over_time") | has("history")
    return rows.select(
        "question_id", "preset", "from_year", "to_year", "months", geography.alias("geography"), "places", transform.alias("transform"), "index_base", chart.alias("chart"),
        F.when(has("horizontal"), True).when(has("column"), False).alias("horizontal"), has("latest").alias("latest"), has("history").alias("full_history"), stretch.alias("ranged"),
    )


def padded(text: Column) -> Column:
    """A text's tokens in lower case, with a blank before and after each."""
    return F.concat(F.lit(" "), F.array_join(F.transform(tokens(text), F.lower), " "), F.lit(" "))


def says(text: Column, phrases: list[str]) -> Column:
    """Whether a padded text of tokens has one of the phrases, at the words' ends."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(text, F.lit(f" {p} "))
    return found


#: Words of what is asked and of what a table must or must not say.
SALES = ["sale", "sales", "receipt", "receipts", "turnover", "revenue", "transaction", "transactions"]
SOLD = ["sales", "sold", "receipt", "receipts", "turnover", "revenue", "transaction", "transactions"]
PRICED = ["price", "prices", "index", "indexes", "indices"]
TAKINGS = ["sale", "sales", "receipt", "receipts", "revenue"]
RESOLD = ["resale", "resales", "resold", *phrases("existing", "home|homes|house|houses")]
HOMES = ["home", "homes", "house", "houses", "housing", "residential", "real estate", "property", "properties", "dwelling", "dwellings"]
EATING = ["restaurant", "restaurants", "food service", "food services", "eating place", "eating places", "dining out"]
RETAIL = [*phrases("average retail", "price|prices"), *phrases("retail", "price|prices", "in", "dollar|dollars"), *phrases("dollar", "price|prices")]
DEATHS = ["death", "deaths", "mortality"]
OFTEN = {"monthly": ["annual", "quarterly"], "quarterly": ["annual", "monthly"], "annual": ["monthly", "quarterly"], "annually": ["monthly", "quarterly"]}
#: What a question must find in a table's title or members if it asks for it.
THINGS = {"Gasoline": ["gas", "gasoline"], "Food": ["food"], "United States": ["united states", *phrases("to|with|from", "|the", "us|usa")]}


def table_fit(pairs: DataFrame, allow_missing: bool = False) -> DataFrame:
    """``question_id, pid, reasons``: why each table can't answer its question, none where it can.

    ``pairs`` has ``question_id, question, geography, places`` as ``question_cues`` gives them, and ``pid, title, family,
    unit_families, dimensions``, where a dimension has ``name, role, members`` and a member ``label, roles, place_id``. Each
    rule looks at the question's words and at the title, the nested members, the families of units or the places: a
    frequency that the title contradicts; sales, resales, restaurants, retail and dollar prices, litres and causes of death
    that the table does not have; kinds of places and named places that it lacks (with ``allow_missing``, only where it
    lacks all); two named places that are one member of a census table; and things that neither title nor members name.
    """
    rows = pairs.withColumn("__q", padded(F.col("question"))).withColumn("__t", padded(F.col("title")))
    rows = rows.withColumn("__m", F.flatten(F.transform("dimensions", lambda d: F.transform(d["members"], lambda m: F.struct(padded(m["label"]).alias("label"), F.coalesce(d["role"] == "measure", F.lit(False)).alias("measure"))))))
    geo = F.flatten(F.transform(F.filter("dimensions", lambda d: d["role"] == "geography"), lambda d: d["members"]))
    rows = rows.withColumn("__geo", F.transform(geo, lambda m: F.struct(m["roles"].alias("roles"), F.substring(m["place_id"], 6, 4).alias("level"), F.lower(F.trim(F.regexp_extract(m["label"], r"\A[^(,]*", 0))).alias("name"))))
    q, t = F.col("__q"), F.col("__t")
    ask = lambda *lists: F.lit(True) if not lists else says(q, lists[0]) & ask(*lists[1:])
    measure = lambda words, without=(): F.exists("__m", lambda m: m["measure"] & says(m["label"], words) & ~says(m["label"], list(without)))
    member = lambda words: F.exists("__m", lambda m: says(m["label"], words))
    role = lambda name: F.exists("__geo", lambda m: F.array_contains(m["roles"], name))
    level = lambda *codes: F.exists("__geo", lambda m: F.coalesce(m["level"].isin(*codes), F.lit(False)))
    census, names = F.col("family").eqNullSafe("census_2021"), F.transform("places", F.lower)
    known = F.transform("__geo", lambda m: m["name"])
    found = F.array_intersect(names, known)
    few = F.size("places").between(2, 3) & says(q, ["vs", "versus", "compared to", "compared with", "and"])
    frequency = F.lit(False)
    for word, others in OFTEN.items():
        frequency = frequency | (ask([word]) & says(t, others))
    rules = {
        "frequency": frequency,
        "sales": ask(SALES) & ~says(t, SOLD) & ~measure(SOLD, ("buyer", "buyers", "price", "prices")),
        "prices, not sales": ask(SALES) & says(t, PRICED) & ~says(t, TAKINGS),
        "resales": ask(RESOLD) & (~says(t, HOMES) | (~says(t, RESOLD) & ~measure(RESOLD))),
        "restaurants": ask(EATING, SALES) & ~says(t, ["food services and drinking places"]),
        "retail prices": ask(RETAIL) & ~says(t, phrases("average retail", "price|prices")),
        "dollars": (ask(["dollar", "dollars"]) | F.contains("question", F.lit("$"))) & ask(["price", "prices"]) & ~F.array_contains("unit_families", "currency"),
        "litres": ask(["sale", "sales", "volume", "volumes"], ["litre", "litres", "liter", "liters"]) & ~member(["sale", "sales", "volume", "volumes"]),
        "causes of death": ask(DEATHS, ["cause", "causes"]) & ~F.exists("dimensions", lambda d: says(padded(d["name"]), phrases("cause|causes", "of death"))),
        "provinces": F.col("geography").isin("provinces", "provinces_and_territories") & ~role("province"),
        "territories": F.col("geography").isin("territories", "provinces_and_territories") & ~role("territory"),
        "cities": census & (F.col("geography") == "cities") & ~level("0503", "0504"),
        "municipalities": census & ask(["census subdivision", "csd", "municipality", "municipalities"]) & ~level("0005"),
        "places": (F.size("places") > 0) & ((F.size(found) == 0) | (F.lit(not allow_missing) & (F.size(found) < F.size("places")))),
        "one member for two places": census & few & F.exists(found, lambda p: F.size(F.filter(names, lambda n: n == p)) > 1),
    }
    labels = F.transform("__m", lambda m: m["label"])
    for thing, words in THINGS.items():
        rules[thing] = ask(words) & ~says(t, [thing.lower()]) & ~F.array_contains(labels, f" {thing.lower()} ")
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))
    return rows.select("question_id", "pid", reasons.alias("reasons"))
