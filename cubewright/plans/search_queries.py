"""Queries of search, retrieval, sampling and question cues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubewright.functions import text
from cubewright.operators import cues, search

from .cubes import tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add

RECORD = "SELECT CAST(doc_id AS VARCHAR) AS pid, 'c' || CAST(doc_id % 97 AS VARCHAR) AS cansim_id, doc_id % 2 = 0 AS queryable, substr(split_part(text, chr(10), 1), 1, 80) AS title, coalesce(source, '') || ' ' || coalesce(lang, '') AS dimensions, text AS members, CASE WHEN doc_id % 3 = 0 THEN 'Note on license ' || coalesce(source, '') ELSE '' END AS notes FROM documents WHERE text IS NOT NULL"
QUESTIONS = ["the and", "la que", "license version", "zzz", "Der %", "e_t", "SRC1 en", "c13", "17 the"]
ASKED = ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS))


def records(spark, sf_dir):
    docs = tables(spark, sf_dir)["documents"].where("text is not null")
    source, lang = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("string").alias("pid"), F.concat(F.lit("c"), (F.col("doc_id") % 97).cast("string")).alias("cansim_id"), (F.col("doc_id") % 2 == 0).alias("queryable"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), F.concat_ws(" ", source, lang).alias("dimensions"), F.col("text").alias("members"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Note on license "), source)).otherwise("").alias("notes"), "text",
    )


def asked(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "query_id int, query string")


@add(f"""
WITH r AS ({RECORD}), q AS (SELECT query_id, unnest(string_split(lower(query), ' ')) AS term FROM (VALUES {ASKED}) q(query_id, query)),
h AS (SELECT query_id, pid, title, queryable, contains(lower(title), term) AS t, contains(lower(dimensions), term) AS d, contains(lower(members), term) AS m, contains(lower(notes), term) AS n, pid = term OR cansim_id = term AS i FROM r, q),
s AS (SELECT query_id, pid, title, queryable, CAST(count(*) FILTER (WHERE t) AS BIGINT) AS title_hits, CAST(count(*) FILTER (WHERE d) AS BIGINT) AS dimensions_hits, CAST(count(*) FILTER (WHERE m) AS BIGINT) AS members_hits, CAST(count(*) FILTER (WHERE n) AS BIGINT) AS notes_hits FROM h GROUP BY 1, 2, 3, 4 HAVING bool_and(t OR d OR m OR n OR i))
SELECT query_id, pid, title, title_hits, dimensions_hits, members_hits, notes_hits, dimensions_hits + members_hits + notes_hits AS text_hits,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY title_hits DESC, queryable DESC, dimensions_hits + members_hits + notes_hits DESC, title, pid) AS INT) AS rank FROM s
""")
def table_search(spark, sf_dir):
    return search.table_search(records(spark, sf_dir), asked(spark))


@add(f"""
WITH r AS (SELECT pid, list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+')) AS t, list_distinct(regexp_extract_all(lower(members), '[a-z0-9]+')) AS x FROM ({RECORD})), q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS w FROM (VALUES {ASKED}) q(query_id, query)),
s AS (SELECT query_id, pid, CAST(4 * len(list_intersect(t, w)) + len(list_intersect(x, w)) AS INT) AS score FROM r, q)
SELECT query_id, pid, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pid) AS rank FROM s WHERE score > 0) WHERE rank <= 20
""")
def lexical_rank(spark, sf_dir):
    return search.ranked(search.lexical_scores(records(spark, sf_dir), asked(spark)), ["query_id"], [F.desc("score"), F.col("pid")], 20)


#: Every vector whose id is divisible by 20 against all others, ranked by cosine and by dot product.
NEAREST = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id, e.label, list_dot_product(q.v, e.v) AS dot, sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)) AS size FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, round(CASE WHEN size > 0 THEN dot / size ELSE 0 END, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN size > 0 THEN dot / size ELSE 0 END, 9) DESC, vec_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY round(dot, 9) DESC, vec_id) AS dot_rank FROM p)
"""


def nearest(spark, sf_dir, top, metric="cosine"):
    e = tables(spark, sf_dir)["embeddings"]
    return search.vector_topk(e, e.where("vec_id % 20 = 0"), top, metric)


@add(NEAREST + "SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20")
def cosine_topk(spark, sf_dir):
    return nearest(spark, sf_dir, 20).withColumn("score", F.round("score", 6))


@add(NEAREST + ", f AS (SELECT query_id, vec_id AS id, 1.0 / (60 + rank) AS part FROM r WHERE rank <= 50 UNION ALL SELECT query_id, vec_id, 0.5 / (60 + dot_rank) FROM r WHERE dot_rank <= 50) SELECT query_id, id, round(sum(part), 9) AS score FROM f GROUP BY 1, 2")
def rrf_fuse(spark, sf_dir):
    ranking = lambda metric: nearest(spark, sf_dir, 50, metric).select("query_id", F.col("vec_id").alias("id"), "rank")
    return search.rrf_fuse([(ranking("cosine"), 1.0), (ranking("dot"), 0.5)]).withColumn("score", F.round("score", 9))


@add(NEAREST + ", h AS (SELECT query_id, min(rank) AS rank FROM r WHERE rank <= 100 AND ql = label GROUP BY 1), a AS (SELECT DISTINCT query_id FROM p WHERE ql = label) SELECT count(*) AS n_queries, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END) AS r1, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END) AS r5, avg(CASE WHEN rank <= 12 THEN 1.0 ELSE 0 END) AS r12, avg(CASE WHEN rank <= 100 THEN 1.0 ELSE 0 END) AS r100, round(avg(coalesce(1.0 / rank, 0)), 9) AS mrr FROM a LEFT JOIN h USING (query_id)")
def retrieval_eval(spark, sf_dir):
    """Each query's own label is what it should find; the ranking's rows get their labels, so no list of all relevant rows is made."""
    e = tables(spark, sf_dir)["embeddings"].select("vec_id", "label")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    several = e.groupBy("label").agg(F.count("*").alias("n")).where("n > 1 and label is not null").select(F.col("label").alias("own"))
    ranking = nearest(spark, sf_dir, 100).join(e, "vec_id").join(queries, "query_id").withColumn("relevant", F.coalesce(F.col("label") == F.col("own"), F.lit(False)))
    return search.retrieval_eval(ranking, queries.join(several, "own", "left_semi").select("query_id")).withColumn("mrr", F.round("mrr", 9))


@add("SELECT doc_id, sha256(text) AS hash, CASE WHEN doc_id % 3 <> 0 THEN 'missing' WHEN doc_id % 6 = 0 THEN 'content' WHEN doc_id % 9 = 0 THEN 'model' ELSE 'dimensions' END AS why FROM documents WHERE text IS NOT NULL AND (doc_id % 3 <> 0 OR doc_id % 6 = 0 OR doc_id % 9 = 0 OR doc_id % 5 = 0)")
def stale_documents(spark, sf_dir):
    docs = tables(spark, sf_dir)["documents"].where("text is not null")
    index = docs.where("doc_id % 3 = 0").select(
        "doc_id", text.content_hash(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("old"))).otherwise(F.col("text"))).alias("hash"),
        F.when(F.col("doc_id") % 9 == 0, "small").otherwise("large").alias("model"), F.when(F.col("doc_id") % 5 == 0, 256).otherwise(512).alias("dimensions"),
    )
    return search.stale_documents(docs, index, "large", 512)


@add("SELECT l_orderkey AS query_id, l_linenumber AS id, l_discount * 10 AS score FROM lineitem WHERE false UNION ALL SELECT * FROM (WITH s AS (SELECT l_orderkey AS query_id, l_linenumber AS id, max(l_discount * 10) AS score FROM lineitem GROUP BY 1, 2), k AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top, row_number() OVER w AS n, coalesce(lag(score) OVER w - score >= 0.15, false) AS cut FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, id)), x AS (SELECT *, bool_or(cut) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after FROM k) SELECT query_id, id, score FROM x WHERE score >= 0.52 AND top - score <= 0.27 AND n <= 12 AND NOT after)")
def cluster_cut(spark, sf_dir):
    scores = tables(spark, sf_dir)["lineitem"].groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("id")).agg(F.max(F.col("l_discount") * 10).alias("score"))
    return search.cluster_cut(scores)


@add("""
WITH c AS (SELECT p_type AS text, CAST(p_partkey AS VARCHAR) || ';' || CAST(p_partkey + 1 AS VARCHAR) AS pids FROM part WHERE p_size < 10), e AS (SELECT text, unnest(string_split(pids, ';')) AS pid FROM c)
SELECT CAST(s_suppkey AS VARCHAR) AS pid, s_name AS title, string_agg(DISTINCT text, '; ' ORDER BY text) AS concepts FROM supplier JOIN e ON pid = CAST(s_suppkey AS VARCHAR) GROUP BY 1, 2
""")
def concept_documents(spark, sf_dir):
    t = tables(spark, sf_dir)
    concepts = t["part"].where("p_size < 10").select(F.col("p_type").alias("text"), F.concat_ws(";", F.col("p_partkey").cast("string"), (F.col("p_partkey") + 1).cast("string")).alias("pids"))
    return search.concept_documents(concepts, t["supplier"].select(F.col("s_suppkey").cast("string").alias("pid"), F.col("s_name").alias("title")))


@add(r"""
WITH q AS (SELECT p_partkey AS question_id, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]{3,}')) AS q FROM part),
c AS (SELECT col0 AS concept_no, col1 AS label, list_distinct(regexp_extract_all(lower(col1), '[a-z0-9]{3,}')) AS l, list_distinct(regexp_extract_all(lower(col2), '[a-z0-9]{3,}')) AS d FROM (VALUES (1, 'red widget', 'small economy'), (2, 'small ring', 'promo red'), (3, 'economy', 'widget ring'))),
s AS (SELECT question_id, label, concept_no, len(list_intersect(q, l)) AS lh, CAST(2 * len(list_intersect(q, l)) + len(list_intersect(q, d)) AS INT) AS score FROM q, c)
SELECT question_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, concept_no) AS r FROM s WHERE lh > 0 AND score > 1) WHERE r = 1
""")
def concept_match(spark, sf_dir):
    concepts = spark.createDataFrame([(1, "red widget", "small economy"), (2, "small ring", "promo red"), (3, "economy", "widget ring")], "concept_no int, label string, description string")
    questions = tables(spark, sf_dir)["part"].select(F.col("p_partkey").alias("question_id"), F.concat_ws(" ", "p_name", "p_type").alias("question"))
    return search.concept_match(questions, concepts)


@add(r"""
WITH v AS (SELECT DISTINCT w AS word, length(w) % 2 = 1 AS place FROM (SELECT unnest(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z]+')) AS w FROM part)),
t AS (SELECT DISTINCT word || 'x' AS word FROM v UNION SELECT DISTINCT substr(word, 2) FROM v UNION SELECT DISTINCT 'q' || substr(word, 3) FROM v),
n AS (SELECT t.word, v.word AS known, levenshtein(t.word, v.word) AS d FROM t, v WHERE length(t.word) >= 5 AND length(v.word) >= 5 AND t.word NOT IN (SELECT word FROM v) AND levenshtein(t.word, v.word) <= CASE WHEN place AND length(t.word) >= 7 THEN 2 ELSE 1 END
  AND (NOT place OR right(t.word, 1) = right(v.word, 1) OR v.word LIKE '%s'))
SELECT word, min(known) AS fixed FROM (SELECT *, min(d) OVER (PARTITION BY word) AS least FROM n) WHERE d = least GROUP BY word HAVING count(*) = 1
""")
def spell_fix(spark, sf_dir):
    """Words of odd length stand for places."""
    v = tables(spark, sf_dir)["part"].select(F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    tokens = v.select(F.concat("word", F.lit("x")).alias("word")).union(v.select(F.expr("substring(word, 2)"))).union(v.select(F.expr("concat('q', substring(word, 3))"))).distinct()
    return search.spell_fix(tokens, v.withColumn("place", F.length("word") % 2 == 1))


ASK = "CASE o_orderkey % 4 WHEN 0 THEN 'Orders over the last ' || CAST(1 + o_orderkey % 9 AS VARCHAR) || ' years as a bar chart' WHEN 1 THEN 'Share of orders from 1996 to 1999' WHEN 2 THEN 'Year over year change since ' || CAST(1990 + o_orderkey % 9 AS VARCHAR) ELSE 'Index of price' END"
ASK_SPARK = ASK.replace("VARCHAR", "STRING")


#: Questions and what they say: text, preset, years from and to, months, geography, transform, base, chart, latest.
CUES = [
    ("Orders over the last 5 years as a bar chart", "5Y", None, None, None, "one", "level", None, "bar", False), ("Share of orders from 1996 to 1999 by province", "max", "1996", "1999", None, "provinces", "share_of_x", None, "stacked_bar", False),
    ("Year over year change since 1994", "max", "1994", None, None, "one", "pct_change_yoy", None, None, False), ("Prices indexed to March 2010, by region", "max", None, None, None, "regions", "index_first", "2010-03", None, False),
    ("index to 2015-Q2 = 100 in 2020", "max", "2020", "2020", None, "one", "index_first", "2015-Q2", None, False), ("latest prices in the territories", "latest", None, None, None, "territories", "level", None, None, True),
    ("growth relative to 2012 in percent", "max", None, None, None, "one", "pct_change_yoy", None, None, False), ("prices over the past 18 months by city as a table", "max", None, None, 18, "cities", "level", None, "table", False),
    ("last year in provinces and territories", "1Y", None, None, None, "provinces_and_territories", "level", None, None, False), ("stacked area of sales across canada in 2021", "1Y", None, None, None, "provinces_and_territories", "level", None, "stacked_area", False),
]
PICK = "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(CUES)) + " END"


@add("WITH c(k, t, preset, from_year, to_year, months, geography, transform, index_base, chart, latest) AS (VALUES " + ", ".join("(" + str(i) + ", " + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'" for v in c) + ")" for i, c in enumerate(CUES)) + ") SELECT o_orderkey AS question_id, preset, from_year, to_year, CAST(months AS INT) AS months, geography, transform, index_base, chart, latest FROM orders JOIN c ON k = o_orderkey % 10")
def extract_cues(spark, sf_dir):
    found = cues.question_cues(tables(spark, sf_dir)["orders"].select(F.col("o_orderkey").alias("question_id"), F.expr(PICK).alias("question")), 2021)
    return found.select("question_id", "preset", "from_year", "to_year", "months", "geography", "transform", "index_base", "chart", "latest")


#: Questions of places, and what they say: text, geography, places, horizontal, full history, a stretch of time.
PLACED = [
    ("population in Ontario and Quebec", "listed", "Ontario,Quebec", None, False, False), ("prices by census metropolitan areas over time", "cities", "", None, False, True), ("jobs in BC as a horizontal bar, full history", "listed", "British Columbia", True, True, True),
    ("territories near yukon", "listed", "Yukon", None, False, False), ("trade across each census agglomeration, 5 yrs", "cities", "", None, False, True), ("a column chart for newfoundland and labrador since 2001", "listed", "Newfoundland and Labrador", False, False, True),
    ("bc or ontario-wide prices 1996–1999", "listed", "Ontario", None, False, True), ("", "one", "", None, False, False),
]
PLACED_PICK = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{c[0]}'" for i, c in enumerate(PLACED)) + " END"
GAZETTEER = [("Ontario", "Ontario", False), ("Quebec", "quebec", False), ("British Columbia", "British Columbia", False), ("British Columbia", "BC", True), ("Yukon", "Yukon", False), ("Newfoundland and Labrador", "Newfoundland and Labrador", False)]


@add("WITH c(k, geography, places, horizontal, full_history, ranged) AS (VALUES " + ", ".join(f"({i}, '{g}', '{p}', {'NULL' if h is None else str(h).lower()}, {str(a).lower()}, {str(r).lower()})" for i, (_, g, p, h, a, r) in enumerate(PLACED)) + ") SELECT o_orderkey AS question_id, geography, places, CAST(horizontal AS BOOLEAN) AS horizontal, full_history, ranged FROM orders JOIN c ON k = o_orderkey % 8")
def place_cues(spark, sf_dir):
    gazetteer = spark.createDataFrame([(*g, i) for i, g in enumerate(GAZETTEER)], "place string, form string, exact boolean, position int")
    asked = tables(spark, sf_dir)["orders"].select(F.col("o_orderkey").alias("question_id"), F.expr(PLACED_PICK).alias("question"))
    found = cues.question_cues(asked, 2021, gazetteer)
    return found.select("question_id", "geography", F.array_join("places", ",").alias("places"), "horizontal", "full_history", "ranged")


#: A question, a table's title, families of units, the names and roles of its dimensions and members, and what is wrong.
FITS = [
    ("monthly prices", "Prices, annual", ["currency"], [("Geo", "geography", [("Canada", [], "")])], ["frequency"]),
    ("sales of cars", "Registrations of cars", [], [("Kind", "measure", [("Average prices of sales", [], "")])], ["sales"]),
    ("sales of cars", "Registrations of cars", [], [("Kind", "measure", [("Cars sold", [], "")])], []),
    ("sales of cars", "New prices sold", [], [], ["prices, not sales"]),
    ("resales by city", "Sold homes", [], [("M", "measure", [("Existing homes", [], "")])], []),
    ("resales by city", "Sold homes", [], [("M", "other", [("Existing homes", [], "")])], ["resales"]),
    ("restaurant sales", "Retail sales", [], [], ["restaurants"]),
    ("average retail prices of milk", "Farm prices of milk", [], [], ["retail prices"]),
    ("price of milk in dollars", "Prices of milk", ["index"], [], ["dollars"]),
    ("price of milk in $", "Prices of milk", ["currency"], [], []),
    ("litres of wine, sales", "Sales of wine", [], [("M", "other", [("Value", [], "")])], ["litres"]),
    ("deaths by cause", "Deaths", [], [("Causes of death", "other", [])], []),
    ("deaths by cause", "Deaths", [], [("Cause", "other", [])], ["causes of death"]),
    ("jobs by province", "Jobs", [], [("Geo", "geography", [("Canada", [], ""), ("Yukon", ["territory"], "")])], ["provinces"]),
    ("jobs in the territories", "Jobs", [], [("Geo", "geography", [("Ontario", ["province"], "")])], ["territories"]),
    ("jobs by city", "Census jobs", [], [("Geo", "geography", [("Ontario", ["province"], "2021A000235")])], ["cities"]),
    ("jobs by municipality", "Census jobs", [], [("Geo", "geography", [("Ajax", [], "2021A00053518005")])], []),
    ("jobs in Ontario and Yukon", "Jobs", [], [("Geo", "geography", [("Ontario (a)", ["province"], "")])], ["places"]),
    ("jobs in Ontario", "Jobs", [], [("Geo", "geography", [("Ontario", ["province"], "")])], []),
    ("gas and food", "Trade", [], [("M", "other", [("Food", [], ""), ("Gasoline and oil", [], "")])], ["Gasoline"]),
]


@add("WITH c(k, reasons) AS (VALUES " + ", ".join(f"({i}, '{','.join(r)}')" for i, (*_, r) in enumerate(FITS)) + ") SELECT o_orderkey AS question_id, 't' || k AS pid, reasons FROM orders JOIN c ON k = o_orderkey % 20")
def concept_fit(spark, sf_dir):
    """Each question against its table, by cues read from it."""
    schema = "k int, question string, title string, unit_families array<string>, dimensions array<struct<name: string, role: string, members: array<struct<label: string, roles: array<string>, place_id: string>>>>"
    made = spark.createDataFrame([(i, *f[:4]) for i, f in enumerate(FITS)], schema)
    asked = tables(spark, sf_dir)["orders"].select(F.col("o_orderkey").alias("question_id"), (F.col("o_orderkey") % 20).cast("int").alias("k"))
    gazetteer = spark.createDataFrame([(*g, i) for i, g in enumerate(GAZETTEER)], "place string, form string, exact boolean, position int")
    said = cues.question_cues(asked.join(F.broadcast(made.select("k", "question")), "k"), 2021, gazetteer).select("question_id", "geography", "places")
    census = F.when(F.col("title").startswith("Census"), "census_2021").otherwise("ordinary")
    pairs = asked.join(said, "question_id").join(F.broadcast(made), "k").withColumn("pid", F.concat(F.lit("t"), F.col("k").cast("string"))).withColumn("family", census)
    return cues.table_fit(pairs).select("question_id", "pid", F.array_join("reasons", ",").alias("reasons"))


@add("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'life satisfaction of ' || p_name WHEN 1 THEN 'consumer price index all-items' WHEN 2 THEN 'consumer price index of food' WHEN 3 THEN 'consumer price index all-items' WHEN 4 THEN p_name ELSE 'consumer price index all-items by year' END AS rewritten FROM part
""")
def rewrite_query(spark, sf_dir):
    asked_ = F.expr("CASE p_partkey % 6 WHEN 0 THEN concat('Quality  of life of ', p_name) WHEN 1 THEN ' Inflation ' WHEN 2 THEN 'CPI of food' WHEN 3 THEN 'cpi' WHEN 4 THEN p_name ELSE 'cost of living by year' END")
    return tables(spark, sf_dir)["part"].select("p_partkey", search.rewrite_query(asked_).alias("rewritten"))


@add("SELECT o_orderkey AS question_id, CASE o_orderkey % 4 WHEN 0 THEN 'orders as a bar chart' WHEN 1 THEN 'share of orders' WHEN 2 THEN 'year over year change' ELSE 'index of price' END AS stripped FROM orders")
def strip_phrases(spark, sf_dir):
    questions = tables(spark, sf_dir)["orders"].select(F.col("o_orderkey").alias("question_id"), F.expr(ASK_SPARK).alias("question"))
    return questions.select("question_id", search.strip_phrases(F.col("question")).alias("stripped"))


@add("SELECT event_type AS split, count(*) AS n, round(avg(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0 END), 9) AS accuracy, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def plan_scorecard(spark, sf_dir):
    results = tables(spark, sf_dir)["events"].select(F.col("event_type").alias("split"), (F.col("user_id") % 2 == 0).alias("ok"), F.col("value").alias("latency"))
    return search.scorecard(results).withColumn("accuracy", F.round("accuracy", 9))


@add("""
WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT *, greatest(60 - count(*) OVER (), 0) AS rest, greatest(60 - count(*) OVER (), 0) * n / sum(n) OVER () AS quota FROM c),
a AS (SELECT lang, n, least(n, 1 + floor(quota) + CASE WHEN row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, sha256('s7' || chr(0) || lang)) <= rest - sum(floor(quota)) OVER () THEN 1 ELSE 0 END) AS take FROM s),
r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s7' || chr(0) || CAST(doc_id AS VARCHAR)), doc_id) AS p FROM documents)
SELECT doc_id, lang FROM r JOIN a USING (lang) WHERE p <= take
""")
def stratified_sample(spark, sf_dir):
    return search.stratified_sample(tables(spark, sf_dir)["documents"].select("doc_id", "lang"), ["lang"], "doc_id", 60, "s7").select("doc_id", "lang")


@add("SELECT lang, quantile_disc(n_chars, 0.25) AS p25, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.75) AS p75, min(n_chars) AS least, max(n_chars) AS most, CAST(sum(n_chars) AS BIGINT) AS total, count(*) - count(n_chars) AS unknown FROM documents GROUP BY lang")
def size_percentiles(spark, sf_dir):
    sizes = search.size_percentiles(tables(spark, sf_dir)["documents"], "lang", "n_chars")
    return sizes.withColumns({p: F.col(p).cast("long") for p in ("p25", "p50", "p75")})


@add("WITH u AS (SELECT * FROM (SELECT doc_id, 'long' AS l FROM documents ORDER BY n_chars DESC, doc_id LIMIT 3) UNION ALL SELECT * FROM (SELECT doc_id, 'short' FROM documents ORDER BY n_chars, doc_id LIMIT 3) UNION ALL SELECT * FROM (SELECT doc_id, 'first' FROM documents ORDER BY doc_id, doc_id LIMIT 3)) SELECT doc_id, string_agg(DISTINCT l, ',' ORDER BY l) AS labels FROM u GROUP BY 1")
def edge_cohort(spark, sf_dir):
    return search.edge_cohort(tables(spark, sf_dir)["documents"], "doc_id", {"long": F.desc("n_chars"), "short": F.asc("n_chars"), "first": F.asc("doc_id")})
