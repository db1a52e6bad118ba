"""Queries of scalar functions and of rules over labels: words, documents, accents, hashes, ordinal buckets, measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubewright.functions import text
from cubewright.operators import records

from .cubes import tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add


def part(spark, sf_dir):
    return tables(spark, sf_dir)["part"]


STOP = "['the', 'and', 'for']"


@add(f"""
WITH p AS (SELECT p_partkey, lower(p_name || ' the 1999 ' || p_type || ' ab') AS t FROM part),
w AS (SELECT p_partkey, list_filter(regexp_extract_all(t, '[a-zà-ÿ0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP}, x) AND NOT regexp_full_match(x, '(19|20)[0-9][0-9]')) AS w FROM p)
SELECT p_partkey, array_to_string(w, ' ') AS words, CAST(len(list_filter(w, lambda x: list_contains(['small', 'ring', 'promo', 'widget'], x))) AS INT) AS hits FROM w
""")
def words(spark, sf_dir):
    found = text.words(F.concat_ws(" ", "p_name", F.lit("the 1999"), "p_type", F.lit("ab")), ["the", "and", "for"])
    return part(spark, sf_dir).select("p_partkey", F.array_join(found, " ").alias("words"), text.token_hits(F.lit("Small ring-promo: WIDGET"), found).alias("hits"))


@add("SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'industry' WHEN 1 THEN 'class' WHEN 2 THEN 'box' WHEN 3 THEN 'church' WHEN 4 THEN 'price' WHEN 5 THEN 'gas' WHEN 6 THEN 'wish' ELSE 'house' END AS singular FROM part")
def singular(spark, sf_dir):
    word = F.expr("CASE p_partkey % 8 WHEN 0 THEN 'industries' WHEN 1 THEN 'classes' WHEN 2 THEN 'boxes' WHEN 3 THEN 'churches' WHEN 4 THEN 'prices' WHEN 5 THEN 'gas' WHEN 6 THEN 'wishes' ELSE 'house' END")
    return part(spark, sf_dir).select("p_partkey", text.singular(word).alias("singular"))


@add("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '3,12' WHEN 1 THEN '' WHEN 2 THEN CAST(c_custkey AS VARCHAR) ELSE '7' END AS ids FROM customer")
def note_ids(spark, sf_dir):
    raw = F.expr("CASE c_custkey % 4 WHEN 0 THEN '3; 12;x;-4' WHEN 1 THEN NULL WHEN 2 THEN CAST(c_custkey AS STRING) ELSE ';7;0;' END")
    return tables(spark, sf_dir)["customer"].select("c_custkey", F.array_join(F.transform(text.note_ids(raw), lambda x: x.cast("string")), ",").alias("ids"))


@add("""
WITH l AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_brand || '; ' || p_container END AS c, * FROM (SELECT p_partkey, p_brand, p_type AS p_container, p_name FROM part)),
t AS (SELECT p_partkey, 'Title: ' || p_name || chr(10) || 'Concepts: ' || c || chr(10) || 'Subjects: ' AS t, p_brand || ' note' AS n FROM l)
SELECT p_partkey, substr(CASE WHEN 90 - length(t) - 8 > 0 THEN t || chr(10) || 'Notes: ' || substr(n, 1, 90 - length(t) - 8) ELSE t END, 1, 90) AS document FROM t
""")
def compact_document(spark, sf_dir):
    concepts = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" | ", "p_brand", F.lit(""), "p_brand")).otherwise(F.concat_ws(" | ", "p_brand", "p_type", "p_brand"))
    made = text.compact_document(F.col("p_name"), {"Concepts": concepts, "Subjects": F.lit(None).cast("string")}, {"Notes": F.concat("p_brand", F.lit(" note"))}, 90)
    return part(spark, sf_dir).select("p_partkey", made.alias("document"))


@add("SELECT doc_id, lower(strip_accents(substr(text, 1, 200))) AS folded FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(substr(text, 1, 200), '[^\\x00-\\x{17F}]')")
def fold_accents(spark, sf_dir):
    """Texts of Latin letters: the rule is the letters' own Unicode decomposition."""
    start = F.substring("text", 1, 200)
    docs = tables(spark, sf_dir)["documents"].where(F.col("text").isNotNull() & ~start.rlike(r"[^\x00-ſ]"))
    return docs.select("doc_id", text.fold_accents(start).alias("folded"))


@add("""SELECT p_partkey, substr(sha256('{"v":1,"pid":"' || p_partkey || '","dims":[' || p_size || ',' || (p_size + 1) || '],"transform":"level"}'), 1, 10) AS hash FROM part""")
def view_hash(spark, sf_dir):
    spec = F.struct(F.lit(1).alias("v"), F.col("p_partkey").cast("string").alias("pid"), F.array("p_size", F.col("p_size") + 1).alias("dims"), F.lit("level").alias("transform"))
    return part(spark, sf_dir).select("p_partkey", text.view_hash(spec).alias("hash"))


@add("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '18100006' END AS pid, CASE WHEN o_orderkey % 4 IN (0, 3) THEN o_orderkey END AS length, CASE o_orderkey % 4 WHEN 0 THEN 'Saint John' WHEN 1 THEN 'Ottawa – Gatineau' ELSE 'St-Jean' END AS place, CASE WHEN o_orderkey % 4 = 0 THEN 'a,b' ELSE 'a' END AS parts FROM orders""")
def code_shapes(spark, sf_dir):
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), (F.col("o_orderkey") % 4).cast("int") + 1)
    key = F.col("o_orderkey").cast("string")
    return tables(spark, sf_dir)["orders"].select(
        "o_orderkey", text.table_pid(pick("18-10-0006-01", "18-10-0006-02", "18100006", "18-10-006-01")).alias("pid"), text.strict_length(pick(key, F.concat(key, F.lit("b")), "", key)).alias("length"),
        text.short_place(pick("Saint John (CMA)", "Ottawa - Gatineau (part)", "St-Jean", "St-Jean (x) y")).alias("place"), F.array_join(text.unique_parts(pick("a | b | a |  ", "a | a", " a", "a")), ",").alias("parts"),
    )


BUCKETS = "'$5,000 to $9,999', '15 to 24 years', 'Under 20 hours', '65 years and over', '65+', 'Lowest decile', '90th percentile', 'Top 1%', '2021', 'Q3 2024', 'Jan 2025', '1-4 employees'"


@add(f"""
WITH b AS (SELECT unnest([{BUCKETS}]) AS label, unnest(range(12)) AS i), d AS (SELECT s_nationkey AS k, s_suppkey % 10 AS j, CASE WHEN s_suppkey % 10 < s_nationkey % 11 THEN (SELECT label FROM b WHERE i = s_suppkey % 12) ELSE s_name END AS label FROM supplier)
SELECT CAST(k AS VARCHAR) AS pid, CAST(1 AS INT) AS dimension_id, count(*) >= 2 AND avg(CASE WHEN j < k % 11 THEN 1.0 ELSE 0 END) >= 0.7 AS ordinal FROM d GROUP BY k
""")
def ordinal_labels(spark, sf_dir):
    """Every form of bucket among names, in shares from none to all."""
    labels = F.split(F.lit(BUCKETS.replace("', '", "|").strip("'")), r"\|")
    label = F.when(F.col("s_suppkey") % 10 < F.col("s_nationkey") % 11, F.element_at(labels, (F.col("s_suppkey") % 12).cast("int") + 1)).otherwise(F.col("s_name"))
    rows = tables(spark, sf_dir)["supplier"].select(F.col("s_nationkey").cast("string").alias("pid"), F.lit(1).alias("dimension_id"), label.alias("member_name"))
    return records.ordinal_dimensions(rows)


MEASURES = [(1, "Average hourly wage rate"), (2, "Unemployment"), (3, "Unemployment rate"), (4, "Employment"), (5, "Employment rate"), (6, "Participation rate"), (7, "Small ring sales"), (8, "Large ring sales")]
ASKS = ["What are wages now", "number of unemployed people", "unemployment by age", "employed share of women", "participation of men", "how many jobs", "small ring sales", "ring sales", "employment vs unemployment", "total wages of workers"]
PICKS = [[1], [2], [3], [5], [6], [4], [7], [], [2, 4], []]


@add("WITH a(k, member_id) AS (VALUES " + ", ".join(f"({k}, {m})" for k, ms in enumerate(PICKS) for m in ms) + ") SELECT p_partkey AS question_id, CAST(member_id AS INT) AS member_id FROM part JOIN a ON k = p_partkey % 10")
def requested_measures(spark, sf_dir):
    members = spark.createDataFrame(MEASURES, "member_id int, member_name string")
    asked = F.element_at(F.array(*map(F.lit, ASKS)), (F.col("p_partkey") % 10).cast("int") + 1)
    return records.requested_measures(part(spark, sf_dir).select(F.col("p_partkey").alias("question_id"), asked.alias("question")), members)
