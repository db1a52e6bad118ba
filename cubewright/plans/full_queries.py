"""Queries of records with all that belongs to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubewright.operators import full_records

from .cubes import LINES, ORDERS, cube, oracle, tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add


@add(oracle(LINES, """SELECT coordinate, ref_date, CAST(ref_date || '-01' AS DATE) AS period_start, 'Nation ' || m1 AS label_1, CASE WHEN m2 < 3 THEN 'Flag ' || m2 END AS label_2, 'place-' || m1 AS place_id, CASE uom_id WHEN 17 THEN 'count' END AS unit_family, CASE status WHEN 'E' THEN 'use with caution' END AS status_meaning, CAST(NULL AS VARCHAR) AS symbol_meaning FROM obs WHERE ref_date >= '1993'"""))
def observation_records(spark, sf_dir):
    obs = cube(spark, sf_dir, LINES, "obs")
    page = obs.select("pid", "coordinate", "ref_date", *[F.col(f"m{k}").alias(f"member_id_{k}") for k in (1, 2, 3)], "uom_id", "status", F.lit("").alias("symbol"))
    period = obs.select("pid", "ref_date").where("ref_date >= '1993'").distinct().select("pid", "ref_date", F.to_date(F.concat("ref_date", F.lit("-01"))).alias("period_start"), F.lit(None).cast("date").alias("period_end"), F.lit("month").alias("period_kind"))
    nation = obs.select("pid", F.col("m1").alias("member_id")).distinct()
    member = nation.select("pid", F.lit(1).alias("dimension_id"), "member_id", F.concat(F.lit("Nation "), F.col("member_id").cast("string")).alias("member_name"))
    flag = obs.select("pid", F.col("m2").alias("member_id")).where("m2 < 3").distinct().select("pid", F.lit(2).alias("dimension_id"), "member_id", F.concat(F.lit("Flag "), F.col("member_id").cast("string")).alias("member_name"))
    place = nation.select("pid", F.lit(1).alias("dimension_id"), "member_id", F.concat(F.lit("place-"), F.col("member_id").cast("string")).alias("place_id"))
    family = spark.createDataFrame([(17, "count")], "uom_code int, family string")
    meanings = spark.createDataFrame([("status", "E", "use with caution"), ("status", "", "nothing"), ("symbol", "", "nothing")], "kind string, code string, meaning string")
    found = full_records.observation_records(page, 3, member.union(flag), period, place, family, meanings)
    return found.select("coordinate", "ref_date", "period_start", "label_1", "label_2", "place_id", "unit_family", "status_meaning", "symbol_meaning")


@add("""
SELECT c_custkey AS pid, CAST(n AS VARCHAR) AS note_id, CASE n WHEN 1 THEN 'table' WHEN 2 THEN 'dimension' WHEN 3 THEN 'dimension' ELSE 'member' END AS scope, CASE n WHEN 1 THEN CAST(NULL AS INT) WHEN 2 THEN CAST(2 AS INT) WHEN 3 THEN 1 ELSE 1 END AS dimension_id, CASE WHEN n = 4 THEN CAST(7 AS INT) END AS member_id
FROM customer, range(1, 6) r(n) WHERE n < 4 OR (n = 4 AND c_custkey % 3 = 0)
""")
def selected_notes(spark, sf_dir):
    """Note 1 is referred to by nothing, 2 by a dimension and a member, 3 by two dimensions, 4 and 5 by members, of which every
    third table selects the first and none the second."""
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("pid"))
    notes = c.select("pid", F.explode(F.array(*[F.lit(str(n)) for n in range(1, 6)])).alias("note_id"))
    references = c.selectExpr("pid", "stack(5, 'dimension', 1, NULL, '3', 'dimension', 2, NULL, '2;3', 'member', 1, 7, '4;2', 'member', 1, 8, '5', 'member', 2, 7, '') AS (scope, dimension_id, member_id, note_ids)")
    selected = c.where("pid % 3 = 0").select("pid", F.lit(1).alias("dimension_id"), F.lit(7).alias("member_id"))
    return full_records.selected_notes(notes, references, selected)


@add("""
WITH m AS (SELECT s_nationkey AS dim, list({'member_id': s_suppkey, 'name': s_name} ORDER BY s_suppkey) AS members FROM supplier GROUP BY 1)
SELECT r_regionkey AS pid, r_name AS title, string_agg(CAST(n_nationkey AS VARCHAR) || ':' || n_name || '(' || coalesce(array_to_string(list_transform(members, lambda x: x.member_id || '=' || x.name), ','), '') || ')', ';' ORDER BY n_nationkey) AS dimensions, CAST(0 AS INT) AS n_notes
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN m ON dim = n_nationkey GROUP BY 1, 2
""")
def nested_tables(spark, sf_dir):
    """Regions as tables, nations as their dimensions, suppliers as members."""
    t = tables(spark, sf_dir)
    dimension = t["nation"].select(F.col("n_regionkey").alias("pid"), F.col("n_nationkey").alias("dimension_id"), F.col("n_name").alias("dimension_name"))
    member = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("pid"), F.col("s_nationkey").alias("dimension_id"), F.col("s_suppkey").alias("member_id"), F.col("s_name").alias("name"))
    notes = t["region"].select(F.col("r_regionkey").alias("pid"), F.lit(1).alias("note_id"), F.lit("n").alias("note")).where("pid < 0")
    found = full_records.nested_tables(t["region"].select(F.col("r_regionkey").alias("pid"), F.col("r_name").alias("title")), dimension, member, {"notes": (notes, ["note_id"])})
    text = F.transform("dimensions", lambda d: F.concat(d["dimension_id"].cast("string"), F.lit(":"), d["dimension_name"], F.lit("("), F.array_join(F.transform(d["members"], lambda m: F.concat(m["member_id"].cast("string"), F.lit("="), m["name"])), ","), F.lit(")")))
    return found.select("pid", "title", F.array_join(text, ";").alias("dimensions"), F.size("notes").alias("n_notes"))


#: Members of every nation by their number's rest by ten: ids on observations, code, name; the place, the match and reasons.
MATCHES = [
    (["2021A000235"], "", "Ontario", "2021A000235", "dguid", ""),
    ([], "[24]", "Quebec", "code:0002:24", "code", "member has no observations"),
    (["2021A000235", "2016A000235"], "", "Ontario", "code:0002:35", "name", "several ids on observations: 2016A000235, 2021A000235|no classification code"),
    ([""], "[99]", "Nowhere", None, "none", "no id on observations|no alias of code [99]|name of no country or province"),
    (["bad"], "", "Quebec", "code:0002:24", "name", "not a well-formed id: bad|no classification code"),
    (["2021A000235"], "[24]", "Twice", "code:0002:24", "code", "2021A000235 disagrees with code [24]"),
    (["2021A000235"], "[35]", "Twice", "2021A000235", "dguid", ""),
    ([], "", "Twice", None, "none", "member has no observations|no classification code|name of 2 countries or provinces"),
    (["2021A00053518005"], "", "Ajax", "2021A00053518005", "dguid", ""),
    ([], "", "Ajax", None, "none", "member has no observations|no classification code|name of no country or province"),
]


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


@add(f"WITH m(k, place_id, match, reasons) AS (VALUES {_values([(i, *m[3:]) for i, m in enumerate(MATCHES)])}) SELECT o_custkey AS pid, o_orderkey AS member_id, place_id, match, reasons FROM orders JOIN m ON k = o_orderkey % 10")
def place_matches(spark, sf_dir):
    made = spark.createDataFrame([(i, m[0], m[1], m[2]) for i, m in enumerate(MATCHES)], "k int, dguids array<string>, code string, member_name string")
    members = tables(spark, sf_dir)["orders"].select(F.col("o_custkey").alias("pid"), F.col("o_orderkey").alias("member_id"), (F.col("o_orderkey") % 10).cast("int").alias("k")).join(F.broadcast(made), "k")
    alias = spark.createDataFrame([("[24]", "0002", "24")], "code string, schema string, geo_code string")
    return full_records.place_matches(members, alias).withColumn("reasons", F.array_join("reasons", "|"))


@add("""
SELECT o_orderkey AS question_id, o_custkey AS pid, i AS dimension_id, CAST(1 AS INT) AS member_id, CASE WHEN o_custkey % 2 = 0 THEN CAST(3 AS INT) END AS alternative
FROM orders, (VALUES (1::INT), (2), (3), (4)) v(i) WHERE (i = 1 AND o_orderkey % 3 <> 0) OR (i = 2 AND o_orderkey % 3 <> 1)
""")
def published_basis(spark, sf_dir):
    """Of adjustment (1), prices (2), another dimension (3) and a wide basis (4), the first member publishes nothing; the third
    does in every second table. Every third question names an adjustment, every third prices."""
    orders = tables(spark, sf_dir)["orders"].select(F.col("o_orderkey").alias("question_id"), F.col("o_custkey").alias("pid"))
    said = F.when(F.col("question_id") % 3 == 0, "Sales, seasonally adjusted").when(F.col("question_id") % 3 == 1, "Sales at constant prices").otherwise("Sales")
    chosen = orders.withColumn("question", said).selectExpr("question_id", "question", "pid", "stack(4, 1, 'Seasonal adjustment', 2, 'Prices', 3, 'Geography', 4, 'Prices') AS (dimension_id, dimension_name)").withColumn("member_id", F.lit(1))
    pids = orders.select("pid").distinct()
    member = pids.withColumn("dimension_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4))))).withColumn("member_id", F.explode(F.sequence(F.lit(1), F.when(F.col("dimension_id") == 4, 4).otherwise(3))))
    return full_records.published_basis(chosen, member, member.where("pid % 2 = 0 and member_id >= 3"))


@add(oracle(ORDERS, """, p AS (SELECT m1, CAST(ref_date || '-01' AS DATE) AS d, value_num AS v, lag(value_num) OVER (PARTITION BY m1 ORDER BY ref_date) AS previous FROM obs WHERE m1 <= 6 AND m2 = 1 AND m3 = 1),
l AS (SELECT p.*, q.v AS yearly FROM (SELECT *, row_number() OVER (PARTITION BY m1 ORDER BY d DESC) AS k FROM p WHERE v IS NOT NULL) p LEFT JOIN p q ON q.m1 = p.m1 AND q.d = p.d - INTERVAL 1 YEAR WHERE k = 1),
c AS (SELECT *, CASE m1 % 3 WHEN 0 THEN yearly ELSE previous END AS earlier FROM l), x AS (SELECT *, CASE m1 % 3 WHEN 2 THEN v - earlier ELSE (v / nullif(earlier, 0) - 1) * 100 END AS change FROM c)
SELECT m1 AS card, v AS value, CASE WHEN m1 % 3 = 1 THEN 'Q' || quarter(d) || ' ' || year(d) ELSE strftime(d, '%b %Y') END AS period_label, round(change, 6) AS change, CASE m1 % 3 WHEN 2 THEN 'pts' ELSE '%' END AS change_unit,
       CASE m1 % 3 WHEN 0 THEN '12-month change' WHEN 1 THEN 'quarterly change' ELSE 'monthly change' END AS change_kind, CASE WHEN change > 0 THEN 'up' WHEN change < 0 THEN 'down' WHEN change = 0 THEN 'flat' END AS direction, least(60, (SELECT count(v) FROM p WHERE p.m1 = x.m1)) AS n FROM x"""))
def highlight_cards(spark, sf_dir):
    points = cube(spark, sf_dir, ORDERS, "obs").where("m1 <= 6 and m2 = 1 and m3 = 1").select(F.col("m1").alias("card"), F.to_date(F.concat("ref_date", F.lit("-01"))).alias("period_start"), F.col("value_num").alias("value"))
    rest = F.col("card") % 3
    cards = points.select("card").distinct().withColumn("headline", F.when(rest == 0, "yoy").when(rest == 1, "qoq").otherwise("mom_pts")).withColumn("quarterly", F.lit(False))
    found = full_records.highlight_cards(points, cards)
    return found.withColumn("change", F.round("change", 6)).withColumn("n", F.size("spark").cast("long")).drop("spark")


@add("SELECT r_regionkey AS pid, count(DISTINCT n_nationkey) FILTER (n_nationkey % 4 <> 0) AS n_places, count(*) FILTER (n_nationkey % 4 = 0) AS n_unplaced, CASE WHEN bool_or(n_nationkey % 4 = 1) THEN 'country,' ELSE '' END || 'province' AS levels FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def table_places(spark, sf_dir):
    """A table's places and their levels: countries for nations with rest 1, provinces by id or by code for rests 2 and 3."""
    t = tables(spark, sf_dir)
    rest = F.col("n_nationkey") % 4
    two = F.lpad(F.col("n_nationkey").cast("string"), 2, "0")
    place = F.when(rest == 1, F.concat(F.lit("2021A0000"), two)).when(rest == 2, F.concat(F.lit("2021A0002"), two)).when(rest == 3, F.concat(F.lit("code:0002:"), two))
    matched = t["nation"].select(F.col("n_regionkey").alias("pid"), place.alias("place_id"))
    found = full_records.table_places(t["region"].select(F.col("r_regionkey").alias("pid")), matched)
    return found.withColumn("levels", F.array_join("levels", ","))
