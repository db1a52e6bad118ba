"""Queries of joins, lookups, selections and table records."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubewright.operators import catalogue

from .cubes import ORDERS, cube, oracle, tables
from .place_queries import mapped
from .place_queries import sql as place_sql
from .registering import Registry
from .series_queries import PERIOD, period_table

REGISTRY = Registry()
add = REGISTRY.add


def obs(spark, sf_dir):
    return cube(spark, sf_dir, ORDERS, "obs")


def member(spark, sf_dir):
    return cube(spark, sf_dir, ORDERS, "member")


@add(oracle(ORDERS, PERIOD + " SELECT pid, ref_date, m1, m2, m3, value, period_start, period_end, period_kind FROM obs JOIN period USING (pid, ref_date) WHERE m1 = 1"))
def join_period(spark, sf_dir):
    o = obs(spark, sf_dir).where("m1 = 1")
    return catalogue.join_period(o, period_table(o)).select("pid", "ref_date", "m1", "m2", "m3", "value", "period_start", "period_end", "period_kind")


LABELS = " LEFT JOIN (SELECT member_id AS m1, member_name AS label_1 FROM member WHERE dimension_id = 1) USING (m1) LEFT JOIN (SELECT member_id AS m2, member_name AS label_2 FROM member WHERE dimension_id = 2) USING (m2) LEFT JOIN (SELECT member_id AS m3, member_name AS label_3 FROM member WHERE dimension_id = 3) USING (m3)"


@add(oracle(ORDERS, "SELECT pid, m1, m2, m3, ref_date, value, label_1, label_2, label_3 FROM obs" + LABELS))
def join_labels(spark, sf_dir):
    return catalogue.join_labels(obs(spark, sf_dir), member(spark, sf_dir), 3).select("pid", "m1", "m2", "m3", "ref_date", "value", "label_1", "label_2", "label_3")


@add("SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END AS label FROM orders")
def label_codes(spark, sf_dir):
    codes = spark.createDataFrame([("F", "filled"), ("O", "open")], "code string, en string")
    return catalogue.label_codes(tables(spark, sf_dir)["orders"].select("o_orderkey", "o_orderstatus"), codes, "o_orderstatus", "label").select("o_orderkey", "o_orderstatus", "label")


@add("SELECT o_orderkey, [CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END, 'low', CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' END]::VARCHAR[] AS labels FROM orders")
def label_lists(spark, sf_dir):
    codes = spark.createDataFrame([("F", "filled"), ("O", "open"), ("L", "low")], "code string, en string")
    lists = tables(spark, sf_dir)["orders"].select("o_orderkey", F.array("o_orderstatus", F.lit("L"), "o_orderstatus").alias("codes"))
    return catalogue.label_lists(lists, "o_orderkey", "codes", codes)


@add(oracle(ORDERS, "SELECT * FROM obs WHERE ref_date BETWEEN '1996-03' AND '1997-02' AND m1 = 3 AND m3 = 2"))
def filter_observations(spark, sf_dir):
    return catalogue.filter_observations(obs(spark, sf_dir), "1996-03", "1997-02", {"m1": 3, "m3": 2, "m4": 7})


@add(oracle(ORDERS, "SELECT pid, m1, m2, m3, ref_date, value, label_1, label_2, label_3 FROM (SELECT * FROM obs WHERE m1 >= 7 ORDER BY m1, m2, m3, ref_date LIMIT 200 OFFSET 50)" + LABELS))
def observations_page(spark, sf_dir):
    rows = catalogue.page(obs(spark, sf_dir).where("m1 >= 7"), ["m1", "m2", "m3", "ref_date"], 50, 200)
    return catalogue.join_labels(rows, member(spark, sf_dir), 3).select("pid", "m1", "m2", "m3", "ref_date", "value", "label_1", "label_2", "label_3")


@add("SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 25")
def total_with_page(spark, sf_dir):
    return catalogue.total_with_page(tables(spark, sf_dir)["orders"].select("o_orderkey", "o_custkey"), ["o_orderkey"], 25)


@add("SELECT (SELECT count(*) FROM orders) > 500 AS refused")
def limits_guard(spark, sf_dir):
    return catalogue.limits_guard(tables(spark, sf_dir)["orders"], 500)


RULE = {"and": [{"any": [{"childrenOf": 1}, {"contains": "_1"}, {"in": ["World", "NATION_3"]}]}, {"not": {"eq": "ASIA"}}]}


@add(oracle(ORDERS, "SELECT member_id, member_name, (coalesce(parent_member_id = 1, false) OR lower(member_name) LIKE '%\\_1%' ESCAPE '\\' OR lower(member_name) IN ('world', 'nation_3')) AND NOT lower(member_name) = 'asia' AS selected FROM member WHERE dimension_id = 1"))
def member_select(spark, sf_dir):
    geo = member(spark, sf_dir).where("dimension_id = 1")
    return geo.select("member_id", "member_name", catalogue.member_select(geo, RULE).alias("selected"))


@add(oracle(ORDERS, """SELECT pid, dimension_id, member_id, concat_ws(',', CASE WHEN root AND roots = 1 AND kids THEN 'total' END, CASE WHEN root THEN 'root' END, CASE WHEN NOT kids THEN 'leaf' END) AS roles
FROM (SELECT *, parent_member_id IS NULL AS root, count(*) FILTER (WHERE parent_member_id IS NULL) OVER (PARTITION BY dimension_id) AS roots, EXISTS (SELECT 1 FROM member c WHERE c.dimension_id = m.dimension_id AND c.parent_member_id = m.member_id) AS kids FROM member m)"""))
def member_roles(spark, sf_dir):
    return catalogue.member_roles(member(spark, sf_dir))


@add(place_sql(" SELECT '10000001' AS pid, 1 AS dimension_id, 'geography' AS role UNION ALL SELECT '10000001', 2, 'category' UNION ALL SELECT '10000001', 3, 'measure'"))
def dimension_roles(spark, sf_dir):
    measures = spark.createDataFrame([("10000001", 3)], "pid string, dimension_id int")
    return catalogue.dimension_roles(member(spark, sf_dir), mapped(spark, sf_dir).where("pid = '10000001'"), measures)


@add(oracle(ORDERS, "SELECT pid, m1, m2, m3 FROM obs WHERE value_num IS NOT NULL AND ref_date IN (SELECT DISTINCT ref_date FROM obs ORDER BY ref_date DESC LIMIT 12) ORDER BY m1, m2, m3 LIMIT 1"))
def default_coordinate(spark, sf_dir):
    return catalogue.default_coordinate(obs(spark, sf_dir), 12)


@add(oracle(ORDERS, """SELECT pid, count(*) AS n_dimensions, '[' || string_agg('{"dimension_id":' || dimension_id || ',"members":[' || ms || ']}', ',' ORDER BY dimension_id) || ']' AS detail
FROM (SELECT pid, dimension_id, string_agg('{"member_id":' || member_id || ',"member_name":"' || member_name || '"}', ',' ORDER BY member_id) AS ms FROM member GROUP BY 1, 2) GROUP BY pid"""))
def table_detail(spark, sf_dir):
    return catalogue.table_detail(member(spark, sf_dir))


@add("SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def ordered_text(spark, sf_dir):
    return catalogue.ordered_text(tables(spark, sf_dir)["nation"], "n_regionkey", "n_nationkey", "n_name")


@add("""
WITH notes AS (SELECT 'p' AS pid, CAST(n_nationkey AS VARCHAR) AS note_id FROM nation),
refs AS (SELECT CAST(n_nationkey AS VARCHAR) AS note_id, 1 AS rank FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 2 FROM nation WHERE n_nationkey % 2 = 1)
SELECT pid, note_id, CASE min(rank) WHEN 1 THEN 'dimension' WHEN 2 THEN 'member' ELSE 'table' END AS scope FROM notes LEFT JOIN refs USING (note_id) GROUP BY 1, 2
""")
def note_scope(spark, sf_dir):
    n = tables(spark, sf_dir)["nation"].select(F.lit("p").alias("pid"), F.col("n_nationkey").cast("string").alias("note_id"), "n_nationkey")
    some = lambda test, scope: n.where(test).select("pid", F.concat_ws(";", "note_id", F.lit("")).alias("note_ids"), F.lit(scope).alias("scope"))
    return catalogue.note_scope(n.select("pid", "note_id"), some("n_nationkey % 4 = 1", "dimension").union(some("n_nationkey % 2 = 1", "member")))


@add(oracle(ORDERS, "SELECT DISTINCT status, CASE status WHEN 'E' THEN 'use with caution' ELSE status END AS meaning FROM obs WHERE status <> ''"))
def marks_legend(spark, sf_dir):
    legend = spark.createDataFrame([("E", "use with caution")], "status string, meaning string")
    return catalogue.marks_legend(obs(spark, sf_dir), legend)


@add("""
WITH f AS (SELECT c_custkey AS pid, c_mktsegment AS family, c_custkey % 7 <> 0 AS captured, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AS built, CASE WHEN c_custkey % 7 = 0 THEN 1 + c_custkey % 2 ELSE 0 END AS attempts FROM customer)
SELECT family, count(*) AS inventory, count(*) FILTER (WHERE captured) AS captured, count(*) FILTER (WHERE built) AS built, count(*) FILTER (WHERE NOT captured) AS gaps, CAST(sum(attempts) AS BIGINT) AS attempts FROM f GROUP BY family
""")
def reconcile_capture(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("pid"), F.col("c_mktsegment").alias("family"))
    captured = c.where("pid % 7 <> 0")
    failures = c.where("pid % 7 = 0").select("pid", F.explode(F.sequence(F.lit(1), (1 + F.col("pid") % 2).cast("int"))).alias("attempt"), F.lit("timeout").alias("reason"))
    return catalogue.reconcile(c, captured, captured.where("pid % 5 <> 0"), failures)


@add(oracle(ORDERS, "SELECT pid, m1, m2, m3, label_1 || ' · ' || label_2 AS name, count(*) AS n_points, count(value_num) AS n_published FROM (SELECT * FROM obs WHERE m3 = 2)" + LABELS + " GROUP BY ALL"))
def series_slice(spark, sf_dir):
    return catalogue.series_slice(obs(spark, sf_dir).where("m3 = 2"), member(spark, sf_dir))


@add("SELECT lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS pid, concat_ws('-', substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 1, 2), substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 3, 2), substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 5, 4), '01') AS number, p_name AS title, 1990 AS period_min, 1990 + p_size AS period_max FROM part WHERE p_size % 2 = 0")
def cube_list(spark, sf_dir):
    t = tables(spark, sf_dir)["part"].select(F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("pid"), F.col("p_name").alias("title"), F.lit(1990).alias("period_min"), (F.lit(1990) + F.col("p_size")).alias("period_max"), (F.col("p_size") % 2 == 0).alias("queryable"))
    return catalogue.cube_list(t)
