"""Queries of places and hierarchies over the orders cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cubewright.operators import places

from .cubes import ORDERS, cube, oracle, tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add

ALIAS = ", alias AS (SELECT lpad(CAST(n_nationkey AS STRING), 2, '0') AS alias_code, '0002' AS alias_schema, lpad(CAST(n_nationkey AS STRING), 2, '0') AS alias_geo FROM {nation} WHERE n_nationkey % 10 = 4)"
#: A second table names places without ids; two of its nations share a name.
TWO = ", two AS (SELECT pid, member_id, member_name, parent_member_id, dguid, code FROM member WHERE dimension_id = 1 UNION ALL SELECT '10000003', n_nationkey + 7, CASE WHEN n_nationkey = 3 THEN 'NATION_2' ELSE n_name END, CAST(1 AS INT), '', '' FROM {nation})"
MAPPED = """, d AS (SELECT *, regexp_full_match(dguid, '\\d{{4}}[AS]\\d{{4}}\\S+') AS ok, regexp_extract(code, '\\[([^\\]]*)\\]', 1) AS c FROM two),
f AS (SELECT d.*, CASE WHEN ok AND (c = '' OR c = substr(dguid, 10)) THEN dguid WHEN alias_code IS NOT NULL THEN 'code:' || alias_schema || ':' || alias_geo END AS p1,
      CASE WHEN ok AND (c = '' OR c = substr(dguid, 10)) THEN 'dguid' WHEN alias_code IS NOT NULL THEN 'code' END AS k1, coalesce(CASE WHEN ok THEN substr(dguid, 6, 4) END, alias_schema) AS sch FROM d LEFT JOIN alias ON c = alias_code),
nm AS (SELECT lower(member_name) AS nk, min(p1) AS np FROM f WHERE p1 IS NOT NULL AND sch IN ('0000', '0002') GROUP BY 1 HAVING count(DISTINCT p1) = 1),
mapped AS (SELECT pid, member_id, member_name, parent_member_id, coalesce(p1, np) AS place_id, coalesce(k1, CASE WHEN np IS NOT NULL THEN 'name' END, 'none') AS match FROM f LEFT JOIN nm ON lower(member_name) = nk)"""


def members(spark, sf_dir) -> DataFrame:
    return cube(spark, sf_dir, ORDERS, "member")


def mapped(spark, sf_dir) -> DataFrame:
    return places.map_places(cube(spark, sf_dir, ORDERS + ALIAS + TWO, "two"), cube(spark, sf_dir, ORDERS + ALIAS, "alias"))


def sql(text: str) -> str:
    return oracle(ORDERS + ALIAS + TWO + MAPPED, text)


@add(sql(" SELECT pid, member_id, member_name, parent_member_id, place_id, match FROM mapped"))
def map_places(spark, sf_dir):
    return mapped(spark, sf_dir)


@add(sql(", n AS (SELECT place_id, member_name, count(*) AS n FROM mapped WHERE place_id IS NOT NULL GROUP BY 1, 2) SELECT place_id, member_name FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY n DESC, member_name) AS r FROM n) WHERE r = 1"))
def place_name(spark, sf_dir):
    return places.place_names(mapped(spark, sf_dir))


PARENTS = ", pc AS (SELECT a.place_id, b.place_id AS parent_place FROM mapped a JOIN mapped b ON a.pid = b.pid AND a.parent_member_id = b.member_id WHERE a.place_id <> b.place_id)"


@add(sql(PARENTS + ", n AS (SELECT place_id, parent_place, count(*) AS n FROM pc GROUP BY 1, 2) SELECT place_id, parent_place FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY n DESC, parent_place) AS r FROM n) WHERE r = 1"))
def place_parent(spark, sf_dir):
    return places.place_parents(mapped(spark, sf_dir))


@add(sql(PARENTS + " SELECT count(*) AS conflicts FROM (SELECT place_id FROM pc GROUP BY 1 HAVING count(DISTINCT parent_place) > 1)"))
def parent_conflicts(spark, sf_dir):
    return places.parent_conflicts(mapped(spark, sf_dir))


@add(sql(" SELECT match, count(*) AS n FROM mapped GROUP BY match"))
def place_match_counts(spark, sf_dir):
    return places.match_counts(mapped(spark, sf_dir))


@add(sql(" SELECT pid, count(place_id) AS mapped, count(*) - count(place_id) AS unmapped, coalesce(string_agg(DISTINCT lv, ',' ORDER BY lv), '') AS levels FROM (SELECT *, CASE WHEN place_id LIKE '2021A%' THEN CASE substr(place_id, 6, 4) WHEN '0000' THEN 'country' WHEN '0002' THEN 'province' ELSE 'schema:' || substr(place_id, 6, 4) END END AS lv FROM mapped) GROUP BY pid"))
def place_levels(spark, sf_dir):
    return places.place_levels(mapped(spark, sf_dir))


@add(sql(", p AS (SELECT DISTINCT place_id FROM mapped WHERE place_id IS NOT NULL UNION ALL SELECT 'nowhere') SELECT p.place_id, (SELECT count(DISTINCT pid) FROM mapped m WHERE m.place_id = p.place_id) AS n_tables FROM p"))
def place_table_counts(spark, sf_dir):
    found = mapped(spark, sf_dir)
    known = found.where("place_id is not null").select("place_id").distinct()
    return places.place_table_counts(known.union(spark.createDataFrame([("nowhere",)], "place_id string")), found)


@add(oracle(ORDERS, "SELECT pid, dimension_id, member_id, CAST(CASE WHEN parent_member_id IS NULL THEN 0 WHEN dimension_id = 1 AND member_id >= 7 THEN 2 ELSE 1 END AS INT) AS depth FROM member"))
def member_depth(spark, sf_dir):
    return places.member_depth(members(spark, sf_dir))


@add(oracle(ORDERS, "SELECT pid, dimension_id, member_id FROM member WHERE dimension_id = 1 AND (parent_member_id = 3 OR member_id = 3 AND false)"))
def descendants(spark, sf_dir):
    start = spark.createDataFrame([("10000001", 1, 3)], "pid string, dimension_id int, member_id int")
    return places.descendants(members(spark, sf_dir), start)


@add(oracle(ORDERS, "SELECT pid, dimension_id, member_id, CASE WHEN member_id % 2 = 1 AND parent_member_id % 2 = 0 THEN parent_member_id WHEN parent_member_id % 2 = 1 AND member_id >= 7 THEN CAST(NULL AS INT) END AS ancestor FROM member WHERE dimension_id = 1 AND member_id % 2 = 1"))
def nearest_published_ancestor(spark, sf_dir):
    geo = members(spark, sf_dir).where("dimension_id = 1")
    even = geo.where("member_id % 2 = 0").select("pid", "dimension_id", "member_id")
    return places.nearest_published(geo, even)


@add("""
WITH w AS (SELECT '10000001' AS pid, r.r_name AS region, n.n_nationkey FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey)
SELECT pid, region, count(*) AS n_codes, count(*) FILTER (WHERE n_nationkey % 5 <> 4) AS n_present, coalesce(string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY CAST(n_nationkey AS VARCHAR)) FILTER (WHERE n_nationkey % 5 = 4), '') AS missing FROM w GROUP BY pid, region
""")
def group_coverage(spark, sf_dir):
    t = tables(spark, sf_dir)
    wanted = t["region"].join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("region"), F.col("n_nationkey").cast("string").alias("code"))
    have = t["nation"].where("n_nationkey % 5 <> 4").select(F.lit("10000001").alias("pid"), F.col("n_nationkey").cast("string").alias("code"))
    return places.group_coverage(wanted, have)


PLACES = " SELECT concat('2021A0002', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS place_id, lpad(CAST(n_nationkey AS STRING), 2, '0') AS geo_code, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'country' WHEN n_nationkey % 3 = 1 THEN 'province' ELSE 'other' END AS level, 2021 AS vintage FROM {nation}"


@add("SELECT *, CAST(row_number() OVER (ORDER BY CASE level WHEN 'country' THEN 0 WHEN 'province' THEN 1 ELSE 2 END, name, vintage DESC, place_id) AS INT) AS position FROM (" + PLACES.format(nation="nation") + ") WHERE lower(name) LIKE '%nation%' AND lower(name) LIKE '%1%'")
def place_search(spark, sf_dir):
    return places.place_search(spark.sql(PLACES, nation=tables(spark, sf_dir)["nation"]), "nation 1")


@add(r"""
SELECT text_id, name, CAST(instr(lower(text), lower(name)) AS INT) AS at FROM (SELECT s_suppkey AS text_id, 'orders of NATION_' || CAST(s_nationkey AS VARCHAR) || ', then ' || r_name AS text FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region)
WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || lower(name) || '($|[^a-z0-9])')
""")
def match_place_mentions(spark, sf_dir):
    t = tables(spark, sf_dir)
    joined = t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    texts = joined.select(F.col("s_suppkey").alias("text_id"), F.concat(F.lit("orders of NATION_"), F.col("s_nationkey").cast("string"), F.lit(", then "), "r_name").alias("text"))
    return places.mentions(texts, t["nation"].select(F.col("n_name").alias("name")).union(t["region"].select("r_name")))
