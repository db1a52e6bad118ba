"""Queries of members' roles and selections, default coordinates, and the parts of a view's result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cubewright.operators import catalogue, places, results

from .cubes import ORDERS, cube, oracle, tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: Nations under regions under the world; the last five have the codes of the first, found by code only; every fifth has no place.
GEO = """geo AS (
  SELECT 'p' AS pid, 1 AS dimension_id, 1 AS member_id, 'World' AS member_name, CAST(NULL AS INT) AS parent_member_id, 'country' AS level, CAST(NULL AS STRING) AS geo_code, 'w' AS place_id UNION ALL
  SELECT 'p' AS pid, 1 AS dimension_id, CAST(r_regionkey + 2 AS INT) AS member_id, r_name AS member_name, 1 AS parent_member_id, 'schema:0001' AS level, CAST(r_regionkey AS STRING) AS geo_code, concat('r', CAST(r_regionkey AS STRING)) AS place_id FROM {region} UNION ALL
  SELECT 'p' AS pid, 1 AS dimension_id, CAST(n_nationkey + 7 AS INT) AS member_id, n_name AS member_name, CAST(n_regionkey + 2 AS INT) AS parent_member_id,
         CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE 'province' END AS level, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE lpad(CAST(n_nationkey % 20 AS STRING), 2, '0') END AS geo_code,
         CASE WHEN n_nationkey % 5 = 4 THEN NULL WHEN n_nationkey >= 20 THEN concat('code:0002:', lpad(CAST(n_nationkey % 20 AS STRING), 2, '0')) ELSE concat('2021A0002', lpad(CAST(n_nationkey AS STRING), 2, '0')) END AS place_id FROM {nation} UNION ALL
  SELECT 'p' AS pid, 2 AS dimension_id, 1 AS member_id, 'Both' AS member_name, CAST(NULL AS INT) AS parent_member_id, NULL AS level, NULL AS geo_code, NULL AS place_id UNION ALL
  SELECT 'p' AS pid, 2 AS dimension_id, 2 AS member_id, 'Other root' AS member_name, 77 AS parent_member_id, NULL AS level, NULL AS geo_code, NULL AS place_id
)"""
TERRITORIES = ("07", "13")


def geo(spark, sf_dir) -> DataFrame:
    return cube(spark, sf_dir, GEO, "geo")


ROLES = """, k AS (SELECT *, EXISTS (SELECT 1 FROM geo c WHERE c.dimension_id = g.dimension_id AND c.parent_member_id = g.member_id) AS parent, NOT EXISTS (SELECT 1 FROM geo c WHERE c.dimension_id = g.dimension_id AND c.member_id = g.parent_member_id) AS root,
  CASE WHEN level = 'country' THEN 'country' WHEN level = 'province' AND member_id >= 27 THEN 'region' WHEN level = 'province' AND geo_code IN ('07', '13') THEN 'territory' WHEN level IS NOT NULL AND level <> 'province' THEN 'region' ELSE level END AS l FROM geo g),
roles AS (SELECT pid, dimension_id, member_id, concat_ws(',', CASE WHEN root AND parent THEN 'total' END, l, CASE WHEN NOT parent THEN 'leaf' END) AS roles, CASE WHEN l IN ('province', 'territory') THEN geo_code END AS own_code, root FROM k)"""


@add(oracle(GEO, ROLES + " SELECT pid, dimension_id, member_id, roles, own_code FROM roles"))
def derive_member_roles(spark, sf_dir):
    return catalogue.derive_member_roles(geo(spark, sf_dir), TERRITORIES).withColumn("roles", F.array_join("roles", ","))


REGIONS = {"first": ["00", "01", "02", "03"], "mixed": ["07", "10", "99"]}
RULES = {
    "eq": ({"eq": 9}, "member_id = 9"), "label": ({"in": ["world", 8, "nobody"]}, "lower(member_name) = 'world' OR member_id = 8"), "role": ({"role": "territory"}, "roles LIKE '%territory%'"),
    "region": ({"region": "mixed"}, "own_code IN ('07', '10', '99')"), "children": ({"childrenOf": 1}, "parent_member_id = 1"),
    "below": ({"descendantsOf": "World"}, "dimension_id = 1 AND member_id > 1"), "contains": ({"contains": "Other"}, "lower(member_name) LIKE '%other%'"),
    "not": ({"not": {"any": [{"role": "leaf"}, {"eq": "World"}]}}, "NOT (roles LIKE '%leaf%' OR lower(member_name) = 'world')"),
    "and": ({"and": [{"descendantsOf": 3}, {"not": {"region": "first"}}, {"all": True}]}, "parent_member_id = 3 AND NOT coalesce(own_code IN ('00', '01', '02', '03'), false)"),
}


@add(oracle(GEO, ROLES + ", s AS (SELECT g.*, roles, own_code FROM geo g JOIN roles USING (pid, dimension_id, member_id)) " + " UNION ALL ".join(f"SELECT '{n}' AS rule, dimension_id, member_id FROM s WHERE {sql}" for n, (_, sql) in RULES.items())))
def member_selection(spark, sf_dir):
    member = geo(spark, sf_dir)
    rows = catalogue.selectable(member, catalogue.derive_member_roles(member, TERRITORIES), places.ancestors(member))
    return reduce(DataFrame.union, [rows.where(catalogue.selection(rule, REGIONS)).select(F.lit(n).alias("rule"), "dimension_id", "member_id") for n, (rule, _) in RULES.items()])


@add(oracle(GEO, " SELECT 'p' AS pid, d AS dimension_id, r AS reference FROM (SELECT DISTINCT dimension_id AS d FROM geo), (SELECT unnest(['world', '8', 'nobody', '900']) AS r) WHERE NOT EXISTS (SELECT 1 FROM geo WHERE dimension_id = d AND (lower(member_name) = r OR CAST(member_id AS VARCHAR) = r))"))
def missing_members(spark, sf_dir):
    return catalogue.missing_references(geo(spark, sf_dir), {"any": [{"in": ["World", 8, "nobody"]}, {"not": {"childrenOf": 900}}]})


@add(oracle(ORDERS, """, k AS (SELECT m.*, NOT EXISTS (SELECT 1 FROM member p WHERE p.dimension_id = m.dimension_id AND p.member_id = m.parent_member_id) AS root, EXISTS (SELECT 1 FROM member c WHERE c.dimension_id = m.dimension_id AND c.parent_member_id = m.member_id) AS parent FROM member m),
f AS (SELECT dimension_id, CASE WHEN count(*) FILTER (WHERE root AND parent) = 1 THEN min(member_id) FILTER (WHERE root AND parent) ELSE min(member_id) FILTER (WHERE root) END AS d FROM k GROUP BY 1),
r AS (SELECT k.dimension_id, member_id, CASE WHEN member_id = d THEN 0 WHEN root THEN 1 ELSE 2 END AS rank FROM k JOIN f USING (dimension_id)), l AS (SELECT DISTINCT ref_date FROM obs ORDER BY 1 DESC LIMIT 12)
SELECT '10000001' AS pid, m1, m2, m3 FROM obs JOIN r a ON a.dimension_id = 1 AND a.member_id = m1 JOIN r b ON b.dimension_id = 2 AND b.member_id = m2 JOIN r c ON c.dimension_id = 3 AND c.member_id = m3
WHERE ref_date IN (SELECT ref_date FROM l) AND value_num IS NOT NULL AND m1 > 1 ORDER BY a.rank, m1, b.rank, m2, c.rank, m3 LIMIT 1"""))
def ranked_default(spark, sf_dir):
    """The world itself is left out, so that the other ranks decide."""
    obs, member = cube(spark, sf_dir, ORDERS, "obs"), cube(spark, sf_dir, ORDERS, "member")
    bare = member.withColumns({c: F.lit(None).cast("string") for c in ("level", "geo_code", "place_id")})
    ranks = catalogue.default_ranks(member, catalogue.derive_member_roles(bare))
    dates = obs.select("pid", "ref_date").distinct().orderBy(F.desc("ref_date")).limit(12)
    return catalogue.ranked_default(obs.where("m1 > 1"), ranks, dates, 3)


NAMES = """coords AS (
  SELECT concat('1810', lpad(CAST(n_regionkey AS STRING), 4, '0')) AS pid, n_nationkey AS series_no, d AS dimension_id, CASE d WHEN 1 THEN concat('Group ', CAST(n_nationkey % 3 AS STRING)) WHEN 2 THEN ' Rate ' ELSE CASE WHEN n_nationkey % 2 = 0 THEN 'Old' ELSE '' END END AS label,
         (n_regionkey < 2 AND d IN (1, 3)) AS varying, d = 2 AND n_regionkey < 4 AS measure FROM {nation} CROSS JOIN (SELECT 1 AS d UNION ALL SELECT 2 AS d UNION ALL SELECT 3 AS d) x
), titles AS (SELECT concat('1810', lpad(CAST(r_regionkey AS STRING), 4, '0')) AS pid, r_name AS title FROM {region})"""


@add(oracle(NAMES, """, l AS (SELECT pid, series_no, string_agg(trim(label), ' · ' ORDER BY dimension_id) FILTER (WHERE varying AND trim(label) <> '') AS v, string_agg(trim(label), ' · ' ORDER BY dimension_id) FILTER (WHERE measure AND trim(label) <> '') AS m FROM coords GROUP BY 1, 2),
n AS (SELECT pid, series_no, coalesce(v, m, title) AS name FROM l JOIN titles USING (pid)) SELECT pid, series_no, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || ' (' || substr(pid, 1, 2) || '-' || substr(pid, 3, 2) || '-' || substr(pid, 5, 4) || '-01)' ELSE name END AS name FROM n"""))
def varying_names(spark, sf_dir):
    return results.series_names(cube(spark, sf_dir, NAMES, "coords"), cube(spark, sf_dir, NAMES, "titles"))


WARN = """layers AS (SELECT r_regionkey AS layer, r_name AS title, CASE WHEN r_regionkey = 4 THEN 'census' ELSE 'ordinary' END AS family, CASE WHEN r_regionkey = 3 THEN 'annual' ELSE 'monthly' END AS frequency, r_regionkey AS n_selected,
  r_regionkey = 1 AS sum_refused, r_regionkey = 2 AS method_difference, r_regionkey = 2 AS substituted, r_regionkey = 3 AS proxy, r_regionkey = 4 AS chart_fallback FROM {region}),
series AS (SELECT s_nationkey % 5 AS layer, s_name AS name, concat('u', CAST(s_suppkey % 3 AS STRING)) AS unit, 'units' AS scale, s_suppkey % 9 = 0 AS unpublished, s_suppkey % 11 = 0 AS base_missing FROM {supplier}),
groups AS (SELECT n_regionkey AS layer, n_name AS label, CASE n_nationkey % 4 WHEN 0 THEN 'group_not_combined' WHEN 1 THEN 'group_published_unavailable' END AS warning, n_nationkey % 6 = 0 AS partial, n_nationkey % 7 = 0 AS missing FROM {nation})"""


@add(oracle(WARN, """ SELECT 'mixed_family' AS code, '' AS subject UNION ALL SELECT 'mixed_frequency', '' UNION ALL SELECT 'mixed_units', '' WHERE (SELECT count(DISTINCT unit) FROM series WHERE NOT unpublished) >= 2 UNION ALL SELECT 'series_capped', '' WHERE (SELECT count(*) FROM series) > 40
UNION ALL SELECT 'no_data', name FROM series WHERE unpublished UNION ALL SELECT 'index_base_missing', name FROM series WHERE base_missing UNION ALL SELECT 'sum_refused', title FROM layers WHERE layer = 1 UNION ALL SELECT 'empty_selection', title FROM layers WHERE layer = 0
UNION ALL SELECT 'member_not_found', title || ' x' FROM layers WHERE layer % 2 = 1 UNION ALL SELECT 'group_method_difference', title FROM layers WHERE layer = 2 UNION ALL SELECT 'substituted_geography', title FROM layers WHERE layer = 2 UNION ALL SELECT 'territory_proxy', title FROM layers WHERE layer = 3
UNION ALL SELECT 'chart_fallback', title FROM layers WHERE layer = 4 UNION ALL SELECT warning, label FROM groups WHERE warning IS NOT NULL UNION ALL SELECT 'group_partial', label FROM groups WHERE partial UNION ALL SELECT 'group_missing', label FROM groups WHERE missing"""))
def all_warnings(spark, sf_dir):
    layers = cube(spark, sf_dir, WARN, "layers").withColumn("not_found", F.when(F.col("layer") % 2 == 1, F.array(F.concat("title", F.lit(" x")))).otherwise(F.array().cast("array<string>")))
    return results.view_warnings(layers, cube(spark, sf_dir, WARN, "series"), cube(spark, sf_dir, WARN, "groups"))


NOTES = """members AS (SELECT concat('1810', lpad(CAST(n_regionkey AS STRING), 4, '0')) AS pid, concat('G', CAST(n_nationkey % 2 AS STRING)) AS group_name, n_nationkey AS position, n_name AS member_name FROM {nation}),
groups AS (SELECT pid, group_name, CASE WHEN substr(pid, 8, 1) = '0' THEN 'ratio' WHEN substr(pid, 8, 1) = '1' THEN 'published' WHEN substr(pid, 8, 1) = '2' THEN 'sum' ELSE 'not_combined' END AS method, concat('All of ', group_name) AS published_as FROM members GROUP BY pid, group_name),
ratios AS (SELECT '18100000' AS pid, 'Unemployed' AS numerator, 'Labour' AS denominator, 100 AS scale),
gaps AS (SELECT concat('1810', lpad(CAST(s_nationkey % 5 AS STRING), 4, '0')) AS pid, concat('S', CAST(s_suppkey % 2 AS STRING)) AS series_name, 'Not published' AS meaning, s_suppkey AS start, s_suppkey + 1 AS stop FROM {supplier}),
tables AS (SELECT concat('1810', lpad(CAST(r_regionkey AS STRING), 4, '0')) AS pid, r_name AS title, CASE WHEN r_regionkey > 1 THEN '2024-05-06T01:02:03Z' END AS captured_at FROM {region})"""
FORMULA = """, names AS (SELECT pid, group_name, string_agg(member_name, ', ' ORDER BY position) AS members FROM members GROUP BY 1, 2),
notes AS (SELECT pid, group_name, method, members, CASE method WHEN 'ratio' THEN 'Unemployed ÷ Labour × 100' WHEN 'published' THEN 'published as ' || published_as WHEN 'sum' THEN 'sum of ' || members ELSE 'shown as individual members' END AS formula FROM groups JOIN names USING (pid, group_name))"""


def notes(spark, sf_dir):
    part = lambda n: cube(spark, sf_dir, NOTES, n)
    return results.group_notes(part("groups"), part("members"), part("ratios"))


@add(oracle(NOTES, FORMULA + " SELECT * FROM notes"))
def group_formulas(spark, sf_dir):
    return notes(spark, sf_dir)


@add(oracle(NOTES, FORMULA + """, g AS (SELECT pid, string_agg(series_name || ': ' || meaning || ' ' || start || '–' || stop, '; ' ORDER BY series_name, start) AS t FROM (SELECT *, row_number() OVER (PARTITION BY pid, series_name ORDER BY start) AS n FROM gaps) WHERE n <= 3 GROUP BY 1),
m AS (SELECT pid, string_agg(group_name || ': ' || formula || '; members: ' || members, '; ' ORDER BY group_name || ': ' || formula) AS t FROM notes GROUP BY 1)
SELECT pid, substr(captured_at, 1, 10) AS captured, concat_ws('; ', 'Table ' || substr(pid, 1, 2) || '-' || substr(pid, 3, 2) || '-' || substr(pid, 5, 4) || '-01, ' || title, m.t, g.t) AS citation FROM tables LEFT JOIN m USING (pid) LEFT JOIN g USING (pid)"""))
def full_citations(spark, sf_dir):
    found = cube(spark, sf_dir, NOTES, "tables")
    gaps = cube(spark, sf_dir, NOTES, "gaps").withColumnsRenamed({"start": "from", "stop": "to"})
    return results.citations(found.select("pid", "title"), notes(spark, sf_dir), gaps, found.select("pid", "captured_at"))


UNITS = "u AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Thousands of persons' WHEN 1 THEN 'Dollars in millions' WHEN 2 THEN 'Tonnes (thousands)' WHEN 3 THEN 'Percent' ELSE 'thousands' END AS unit, CASE p_partkey % 5 WHEN 1 THEN 'millions' WHEN 3 THEN 'units' ELSE 'thousands' END AS scale FROM {part})"


@add(oracle(UNITS, " SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Persons' WHEN 1 THEN 'Dollars' WHEN 2 THEN 'Tonnes' ELSE unit END AS scaled_unit, 'units' AS scaled_scale, unit AS plain_unit, 'units' AS plain_scale FROM u"))
def display_units(spark, sf_dir):
    a, b = results.display_unit(F.col("unit"), F.col("scale"), True), results.display_unit(F.col("unit"), F.col("scale"), False)
    return cube(spark, sf_dir, UNITS, "u").select("p_partkey", a["unit"].alias("scaled_unit"), a["scale"].alias("scaled_scale"), b["unit"].alias("plain_unit"), b["scale"].alias("plain_scale"))


@add("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN 'Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) WHEN 2 THEN strftime(o_orderdate, '%b %Y') WHEN 3 THEN strftime(o_orderdate, '%b %-d, %Y') ELSE 'first' END AS label FROM orders")
def base_labels(spark, sf_dir):
    base = F.expr("CASE o_orderkey % 5 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) WHEN 1 THEN concat(CAST(year(o_orderdate) AS STRING), '-Q', CAST(quarter(o_orderdate) AS STRING)) WHEN 2 THEN substr(CAST(o_orderdate AS STRING), 1, 7) WHEN 3 THEN substr(CAST(o_orderdate AS STRING), 1, 10) END")
    return tables(spark, sf_dir)["orders"].select("o_orderkey", results.base_label(base).alias("label"))
