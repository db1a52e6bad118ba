"""Queries of whole views over the two cubes: layers, groups, ratios, changes, shares, axes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubewright.operators import view_run

from .cubes import LINES, ORDERS, cube, oracle
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add

def dated(df):
    return df.withColumn("period_start", F.to_date(F.concat("ref_date", F.lit("-01"))))


def orders(spark, sf_dir):
    return dated(cube(spark, sf_dir, ORDERS, "obs")).withColumn("scalar_id", F.lit(0))


def lines(spark, sf_dir):
    return dated(cube(spark, sf_dir, LINES, "obs"))


def two_layers(spark, sf_dir):
    """Orders of two regions and of the other three together; line items of three nations together by flag."""
    first = {"m1": {"use": "series", "members": [2, 3], "groups": [{"label": "rest", "members": [4, 5, 6]}]}, "m2": {"use": "fixed", "members": [1]}, "m3": {"use": "fixed", "members": [1]}}
    second = {"m1": {"use": "sum", "members": [1, 2, 3]}, "m2": {"use": "series", "members": [1, 3]}, "m3": {"use": "fixed", "members": [1]}}
    return [{"obs": orders(spark, sf_dir), "dims": first, "kind": "month"}, {"obs": lines(spark, sf_dir), "dims": second, "kind": "month"}]


A = "SELECT CAST(0 AS INT) AS layer, CASE WHEN m1 < 4 THEN 'm1=' || m1 ELSE 'm1=g:rest' END AS series, CAST(ref_date || '-01' AS DATE) AS d, CASE WHEN count(DISTINCT CASE WHEN value_num IS NOT NULL THEN m1 END) = CASE WHEN min(m1) < 4 THEN 1 ELSE 3 END THEN sum(value_num) END AS v FROM {o} WHERE m1 BETWEEN 2 AND 6 AND m2 = 1 AND m3 = 1 GROUP BY 2, 3"
B = "SELECT CAST(1 AS INT) AS layer, 'm2=' || m2 AS series, CAST(ref_date || '-01' AS DATE) AS d, CASE WHEN count(DISTINCT m1) = 3 THEN sum(value_num) END AS v FROM {l} WHERE m1 <= 3 AND m2 IN (1, 3) AND m3 = 1 GROUP BY 2, 3"
#: Both cubes' derivations under one WITH; the second's frames get names of their own.
BOTH = ORDERS + ", " + LINES.replace("cells AS", "line_cells AS").replace("obs AS", "line_obs AS").replace("FROM cells", "FROM line_cells") + ", p AS (" + A.format(o="obs") + " UNION ALL " + B.format(l="line_obs") + "), n AS (SELECT layer, d, row_number() OVER (PARTITION BY layer ORDER BY d) AS n FROM (SELECT DISTINCT layer, d FROM p)), k AS (SELECT DISTINCT layer, series FROM p), "
CHANGE = BOTH + "c AS (SELECT p.layer, p.series, p.d, CASE WHEN q.v <> 0 THEN (p.v / q.v - 1) * 100 END AS v FROM p JOIN n ON p.layer = n.layer AND p.d = n.d LEFT JOIN n m ON m.layer = n.layer AND m.n = n.n - 12 LEFT JOIN p q ON q.layer = p.layer AND q.series = p.series AND q.d = m.d), w AS (SELECT * FROM c WHERE d >= (SELECT max(d) FROM c) - INTERVAL 2 YEAR)"


@add(oracle(CHANGE, ", g AS (SELECT k.layer, k.series, x.d FROM k CROSS JOIN (SELECT DISTINCT d FROM p WHERE d >= (SELECT max(d) FROM p) - INTERVAL 2 YEAR) x) SELECT g.layer, g.series, g.d AS period_start, round(w.v, 6) AS value FROM g LEFT JOIN w USING (layer, series, d)"))
def view_of_layers(spark, sf_dir):
    found = view_run.run_view(two_layers(spark, sf_dir), {"preset": "2Y"}, "pct_change_yoy")["points"]
    return found.select("layer", "series", "period_start", F.round("value", 6).alias("value"))


@add(oracle(BOTH, "s AS (SELECT layer, series, min(d) FILTER (WHERE v IS NOT NULL) AS first, max(d) FILTER (WHERE v IS NOT NULL) AS last, count(v) = 0 AS unpublished FROM p GROUP BY 1, 2) SELECT layer, series, CASE layer WHEN 0 THEN '223' ELSE '17' END AS unit, first, last, unpublished, CAST(layer AS INT) AS axis, (SELECT count(*) FROM k) AS total FROM s"))
def view_series(spark, sf_dir):
    return view_run.run_view(two_layers(spark, sf_dir))["series"].select("layer", "series", "unit", "first", "last", "unpublished", "axis", "total")


@add(oracle(ORDERS, """, p AS (SELECT m3, m1, ref_date, value_num AS v FROM obs WHERE m1 BETWEEN 2 AND 6 AND m2 = 1), f AS (SELECT ref_date FROM p GROUP BY 1 HAVING count(v) = 10 ORDER BY 1 DESC LIMIT 1)
SELECT 'm3=' || m3 AS series, CAST(m1 AS VARCHAR) AS category, CAST(ref_date || '-01' AS DATE) AS period_start, round(v / sum(v) OVER (PARTITION BY m3) * 100, 6) AS value FROM p WHERE ref_date = (SELECT ref_date FROM f)"""))
def view_share_by_category(spark, sf_dir):
    dims = {"m1": {"use": "x", "members": [2, 3, 4, 5, 6]}, "m2": {"use": "fixed", "members": [1]}, "m3": {"use": "series", "members": [1, 2]}}
    found = view_run.run_view([{"obs": orders(spark, sf_dir), "dims": dims, "kind": "month"}], transform="share_of_x")["points"]
    return found.select("series", "category", "period_start", F.round("value", 6).alias("value"))


@add(oracle(ORDERS, """, e AS (SELECT ref_date, m1, max(value_num) FILTER (WHERE m3 = 2) AS a, max(value_num) FILTER (WHERE m3 = 1) AS b FROM obs WHERE m1 IN (2, 3, 4, 5) AND m2 = 1 GROUP BY 1, 2), g AS (SELECT 'm1=g:west' AS series, ref_date, m1, a, b FROM e WHERE m1 IN (2, 3) UNION ALL SELECT 'm1=g:east', ref_date, m1, a, b FROM e WHERE m1 IN (4, 5))
SELECT series, CAST(ref_date || '-01' AS DATE) AS period_start, CASE WHEN count(a) = 2 AND count(b) = 2 THEN round(sum(a) / sum(b) * 0.5, 4) END AS value FROM g WHERE ref_date BETWEEN '1994-01' AND '1995-12' GROUP BY 1, 2"""))
def view_of_ratios(spark, sf_dir):
    """The price of an order in two groups of regions: a ratio of their sums, not of their ratios."""
    ratio = {"column": "m3", "numerator": 2, "denominator": 1, "scale": 0.5}
    dims = {"m1": {"use": "series", "members": [], "groups": [{"label": "west", "members": [2, 3], "ratio": ratio}, {"label": "east", "members": [4, 5], "ratio": ratio}]}, "m2": {"use": "fixed", "members": [1]}, "m3": {"use": "fixed", "members": [1]}}
    found = view_run.run_view([{"obs": orders(spark, sf_dir), "dims": dims, "kind": "month"}], {"from": "1994-01-01", "to": "1995"})["points"]
    return found.select("series", "period_start", F.round("value", 4).alias("value"))


FIXED = {"use": "fixed", "members": [1]}


@add(oracle(ORDERS, """, s AS (SELECT a.m1, b.m2, row_number() OVER (ORDER BY a.i, b.i) - 1 AS n FROM (SELECT i, CASE WHEN i = 40 THEN 99 ELSE (i * 7) % 32 + 1 END AS m1 FROM range(41) r(i) WHERE i < 32 OR i = 40) a, (VALUES (0, 3), (1, 1)) b(i, m2))
SELECT CAST(n AS INT) AS position, 'm1=' || s.m1 || ',m2=' || s.m2 AS series, min(CAST(ref_date || '-01' AS DATE)) FILTER (WHERE value_num IS NOT NULL) AS first, count(value_num) = 0 AS unpublished, CAST(66 AS BIGINT) AS total
FROM s LEFT JOIN obs ON obs.m1 = s.m1 AND obs.m2 = s.m2 AND m3 = 1 WHERE n < 40 GROUP BY n, s.m1, s.m2"""))
def view_in_order(spark, sf_dir):
    """66 series in the order of the selection, of which the first 40 are shown; two members have no rows."""
    members = [(i * 7) % 32 + 1 for i in range(32)] + [99]
    layer = {"obs": orders(spark, sf_dir), "kind": "month", "dims": {"m1": {"use": "series", "members": members}, "m2": {"use": "series", "members": [3, 1]}, "m3": FIXED}}
    return view_run.run_view([layer])["series"].select("position", "series", "first", "unpublished", "total")


@add(oracle(ORDERS, """, p AS (SELECT CASE WHEN m1 IN (4, 5) THEN 'A|B' ELSE CAST(m1 AS VARCHAR) END AS category, m3, sum(value_num) AS v FROM obs WHERE m1 BETWEEN 2 AND 5 AND m2 = 1 AND ref_date = (SELECT max(ref_date) FROM obs WHERE ref_date LIKE '1995%') GROUP BY 1, 2),
t AS (SELECT category, row_number() OVER (ORDER BY sum(v) DESC) - 1 AS k FROM p GROUP BY 1)
SELECT 'm3=' || m3 AS series, category, CAST(k AS INT) AS category_position, DATE '1995-12-01' AS period_start, round(v, 4) AS value FROM p JOIN t USING (category)"""))
def view_snapshot(spark, sf_dir):
    """Categories at the last date of a year, by falling sums; a group's name holds a bar."""
    dims = {"m1": {"use": "x", "members": [2, 3], "groups": [{"label": "A|B", "members": [4, 5]}]}, "m2": FIXED, "m3": {"use": "series", "members": [1, 2]}}
    found = view_run.run_view([{"obs": orders(spark, sf_dir), "dims": dims, "kind": "month"}], {"at": "1995"}, sort="desc")["points"]
    return found.select("series", "category", "category_position", "period_start", F.round("value", 4).alias("value"))


@add(oracle(BOTH.rsplit(", p AS", 1)[0], """, a AS (SELECT ref_date, value_num AS v FROM obs WHERE m1 = 1 AND m2 = 1 AND m3 = 1 AND ref_date BETWEEN '1994-03' AND '1995-06'), b AS (SELECT ref_date, sum(value_num) AS v FROM line_obs WHERE m1 = 1 AND m2 = 1 AND m3 = 1 AND ref_date >= '1993-11' AND ref_date <> '1994-05' GROUP BY 1),
d AS (SELECT ref_date FROM a UNION SELECT ref_date FROM b)
SELECT 0::INT AS layer, 'm1=1' AS series, CAST(d.ref_date || '-01' AS DATE) AS period_start, v AS value FROM d LEFT JOIN a ON a.ref_date = d.ref_date UNION ALL SELECT 0, 'm1=77', CAST(ref_date || '-01' AS DATE), NULL FROM d
UNION ALL SELECT 1, 'm2=1', CAST(d.ref_date || '-01' AS DATE), v FROM d LEFT JOIN b ON b.ref_date = d.ref_date"""))
def view_on_shared_dates(spark, sf_dir):
    """Two layers with other dates, and a member without rows: all series at the dates of both."""
    first = {"obs": orders(spark, sf_dir).where("ref_date between '1994-03' and '1995-06'"), "kind": "month", "dims": {"m1": {"use": "series", "members": [1, 77]}, "m2": FIXED, "m3": FIXED}}
    second = {"obs": lines(spark, sf_dir).where("ref_date >= '1993-11' and ref_date <> '1994-05'"), "kind": "month", "dims": {"m1": FIXED, "m2": {"use": "series", "members": [1]}, "m3": FIXED}}
    return view_run.run_view([first, second])["points"].select("layer", "series", "period_start", "value")


@add(oracle(BOTH.rsplit(", p AS", 1)[0], "SELECT * FROM (VALUES (0::INT, 'm3=2', '81', '0', 0::INT), (0, 'm3=1', '223', '0', 1), (0, 'm3=9', '81', '0', 0)) v(layer, series, unit, scale, axis)"))
def view_of_three_units(spark, sf_dir):
    """A third unit has no axis; a series without rows has its layer's."""
    first = {"obs": orders(spark, sf_dir), "kind": "month", "dims": {"m1": FIXED, "m2": FIXED, "m3": {"use": "series", "members": [2, 9, 1]}}}
    second = {"obs": lines(spark, sf_dir), "kind": "month", "dims": {"m1": {"use": "series", "members": [1, 2, 3]}, "m2": FIXED, "m3": FIXED}}
    return view_run.run_view([first, second])["series"].select("layer", "series", "unit", "scale", "axis")


@add(oracle(ORDERS, """, a AS (SELECT m1, value_num AS v FROM obs WHERE m1 IN (3, 2, 6) AND m2 = 1 AND m3 = 1 AND ref_date = '1996-02'), b AS (SELECT m2, value_num AS v FROM obs WHERE m1 = 1 AND m2 IN (2, 3) AND m3 = 1 AND ref_date = '1996-02')
SELECT 0::INT AS layer, '' AS series, CAST(m1 AS VARCHAR) AS category, CAST(CASE m1 WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INT) AS category_position, v AS value FROM a UNION ALL SELECT 1, 'm2=' || m2, c, k, v FROM b, (VALUES ('3', 0), ('2', 1), ('6', 2)) x(c, k)"""))
def view_repeats_over_categories(spark, sf_dir):
    first = {"m1": {"use": "x", "members": [3, 2, 6]}, "m2": FIXED, "m3": FIXED}
    second = {"m1": FIXED, "m2": {"use": "series", "members": [2, 3]}, "m3": FIXED}
    obs = orders(spark, sf_dir)
    found = view_run.run_view([{"obs": obs, "dims": d, "kind": "month"} for d in (first, second)], {"at": "1996-02"})["points"]
    return found.select("layer", "series", "category", "category_position", "value")
