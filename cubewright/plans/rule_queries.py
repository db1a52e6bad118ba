"""Queries of the view's rules: changes by kind of period, windows, groups with their methods, gaps, cards, readiness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cubewright.operators import view

from .cubes import LINES, ORDERS, cube, oracle, tables
from .registering import Registry
from .view_queries import NATIONS, REGIONS, points

REGISTRY = Registry()
add = REGISTRY.add

#: Orders' prices by region and period, one layer for each kind of period.
KINDS = {
    "month": "CAST(date_trunc('month', o_orderdate) AS DATE)", "quarter": "CAST(date_trunc('quarter', o_orderdate) AS DATE)", "week": "CAST(date_trunc('week', o_orderdate) AS DATE)",
    "half_year": "make_date(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1)", "year": "make_date(year(o_orderdate), 1, 1)", "day": "CAST(o_orderdate AS DATE)",
}
BY_KIND = "d AS (" + " UNION ALL ".join(
    f"SELECT CAST({i} AS INT) AS layer, '{kind}' AS kind, CAST(n_regionkey AS STRING) AS series, {start} AS period_start, CAST(o_totalprice AS DOUBLE) AS price FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey"
    for i, (kind, start) in enumerate(KINDS.items(), 1)
) + "), points AS (SELECT layer, kind, series, period_start, sum(price) AS value FROM d GROUP BY layer, kind, series, period_start)"


def rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns or ("value",)})


@add(oracle(BY_KIND, """, n AS (SELECT layer, kind, period_start, row_number() OVER (PARTITION BY layer ORDER BY period_start) AS n FROM (SELECT DISTINCT layer, kind, period_start FROM points)),
s AS (SELECT a.layer, a.period_start, b.period_start AS prior FROM n a JOIN n b ON a.layer = b.layer AND b.n = a.n - CASE a.kind WHEN 'month' THEN 12 WHEN 'quarter' THEN 4 WHEN 'half_year' THEN 2 WHEN 'week' THEN 52 ELSE 1 END WHERE a.kind <> 'day'
      UNION ALL SELECT layer, period_start, TRY_CAST(CAST(year(period_start) - 1 AS VARCHAR) || strftime(period_start, '-%m-%d') AS DATE) FROM n WHERE kind = 'day')
SELECT p.layer, p.series, p.period_start, CASE WHEN b.value <> 0 THEN round((p.value / b.value - 1) * 100, 4) END AS value
FROM points p LEFT JOIN s ON s.layer = p.layer AND s.period_start = p.period_start LEFT JOIN points b ON b.layer = p.layer AND b.series = p.series AND b.period_start = s.prior"""))
def yoy_by_kind(spark, sf_dir):
    """A year back is so many dates of the layer as its kind of period says, or the same calendar day."""
    frame = cube(spark, sf_dir, BY_KIND, "points")
    kinds = spark.createDataFrame(list(enumerate(KINDS, 1)), "layer int, kind string")
    return rounded(view.pct_change_yoy(frame.drop("kind"), kinds))


@add(oracle(ORDERS, REGIONS + """, w AS (SELECT 'latest' AS "window", p.* FROM points p WHERE period_start = (SELECT max(period_start) FROM points) UNION ALL SELECT 'max', * FROM points
UNION ALL SELECT '2Y', * FROM points WHERE period_start > (SELECT max(period_start) - INTERVAL 2 YEAR FROM points) UNION ALL SELECT '2Y changes', * FROM points WHERE period_start >= (SELECT max(period_start) - INTERVAL 2 YEAR FROM points)
UNION ALL SELECT 'at', * FROM points WHERE year(period_start) = 1995 AND month(period_start) = 3 UNION ALL SELECT 'bounds', * FROM points WHERE period_start >= DATE '1994-05-01' AND period_start < DATE '1996-01-01')
SELECT "window", series, period_start, value FROM w"""))
def time_presets(spark, sf_dir):
    p = points(spark, sf_dir, REGIONS)
    windows = {"latest": {"preset": "latest"}, "max": {}, "2Y": {"preset": "2Y"}, "2Y changes": {"preset": "2Y", "changes": True}, "at": {"at": "1995-03"}, "bounds": {"from_": "1994-05-01", "to": "1995"}}
    whole = None
    for name, how in windows.items():
        part = view.window_bounds(p, **how).select(F.lit(name).alias("window"), "series", "period_start", "value")
        whole = part if whole is None else whole.union(part)
    return whole


#: Line items by nation and month: three measures, each with its own scale; region groups.
CELLS = LINES + """, parts AS (
  SELECT m1, m2, ref_date, min(CAST(price AS DOUBLE)) AS value_num, CAST(m2 - 1 AS INT) AS scalar_id FROM cells WHERE m3 = 1 OR m2 = 2 GROUP BY m1, m2, ref_date
), groups AS (SELECT r_name AS group_name, n_nationkey + 1 AS member FROM {region} JOIN {nation} ON r_regionkey = n_regionkey)"""


@add(oracle(CELLS, """ SELECT g.group_name, p.m2, p.ref_date, CASE WHEN count(DISTINCT p.m1) = (SELECT count(*) FROM groups x WHERE x.group_name = g.group_name) THEN round(sum(value_num * power(10, scalar_id)), 2) END AS value
FROM parts p JOIN groups g ON p.m1 = g.member GROUP BY g.group_name, p.m2, p.ref_date"""))
def group_sum_scaled(spark, sf_dir):
    """Every row twice: a repeated cell doesn't stand in for a missing member."""
    parts = cube(spark, sf_dir, CELLS, "parts")
    return rounded(view.group_sum(parts.union(parts), cube(spark, sf_dir, CELLS, "groups"), "m1", ["m2", "ref_date"], "scalar_id"), places=2)


@add(oracle(CELLS, """, e AS (SELECT g.group_name, p.ref_date, p.m1, max(CASE WHEN m2 = 2 THEN value_num * power(10, scalar_id) END) AS a, max(CASE WHEN m2 = 1 THEN value_num * power(10, scalar_id) END) AS b FROM parts p JOIN groups g ON p.m1 = g.member WHERE m2 IN (1, 2) GROUP BY 1, 2, 3)
SELECT group_name, ref_date, CASE WHEN count(a) = n AND count(b) = n AND sum(b) <> 0 THEN round(sum(a) / sum(b) * 100, 4) END AS value FROM e JOIN (SELECT group_name, count(*) AS n FROM groups GROUP BY 1) USING (group_name) GROUP BY group_name, ref_date, n"""))
def group_rule_ratio(spark, sf_dir):
    rule = {"numerator": 2, "denominator": 1, "scale": 100.0}
    return rounded(view.rule_ratio(cube(spark, sf_dir, CELLS, "parts"), cube(spark, sf_dir, CELLS, "groups"), rule, "m1", "m2", ["ref_date"], "scalar_id"))


CHOICES = LINES + """, groups AS (SELECT CAST(r_regionkey AS INT) AS k, r_name AS group_name, n_nationkey + 1 AS member FROM {region} JOIN {nation} ON r_regionkey = n_regionkey),
choices AS (
  SELECT DISTINCT a AS agg, concat(group_name, '/', a) AS group_name, CASE WHEN k = 0 THEN 99 END AS published, CASE WHEN k = 2 THEN 1 ELSE 0 END AS missing, group_name AS region, k FROM groups CROSS JOIN (
    SELECT 'auto' AS a UNION ALL SELECT 'published' AS a UNION ALL SELECT 'sum' AS a UNION ALL SELECT 'ratio' AS a) x
), used AS (
  SELECT c.group_name, o.m1 AS member, CASE o.m2 WHEN 1 THEN 'own' WHEN 2 THEN 'numerator' ELSE 'denominator' END AS part, CASE WHEN o.m2 = 1 THEN o.uom_id ELSE 17 END AS uom_id, o.scalar_id,
         CASE WHEN o.m2 = 1 AND c.k = 3 THEN 'index' ELSE 'count' END AS family, c.k = 4 AS counts
  FROM obs o JOIN groups g ON o.m1 = g.member JOIN choices c ON c.region = g.group_name WHERE NOT (c.k = 4 AND o.m2 = 3 AND o.m1 % 2 = 0)
)"""


@add(oracle(CHOICES, """, f AS (
  SELECT group_name, count(DISTINCT CASE WHEN part = 'own' THEN uom_id || ':' || scalar_id END) AS units, bool_and(CASE WHEN part = 'own' THEN family IN ('count', 'currency') OR counts END) AS adds,
         count(DISTINCT CASE WHEN part <> 'own' THEN uom_id || ':' || scalar_id END) AS part_units, bool_and(CASE WHEN part <> 'own' THEN family = 'count' END) AS parts_add,
         count(DISTINCT CASE WHEN part = 'numerator' THEN member END) = count(DISTINCT member) AND count(DISTINCT CASE WHEN part = 'denominator' THEN member END) = count(DISTINCT member) AS paired
  FROM used GROUP BY 1
), m AS (
  SELECT c.group_name, c.agg, c.published, CASE WHEN c.published IS NOT NULL AND c.agg IN ('auto', 'published') THEN 'published' WHEN (c.agg IN ('auto', 'sum') OR c.agg = 'published') AND missing = 0 AND units = 1 AND adds THEN 'sum'
    WHEN (c.agg IN ('auto', 'ratio') OR c.agg = 'published') AND missing = 0 AND part_units = 1 AND parts_add AND paired THEN 'ratio' ELSE 'members' END AS method
  FROM choices c LEFT JOIN f USING (group_name)
) SELECT group_name, method, CASE WHEN method = 'members' THEN 'group_not_combined' WHEN agg = 'published' AND published IS NULL THEN 'group_published_unavailable' END AS warning FROM m"""))
def group_method_choice(spark, sf_dir):
    return view.choose_group_method(cube(spark, sf_dir, CHOICES, "choices"), cube(spark, sf_dir, CHOICES, "used"))


@add(oracle(ORDERS, NATIONS + """, d AS (SELECT DISTINCT period_start FROM points), g AS (SELECT s.series, d.period_start, p.value, coalesce(p.status, '') AS mark FROM (SELECT DISTINCT series FROM points) s CROSS JOIN d LEFT JOIN points p ON p.series = s.series AND p.period_start = d.period_start),
b AS (SELECT series, min(period_start) AS lo, max(period_start) AS hi FROM g WHERE value IS NOT NULL GROUP BY 1), i AS (SELECT g.*, row_number() OVER (PARTITION BY series ORDER BY period_start) AS n FROM g JOIN b USING (series) WHERE period_start > lo AND period_start < hi),
r AS (SELECT *, sum(CASE WHEN value IS NOT NULL OR mark <> coalesce(pm, '?') OR pv THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY n) AS run FROM (SELECT *, lag(mark) OVER (PARTITION BY series ORDER BY n) AS pm, lag(value IS NOT NULL) OVER (PARTITION BY series ORDER BY n) AS pv FROM i))
SELECT 1 AS layer, series, mark, min(period_start) AS "from", max(period_start) AS "to", count(*) AS n, CASE mark WHEN '' THEN 'Not published' WHEN 'x' THEN 'confidential' ELSE mark END AS meaning FROM r WHERE value IS NULL GROUP BY series, mark, run"""))
def gaps_with_meaning(spark, sf_dir):
    grid = view.densify(points(spark, sf_dir, NATIONS), ["layer", "series"])
    return view.null_runs(grid, spark.createDataFrame([("x", "confidential"), ("E", "use with caution")], "status string, meaning string"))


READY = "p AS (SELECT l_partkey % 12 AS view, CAST(l_suppkey AS STRING) AS series, CASE WHEN l_partkey % 12 = 3 THEN DATE '1995-01-01' ELSE CAST(date_trunc('year', l_shipdate) AS DATE) END AS period_start, CASE l_partkey % 12 WHEN 1 THEN NULL WHEN 2 THEN CAST(5 AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) END AS value, l_partkey % 12 = 4 OR l_suppkey % 7 = 0 AS hidden FROM {lineitem})"


@add(oracle(READY, "SELECT view, count(value) FILTER (WHERE NOT hidden) = 0 AS unpublished, count(DISTINCT value) FILTER (WHERE NOT hidden) = 1 AS constant, count(DISTINCT period_start) FILTER (WHERE NOT hidden) = 1 AS one_period, bool_and(hidden) AS nothing_visible FROM p GROUP BY view"))
def view_ready(spark, sf_dir):
    return view.view_ready(cube(spark, sf_dir, READY, "p"))


@add(oracle(ORDERS, REGIONS + ", o AS (SELECT * FROM points WHERE period_start >= DATE '1993-02-01' AND month(period_start) <> 5) SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start FROM orders WHERE date_trunc('month', o_orderdate) BETWEEN (SELECT min(period_start) FROM o) AND (SELECT max(period_start) FROM o)"))
def dates_in_span(spark, sf_dir):
    """The points lack every May and their first year; the tables' own periods give the Mays back, not the year."""
    seen = points(spark, sf_dir, REGIONS).where("period_start >= '1993-02-01' and month(period_start) <> 5")
    periods = tables(spark, sf_dir)["orders"].select(F.lit(1).alias("layer"), F.trunc("o_orderdate", "month").alias("period_start"))
    return view.layer_union(seen, periods)


@add(oracle(ORDERS, REGIONS + " SELECT greatest(DATE '1992-03-01', (SELECT max(f) FROM (SELECT min(period_start) AS f FROM (SELECT 1 AS layer, period_start FROM points UNION ALL SELECT 2, period_start FROM points WHERE year(period_start) >= 1994) GROUP BY layer))) AS start"))
def clipped_start(spark, sf_dir):
    p = points(spark, sf_dir, REGIONS)
    return view.clipped_start(p.union(p.where("year(period_start) >= 1994").withColumn("layer", F.lit(2))), "1992-03-01")


@add(oracle(ORDERS, REGIONS + """, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period_start DESC) AS r, lag(value) OVER (PARTITION BY series ORDER BY period_start) AS p, lag(value, 12) OVER (PARTITION BY series ORDER BY period_start) AS y FROM points WHERE value IS NOT NULL)
SELECT series, string_agg(strftime(period_start, '%Y-%m-%d') || '=' || CAST(CAST(value AS DECIMAL(30, 2)) AS VARCHAR), ',' ORDER BY period_start) AS points, max(CASE WHEN r = 1 THEN CASE WHEN value > coalesce(y, p) THEN 'up' WHEN value < coalesce(y, p) THEN 'down' ELSE 'flat' END END) AS direction FROM x WHERE r <= 24 GROUP BY series"""))
def kpi_points(spark, sf_dir):
    return view.kpi_cards(points(spark, sf_dir, REGIONS), 12, 24).select("series", "points", "direction")
