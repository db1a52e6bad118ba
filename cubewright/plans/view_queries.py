"""Queries of the view's time, group and category operators over the orders cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cubewright.operators import view

from .cubes import LINES, ORDERS, cube, oracle, tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: Regions as series, all priorities, orders: dense. Nations by priority: with gaps and hidden cells.
REGIONS = ", points AS (SELECT 1 AS layer, CAST(m1 AS STRING) AS series, CAST(concat(ref_date, '-01') AS DATE) AS period_start, value_num AS value, status FROM obs WHERE m1 BETWEEN 2 AND 6 AND m2 = 1 AND m3 = 1)"
NATIONS = ", points AS (SELECT 1 AS layer, concat(CAST(m1 AS STRING), '.', CAST(m2 AS STRING)) AS series, CAST(concat(ref_date, '-01') AS DATE) AS period_start, value_num AS value, status FROM obs WHERE m1 >= 7 AND m2 > 1 AND m3 = 1)"
SHARES = ", points AS (SELECT m1, m2, ref_date, value_num AS value FROM obs WHERE m1 BETWEEN 2 AND 31 AND m2 > 1 AND m3 = 1)"
DATES = ", dates AS (SELECT period_start, row_number() OVER (ORDER BY period_start) AS n FROM (SELECT DISTINCT period_start FROM points))"
GRID = DATES + ", grid AS (SELECT k.series, d.period_start, d.n, p.value, p.status FROM (SELECT DISTINCT series FROM points) k CROSS JOIN dates d LEFT JOIN points p ON p.series = k.series AND p.period_start = d.period_start)"


def points(spark, sf_dir, text: str) -> DataFrame:
    return cube(spark, sf_dir, ORDERS + text, "points")


def change_sql(lag: int) -> str:
    return oracle(ORDERS, REGIONS + DATES + f", x AS (SELECT p.*, n FROM points p JOIN dates USING (period_start)) SELECT x.layer, x.series, x.period_start, CASE WHEN b.value <> 0 THEN round((x.value / b.value - 1) * 100, 6) END AS value FROM x LEFT JOIN x b ON b.series = x.series AND b.n = x.n - {lag}")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns or ("value",)})


@add(change_sql(12))
def view_yoy_by_region(spark, sf_dir):
    return rounded(view.pct_change(points(spark, sf_dir, REGIONS), 12))


@add(change_sql(1))
def view_period_change(spark, sf_dir):
    return rounded(view.pct_change(points(spark, sf_dir, REGIONS), 1))


@add(oracle(ORDERS, NATIONS + ", e AS (SELECT min(period_start) AS a, max(period_start) AS b FROM points) SELECT 1 AS layer, series, b AS period_start, CASE WHEN max(CASE WHEN period_start = a THEN value END) <> 0 THEN round((max(CASE WHEN period_start = b THEN value END) / max(CASE WHEN period_start = a THEN value END) - 1) * 100, 6) END AS value FROM points, e GROUP BY series, b"))
def view_window_change(spark, sf_dir):
    return rounded(view.pct_change_window(points(spark, sf_dir, NATIONS)))


@add(oracle(ORDERS, NATIONS + ", b AS (SELECT series, arg_min(value, period_start) FILTER (WHERE value IS NOT NULL) AS base FROM points GROUP BY series) SELECT 1 AS layer, series, period_start, CASE WHEN base <> 0 THEN round(value / base * 100, 6) END AS value FROM points JOIN b USING (series)"))
def view_index_first(spark, sf_dir):
    return rounded(view.index_rebase(points(spark, sf_dir, NATIONS)))


@add(oracle(ORDERS, NATIONS + ", b AS (SELECT series, arg_min(value, period_start) FILTER (WHERE value IS NOT NULL) AS base FROM points WHERE period_start BETWEEN DATE '1996-04-01' AND DATE '1996-06-30' GROUP BY series) SELECT 1 AS layer, series, period_start, CASE WHEN base <> 0 THEN round(value / base * 100, 6) END AS value FROM points LEFT JOIN b USING (series) WHERE period_start >= DATE '1998-01-01'"))
def view_index_base_quarter(spark, sf_dir):
    return rounded(view.index_rebase(points(spark, sf_dir, NATIONS), "1996-Q2", F.col("period_start") >= "1998-01-01"))


@add(oracle(ORDERS, REGIONS + " SELECT p.* FROM points p, (SELECT max(period_start) AS latest FROM points) WHERE period_start > latest - INTERVAL 2 YEAR"))
def time_window(spark, sf_dir):
    return view.window_bounds(points(spark, sf_dir, REGIONS), preset_years=2)


@add(oracle(ORDERS, REGIONS + " SELECT * FROM points WHERE period_start >= DATE '1996-03-01' AND substr(CAST(period_start AS VARCHAR), 1, 7) <= '1997-05'"))
def time_window_bounds(spark, sf_dir):
    return view.window_bounds(points(spark, sf_dir, REGIONS), from_="1996-03-01", to="1997-05")


@add(oracle(ORDERS, NATIONS + GRID + " SELECT 1 AS layer, series, period_start, value, status FROM grid"))
def densify_grid(spark, sf_dir):
    return view.densify(points(spark, sf_dir, NATIONS), ["layer", "series"]).select("layer", "series", "period_start", "value", "status")


@add(oracle(ORDERS, REGIONS + DATES + " SELECT 1 AS layer, period_start, lag(period_start, 12) OVER (ORDER BY n) AS prior FROM dates"))
def lookback_join(spark, sf_dir):
    return view.lookback(points(spark, sf_dir, REGIONS), 12)


@add("""
WITH p AS (SELECT o_orderpriority AS series, CAST(o_orderdate AS DATE) AS period_start, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1, 2)
SELECT 1 AS layer, a.series, a.period_start, (a.value / nullif(b.value, 0) - 1) * 100 AS value
FROM p a LEFT JOIN p b ON b.series = a.series AND b.period_start = a.period_start - INTERVAL 1 YEAR AND strftime(a.period_start, '%m-%d') = strftime(b.period_start, '%m-%d')
""")
def daily_yoy(spark, sf_dir):
    """Daily orders of each priority against the same day a year earlier; the last of February in leap years has no partner."""
    daily = tables(spark, sf_dir)["orders"].groupBy(F.lit(1).alias("layer"), F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("period_start")).agg(F.count("*").cast("double").alias("value"))
    return view.pct_change_daily_yoy(daily)


@add(oracle(ORDERS, SHARES + " SELECT m1, m2, ref_date, value, CASE WHEN count(value) OVER w = count(*) OVER w AND sum(value) OVER w <> 0 THEN round(value / sum(value) OVER w * 100, 6) END AS share FROM points WINDOW w AS (PARTITION BY m1, ref_date)"))
def view_share_of_priority(spark, sf_dir):
    return rounded(view.category_share(points(spark, sf_dir, SHARES), ["m1", "ref_date"]), "share")


@add(oracle(ORDERS, SHARES + ", q AS (SELECT m1, m2, ref_date, CASE WHEN m2 % 2 = 0 THEN -value ELSE value END AS value FROM points) SELECT m1, m2, ref_date, value, CASE WHEN value >= 0 THEN round(value / sum(value) FILTER (WHERE value > 0) OVER w * 100, 6) WHEN value < 0 THEN round(-(value / sum(value) FILTER (WHERE value < 0) OVER w) * 100, 6) END AS share FROM q WINDOW w AS (PARTITION BY m1, ref_date)"))
def signed_stack_share(spark, sf_dir):
    signed = points(spark, sf_dir, SHARES).withColumn("value", F.when(F.col("m2") % 2 == 0, -F.col("value")).otherwise(F.col("value")))
    return rounded(view.signed_stack_share(signed, ["m1", "ref_date"]), "share")


@add(oracle(ORDERS, ", g AS (SELECT concat('R', CAST(n_regionkey AS VARCHAR)) AS group_name, n_nationkey + 7 AS member FROM nation) SELECT group_name, m2, ref_date, CASE WHEN count(value_num) = (SELECT count(*) FROM g h WHERE h.group_name = g.group_name) THEN sum(value_num) END AS value FROM obs JOIN g ON m1 = member WHERE m3 = 1 AND m2 > 1 GROUP BY group_name, m2, ref_date"))
def group_sum_complete_case(spark, sf_dir):
    group = tables(spark, sf_dir)["nation"].select(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("group_name"), (F.col("n_nationkey") + 7).alias("member"))
    obs = cube(spark, sf_dir, ORDERS, "obs").where("m3 = 1 and m2 > 1")
    return view.group_sum(obs, group, "m1", ["m2", "ref_date"])


@add(oracle(LINES, "SELECT m1, ref_date, CASE WHEN count(*) = 3 AND sum(price) <> 0 THEN round(CAST(sum(discount) AS DOUBLE) / CAST(sum(price) AS DOUBLE) * 100, 6) END AS value FROM cells WHERE NOT (m2 = 2 AND m3 = 1) AND NOT (m2 <> 2 AND m3 = 2) GROUP BY m1, ref_date"))
def group_ratio(spark, sf_dir):
    cells = cube(spark, sf_dir, LINES, "cells").where("not (m2 = 2 and m3 = 1) and not (m2 <> 2 and m3 = 2)")
    parts = cells.select("m1", "ref_date", F.col("discount").cast("double").alias("discount"), F.col("price").cast("double").alias("price"))
    return rounded(view.group_ratio(parts, ["m1", "ref_date"], "discount", "price", 100.0, 3))



@add(oracle(ORDERS, NATIONS + " SELECT 1 AS layer, series, min(CASE WHEN value IS NOT NULL THEN period_start END) AS first, max(CASE WHEN value IS NOT NULL THEN period_start END) AS last, count(value) = 0 AS unpublished FROM points GROUP BY series"))
def coverage_bounds(spark, sf_dir):
    return view.coverage_bounds(points(spark, sf_dir, NATIONS))


@add(oracle(ORDERS, NATIONS + GRID + """, b AS (SELECT series, min(period_start) AS lo, max(period_start) AS hi FROM points WHERE value IS NOT NULL GROUP BY series),
i AS (SELECT g.series, period_start, coalesce(status, '') AS mark, value IS NULL AS missing FROM grid g JOIN b USING (series) WHERE period_start > lo AND period_start < hi),
r AS (SELECT *, sum(CASE WHEN missing AND prev THEN 0 ELSE 1 END) OVER (PARTITION BY series ORDER BY period_start) AS run FROM (SELECT *, coalesce(lag(missing) OVER (PARTITION BY series ORDER BY period_start) AND lag(mark) OVER (PARTITION BY series ORDER BY period_start) = mark, false) AS prev FROM i))
SELECT 1 AS layer, series, mark, min(period_start) AS "from", max(period_start) AS "to", count(*) AS n FROM r WHERE missing GROUP BY series, mark, run"""))
def null_runs(spark, sf_dir):
    return view.null_runs(view.densify(points(spark, sf_dir, NATIONS), ["layer", "series"]))


@add(oracle(ORDERS, NATIONS + " SELECT coalesce(max(CASE WHEN n = 125 THEN period_start END), max(period_start)) AS period_start FROM (SELECT period_start, count(value) AS n FROM points GROUP BY period_start)"))
def category_period(spark, sf_dir):
    return view.category_period(points(spark, sf_dir, NATIONS), 125)


CATEGORIES = ", points AS (SELECT m1 AS category, m1 AS position, CAST(m2 AS STRING) AS series, sum(value_num) AS value FROM obs WHERE m1 >= 7 AND m2 > 1 AND m3 = 1 GROUP BY m1, m2)"


@add(oracle(ORDERS, CATEGORIES + " SELECT category, sum(coalesce(value, 0)) AS total, min(position) AS position, CAST(row_number() OVER (ORDER BY sum(coalesce(value, 0)) DESC, min(position)) AS INT) AS rank FROM points GROUP BY category"))
def sort_categories(spark, sf_dir):
    return view.sort_categories(points(spark, sf_dir, CATEGORIES), descending=True)


@add(oracle(ORDERS, CATEGORIES + " SELECT category, value, CAST(row_number() OVER (ORDER BY value DESC NULLS LAST, position) AS INT) AS rank FROM points WHERE series = '3'"))
def lead_order(spark, sf_dir):
    return view.lead_order(points(spark, sf_dir, CATEGORIES), "3")


AXES = ", series AS (SELECT CAST(m1 * 10 + m3 AS INT) AS series_no, CAST(CASE WHEN m1 = 9 THEN 1 ELSE uom_id END AS STRING) AS unit, 0 AS scale, m1 = 4 AS unpublished FROM obs WHERE m2 = 1 GROUP BY m1, m3, uom_id)"


@add(oracle(ORDERS, AXES + ", u AS (SELECT unit, scale, min(series_no) AS first FROM series WHERE NOT unpublished GROUP BY 1, 2), a AS (SELECT unit, scale, row_number() OVER (ORDER BY first) - 1 AS axis FROM u) SELECT series_no, s.unit, s.scale, unpublished, CAST(CASE WHEN axis IS NULL OR axis > 1 THEN 0 ELSE axis END AS INT) AS axis FROM series s LEFT JOIN a USING (unit, scale) WHERE unpublished OR axis < 2"))
def assign_axes(spark, sf_dir):
    return view.assign_axes(cube(spark, sf_dir, ORDERS + AXES, "series"))


@add(oracle(ORDERS, AXES + " SELECT *, (SELECT count(*) FROM series) AS total FROM series ORDER BY series_no LIMIT 40"))
def series_cap(spark, sf_dir):
    return view.series_cap(cube(spark, sf_dir, ORDERS + AXES, "series"))


@add(oracle(ORDERS, CATEGORIES + " SELECT s.position, s.series, s.value, c.category FROM (SELECT * FROM points WHERE category = 7) s CROSS JOIN (SELECT DISTINCT category FROM points) c"))
def repeat_over_categories(spark, sf_dir):
    p = points(spark, sf_dir, CATEGORIES)
    return view.repeat_over_categories(p.where("category = 7"), p)


@add(oracle(ORDERS, NATIONS + " SELECT 1 AS layer, series, max(period_start) AS period_start, arg_max(value, period_start) AS value FROM points WHERE value IS NOT NULL GROUP BY series"))
def last_published(spark, sf_dir):
    return view.last_published(points(spark, sf_dir, NATIONS))


@add(oracle(ORDERS, REGIONS + ' SELECT period_start, ' + ", ".join(f"max(value) FILTER (WHERE series = '{k}') AS \"{k}\"" for k in range(2, 7)) + " FROM points GROUP BY period_start"))
def pivot_view(spark, sf_dir):
    return view.pivot_view(points(spark, sf_dir, REGIONS), [str(k) for k in range(2, 7)])


@add(oracle(ORDERS, NATIONS + " SELECT 1 AS layer, series, count(value) = 0 AS unpublished, count(DISTINCT value) = 1 AS constant, count(DISTINCT period_start) = 1 AS one_period FROM points GROUP BY series"))
def plot_ready(spark, sf_dir):
    return view.plot_ready(points(spark, sf_dir, NATIONS))


@add(oracle(ORDERS, REGIONS + " SELECT DISTINCT period_start FROM points UNION SELECT DISTINCT CAST(CAST(ts AS DATE) AS DATE) FROM events"))
def layer_union(spark, sf_dir):
    days = tables(spark, sf_dir)["events"].select(F.to_date("ts").alias("period_start"))
    return view.layer_union(points(spark, sf_dir, REGIONS).select("period_start").unionByName(days))


@add("SELECT 1 AS layer, 'month' AS grain UNION ALL SELECT 2, 'day'")
def time_grain(spark, sf_dir):
    days = tables(spark, sf_dir)["events"].select(F.lit(2).alias("layer"), F.to_date("ts").alias("period_start"))
    return view.time_grain(points(spark, sf_dir, REGIONS).select("layer", "period_start").unionByName(days))


@add(oracle(ORDERS, NATIONS + GRID + """, m AS (SELECT *, year(period_start) * 12 + month(period_start) AS mo FROM grid), g AS (SELECT series, mo - lag(mo) OVER (PARTITION BY series ORDER BY mo) AS gap, mo FROM m WHERE value IS NOT NULL),
s AS (SELECT series, min(gap) AS step, min(mo) AS start FROM g GROUP BY series)
SELECT 1 AS layer, series, period_start, value FROM m LEFT JOIN s USING (series) WHERE value IS NOT NULL OR (mo - start) % coalesce(step, 1) = 0"""))
def own_cadence(spark, sf_dir):
    return view.own_cadence(view.densify(points(spark, sf_dir, NATIONS), ["layer", "series"]))


@add(oracle(ORDERS, REGIONS + """, x AS (SELECT *, lag(value, 12) OVER w AS y, lag(value, 1) OVER w AS p, row_number() OVER (PARTITION BY series ORDER BY period_start DESC) AS rn, count(*) OVER (PARTITION BY series) AS n FROM points WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series ORDER BY period_start))
SELECT 1 AS layer, series, period_start, value, round((value / y - 1) * 100, 6) AS yoy, round((value / p - 1) * 100, 6) AS step, CASE WHEN (value / y - 1) * 100 > 0 THEN 'up' WHEN (value / y - 1) * 100 < 0 THEN 'down' ELSE 'flat' END AS direction, least(n, 60) AS n_points FROM x WHERE rn = 1"""))
def kpi_cards(spark, sf_dir):
    return rounded(view.kpi_cards(points(spark, sf_dir, REGIONS), 12), "yoy", "step").drop("points")
