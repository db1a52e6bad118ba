"""Queries of periods, series and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cubewright.functions import periods, text
from cubewright.operators import series

from .cubes import LINES, ORDERS, cube, oracle, tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: Families of the unit codes that the cubes use. Fixed values.
FAMILY = [(223, "count"), (81, "currency"), (17, "count")]
PERIOD = ", period AS (SELECT DISTINCT pid, ref_date, CAST(concat(ref_date, '-01') AS DATE) AS period_start, last_day(CAST(concat(ref_date, '-01') AS DATE)) AS period_end, 'month' AS period_kind FROM obs)"
FAMILY_SQL = ", family AS (SELECT * FROM (VALUES (223, 'count'), (81, 'currency'), (17, 'count')) f(uom_code, family))"
KEYED = ", keyed AS (SELECT *, CASE WHEN vector = '' THEN 'coordinate' ELSE 'vector' END AS key_kind, CASE WHEN vector = '' THEN coordinate ELSE vector END AS series_key FROM obs)"
SERIES = f""", s AS (
SELECT pid, key_kind, series_key, min(uom_id) AS uom_id_min, max(uom_id) AS uom_id_max, min(dguid) AS dguid_min, max(dguid) AS dguid_max,
       min(decimals) AS decimals_min, max(decimals) AS decimals_max, min(period_start) AS period_min, max(period_end) AS period_max, count(*) AS n_obs,
       count(*) FILTER (WHERE value <> '') AS n_published, arg_max(status, ref_date) AS last_status
FROM keyed JOIN period USING (pid, ref_date) GROUP BY pid, key_kind, series_key)"""


def lines(spark, sf_dir) -> DataFrame:
    return cube(spark, sf_dir, LINES, "obs")


def period_table(obs: DataFrame, frequency: int = 6) -> DataFrame:
    p = periods.period(F.col("ref_date"), F.lit(frequency))
    found = obs.select("pid", "ref_date").distinct().select("pid", "ref_date", p.alias("p"))
    return found.select("pid", "ref_date", F.col("p.start").alias("period_start"), F.col("p.end").alias("period_end"), F.col("p.kind").alias("period_kind"))


def family(spark) -> DataFrame:
    return spark.createDataFrame(FAMILY, "uom_code int, family string")


def built(spark, sf_dir) -> DataFrame:
    obs = lines(spark, sf_dir)
    return series.build_series(obs, period_table(obs))


@add(oracle(LINES, PERIOD + KEYED + SERIES + " SELECT pid, key_kind, series_key, uom_id_min, uom_id_max, dguid_min, dguid_max, period_min, period_max, n_obs, n_published, last_status FROM s"))
def series_build(spark, sf_dir):
    return built(spark, sf_dir).select("pid", "key_kind", "series_key", "uom_id_min", "uom_id_max", "dguid_min", "dguid_max", "period_min", "period_max", "n_obs", "n_published", "last_status")


@add(oracle(LINES, PERIOD + KEYED + SERIES + FAMILY_SQL + " SELECT pid, key_kind, series_key, family, 'month' AS period_kind, n_obs, n_published, last_status FROM s LEFT JOIN family ON uom_id_min = uom_code"))
def series_labels(spark, sf_dir):
    return series.series_labels(built(spark, sf_dir), family(spark))


@add(oracle(LINES, PERIOD + KEYED + " SELECT pid, key_kind, series_key, period_kind, period_start AS period_min, period_end AS period_max, CAST(1 AS BIGINT) AS n_obs, CAST(value <> '' AS BIGINT) AS n_published, status AS last_status FROM keyed JOIN period USING (pid, ref_date) WHERE ref_date = '1998-01'"))
def direct_series(spark, sf_dir):
    obs = lines(spark, sf_dir).where("ref_date = '1998-01'")
    return series.direct_series(obs, period_table(obs))


@add(oracle(LINES, PERIOD + KEYED + SERIES + " SELECT pid, count(*) FILTER (WHERE uom_id_min <> uom_id_max) AS uom_id_changes, CAST(0 AS BIGINT) AS scalar_id_changes, count(*) FILTER (WHERE decimals_min <> decimals_max) AS decimals_changes, CAST(0 AS BIGINT) AS terminated_changes, count(*) FILTER (WHERE dguid_min <> dguid_max) AS dguid_changes, CAST(0 AS BIGINT) AS coordinate_changes, CAST(0 AS BIGINT) AS kind_changes FROM s GROUP BY pid"))
def series_variation(spark, sf_dir):
    return series.series_variation(built(spark, sf_dir))


@add(oracle(LINES, KEYED + ", a AS (SELECT pid, key_kind, series_key, count(*) AS n_seen FROM keyed GROUP BY 1, 2, 3), b AS (SELECT pid, key_kind, series_key, count(*) AS n_obs FROM keyed WHERE ref_date <> '1998-02' GROUP BY 1, 2, 3) SELECT pid, key_kind, series_key, n_obs, n_seen FROM a FULL JOIN b USING (pid, key_kind, series_key) WHERE n_obs IS DISTINCT FROM n_seen"))
def series_count_check(spark, sf_dir):
    obs = lines(spark, sf_dir)
    short = obs.where("ref_date <> '1998-02'")
    return series.series_count_check(series.build_series(short, period_table(short)), obs)


@add(oracle(LINES, PERIOD + KEYED + SERIES + FAMILY_SQL + " SELECT pid, CAST(sum(n_obs) AS BIGINT) AS n_rows, count(*) AS n_series, min(period_min) AS period_min, max(period_max) AS period_max, string_agg(DISTINCT family, ',' ORDER BY family) AS families FROM s LEFT JOIN family ON uom_id_min = uom_code GROUP BY pid"))
def table_stats(spark, sf_dir):
    return series.table_stats(built(spark, sf_dir), family(spark))


@add(oracle(LINES, PERIOD + KEYED + SERIES + " SELECT 'month' AS period_kind, count(*) AS n_series, CAST(sum(n_obs) AS BIGINT) AS n_obs FROM s"))
def period_kind_counts(spark, sf_dir):
    return series.period_kind_counts(built(spark, sf_dir))


@add(oracle(ORDERS, "SELECT pid, status, count(*) AS n, count(*) FILTER (WHERE value = '') AS n_blank FROM obs GROUP BY pid, status"))
def status_profile(spark, sf_dir):
    return series.status_profile(cube(spark, sf_dir, ORDERS, "obs"))


@add("SELECT regexp_replace(CAST(o_orderdate AS VARCHAR), '[0-9]', '9', 'g') AS shape, count(*) AS n FROM orders GROUP BY 1")
def unknown_shapes(spark, sf_dir):
    texts = tables(spark, sf_dir)["orders"].select(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ref_date"))
    known = periods.period(F.col("ref_date"), F.lit(1))["kind"] != "other"
    return series.unknown_shapes(texts, periods.shape(F.col("ref_date")), known)


@add("SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return series.duplicate_keys(tables(spark, sf_dir)["orders"], ["o_custkey", "o_orderpriority"])


@add(oracle(LINES, "SELECT DISTINCT pid, uom_id FROM obs"))
def distinct_units(spark, sf_dir):
    return series.distinct_units(built(spark, sf_dir))


@add(oracle(LINES, "SELECT DISTINCT uom_id FROM obs WHERE uom_id NOT IN (223, 81, 17)"))
def code_coverage(spark, sf_dir):
    return series.code_coverage(lines(spark, sf_dir), family(spark).withColumnRenamed("uom_code", "uom_id"), "uom_id")


@add("SELECT count(l_tax) = 0 AS l_tax_null, count(CASE WHEN l_quantity < 0 THEN 1 END) = 0 AS none_null, count(*) AS n_rows FROM lineitem")
def null_column_proof(spark, sf_dir):
    items = tables(spark, sf_dir)["lineitem"].select("l_tax", F.when(F.col("l_quantity") < 0, 1).alias("none"))
    return series.null_columns(items, ["l_tax", "none"])


@add(oracle(LINES, "SELECT pid, CAST(count(*) + 1 AS BIGINT) AS rows, count(*) AS n_rows FROM obs GROUP BY pid"))
def row_count_check(spark, sf_dir):
    manifest = lines(spark, sf_dir).groupBy("pid").agg((F.count("*") + 1).alias("rows"))
    return series.row_count_check(built(spark, sf_dir), manifest)


FREQUENCIES = (1, 2, 6, 9, 11, 12, 19)
DATES = """
WITH d AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders),
t AS (SELECT d AS ref_date FROM d UNION SELECT substr(d, 1, 7) FROM d UNION SELECT substr(d, 1, 4) FROM d UNION SELECT substr(d, 1, 4) || '/' || CAST(CAST(substr(d, 1, 4) AS INT) + 1 AS VARCHAR) FROM d
      UNION SELECT substr(d, 1, 4) || '/' || CAST(CAST(substr(d, 1, 4) AS INT) + CAST(substr(d, 10, 1) AS INT) AS VARCHAR) FROM d UNION SELECT substr(d, 1, 7) || '-31' FROM d UNION SELECT substr(d, 1, 4) || '-' || substr(d, 9, 2) FROM d UNION SELECT '0' || d FROM d),
f AS (SELECT unnest([1, 2, 6, 9, 11, 12, 19]) AS frequency),
p AS (SELECT ref_date, frequency, length(ref_date) AS n, try_cast(substr(ref_date, 1, 4) AS INT) AS y,
      CASE WHEN regexp_full_match(ref_date, '\\d{4}') THEN 'Y' WHEN regexp_full_match(ref_date, '\\d{4}-\\d{2}') THEN 'M' WHEN regexp_full_match(ref_date, '\\d{4}-\\d{2}-\\d{2}') THEN 'D' WHEN regexp_full_match(ref_date, '\\d{4}/\\d{4}') THEN 'S' ELSE '' END AS s FROM t, f),
q AS (SELECT *, CASE s WHEN 'Y' THEN make_date(y, 1, 1) WHEN 'M' THEN try_cast(ref_date || '-01' AS DATE) WHEN 'D' THEN try_cast(ref_date AS DATE) WHEN 'S' THEN CASE WHEN CAST(substr(ref_date, 6, 4) AS INT) = y + 1 THEN make_date(y, 4, 1) WHEN CAST(substr(ref_date, 6, 4) AS INT) > y + 1 THEN make_date(y, 1, 1) END END AS a FROM p)
SELECT ref_date, frequency, CAST(a AS DATE) AS period_start,
  CAST(CASE WHEN a IS NULL THEN NULL WHEN s = 'Y' THEN make_date(y, 12, 31) WHEN s = 'M' THEN last_day(a + to_months(CASE WHEN frequency IN (9, 19) THEN 2 WHEN frequency = 11 THEN 5 ELSE 0 END)) WHEN s = 'D' THEN a + CASE WHEN frequency = 2 THEN INTERVAL 6 DAY ELSE INTERVAL 0 DAY END
       WHEN CAST(substr(ref_date, 6, 4) AS INT) = y + 1 THEN make_date(y + 1, 3, 31) ELSE make_date(CAST(substr(ref_date, 6, 4) AS INT), 12, 31) END AS DATE) AS period_end,
  CASE WHEN a IS NULL THEN 'other' WHEN s = 'Y' THEN 'year' WHEN s = 'M' THEN CASE WHEN frequency IN (9, 19) THEN 'quarter' WHEN frequency = 11 THEN 'half_year' ELSE 'month' END WHEN s = 'D' THEN CASE WHEN frequency = 2 THEN 'week' ELSE 'day' END
       WHEN CAST(substr(ref_date, 6, 4) AS INT) = y + 1 THEN 'fiscal_year' ELSE 'multi_year' END AS period_kind
FROM q
"""


@add(DATES)
def period_rules(spark, sf_dir):
    d = tables(spark, sf_dir)["orders"].select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")).distinct()
    year = F.substring("d", 1, 4)
    later = lambda n: F.concat(year, F.lit("/"), (year.cast("int") + n).cast("string"))
    shapes = [F.col("d"), F.substring("d", 1, 7), year, later(1), later(F.substring("d", 10, 1).cast("int")), F.concat(F.substring("d", 1, 7), F.lit("-31")), F.concat(year, F.lit("-"), F.substring("d", 9, 2)), F.concat(F.lit("0"), "d")]
    texts = d.select(F.explode(F.array(*shapes)).alias("ref_date")).distinct()
    both = texts.withColumn("frequency", F.explode(F.array(*[F.lit(f) for f in FREQUENCIES])))
    p = periods.period(F.col("ref_date"), F.col("frequency"))
    return both.select("ref_date", "frequency", p["start"].alias("period_start"), p["end"].alias("period_end"), p["kind"].alias("period_kind"))


@add(r"""
SELECT p_partkey, p_brand || ' (' || p_type || ')' AS label, CASE WHEN p_size <= 2 THEN '1-2' WHEN p_size <= 4 THEN '3-4' ELSE '5+' END AS band,
  split_part(p_brand || ' (' || p_type || ')', ' (', 1) AS short, substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 1, 2) || '-' || substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 3, 2) || '-' || substr(lpad(CAST(p_partkey AS VARCHAR), 8, '0'), 5, 4) || '-01' AS number,
  lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS pid, CAST(p_size AS VARCHAR) AS code, p_retailprice * 1000 AS scaled, substr(sha256(p_name), 1, 10) AS hash, regexp_replace('<b>' || p_name || '</b>', '<[^>]*>', ' ', 'g') AS plain,
  CASE WHEN regexp_full_match(p_name, '[0-9]+') THEN CAST(p_name AS BIGINT) END AS strict
FROM part
""")
def x_functions(spark, sf_dir):
    parts = tables(spark, sf_dir)["part"].withColumn("label", F.concat("p_brand", F.lit(" ("), "p_type", F.lit(")"))).withColumn("pid", F.lpad(F.col("p_partkey").cast("string"), 8, "0"))
    return parts.select(
        "p_partkey", "label", text.dimension_band(F.col("p_size")).alias("band"), F.replace(text.short_place(F.col("label")), F.lit("–"), F.lit("-")).alias("short"), text.table_number(F.col("pid")).alias("number"),
        text.table_pid(text.table_number(F.col("pid"))).alias("pid"), text.bracket_code(F.concat(F.lit("["), F.col("p_size").cast("string"), F.lit("]"))).alias("code"), text.scale_value(F.col("p_retailprice"), F.lit(3)).alias("scaled"),
        text.content_hash(F.col("p_name"), 10).alias("hash"), text.strip_html(F.concat(F.lit("<b>"), "p_name", F.lit("</b>"))).alias("plain"), text.strict_length(F.col("p_name")).alias("strict"),
    )


@add(r"""
WITH t AS (SELECT DISTINCT CASE WHEN l_linenumber % 4 = 0 THEN '' WHEN l_linenumber % 4 = 1 THEN CAST(CAST(l_quantity AS DECIMAL(10, 2)) AS VARCHAR) WHEN l_linenumber % 4 = 2 THEN '-' || CAST(l_linenumber AS VARCHAR) ELSE CAST(l_linenumber AS VARCHAR) || 'e3' END AS value, l_returnflag || ',r,' || l_linestatus AS marks FROM lineitem)
SELECT value, marks, CASE WHEN regexp_full_match(value, '-?\d+(\.\d+)?') THEN CAST(value AS DOUBLE) END AS value_num, value <> '' AND NOT regexp_full_match(value, '-?\d+(\.\d+)?') AS error,
       replace(marks, ',r,', ',') AS status, 'r' AS symbol FROM t
""")
def row_checks(spark, sf_dir):
    n = F.col("l_linenumber")
    value = F.when(n % 4 == 0, "").when(n % 4 == 1, F.col("l_quantity").cast("decimal(10,2)").cast("string")).when(n % 4 == 2, F.concat(F.lit("-"), n.cast("string"))).otherwise(F.concat(n.cast("string"), F.lit("e3")))
    rows = tables(spark, sf_dir)["lineitem"].select(value.alias("value"), F.concat_ws(",", "l_returnflag", F.lit("r"), "l_linestatus").alias("marks")).distinct()
    split = text.split_marks(F.col("marks"))
    return rows.select("value", "marks", text.parse_value(F.col("value")).alias("value_num"), text.value_error(F.col("value")).alias("error"), split["status"].alias("status"), split["symbol"].alias("symbol"))
