"""Statistical cubes derived from the order tables: the inputs of the registered queries.

The text of each derivation is plain SQL that Spark and the oracle both read; the operators come after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

#: Orders by place, priority and month, as published: World, regions and nations; all and each priority.
ORDERS = """
geo AS (
  SELECT n_nationkey AS nat, n_nationkey + 7 AS m1 FROM {nation} UNION ALL
  SELECT n_nationkey AS nat, n_regionkey + 2 AS m1 FROM {nation} UNION ALL
  SELECT n_nationkey AS nat, 1 AS m1 FROM {nation}
), pri AS (
  SELECT DISTINCT o_orderpriority AS pri, CAST(substr(o_orderpriority, 1, 1) AS INT) + 1 AS m2 FROM {orders} UNION ALL
  SELECT DISTINCT o_orderpriority AS pri, 1 AS m2 FROM {orders}
), cells AS (
  SELECT g.m1 AS m1, p.m2 AS m2, substr(CAST(o.o_orderdate AS STRING), 1, 7) AS ref_date,
         CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18, 2))) AS DECIMAL(24, 2)) AS total
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN geo g ON g.nat = c.c_nationkey JOIN pri p ON p.pri = o.o_orderpriority
  GROUP BY g.m1, p.m2, substr(CAST(o.o_orderdate AS STRING), 1, 7)
), marked AS (
  SELECT *, m1 >= 7 AND n = 1 AND (m1 - 7 + CAST(substr(ref_date, 6, 2) AS INT)) % 7 = 0 AS hidden FROM cells
), obs AS (
  SELECT '10000001' AS pid, m1, m2, 1 AS m3, ref_date, CASE WHEN hidden THEN '' ELSE CAST(n AS STRING) END AS value,
         CASE WHEN hidden THEN NULL ELSE CAST(n AS DOUBLE) END AS value_num, CASE WHEN hidden THEN 'x' ELSE '' END AS status, 223 AS uom_id, 0 AS decimals FROM marked UNION ALL
  SELECT '10000001' AS pid, m1, m2, 2 AS m3, ref_date, CASE WHEN hidden THEN '' ELSE CAST(total AS STRING) END AS value,
         CASE WHEN hidden THEN NULL ELSE CAST(total AS DOUBLE) END AS value_num, CASE WHEN hidden THEN 'x' ELSE '' END AS status, 81 AS uom_id, 2 AS decimals FROM marked
), member AS (
  SELECT '10000001' AS pid, 1 AS dimension_id, 1 AS member_id, 'World' AS member_name, CAST(NULL AS INT) AS parent_member_id, '2021A000011124' AS dguid, '' AS code UNION ALL
  SELECT '10000001' AS pid, 1 AS dimension_id, r_regionkey + 2 AS member_id, r_name AS member_name, 1 AS parent_member_id, concat('2021A0001', CAST(r_regionkey AS STRING)) AS dguid, '' AS code FROM {region} UNION ALL
  SELECT '10000001' AS pid, 1 AS dimension_id, n_nationkey + 7 AS member_id, n_name AS member_name, n_regionkey + 2 AS parent_member_id,
         CASE WHEN n_nationkey % 5 = 4 THEN '' ELSE concat('2021A0002', lpad(CAST(n_nationkey AS STRING), 2, '0')) END AS dguid,
         CASE WHEN n_nationkey % 5 = 4 THEN concat('[', lpad(CAST(n_nationkey AS STRING), 2, '0'), ']') ELSE '' END AS code FROM {nation} UNION ALL
  SELECT '10000001' AS pid, 2 AS dimension_id, 1 AS member_id, 'Total' AS member_name, CAST(NULL AS INT) AS parent_member_id, '' AS dguid, '' AS code UNION ALL
  SELECT DISTINCT '10000001' AS pid, 2 AS dimension_id, m2 AS member_id, pri AS member_name, 1 AS parent_member_id, '' AS dguid, '' AS code FROM pri WHERE m2 > 1 UNION ALL
  SELECT '10000001' AS pid, 3 AS dimension_id, 1 AS member_id, 'Orders' AS member_name, CAST(NULL AS INT) AS parent_member_id, '' AS dguid, '' AS code UNION ALL
  SELECT '10000001' AS pid, 3 AS dimension_id, 2 AS member_id, 'Total price' AS member_name, CAST(NULL AS INT) AS parent_member_id, '' AS dguid, '' AS code
)
"""

#: Line items by supplier nation, return flag and line status, with vectors; the unit of nation 3 changes in 1998.
LINES = """
cells AS (
  SELECT s.s_nationkey + 1 AS m1, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS m2, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS m3,
         substr(CAST(l_shipdate AS STRING), 1, 7) AS ref_date, CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DECIMAL(24, 2)) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DECIMAL(24, 2)) AS price,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2)) * CAST(l_discount AS DECIMAL(18, 2))) AS DECIMAL(28, 4)) AS discount
  FROM {lineitem} JOIN {supplier} s ON l_suppkey = s.s_suppkey
  GROUP BY s.s_nationkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END, substr(CAST(l_shipdate AS STRING), 1, 7)
), obs AS (
  SELECT '10000002' AS pid, concat(CAST(m1 AS STRING), '.', CAST(m2 AS STRING), '.', CAST(m3 AS STRING)) AS coordinate,
         CASE WHEN m3 = 2 THEN '' ELSE concat('v', CAST(m1 * 100 + m2 * 10 + m3 AS STRING)) END AS vector, m1, m2, m3, ref_date,
         CAST(quantity AS STRING) AS value, CAST(quantity AS DOUBLE) AS value_num, CASE WHEN n = 1 THEN 'E' ELSE '' END AS status, CASE WHEN m1 = 4 AND ref_date >= '1998-01' THEN 18 ELSE 17 END AS uom_id,
         0 AS scalar_id, 2 AS decimals, '' AS terminated, concat('2021A0002', lpad(CAST(m1 AS STRING), 2, '0')) AS dguid, m1 * 100000 + m2 * 10000 + m3 * 1000 AS row_index
  FROM cells
)
"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def cube(spark: SparkSession, sf_dir: str, text: str, name: str) -> DataFrame:
    """One frame of a derivation, such as ``obs`` or ``member``."""
    own = {t: f for t, f in tables(spark, sf_dir).items() if "{" + t + "}" in text}
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **own)


def oracle(text: str, sql: str) -> str:
    return "WITH " + text.format(**{t: t for t in TABLES}) + sql
