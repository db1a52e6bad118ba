"""Queries of sources and sinks: each writes a shape derived from the tables and reads it back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubewright.sources import archives, observations, storage

from .cubes import LINES, ORDERS, cube, oracle, tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add


def inventory(spark, sf_dir):
    part = tables(spark, sf_dir)["part"]
    dimension = lambda i, name, unit: F.struct(F.lit(name).alias("dimensionNameEn"), F.lit(i).alias("dimensionPositionId"), unit.alias("hasUOM"))
    record = F.struct(
        (F.col("p_partkey") - 3).alias("productId"), F.when(F.col("p_size") > 1, F.col("p_name")).otherwise("").alias("cubeTitleEn"), F.col("p_size").alias("frequencyCode"), F.array(F.col("p_type")).alias("subjectCode"),
        F.array(dimension(1, "Geography", F.lit(False)), dimension(2, "Size", F.col("p_size") > 20)).alias("dimensions"),
    )
    path = storage.work_path(spark, "inventory")
    part.select(F.to_json(record).alias("value")).write.text(path)  # a record a line, so that tasks share the work
    return archives.read_inventory(spark, path)


@add("SELECT CAST(p_partkey - 3 AS VARCHAR) AS pid, p_partkey - 3 AS productId, CASE WHEN p_size > 1 THEN p_name ELSE '' END AS title, p_size AS frequency_code, p_type AS subject, CAST(2 AS INT) AS n_dimensions FROM part")
def read_inventory(spark, sf_dir):
    cube = inventory(spark, sf_dir)["cube"]
    return cube.select("pid", "productId", "title", "frequency_code", F.col("subject_codes")[0].alias("subject"), "n_dimensions")


@add("SELECT CAST(p_partkey - 3 AS VARCHAR) AS pid, i AS dimension_id, CASE i WHEN 1 THEN 'Geography' ELSE 'Size' END AS name, i = 2 AND p_size > 20 AS has_uom FROM part, (SELECT unnest([1, 2]) AS i)")
def inventory_dimension(spark, sf_dir):
    return inventory(spark, sf_dir)["inventory_dimension"]


BAD = "SELECT p_partkey, CASE p_partkey % 50 WHEN 7 THEN '-4' WHEN 8 THEN '\"12\"' WHEN 9 THEN '12.5' WHEN 11 THEN '77' ELSE CAST(p_partkey + 100 AS STRING) END AS id, CASE p_partkey % 50 WHEN 10 THEN '\"\"' ELSE concat('\"', p_name, '\"') END AS title, CASE p_partkey % 50 WHEN 12 THEN 'null' WHEN 13 THEN '\"6\"' ELSE '6' END AS freq, p_partkey % 50 = 14 AS bare FROM {part}"


@add("WITH b AS (" + BAD.format(part="part") + """), p AS (SELECT p_partkey % 50 AS k, replace(id, '"', '') AS pid FROM b)
SELECT pid, 'productId' AS problem FROM p WHERE k IN (7, 8, 9) UNION ALL SELECT pid, 'title' FROM p WHERE k = 10 UNION ALL SELECT pid, 'frequencyCode' FROM p WHERE k IN (12, 13) UNION ALL SELECT pid, 'dimensions' FROM p WHERE k = 14 UNION ALL SELECT pid, 'repeated' FROM p GROUP BY pid HAVING count(*) > 1""")
def check_inventory(spark, sf_dir):
    rows = spark.sql(BAD, part=tables(spark, sf_dir)["part"])
    dimension = F.when(F.col("bare"), "[]").otherwise('[{"dimensionPositionId": 1}]')
    return archives.check_inventory(rows.select(F.concat(F.lit('{"productId": '), "id", F.lit(', "cubeTitleEn": '), "title", F.lit(', "frequencyCode": '), "freq", F.lit(', "dimensions": '), dimension, F.lit("}")).alias("record")))


HEADERS = ["Cube", "Members", "Notes"]
STACK = """SELECT CAST(c_custkey AS STRING) AS pid, i AS line_no, CASE WHEN i IN (0, 3, 6) THEN CASE i WHEN 0 THEN 'Cube' WHEN 3 THEN CASE WHEN c_custkey % 9 = 0 THEN 'Cube' ELSE 'Members' END ELSE 'Notes' END ELSE concat(c_mktsegment, ' ', CAST(i AS STRING)) END AS line FROM {customer} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8)) v(i)"""


def stack(spark, sf_dir):
    return spark.sql(STACK, customer=tables(spark, sf_dir)["customer"])


@add("WITH l AS (" + STACK.format(customer="customer") + ") SELECT pid, line_no, line, CASE WHEN line_no < 3 THEN 'Cube' WHEN line_no < 6 THEN CASE WHEN CAST(pid AS BIGINT) % 9 = 0 THEN 'Cube' ELSE 'Members' END ELSE 'Notes' END AS block FROM l WHERE line_no NOT IN (0, 3, 6)")
def split_blocks(spark, sf_dir):
    return archives.split_blocks(stack(spark, sf_dir), HEADERS)


@add("SELECT CAST(c_custkey AS VARCHAR) AS pid, h AS header, CAST(n AS BIGINT) AS n FROM customer, (VALUES ('Cube', 2), ('Members', 0)) v(h, n) WHERE c_custkey % 9 = 0")
def block_errors(spark, sf_dir):
    return archives.block_errors(stack(spark, sf_dir), HEADERS)


@add("SELECT CAST(o_custkey AS VARCHAR) AS pid, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS record, CAST(o_orderkey AS VARCHAR) || ',note' || chr(10) || o_orderpriority || chr(10) || '' AS text FROM orders")
def fold_loose_records(spark, sf_dir):
    orders = tables(spark, sf_dir)["orders"].select(F.col("o_custkey").cast("string").alias("pid"), "o_orderkey", F.posexplode(F.array(F.concat(F.col("o_orderkey").cast("string"), F.lit(",note")), F.col("o_orderpriority"), F.lit(""))).alias("i", "line"))
    return archives.fold_records(orders.select("pid", (F.col("o_orderkey") * 10 + F.col("i")).alias("line_no"), "line"), r"^\d+,")


@add("""SELECT CAST(c_custkey AS VARCHAR) AS pid, CAST(1 AS INT) AS dimension_id, c_mktsegment || ' "old" x' AS member_name, '[' || c_nationkey || ']' AS code, CAST(c_custkey AS INT) AS member_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(1 AS INT) END AS parent_member_id FROM customer""")
def member_lines(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"]
    line = F.concat(F.lit('1,"'), "c_mktsegment", F.lit(' "old" x",['), F.col("c_nationkey").cast("string"), F.lit("],"), F.col("c_custkey").cast("string"), F.lit(","), F.when(F.col("c_custkey") % 2 == 0, "1").otherwise(""), F.lit(",f"))
    return archives.parse_members(c.select(F.col("c_custkey").cast("string").alias("pid"), line.alias("line")))[0]


TYPES = "SELECT p_type, row_number() OVER (ORDER BY p_type) AS id FROM (SELECT DISTINCT p_type FROM part)"


@add(f"WITH t AS ({TYPES}), c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) SELECT b.p_brand AS brand, b.p_brand || '.' || CAST(id AS VARCHAR) AS coordinate, CAST(n AS VARCHAR) AS value, CASE WHEN n IS NULL THEN 'x' ELSE '' END AS symbol FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN t LEFT JOIN c ON c.p_brand = b.p_brand AND c.p_type = t.p_type")
def unpivot_wide(spark, sf_dir):
    part = tables(spark, sf_dir)["part"]
    types = [r["p_type"] for r in part.select("p_type").distinct().orderBy("p_type").collect()]  # the header of the wide file
    wide = part.groupBy(F.col("p_brand").alias("brand")).pivot("p_type", types).count()
    values = F.array(*[F.col(f"`{t}`").cast("string") for t in types])
    rows = wide.select("brand", F.col("brand").alias("coordinate"), values.alias("v"), F.transform(values, lambda v: F.when(v.isNull(), "x").otherwise("")).alias("s"))
    return archives.unpivot_wide(rows.withColumnRenamed("brand", "brand"), ["brand"], list(range(1, len(types) + 1)), "v", "s")


@add("SELECT n_nationkey AS position, CAST(CASE WHEN n_nationkey = 9 THEN 3 WHEN n_nationkey = 12 THEN 99 ELSE n_nationkey END AS INT) AS member_id, CASE WHEN n_nationkey % 3 = 1 THEN 'other' WHEN n_nationkey % 3 = 2 THEN n_name || ' (1)' ELSE n_name END AS label, CASE WHEN n_nationkey = 9 THEN 'not ascending' WHEN n_nationkey = 12 THEN 'unknown id' WHEN n_nationkey = 13 THEN 'not ascending' WHEN n_nationkey % 3 = 1 THEN 'another name' ELSE '' END AS problem FROM nation")
def decode_wide_header(spark, sf_dir):
    nation = tables(spark, sf_dir)["nation"]
    id_ = F.when(F.col("n_nationkey") == 9, 3).when(F.col("n_nationkey") == 12, 99).otherwise(F.col("n_nationkey"))
    label = F.when(F.col("n_nationkey") % 3 == 1, "other").when(F.col("n_nationkey") % 3 == 2, F.concat("n_name", F.lit(" (1)"))).otherwise(F.col("n_name"))
    name = F.concat(F.lit("Geo (25):"), label, F.lit("["), id_.cast("string"), F.lit("]"))
    return archives.decode_wide_header(nation.select(F.col("n_nationkey").alias("position"), name.alias("name")), nation.select(F.col("n_nationkey").cast("int").alias("member_id"), F.col("n_name").alias("member_name")))


@add("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS en, 'fr ' || n_name AS fr, CASE WHEN n_nationkey % 2 = 0 THEN 'x' END AS representation FROM nation")
def code_sets(spark, sf_dir):
    return storage.read_code_set(spark, code_set(spark, sf_dir, False))[0]


def code_set(spark, sf_dir, mixed):
    """A code set is one small JSON document: the nations, one row each."""
    text = F.when(F.lit(mixed) & (F.col("n_nationkey") > 20), F.concat(F.lit('"'), F.col("n_nationkey").cast("string"), F.lit('"'))).otherwise(F.col("n_nationkey").cast("string"))
    mark = F.when(F.col("n_nationkey") % 2 == 0, '"x"').otherwise("null")
    record = F.concat(F.lit('{"code": '), text, F.lit(', "en": "'), "n_name", F.lit('", "fr": "fr '), "n_name", F.lit('", "representation": '), mark, F.lit("}"))
    path = storage.work_path(spark, "codes")
    tables(spark, sf_dir)["nation"].agg(F.concat(F.lit('{"object": ['), F.array_join(F.collect_list(record), ", "), F.lit("]}")).alias("value")).write.text(path)
    return path


@add("SELECT 'codes of two types' AS problem, count(*) AS n FROM region WHERE r_regionkey = 0 UNION ALL SELECT 'another checksum', 1 FROM region WHERE r_regionkey = 0")
def code_set_problems(spark, sf_dir):
    return storage.read_code_set(spark, code_set(spark, sf_dir, True), "0" * 64)[1].groupBy("problem").agg(F.count("*").alias("n"))


@add("SELECT r_name AS name, string_agg(CAST(n_nationkey AS VARCHAR), ',' ORDER BY CAST(n_nationkey AS VARCHAR)) AS codes FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1")
def reference_csv(spark, sf_dir):
    t = tables(spark, sf_dir)
    path = storage.work_path(spark, "regions")
    joined = t["region"].join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey")).groupBy(F.col("r_name").alias("name"))
    joined.agg(F.array_join(F.array_sort(F.collect_list(F.col("n_nationkey").cast("string"))), ";").alias("codes")).write.csv(path, header=True)
    return storage.read_reference(spark, path, "name string, codes string").select("name", F.array_join(F.split("codes", ";"), ",").alias("codes"))


@add("SELECT * FROM supplier WHERE s_suppkey % 3 <> 2 OR s_suppkey % 2 = 0")
def union_builds(spark, sf_dir):
    s = tables(spark, sf_dir)["supplier"]
    return storage.union_builds([s.where("s_suppkey % 3 <> 2"), s.where("s_suppkey % 2 = 0")])[0]


@add("SELECT (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 2) + (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 0) AS rows, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 2 OR s_suppkey % 2 = 0) AS kept, (SELECT count(*) FROM supplier WHERE s_suppkey % 3 <> 2 AND s_suppkey % 2 = 0) AS repeats")
def union_builds_report(spark, sf_dir):
    s = tables(spark, sf_dir)["supplier"]
    return storage.union_builds([s.where("s_suppkey % 3 <> 2"), s.where("s_suppkey % 2 = 0")])[1]


@add("SELECT c_custkey AS pid, CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'b' END AS build FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 5 = 0) AND (c_custkey % 3 = 0 OR c_custkey % 5 = 0)")
def merge_manifests(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("pid"))
    return storage.merge_manifests(c.where("pid % 3 = 0"), c.where("pid % 5 = 0"))[0]


@add("SELECT c_custkey AS pid, c_name FROM customer WHERE c_custkey % 4 <> 0")
def assemble_catalogue(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("pid"), "c_name")
    return storage.assemble_catalogue(c, c.select("pid", F.when(F.col("pid") % 4 == 0, "failed").otherwise("ok").alias("status")), ["c_name"])


@add("SELECT c_custkey AS pid FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 7 = 0")
def pending_tables(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("pid"))
    reports = c.select("pid", F.when(F.col("pid") % 4 == 0, "failed").otherwise("ok").alias("status"), (F.col("pid") * 10).alias("bytes"))
    return storage.pending_tables(c, reports, c.select("pid", (F.col("pid") * 10 + F.when(F.col("pid") % 7 == 0, 1).otherwise(0)).alias("size")))


@add("SELECT c_name AS path, CASE WHEN c_custkey % 6 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM customer WHERE c_custkey % 6 = 0 OR c_custkey % 11 = 0")
def verify_hashes(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"]
    expected = c.select(F.col("c_name").alias("path"), F.sha2("c_mktsegment", 256).alias("hash"))
    actual = c.where("c_custkey % 6 <> 0").select(F.col("c_name").alias("path"), F.sha2(F.when(F.col("c_custkey") % 11 == 0, "x").otherwise(F.col("c_mktsegment")), 256).alias("hash"))
    return storage.verify_hashes(expected, actual)


@add(oracle(ORDERS, "SELECT m1, m2, m3, ref_date, value, status FROM obs"))
def write_sorted_parquet(spark, sf_dir):
    path = storage.work_path(spark, "obs")
    storage.write_sorted(cube(spark, sf_dir, ORDERS, "obs"), path, ["m1", "m2", "m3", "ref_date"], 8)
    return spark.read.parquet(path).select("m1", "m2", "m3", "ref_date", "value", "status")


@add(oracle(LINES, "SELECT m1, m2, m3, ref_date, value FROM obs"))
def write_series_parts(spark, sf_dir):
    path = storage.work_path(spark, "parts")
    storage.write_parts(cube(spark, sf_dir, LINES, "obs"), path, "m1")
    return spark.read.parquet(path).select("m1", "m2", "m3", "ref_date", "value")


@add(oracle(LINES, "SELECT m1, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(coordinate || '|' || ref_date || '|' || value), 1, 15) AS BIGINT)) AS VARCHAR) AS hash FROM obs GROUP BY m1"))
def write_manifest(spark, sf_dir):
    found = storage.manifest(cube(spark, sf_dir, LINES, "obs"), "m1", ["coordinate", "ref_date", "value"])
    return found.withColumn("hash", F.col("hash").cast("string"))


@add(oracle(LINES, "SELECT count(DISTINCT m1) AS tables, true AS hashed, true AS sized FROM obs"))
def file_manifest(spark, sf_dir):
    """A file or more for each part; every one has its size and its SHA-256."""
    path = storage.work_path(spark, "hashed")
    storage.write_parts(cube(spark, sf_dir, LINES, "obs"), path, "m1")
    files = storage.file_manifest(spark, path).where(F.col("path").contains("/m1="))
    return files.agg(F.count_distinct(F.regexp_extract("path", r"/m1=(\d+)/", 1)).alias("tables"), F.bool_and(F.length("sha256") == 64).alias("hashed"), F.bool_and(F.col("bytes") > 0).alias("sized"))


@add(oracle(LINES, "SELECT m1, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(coordinate || '|' || ref_date || '|' || value), 1, 15) AS BIGINT)) AS VARCHAR) AS hash, CASE WHEN m1 % 3 = 0 THEN '1' ELSE '2' END AS tool FROM obs GROUP BY m1"))
def resumed_parts(spark, sf_dir):
    """A build of every third nation by one tool, and of all by the next in batches, which keeps none of the other's rows."""
    path = storage.work_path(spark, "resumed")
    obs = cube(spark, sf_dir, LINES, "obs").select("m1", "coordinate", "ref_date", "value")
    storage.build_parts(obs.where("m1 % 3 = 0"), path, "m1", "1")
    storage.build_parts(obs.where("m1 % 3 = 1"), path, "m1", "2")
    found = storage.build_parts(obs.where("m1 % 3 <> 0"), path, "m1", "2", batches=3)
    return found.select("m1", "rows", F.col("hash").cast("string").alias("hash"), "tool")


@add(oracle(LINES, "SELECT CASE WHEN m1 % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, count(DISTINCT m1) AS tables, count(*) AS rows, true AS sized, CAST(count(DISTINCT CASE WHEN m1 % 4 = 0 THEN m1 END) AS BIGINT) AS warnings FROM obs GROUP BY 1"))
def build_summary(spark, sf_dir):
    """The parts' files by hash, with a report for each table."""
    path = storage.work_path(spark, "recorded")
    obs = cube(spark, sf_dir, LINES, "obs")
    storage.write_parts(obs, path, "m1")
    files = storage.file_manifest(spark, path).withColumn("pid", F.regexp_extract("path", r"/m1=(\d+)/", 1))
    bad = F.col("m1") % 4 == 0
    reports = obs.groupBy("m1").agg(F.count("*").alias("rows")).select(F.col("m1").cast("string").alias("pid"), F.when(bad, "failed").otherwise("ok").alias("status"), "rows", F.when(bad, F.array(F.lit("odd"))).alias("warnings"))
    inputs = files.select("pid", F.concat(F.lit("in/"), "pid").alias("path"), "bytes", "sha256")
    rows, summary = storage.build_record(reports, files, inputs, {"script": "build", "spark": "4"})
    sized = rows.select("status", (F.size("files") > 0).alias("s")).groupBy("status").agg(F.bool_and("s").alias("sized"))
    return summary.join(sized, "status").select("status", "tables", "rows", "sized", "warnings")


@add("""SELECT c_custkey AS pid, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 3 <> 0 AS reuse, CASE WHEN c_custkey % 7 = 0 THEN 'inputs' WHEN c_custkey % 5 = 0 THEN 'tool' WHEN c_custkey % 3 = 0 THEN 'proof' ELSE '' END AS why FROM customer""")
def reuse_builds(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("pid"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("part"))
    path = F.concat_ws("/", F.col("pid").cast("string"), "part")
    expected = c.select("pid", path.alias("path"), F.sha2(path, 256).alias("hash"), F.when((F.col("pid") % 5 == 0) & (F.col("part") == "b"), "1").otherwise("2").alias("tool"))
    actual = c.where("NOT (pid % 7 = 0 AND part = 'a')").select(path.alias("path"), F.sha2(path, 256).alias("hash"))
    return storage.reuse(expected, actual, "2", c.select("pid", (F.col("pid") % 3 != 0).alias("proved")).distinct().where("pid % 6 <> 0"))


@add("SELECT CASE WHEN c_custkey % 4 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS tables, CAST(sum(c_nationkey) AS BIGINT) AS rows FROM customer GROUP BY 1")
def merged_summary(spark, sf_dir):
    c = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").alias("pid"), F.when(F.col("c_custkey") % 4 == 0, "failed").otherwise("ok").alias("status"), F.col("c_nationkey").cast("long").alias("rows"))
    return storage.merged_summary(c.where("pid % 3 = 0"), c.where("pid % 3 <> 0"))


@add("SELECT CAST(o_custkey AS VARCHAR) AS series, '[' || string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) || ']' AS points, CAST(len(list(o_orderkey)) AS INT) AS typed, 'orders' AS source FROM orders GROUP BY 1")
def export_view(spark, sf_dir):
    """Once as CSV, with lists as JSON text, and once as Parquet, with typed lists, each beside its provenance."""
    path = storage.work_path(spark, "export")
    rows = tables(spark, sf_dir)["orders"].groupBy(F.col("o_custkey").cast("string").alias("series")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("points"))
    for kind in ("csv", "parquet"):
        storage.export_view(rows, f"{path}/{kind}", kind, spark.createDataFrame([("orders", kind)], "source string, kind string"))
    text = spark.read.csv(f"{path}/csv/points", header=True, schema="series string, points string")
    typed = spark.read.parquet(f"{path}/parquet/points").select("series", F.size("points").alias("typed"))
    source = spark.read.json(f"{path}/parquet/provenance").select("source")
    return text.join(typed, "series").join(F.broadcast(source))  # one row


def packed(spark, sf_dir):
    """An archive for each nation's observations, written by the tasks to the shared folder, which has to be a mounted one.

    A unit holds a line end, one dimension's name quotes and a comma, labels a line end or a code. Nations divisible by 5
    have another header, by 7 a wider last row, by 11 a label that isn't the member's, by 13 a second value that is no number.
    """
    import pandas as pd

    folder = storage.work_path(spark, "archives").removeprefix("file://")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        import csv
        import io
        import os
        import zipfile

        os.makedirs(folder, exist_ok=True)
        nation = int(frame.m1.iloc[0])
        pid, text = f"1000{nation:04d}", io.StringIO(newline="")
        out = csv.writer(text)
        place = "PLACE" if nation % 5 == 0 else "GEO"
        out.writerow(["REF_DATE", place, "DGUID", 'Flag, "own"', "Status", "UOM", "UOM_ID", "SCALAR_FACTOR", "SCALAR_ID", "VECTOR", "COORDINATE", "VALUE", "STATUS", "SYMBOL", "TERMINATED", "DECIMALS"])
        rows = frame.sort_values(["m2", "m3", "ref_date"]).reset_index(drop=True)
        for k, r in rows.iterrows():
            geo = "Elsewhere" if nation % 11 == 0 and k == 0 else f"Nation {nation}"
            flag = f'Flag "{r.m2}"' + ("\n" if r.m2 == 3 else "")
            value = "1e3" if nation % 13 == 0 and k == 1 else r.value
            extra = ["more"] if nation % 7 == 0 and k == len(rows) - 1 else []
            out.writerow([r.ref_date, geo, r.dguid, flag, f"Status {r.m3} [{r.m3}]" if r.m3 == 2 else "Status 1", "Dollars,\nall", r.uom_id, "units", r.scalar_id, r.vector, r.coordinate, value, r.status, "", r.terminated, r.decimals, *extra])
        with zipfile.ZipFile(f"{folder}/{pid}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(f"{pid}.csv", "\ufeff" + text.getvalue())
            z.writestr(f"{pid}_MetaData.csv", "")
        return pd.DataFrame({"path": [f"{folder}/{pid}.zip"]})

    chosen = ["m1", "m2", "m3", "ref_date", "dguid", "uom_id", "scalar_id", "vector", "coordinate", "value", "status", "terminated", "decimals"]
    made = cube(spark, sf_dir, LINES, "obs").select(*chosen).groupBy("m1").applyInPandas(pack, "path string")
    paths = sorted(r["path"] for r in made.collect())  # one an archive
    spark.dataSource.register(archives.StatZip)
    return spark.read.format("statzip").option("paths", ",".join(paths))


def read_packed(spark, sf_dir):
    records = packed(spark, sf_dir).load()
    pids = cube(spark, sf_dir, LINES, "obs").select(F.format_string("1000%04d", "m1").alias("pid"), "m1").distinct()
    dimension = pids.selectExpr("pid", "stack(3, 1, 'Geography', 2, 'Flag, \"own\"', 3, 'Status') AS (dimension_id, dimension_name)")
    flags = ", ".join(f"2, {k}, '{name}', ''" for k, name in ((1, 'Flag "1"'), (2, 'Flag "2"'), (3, "Flag 3")))
    member = pids.selectExpr("pid", f"stack(6, 1, m1, concat('Nation ', m1), '', {flags}, 3, 1, 'Status 1', '', 3, 2, 'Status 2', '[2]') AS (dimension_id, member_id, member_name, classification_code)")
    return observations.read_observations(records, dimension, member)


NUMBERED = ", numbered AS (SELECT *, concat('1000', lpad(CAST(m1 AS VARCHAR), 4, '0')) AS file, row_number() OVER (PARTITION BY m1 ORDER BY m2, m3, ref_date) AS k, count(*) OVER (PARTITION BY m1) AS n FROM obs) "
WHOLE_FILES = "m1 % 5 <> 0 AND m1 % 7 <> 0 AND m1 % 11 <> 0 AND NOT (m1 % 13 = 0 AND n > 1)"


@add(oracle(LINES, NUMBERED + f"SELECT file AS pid, k AS row_index, ref_date, dguid, 'Dollars,' || chr(10) || 'all' AS uom, uom_id, vector, coordinate, value, value_num, status, m1 AS member_id_1, m2 AS member_id_2, m3 AS member_id_3, CAST(NULL AS INT) AS member_id_4 FROM numbered WHERE {WHOLE_FILES}"))
def archive_observations(spark, sf_dir):
    found = read_packed(spark, sf_dir)[0]
    return found.select("pid", "row_index", "ref_date", "dguid", "uom", "uom_id", "vector", "coordinate", "value", "value_num", "status", "member_id_1", "member_id_2", "member_id_3", "member_id_4")


@add(oracle(LINES, NUMBERED + """
SELECT file AS pid, 0::BIGINT AS row_index, 'another header: REF_DATE,PLACE,DGUID,Flag, "own",Status,UOM,UOM_ID,SCALAR_FACTOR,SCALAR_ID,VECTOR,COORDINATE,VALUE,STATUS,SYMBOL,TERMINATED,DECIMALS' AS problem FROM numbered WHERE m1 % 5 = 0 AND k = 1
UNION ALL SELECT file, k, 'width 17, expected 16' FROM numbered WHERE m1 % 7 = 0 AND k = n
UNION ALL SELECT file, k, 'dimension 1 member ' || m1 || ' is Nation ' || m1 || ', labelled Elsewhere' FROM numbered WHERE m1 % 11 = 0 AND k = 1
UNION ALL SELECT file, k, 'not a number: 1e3' FROM numbered WHERE m1 % 13 = 0 AND k = 2"""))
def archive_problems(spark, sf_dir):
    return read_packed(spark, sf_dir)[1]


@add(oracle(LINES, NUMBERED + "SELECT file AS pid, count(*) AS n_rows, CAST(0 AS BIGINT) AS blank_values, count(*) FILTER (m2 = 3 AND NOT (m1 % 7 = 0 AND k = n) AND NOT (m1 % 13 = 0 AND k = 2)) AS loose_labels FROM numbered GROUP BY file"))
def archive_report(spark, sf_dir):
    return read_packed(spark, sf_dir)[2]


@add(oracle(LINES, "SELECT concat('1000', lpad(CAST(m1 AS VARCHAR), 4, '0')) AS pid, count(*) AS n_rows, min(ref_date) AS first, max(value) AS most FROM obs WHERE m1 % 13 <> 0 GROUP BY m1"))
def scan_archives(spark, sf_dir):
    """Only the tables asked for are opened."""
    reader = packed(spark, sf_dir).option("pids", ",".join(f"1000{m:04d}" for m in range(1, 26) if m % 13))
    wide = F.size("cells") - F.size("cells") % 16 - 16  # a wider row has its cell more at the end
    rows = reader.load().where("row_index > 0").select("pid", F.get("cells", F.lit(0)).alias("ref_date"), F.get("cells", wide + 11).alias("value"))
    return rows.groupBy("pid").agg(F.count("*").alias("n_rows"), F.min("ref_date").alias("first"), F.max("value").alias("most"))


def wide_records(spark, sf_dir):
    """Wide files' records: a file a brand, a row a size, a value column a container type of the brand; the last have notes.

    Brands that end in 1 have a row too many cells, in 2 a row after a blank line, in 3 columns that don't ascend, in 4 rows
    out of order.
    """
    import pandas as pd

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        brand, kinds = frame.pid.iloc[0], sorted(frame.kind.unique())
        columns = list(enumerate(kinds, 1))
        if brand.endswith("3") and len(columns) > 1:
            columns[0], columns[1] = columns[1], columns[0]
        header = ["REF_DATE", "GEO", "DGUID", "Coordinate"]
        for i, kind in columns:
            header += [f"Type: {kind}{f' ({i})' if i % 2 == 0 else ''}[{i}]", "Symbol" if i % 3 else "Symbols"]
        counts = frame.set_index(["size", "kind"]).n.to_dict()
        rows = []
        for size in sorted(frame["size"].unique(), reverse=brand.endswith("4")):
            row = ["2021", f'Size "{size}" ', f"g{size}", str(size)]
            for _, kind in columns:
                n = counts.get((size, kind))
                row += ["" if n is None else str(n), "r,.." if n is None else ""]
            rows.append(row)
        if brand.endswith("1"):
            rows[-1].append("more")
        if brand.endswith("2"):
            rows.insert(1, [])
        rows += [[], []]
        return pd.DataFrame({"pid": brand, "row_index": range(len(rows) + 1), "cells": [header, *rows], "problem": None})

    part = tables(spark, sf_dir)["part"].groupBy(F.col("p_brand").alias("pid"), F.col("p_size").alias("size"), F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))
    return part, part.groupBy("pid").applyInPandas(pack, "pid string, row_index long, cells array<string>, problem string")


def read_wide(spark, sf_dir):
    part, records = wide_records(spark, sf_dir)
    dimension = part.select("pid").distinct().selectExpr("pid", "stack(2, 1, 'Geography', 2, 'Type') AS (dimension_id, dimension_name)")
    sizes = part.select("pid", F.lit(1).alias("dimension_id"), F.col("size").cast("int").alias("member_id"), F.concat(F.lit("Size "), F.col("size").cast("string")).alias("member_name"), F.lit("").alias("member_notes")).distinct()
    kinds = part.groupBy("pid").agg(F.array_sort(F.collect_set("kind")).alias("k")).select("pid", F.posexplode("k").alias("i", "kind"))
    kinds = kinds.select("pid", F.lit(2).alias("dimension_id"), (F.col("i") + 1).cast("int").alias("member_id"), F.col("kind").alias("member_name"), (F.col("i") + 1).cast("string").alias("member_notes"))
    return observations.read_wide(records, dimension, sizes.union(kinds).withColumn("classification_code", F.lit("")))


WIDE = """WITH c AS (SELECT p_brand AS pid, p_size AS size, p_type AS kind, count(*) AS n FROM part GROUP BY ALL), k AS (SELECT pid, kind, row_number() OVER (PARTITION BY pid ORDER BY kind) AS id, count(*) OVER (PARTITION BY pid) AS kinds FROM (SELECT DISTINCT pid, kind FROM c)),
s AS (SELECT pid, size, row_number() OVER (PARTITION BY pid ORDER BY size) AS i, count(*) OVER (PARTITION BY pid) AS sizes FROM (SELECT DISTINCT pid, size FROM c)) """


@add(WIDE + """SELECT pid, i AS row_index, 'g' || size AS dguid, size || '.' || id AS coordinate, coalesce(CAST(n AS VARCHAR), '') AS value, CAST(n AS DOUBLE) AS value_num, CASE WHEN n IS NULL THEN '..' ELSE '' END AS status, CASE WHEN n IS NULL THEN 'r' ELSE '' END AS symbol, CAST(size AS INT) AS member_id_1, CAST(id AS INT) AS member_id_2, CAST(NULL AS INT) AS member_id_3
FROM s JOIN k USING (pid) LEFT JOIN c USING (pid, size, kind) WHERE right(pid, 1) NOT IN ('1', '2', '3', '4')""")
def wide_observations(spark, sf_dir):
    found = read_wide(spark, sf_dir)[0]
    return found.select("pid", "row_index", "dguid", "coordinate", "value", "value_num", "status", "symbol", "member_id_1", "member_id_2", "member_id_3")


@add(WIDE + """SELECT pid, sizes AS row_index, 'width ' || (5 + 2 * kinds) || ', expected ' || (4 + 2 * kinds) AS problem FROM s JOIN (SELECT DISTINCT pid, kinds FROM k) USING (pid) WHERE pid LIKE '%1' AND i = sizes
UNION ALL SELECT pid, i + 1, 'data after a blank line' FROM s WHERE pid LIKE '%2' AND i > 1
UNION ALL SELECT pid, 0, 'value column Type: ' || kind || '[1]: not ascending' FROM k WHERE pid LIKE '%3' AND id = 1 AND kinds > 1
UNION ALL SELECT DISTINCT pid, CAST(NULL AS BIGINT), (sizes - 1) || ' rows not after the one before' FROM s WHERE pid LIKE '%4' AND sizes > 1""")
def wide_problems(spark, sf_dir):
    return read_wide(spark, sf_dir)[1]
