"""Queries of metadata files: a stacked file for every customer, some of them with faults, read by the block rules."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from cubewright.operators import records
from cubewright.sources import metadata

from .cubes import LINES, ORDERS, cube, oracle, tables
from .registering import Registry

REGISTRY = Registry()
add = REGISTRY.add

#: Every 11th file has a second cube row, every 13th a wider row, every 17th a bad integer, every 19th an unknown column,
#: every 23rd no survey block, and every 29th declares three dimensions.
STACK = [
    "'Cube Title,Product Id,Total number of dimensions' || CASE WHEN c_custkey % 19 = 0 THEN ',Colour' ELSE '' END",
    "'\"Orders, \"\"all\"\" of ' || c_name || '\",' || CAST(c_custkey AS STRING) || CASE WHEN c_custkey % 29 = 0 THEN ',3' ELSE ',2' END",
    "CASE WHEN c_custkey % 11 = 0 THEN 'Again,1,2' ELSE '' END",
    "'Dimension ID,Dimension name,Dimension Notes'", "'1,Geography,'", "'2,\"Sex, age\",1;2' || CASE WHEN c_custkey % 13 = 0 THEN ',more' ELSE ',' END", "',,'",
    "'Dimension ID,Member Name,Classification Code,Member ID,Parent Member ID,Terminated,Member Notes'",
    "'1,\"Total \"old\" one\",[' || CAST(c_nationkey AS STRING) || '],1,,,2,3'",
    "'1,' || c_mktsegment || ',,2,' || CASE WHEN c_custkey % 17 = 0 THEN 'x' ELSE '1' END || ',t,1,'",
    "'Symbol,Description'", "'x,hidden'", "CASE WHEN c_custkey % 23 = 0 THEN '' ELSE 'Survey Code,Survey Name' END", "CASE WHEN c_custkey % 23 = 0 THEN '' ELSE '7,Orders' END",
    "'Subject Code,Subject Name'", "'35,Trade'", "'Note ID,Note'", "'1,\"First \"of\" two'", "''", "'lines\",'", "'2,plain'", "'Correction ID,Correction Date,Correction Note'", "'5,2020-01-02,\"Mended <b>' || c_mktsegment || '</b>\"'",
]
FAULTY = " OR ".join(f"c_custkey % {n} = 0" for n in (11, 13, 17, 19, 23, 29))


def stacked(spark, sf_dir, texts):
    """A file of ``texts`` for every customer. Customers are dealt out before their lines are made, as these are many times larger."""
    files = tables(spark, sf_dir)["customer"].select(F.col("c_custkey").cast("string").alias("pid"), "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    each = metadata.dealt_out(files, len(texts)).select("pid", F.posexplode(F.array(*[F.expr(s) for s in texts])).alias("line_no", "line"))
    return each.select("pid", F.col("line_no").cast("int"), "line")


def lines(spark, sf_dir):
    return stacked(spark, sf_dir, STACK)


def block(name):
    return lambda spark, sf_dir: metadata.read_metadata(lines(spark, sf_dir), dealt=True)[0][name]


@add(f"SELECT CAST(c_custkey AS VARCHAR) AS pid, 'Orders, \"all\" of ' || c_name AS cube_title, CAST(c_custkey AS VARCHAR) AS product_id, CAST(2 AS INT) AS total_dimensions, CAST(NULL AS VARCHAR) AS frequency FROM customer WHERE NOT ({FAULTY})")
def read_metadata_cube(spark, sf_dir):
    return block("cube")(spark, sf_dir).select("pid", "cube_title", "product_id", "total_dimensions", "frequency")


@add("""
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS pid FROM customer)
SELECT pid, CAST(NULL AS INT) AS line_no, '2 cube rows' AS problem FROM c WHERE k % 11 = 0
UNION ALL SELECT pid, 5, 'row wider than its header' FROM c WHERE k % 13 = 0
UNION ALL SELECT pid, NULL, '1 dimensions of ' || CASE WHEN k % 29 = 0 THEN '3' ELSE '2' END FROM c WHERE k % 13 = 0 AND k % 11 <> 0
UNION ALL SELECT pid, 9, 'not an integer: parent_member_id' FROM c WHERE k % 17 = 0
UNION ALL SELECT pid, 0, 'unknown column Colour' FROM c WHERE k % 19 = 0
UNION ALL SELECT pid, NULL, 'missing block survey' FROM c WHERE k % 23 = 0
UNION ALL SELECT pid, NULL, '2 dimensions of 3' FROM c WHERE k % 29 = 0 AND k % 13 <> 0 AND k % 11 <> 0
""")
def read_metadata(spark, sf_dir):
    return metadata.read_metadata(lines(spark, sf_dir), dealt=True)[1]


@add("""
SELECT CAST(c_custkey AS VARCHAR) AS pid, CAST(1 AS INT) AS dimension_id, 'Geography' AS dimension_name, '' AS dimension_notes, CAST(NULL AS VARCHAR) AS dimension_definitions FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 'Sex, age', '1;2', NULL FROM customer WHERE c_custkey % 13 <> 0
""")
def parse_blocks(spark, sf_dir):
    rows = metadata.parse_block(metadata.named_blocks(lines(spark, sf_dir), dealt=True), "dimension")[0]
    return rows.select("pid", "dimension_id", "dimension_name", "dimension_notes", "dimension_definitions")


@add("""
SELECT CAST(c_custkey AS VARCHAR) AS pid, CAST(1 AS INT) AS dimension_id, 'Total "old" one' AS member_name, '[' || c_nationkey || ']' AS classification_code, CAST(1 AS INT) AS member_id, CAST(NULL AS INT) AS parent_member_id, '' AS terminated, '2;3' AS member_notes FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 1, c_mktsegment, '', 2, 1, 't', '1' FROM customer WHERE c_custkey % 17 <> 0
""")
def parse_member_lines(spark, sf_dir):
    rows = metadata.parse_block(metadata.named_blocks(lines(spark, sf_dir), dealt=True), "member")[0]
    return rows.select("pid", "dimension_id", "member_name", "classification_code", "member_id", "parent_member_id", "terminated", "member_notes")


@add("""
SELECT CAST(c_custkey AS VARCHAR) AS pid, CAST(1 AS INT) AS note_id, 'First "of" two' || chr(10) || chr(10) || 'lines' AS note FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 2, 'plain' FROM customer
""")
def loose_notes(spark, sf_dir):
    return metadata.loose_block(metadata.named_blocks(lines(spark, sf_dir), dealt=True), "note")[0]


@add("""
WITH c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS pid, c_mktsegment AS s FROM customer)
SELECT pid, CAST(1 AS INT) AS source, '2020-01-02' AS date, 'Mended  ' || s || ' ' AS text FROM c UNION ALL SELECT pid, 2, '2021-05-0' || CAST(1 + k % 9 AS VARCHAR), 'Inventory' FROM c WHERE k % 2 = 0
""")
def corrections(spark, sf_dir):
    own = metadata.loose_block(metadata.named_blocks(lines(spark, sf_dir), dealt=True), "correction")[0]
    customer = tables(spark, sf_dir)["customer"].where("c_custkey % 2 = 0")
    inventory = customer.select(F.col("c_custkey").cast("string").alias("pid"), F.concat(F.lit("2021-05-0"), (1 + F.col("c_custkey") % 9).cast("string")).alias("correction_date"), F.lit("Inventory").alias("note_en"))
    return records.corrections(own, inventory)


@add(oracle(LINES, "SELECT coordinate, m1, m2, m3, CAST(NULL AS INT) AS short FROM obs"))
def split_coordinate(spark, sf_dir):
    obs = cube(spark, sf_dir, LINES, "obs")
    ids, fewer = metadata.split_coordinate(F.col("coordinate"), F.lit(3)), metadata.split_coordinate(F.col("coordinate"), F.lit(2))
    return obs.select("coordinate", *[ids[k].alias(f"m{k + 1}") for k in range(3)], fewer[0].alias("short"))


@add("""
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(7 AS INT) WHEN 1 THEN CAST(12 AS INT) END AS first, o_orderkey % 5 <= 1 AS good FROM orders
""")
def coordinate_shapes(spark, sf_dir):
    text = F.expr("CASE o_orderkey % 5 WHEN 0 THEN '7.1' WHEN 1 THEN '12.03' WHEN 2 THEN '7' WHEN 3 THEN '7.x' ELSE '7.1.' END")
    ids = metadata.split_coordinate(text, F.lit(2))
    return tables(spark, sf_dir)["orders"].select("o_orderkey", ids[0].alias("first"), ids.isNotNull().alias("good"))


#: A file as published for every customer, in the dialect with quoted fields and trailing commas for even ids, and with bare
#: ones for odd ids: byte-order mark, blank lines between blocks, a bare line before the symbols, names with quotes and
#: commas, notes with quotes and line ends. Every 10th file has a member's name over two lines, every 15th a member's line
#: with one quote too many.
PUBLISHED = [
    "'\\ufeff\"Cube Title\",\"Product Id\",\"CANSIM Id\",URL,\"Cube Notes\",\"Archive Status\",Frequency,\"Start Reference Period\",\"End Reference Period\",\"Total number of dimensions\"'",
    "CASE WHEN c_custkey % 2 = 0 THEN concat('\"Orders, of ', c_name, '\",\"', c_custkey, '\",\"\",\"https://example/', c_custkey, '\",1;2,\"CURRENT\",\"Monthly\",\"1992-01-01\",\"1998-12-01\",\"2\",') ELSE concat('\"Orders, of ', c_name, '\",', c_custkey, ',276-0015,\"https://example/', c_custkey, '\",6,\"ARCHIVED -  as it was\",Monthly,1992-01-01,1998-12-01,2') END",
    "''", "'\"Dimension ID\",\"Dimension name\",\"Dimension Notes\",\"Dimension Definitions\"'",
    "CASE WHEN c_custkey % 2 = 0 THEN '\"1\",\"Geography\",,\"\"' ELSE '1,Geography,,' END", "CASE WHEN c_custkey % 2 = 0 THEN '\"2\",\"Segment, \"\"own\"\"\",2,\"\"' ELSE '2,\"Segment, \"\"own\"\"\",2,' END",
    "''", "'\"Dimension ID\",\"Member Name\",\"Classification Code\",\"Member ID\",\"Parent Member ID\",Terminated,\"Member Notes\",\"Member Definitions\"'",
    "CASE WHEN c_custkey % 2 = 0 THEN '\"1\",\"Canada\",\"[11124]\",\"1\",\"\",,,\"\",' ELSE '1,Canada,[11124],1,,t,,' END",
    "CASE WHEN c_custkey % 2 = 0 THEN concat('\"2\",\"', c_mktsegment, ', \"very good\" or \"excellent\"\",\"11-', c_nationkey, '\",\"1\",\"\",,,\"\",') ELSE concat('2,\"', c_mktsegment, ', \"\"very good\"\" or \"\"excellent\"\"\",11-', c_nationkey, ',1,,,,') END",
    "CASE WHEN c_custkey % 10 = 0 THEN '\"2\",\"Over two ' ELSE '\"2\",\"Plain\",\"\",\"2\",\"1\",,1;2,\"\",' END", "CASE WHEN c_custkey % 10 = 0 THEN 'lines\",\"\",\"2\",\"1\",,1;2,\"\",' ELSE '' END",
    "CASE WHEN c_custkey % 15 = 0 THEN '2,\"Odd,\"\",x,3,,,,' ELSE '' END",
    "''", "'Symbol Legend'", "'Description,Symbol'", "CASE WHEN c_custkey % 2 = 0 THEN '\"not available\",\"..\",' ELSE '\"not available\",..' END", "'\"use with caution\",\"E\",'",
    "''", "'\"Survey Code\",\"Survey Name\"'", "'\"2301\",\"Price Index\",'", "''", "'\"Subject Code\",\"Subject Name\"'", "'\"18\",\"Prices\",'", "''", "'\"Note ID\",Note'",
    "'1,\"First <a href=\"https://example\">with \"quotes\"</a>.\"'", "concat('2,\"', c_name, ' spans lines')", "''", "'and has a blank one.\"'", "''",
    "CASE WHEN c_custkey % 2 = 0 THEN '\"Correction ID\",\"Correction Date\",\"Correction Note\"' ELSE '\"Dimension ID\",\"Member ID\",\"Attribute Key\",Title,Label,\"Long Label\",Value' END",
    "CASE WHEN c_custkey % 2 = 0 THEN '\"3671\",\"2023-07-18\",\"<p>Fixed \"it\" and \"that\".</p>\",' ELSE '1,1,key,,\"A, label\",,v' END", "''",
]
SOUND = "c_custkey % 15 <> 0"


def published_lines(spark, sf_dir):
    return stacked(spark, sf_dir, PUBLISHED).withColumn("line", F.concat("line", F.lit("\r")))


@add(f"""
SELECT CAST(c_custkey AS VARCHAR) AS pid, 'Orders, of ' || c_name AS cube_title, CAST(c_custkey AS VARCHAR) AS product_id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '276-0015' END AS cansim_id, CASE WHEN c_custkey % 2 = 0 THEN '1;2' ELSE '6' END AS cube_notes,
       CASE WHEN c_custkey % 2 = 0 THEN 'CURRENT' ELSE 'ARCHIVED -  as it was' END AS archive_status, CAST(2 AS INT) AS total_dimensions, CAST(NULL AS VARCHAR) AS universe,
       '"Note ID",Note' || chr(10) || '1,"First <a href="https://example">with "quotes"</a>."' || chr(10) || '2,"' || c_name || ' spans lines' || chr(10) || chr(10) || 'and has a blank one."' || chr(10) AS note_block_raw
FROM customer WHERE {SOUND}
""")
def published_cubes(spark, sf_dir):
    found = metadata.read_metadata(published_lines(spark, sf_dir), dealt=True)[0]["cube"]
    return found.select("pid", "cube_title", "product_id", "cansim_id", "cube_notes", "archive_status", "total_dimensions", "universe", "note_block_raw")


@add(f"""
SELECT CAST(c_custkey AS VARCHAR) AS pid, i AS dimension_id, m AS member_id, CASE WHEN i = 1 THEN 'Canada' WHEN m = 1 THEN c_mktsegment || ', "very good" or "excellent"' WHEN c_custkey % 10 = 0 THEN 'Over two lines' ELSE 'Plain' END AS member_name,
       CASE WHEN i = 1 THEN '[11124]' WHEN m = 1 THEN '11-' || c_nationkey ELSE '' END AS classification_code, CASE WHEN m = 2 THEN CAST(1 AS INT) END AS parent_member_id,
       CASE WHEN i = 1 AND c_custkey % 2 = 1 THEN 't' ELSE '' END AS terminated, CASE WHEN m = 2 THEN '1;2' ELSE '' END AS member_notes
FROM customer, (VALUES (1::INT, 1::INT), (2, 1), (2, 2)) v(i, m) WHERE {SOUND} AND c_custkey % 10 <> 0
UNION ALL
SELECT CAST(c_custkey AS VARCHAR), i, m, CASE WHEN i = 1 THEN 'Canada' WHEN m = 1 THEN c_mktsegment || ', very good" or "excellent""' ELSE 'Over two lines' END, CASE WHEN i = 1 THEN '[11124]' WHEN m = 1 THEN '11-' || c_nationkey ELSE '' END,
       CASE WHEN m = 2 THEN CAST(1 AS INT) END, '', CASE WHEN m = 2 THEN '1;2' ELSE '' END
FROM customer, (VALUES (1::INT, 1::INT), (2, 1), (2, 2)) v(i, m) WHERE {SOUND} AND c_custkey % 10 = 0
""")
def published_members(spark, sf_dir):
    """A file with a name over two lines is read as CSV throughout, where a quote inside a quoted name ends the quoting."""
    found = metadata.read_metadata(published_lines(spark, sf_dir), dealt=True)[0]["member"]
    return found.select("pid", "dimension_id", "member_id", "member_name", "classification_code", "parent_member_id", "terminated", "member_notes")


@add(f"""
SELECT CAST(c_custkey AS VARCHAR) AS pid, 'symbol' AS block, s AS key, d AS text FROM customer, (VALUES ('..', 'not available'), ('E', 'use with caution')) v(s, d) WHERE {SOUND}
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'survey', '2301', 'Price Index' FROM customer WHERE {SOUND} UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'subject', '18', 'Prices' FROM customer WHERE {SOUND}
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'dimension', '2', 'Segment, "own"' FROM customer WHERE {SOUND} UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'dimension', '1', 'Geography' FROM customer WHERE {SOUND}
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'note', '1', 'First <a href="https://example">with "quotes"</a>.' FROM customer WHERE {SOUND}
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'note', '2', c_name || ' spans lines' || chr(10) || chr(10) || 'and has a blank one.' FROM customer WHERE {SOUND}
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'correction', '3671 2023-07-18', '<p>Fixed "it" and "that".</p>' FROM customer WHERE {SOUND} AND c_custkey % 2 = 0
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'attribute', '1.1 key', 'A, label=v' FROM customer WHERE {SOUND} AND c_custkey % 2 = 1
""")
def published_blocks(spark, sf_dir):
    t = metadata.read_metadata(published_lines(spark, sf_dir), dealt=True)[0]
    texts = {
        "symbol": ("symbol", "description"), "survey": ("survey_code", "survey_name"), "subject": ("subject_code", "subject_name"), "dimension": ("CAST(dimension_id AS STRING)", "dimension_name"), "note": ("CAST(note_id AS STRING)", "note"),
        "correction": ("concat(correction_id, ' ', correction_date)", "correction_note"), "attribute": ("concat(dimension_id, '.', member_id, ' ', attribute_key)", "concat(label, '=', value)"),
    }
    whole = [t[name].select("pid", F.lit(name).alias("block"), F.expr(key).alias("key"), F.expr(text).alias("text")) for name, (key, text) in texts.items()]
    return functools.reduce(lambda a, b: a.union(b), whole)


@add("""
SELECT CAST(c_custkey AS VARCHAR) AS pid, CAST(CASE WHEN c_custkey % 10 = 0 THEN 12 ELSE 12 END AS INT) AS line_no, 'quotes never close' AS problem FROM customer WHERE c_custkey % 15 = 0
""")
def published_problems(spark, sf_dir):
    return metadata.read_metadata(published_lines(spark, sf_dir), dealt=True)[1]
