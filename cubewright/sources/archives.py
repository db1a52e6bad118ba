"""Archives of statistical tables: inventory, stacked metadata blocks, long and wide observation files.

Archives are not splittable and may be large: a Python data source gives each archive to one task, which streams its
member as Arrow batches, and everything after it is column expressions.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

INVENTORY = "productId long, cansimId string, cubeTitleEn string, frequencyCode int, subjectCode array<string>, dimensions array<struct<dimensionNameEn:string,dimensionPositionId:int,hasUOM:boolean>>, corrections array<struct<correctionDate:string,correctionNoteEn:string>>"


def read_inventory(spark: SparkSession, path: str, one_array: bool = False) -> dict[str, DataFrame]:
    """The catalogue's JSON records, a line each or all in ``one_array`` as published, as ``cube``, ``inventory_dimension`` and ``inventory_correction``."""
    raw = spark.read.schema(INVENTORY).json(path, multiLine=one_array).withColumn("pid", F.col("productId").cast("string"))
    cube = raw.select("pid", "productId", F.col("cubeTitleEn").alias("title"), F.col("frequencyCode").alias("frequency_code"), F.col("subjectCode").alias("subject_codes"), F.coalesce(F.size("dimensions"), F.lit(0)).alias("n_dimensions"))
    dimension = raw.select("pid", F.explode("dimensions").alias("d")).select("pid", F.col("d.dimensionPositionId").alias("dimension_id"), F.col("d.dimensionNameEn").alias("name"), F.col("d.hasUOM").alias("has_uom"))
    correction = raw.select("pid", F.explode("corrections").alias("c")).select("pid", F.col("c.correctionDate").alias("date"), F.col("c.correctionNoteEn").alias("note"))
    return {"cube": cube, "inventory_dimension": dimension, "inventory_correction": correction}


def check_inventory(raw: DataFrame) -> DataFrame:
    """``pid, problem`` over the inventory's records as texts, ``record``: ids that aren't positive whole numbers or are
    repeated, fields that are missing or of another type, no dimensions, and an inventory without records."""
    kinds = "productId string, cubeTitleEn string, frequencyCode string, dimensions array<struct<dimensionPositionId:string>>"
    rows = raw.select("record", F.from_json("record", kinds).alias("r")).select("record", "r.*")
    typed = lambda field, pattern: F.col("record").rlike(rf'"{field}"\s*:\s*{pattern}')
    tests = [
        ("productId", ~typed("productId", r"[1-9]\d*\s*[,}]")), ("title", ~typed("cubeTitleEn", '"[^"]')), ("frequencyCode", ~typed("frequencyCode", r"\d+\s*[,}]")),
        ("dimensions", F.coalesce(F.size("dimensions"), F.lit(0)) < 1),
    ]
    pid = F.coalesce("productId", F.lit(""))
    bad = rows.select(pid.alias("pid"), F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in tests]))).alias("problem"))
    twice = rows.groupBy(pid.alias("pid")).count().where("count > 1").select("pid", F.lit("repeated").alias("problem"))
    none = rows.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("pid"), F.lit("empty").alias("problem"))
    return bad.union(twice).union(none)


def split_blocks(lines: DataFrame, headers: list[str]) -> DataFrame:
    """Lines of stacked blocks with the header that each stands under. Windows are within a table's own file."""
    own = Window.partitionBy("pid").orderBy("line_no")
    is_header = F.col("line").isin(*headers)
    block = F.last(F.when(is_header, F.col("line")), ignorenulls=True).over(own)
    return lines.withColumn("block", block).where(~is_header & F.col("block").isNotNull())


def block_errors(lines: DataFrame, headers: list[str]) -> DataFrame:
    """Headers that a table lacks or has twice."""
    wanted = lines.select("pid").distinct().withColumn("line", F.explode(F.array(*[F.lit(h) for h in headers])))
    found = lines.where(F.col("line").isin(*headers)).groupBy("pid", "line").agg(F.count("*").alias("n"))
    return wanted.join(found, ["pid", "line"], "left").where("n is null or n > 1").select("pid", F.col("line").alias("header"), F.coalesce("n", F.lit(0)).alias("n"))


def fold_records(lines: DataFrame, start: str) -> DataFrame:
    """Records of loose text: one starts at each line that matches ``start``, and following lines belong to it."""
    own = Window.partitionBy("pid").orderBy("line_no")
    numbered = lines.withColumn("record", F.sum(F.col("line").rlike(start).cast("int")).over(own)).where("record > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy("pid", "record").agg(joined.alias("text"))


def parse_members(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Member rows whose names may hold unescaped quotes, anchored at both ends by the numeric fields; and the lines,
    ``pid, line``, that aren't such rows."""
    pattern = r'^(\d+),"?(.*?)"?,"?(\[[^\]]*\]|)"?,(\d+),(\d*),([^,]*)$'
    part = lambda i: F.regexp_extract("line", pattern, i)
    fits = F.col("line").rlike(pattern)
    rows = lines.where(fits).select("pid", part(1).cast("int").alias("dimension_id"), part(2).alias("member_name"), part(3).alias("code"), part(4).cast("int").alias("member_id"), part(5).try_cast("int").alias("parent_member_id"))
    return rows, lines.where(~fits).select("pid", "line")


class StatZip(DataSource):
    """``spark.read.format("statzip").option("paths", "a.zip,b.zip")``: CSV records of the observation member of each archive.

    Yields ``pid, row_index, cells, problem``: the header is row 0, a quoted cell may hold line ends, and a file that can't
    be read to its end has a last row without cells that says why. An archive ``<pid>.zip`` or ``<pid>-eng.zip`` must hold
    just ``<pid>.csv`` and ``<pid>_MetaData.csv``. One partition an archive; the file is streamed. ``option("pids", "1,2")``
    opens only these tables' archives, and so does a filter on ``pid`` with ``option("pushdown", "true")``, for which Spark
    wants ``spark.sql.python.filterPushdown.enabled`` in the session. Paths are of folders mounted on all executors.
    """

    @classmethod
    def name(cls) -> str:
        return "statzip"

    def schema(self) -> str:
        return "pid string, row_index long, cells array<string>, problem string"

    def reader(self, schema) -> DataSourceReader:
        pids = self.options.get("pids")
        kind = _FilteredReader if self.options.get("pushdown") == "true" else _Reader
        return kind(self.options["paths"].split(","), None if pids is None else pids.split(","))


def _pid(path: str) -> str:
    return path.rsplit("/", 1)[-1].removesuffix(".zip").removesuffix("-eng")


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], pids: list[str] | None):
        self.paths = [p for p in paths if pids is None or _pid(p) in pids]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator:
        import csv
        import io

        import pyarrow as pa

        if partition is None:  # Spark's stand-in where there is nothing to read
            return
        csv.field_size_limit(1 << 30)
        kinds = {"pid": pa.string(), "row_index": pa.int64(), "cells": pa.list_(pa.string()), "problem": pa.string()}
        schema = pa.schema(list(kinds.items()))

        def batch(first: int, rows: list, problem: str | None = None) -> pa.RecordBatch:
            n = len(rows)
            return pa.RecordBatch.from_pydict({"pid": [pid] * n, "row_index": list(range(first, first + n)), "cells": rows, "problem": [problem] * n}, schema=schema)

        with zipfile.ZipFile(partition.value) as archive:
            pid = _pid(partition.value)
            names, wanted = sorted(archive.namelist()), [f"{pid}.csv", f"{pid}_MetaData.csv"]
            if names != wanted:
                raise ValueError(f"{partition.value}: holds {names}, not {wanted}")
            with archive.open(names[0]) as raw:
                records = csv.reader(io.TextIOWrapper(raw, encoding="utf-8-sig", newline=""))
                held, size, first = [], 0, 0
                try:
                    for record in records:
                        held.append(record)
                        size += sum(map(len, record))
                        if len(held) == 20_000 or size > 8 << 20:
                            yield batch(first, held)
                            first, held, size = first + len(held), [], 0
                except (UnicodeDecodeError, csv.Error) as error:
                    yield batch(first, held)
                    yield batch(first + len(held), [None], f"unreadable: {error}")
                else:
                    if held:
                        yield batch(first, held)


class _FilteredReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if wanted is None or f.attribute != ("pid",):
                yield f
            else:
                self.paths = [p for p in self.paths if _pid(p) in wanted]


def unpivot_wide(rows: DataFrame, keys: list[str], ids: list[int], values: str, symbols: str) -> DataFrame:
    """One row per wide row and value column: arrays of values and symbols beside the member ids of their columns."""
    cells = F.arrays_zip(F.array(*[F.lit(i) for i in ids]).alias("id"), F.col(values).alias("value"), F.col(symbols).alias("symbol"))
    each = rows.select(*keys, "coordinate", F.explode(cells).alias("c"))
    return each.select(*keys, F.concat_ws(".", "coordinate", F.col("c.id").cast("string")).alias("coordinate"), F.col("c.value").alias("value"), F.col("c.symbol").alias("symbol"))


def decode_wide_header(header: DataFrame, member: DataFrame) -> DataFrame:
    """Value columns ``<dimension>:<member>[id]`` in order, with what is wrong with each: an id that the catalogue lacks or
    that isn't above the one before it, or a name that is neither the member's nor that with a note in brackets."""
    pattern = r"^(.*?):(.*)\[(\d+)\]$"
    part = lambda i: F.regexp_extract("name", pattern, i)
    columns = header.where(F.col("name").rlike(pattern)).select("position", F.trim(part(2)).alias("label"), part(3).cast("int").alias("member_id"))
    rows = columns.withColumn("before", F.lag("member_id").over(Window.orderBy("position"))).join(member, "member_id", "left")  # one file's header
    named = (F.col("label") == F.col("member_name")) | (F.startswith("label", F.concat("member_name", F.lit(" ("))) & F.endswith("label", F.lit(")")))
    wrong = F.when(F.col("member_name").isNull(), "unknown id").when(F.col("before") >= F.col("member_id"), "not ascending").when(~named, "another name")
    return rows.select("position", "member_id", "label", F.coalesce(wrong, F.lit("")).alias("problem"))
