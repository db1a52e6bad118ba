"""Long and wide observation files checked against their tables' metadata: header, width, coordinate, numbers and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.functions.text import parse_value, split_marks, value_error
from cubewright.operators.records import order_check

from .metadata import split_coordinate
from .storage import stored

#: Columns before and after those of the dimensions, the first of which is the place. Fixed values.
HEAD = ["REF_DATE", "GEO", "DGUID"]
TAIL = ["UOM", "UOM_ID", "SCALAR_FACTOR", "SCALAR_ID", "VECTOR", "COORDINATE", "VALUE", "STATUS", "SYMBOL", "TERMINATED", "DECIMALS"]
WHOLE = ("UOM_ID", "SCALAR_ID", "DECIMALS")
MAX_DIMENSIONS = 9
#: Rows of a file that are compared in one window.
PIECE = 1_000_000


def expected_headers(dimension: DataFrame) -> DataFrame:
    """``pid, dimension_ids, expected``: a table's dimensions in order, and the header that its file must have."""
    each = dimension.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("dimension_id", "dimension_name"))).alias("d"))
    lists = [F.array(*map(F.lit, c)) for c in (HEAD, TAIL)]
    names = F.transform(F.slice("d", 2, F.size("d")), lambda d: d["dimension_name"])
    return each.select("pid", F.transform("d", lambda d: d["dimension_id"]).alias("dimension_ids"), F.concat(lists[0], names, lists[1]).alias("expected"))


def loosely(label: Column) -> Column:
    """A label without quotes and without white space at its end."""
    return F.regexp_replace(F.replace(label, F.lit('"'), F.lit("")), r"\s+\z", "")


def _labels(parsed: DataFrame, member: DataFrame, bare) -> tuple[DataFrame, DataFrame]:
    """Each different label of a member with its number of rows, the first of them, and how it agrees with the metadata:
    ``exact``, ``loose`` if it does once both are ``bare``, ``other`` or ``unknown``; and the problems among these.

    ``parsed`` has ``pid, row_index, dimension_ids, ids, labels``, null where a row has a problem of its own.
    """
    zipped = F.arrays_zip(F.col("dimension_ids").alias("dimension_id"), F.col("ids").alias("member_id"), F.col("labels").alias("label"))
    each = parsed.where("ids is not null").select("pid", "row_index", F.explode(zipped).alias("l")).select("pid", "row_index", "l.*").where("label is not null")
    used = each.groupBy("pid", "dimension_id", "member_id", "label").agg(F.min("row_index").alias("row_index"), F.count("*").alias("n"))
    met = used.join(member.select("pid", "dimension_id", "member_id", "member_name", "classification_code"), ["pid", "dimension_id", "member_id"], "left")
    exact = (F.col("label") == F.col("member_name")) | (F.col("label") == F.concat_ws(" ", "member_name", F.coalesce("classification_code", F.lit(""))))
    near = bare(F.col("label")) == bare(F.col("member_name"))
    met = stored(met.withColumn("kind", F.when(F.col("member_name").isNull(), "unknown").when(exact, "exact").when(near, "loose").otherwise("other")), "observation-labels")
    place = F.concat(F.lit("dimension "), F.col("dimension_id").cast("string"), F.lit(" member "), F.col("member_id").cast("string"))
    told = F.when(F.col("kind") == "unknown", " is not in the metadata").otherwise(F.concat(F.lit(" is "), "member_name", F.lit(", labelled "), "label"))
    return met, met.where("kind in ('unknown', 'other')").select("pid", "row_index", F.concat(place, told).alias("problem"))


def read_observations(records: DataFrame, dimension: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, problems and reports of CSV records, ``pid, row_index, cells, problem``, whose header is row 0.

    ``dimension`` has ``pid, dimension_id, dimension_name`` and ``member`` ``pid, dimension_id, member_id, member_name,
    classification_code``. A file's header must be that of its dimensions; every row must be as wide, have a coordinate of
    a member id for each dimension, whole numbers where those are due, a number or nothing as its value, and as labels its
    members' names, or these with their codes; a name may differ in quotes and in white space at its end, which the report
    counts. The labels are then dropped: members are named by the metadata. Problems are ``pid, row_index, problem``, for
    labels one a member and label; a table with any has no observations. A table without rows or header has a problem.

    The records are read once and stored, with their labels; labels are compared once for each different one.
    """
    known = expected_headers(dimension)
    rows = records.join(known, "pid", "left")
    n, width = F.size("dimension_ids"), F.size("expected")
    at = lambda name: F.get("cells", width - len(TAIL) + TAIL.index(name))
    ids = split_coordinate(at("COORDINATE"), n)
    bad = F.array_compact(F.array(*[F.when(~at(c).rlike(r"\A-?[0-9]+\z"), F.lit(c)) for c in WHOLE]))
    found = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col("expected").isNull(), F.when(F.col("row_index") == 0, "no dimensions in the metadata"))
        .when(F.col("row_index") == 0, F.when(F.col("cells") != F.col("expected"), F.concat(F.lit("another header: "), F.array_join("cells", ","))))
        .when(F.size("cells") != width, F.concat(F.lit("width "), F.size("cells").cast("string"), F.lit(", expected "), width.cast("string")))
        .when(ids.isNull(), F.concat(F.lit("coordinate "), at("COORDINATE")))
        .when(F.size(bad) > 0, F.concat(F.lit("not an integer: "), F.array_join(bad, ",")))
        .when(value_error(at("VALUE")), F.concat(F.lit("not a number: "), at("VALUE")))
    )
    labels = F.concat(F.array(F.get("cells", F.lit(1))), F.slice("cells", len(HEAD) + 1, F.greatest(n - 1, F.lit(0))))
    text = {"ref_date": F.get("cells", F.lit(0)), "dguid": F.get("cells", F.lit(2))} | {c.lower(): at(c) for c in TAIL}
    good = found.isNull() & (F.col("row_index") > 0)
    parsed = rows.select(
        "pid", "row_index", found.alias("problem"), *[F.when(good, v.try_cast("int") if c.upper() in WHOLE else v).alias(c) for c, v in text.items()],
        F.when(good, parse_value(at("VALUE"))).alias("value_num"), F.when(good, ids).alias("ids"), F.when(good, labels).alias("labels"), "dimension_ids",
    )
    parsed = stored(parsed, "observations")

    met, wrong = _labels(parsed, member, loosely)
    headless = dimension.select("pid").distinct().join(parsed.where("row_index = 0").select("pid"), "pid", "left_anti").select("pid", F.lit(None).cast("long").alias("row_index"), F.lit("no header").alias("problem"))
    problems = stored(parsed.where("problem is not null").select("pid", "row_index", "problem").union(wrong).union(headless), "observation-problems")
    members = [F.get("ids", F.lit(k)).alias(f"member_id_{k + 1}") for k in range(MAX_DIMENSIONS)]
    sound = parsed.where("ids is not null").join(problems.select("pid").distinct(), "pid", "left_anti")
    loose = met.where("kind = 'loose'").groupBy("pid").agg(F.sum("n").alias("loose_labels"))
    report = parsed.where("row_index > 0").groupBy("pid").agg(F.count("*").alias("n_rows"), F.count_if(F.col("value") == "").alias("blank_values"))
    report = report.join(loose, "pid", "left").select("pid", "n_rows", "blank_values", F.coalesce("loose_labels", F.lit(0).cast("long")).alias("loose_labels"))
    return sound.select("pid", "row_index", *text, "value_num", *members), problems, report


def wide_headers(headers: DataFrame, dimension: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Headers of wide files as data: ``pid, dimension_ids, width, ids``, the members of a file's last dimension by value
    column; and their problems.

    ``headers`` has ``pid, cells``. After the columns of the other dimensions and ``Coordinate`` come pairs of a value
    column, ``<dimension>:<member>[id]``, and one of marks. The member is one of the last dimension's under its name, or
    that with its note ids in brackets, and the ids ascend. Any number of files is read in one plan; windows are in a file.
    """
    each = dimension.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("dimension_id", "dimension_name"))).alias("d"))
    n = F.size("d")
    names = F.transform(F.slice("d", 2, F.greatest(n - 2, F.lit(0))), lambda d: d["dimension_name"])
    expected = F.concat(F.array(*map(F.lit, HEAD)), names, F.array(F.lit("Coordinate")))
    known = headers.join(each, "pid", "left").withColumn("expected", expected).withColumn("from", F.size("expected"))
    rest = F.size("cells") - F.col("from")
    whole = known.select("pid", "cells", "d", "from", F.when(F.col("d").isNull(), "no dimensions in the metadata").when(n < 2, "fewer than two dimensions").when(F.slice("cells", 1, F.col("from")) != F.col("expected"), F.concat(F.lit("another header: "), F.array_join(F.slice("cells", 1, F.col("from")), ","))).when((rest % 2 != 0) | (rest == 0), "value columns are not in pairs").alias("problem"))
    pairs = F.transform(F.sequence(F.lit(0), ((F.size("cells") - F.col("from")) / 2).cast("int") - 1), lambda i: F.struct(i.alias("at"), F.get("cells", F.col("from") + 2 * i).alias("name"), F.get("cells", F.col("from") + 2 * i + 1).alias("marks")))
    last = F.element_at("d", -1)
    columns = whole.where("problem is null").select("pid", last["dimension_id"].alias("dimension_id"), last["dimension_name"].alias("dimension_name"), F.explode(pairs).alias("p")).select("pid", "dimension_id", "dimension_name", "p.*")
    head, number = F.regexp_extract("name", r"(?s)\A(.*)\[[0-9]+\]\z", 1), F.regexp_extract("name", r"\[([0-9]+)\]\z", 1)
    columns = columns.withColumn("member_id", number.try_cast("int")).withColumn("label", F.when(F.startswith(head, F.concat("dimension_name", F.lit(":"))), F.trim(F.substring(head, F.length("dimension_name") + 2, F.length(head)))))
    met = columns.join(member.select("pid", "dimension_id", "member_id", F.trim("member_name").alias("member_name"), "member_notes"), ["pid", "dimension_id", "member_id"], "left")
    own = Window.partitionBy("pid").orderBy("at")
    noted = F.concat("member_name", F.lit(" ("), "member_notes", F.lit(")"))
    named = (F.col("label") == F.col("member_name")) | ((F.col("member_notes") != "") & (F.col("label") == noted))
    wrong = (
        F.when(F.col("member_id").isNull(), "no member id").when(F.col("label").isNull() | F.col("member_name").isNull(), "not of the last dimension").when(~F.coalesce(named, F.lit(False)), "another name")
        .when(~F.col("marks").isin("Symbol", "Symbols"), "no column of marks").when(F.lag("member_id").over(own) >= F.col("member_id"), "not ascending")
    )
    met = stored(met.withColumn("wrong", wrong), "wide-headers")
    problems = whole.where("problem is not null").select("pid", "problem").union(met.where("wrong is not null").select("pid", F.concat(F.lit("value column "), "name", F.lit(": "), "wrong").alias("problem")))
    ids = met.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "member_id"))), lambda x: x["member_id"]).alias("ids"))
    good = known.select("pid", F.transform("d", lambda d: d["dimension_id"]).alias("dimension_ids"), F.size("cells").alias("width")).join(ids, "pid").join(problems.select("pid").distinct(), "pid", "left_anti")
    return good, problems


def read_wide(records: DataFrame, dimension: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``read_observations``, of files whose last dimension's members are columns: a row for each row and value column.

    ``member`` has ``member_notes`` too. Besides the header's rules, rows are as wide as it, in strictly ascending order of
    their coordinates of the other dimensions, and end with blank lines if they have any; marks are parted into status and
    symbol. The records are stored once as they come; a row becomes its cells after the checks.
    """
    rows = stored(records, "wide-records")
    headers, bad = wide_headers(rows.where("row_index = 0").select("pid", F.coalesce("cells", F.array().cast("array<string>")).alias("cells")), dimension, member)
    blank = rows.where("row_index > 0 and size(cells) = 0").groupBy("pid").agg(F.min("row_index").alias("blank"))
    n = F.size("dimension_ids")
    data = rows.where("row_index > 0").join(headers, "pid").join(blank, "pid", "left")
    place = F.get("cells", n + 1)
    ids = split_coordinate(place, n - 1)
    cells = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.struct(F.get("ids", i).alias("id"), F.get("cells", n + 2 + 2 * i).alias("value"), F.get("cells", n + 3 + 2 * i).alias("marks")))
    odd = F.get(F.filter(cells, lambda c: value_error(c["value"])), F.lit(0))["value"]
    found = (
        F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.size("cells") == 0, None).when(F.col("row_index") > F.col("blank"), "data after a blank line")
        .when(F.size("cells") != F.col("width"), F.concat(F.lit("width "), F.size("cells").cast("string"), F.lit(", expected "), F.col("width").cast("string")))
        .when(ids.isNull(), F.concat(F.lit("coordinate "), place)).when(odd.isNotNull(), F.concat(F.lit("not a number: "), odd))
    )
    good = found.isNull() & (F.size("cells") > 0)
    labels = F.concat(F.array(F.get("cells", F.lit(1))), F.slice("cells", len(HEAD) + 1, F.greatest(n - 2, F.lit(0))))
    parsed = data.select(
        "pid", "row_index", found.alias("problem"), F.get("cells", F.lit(0)).alias("ref_date"), F.get("cells", F.lit(2)).alias("dguid"), place.alias("place"),
        F.when(good, labels).alias("labels"), "dimension_ids", F.when(good, ids).alias("row_ids"), F.when(good, cells).alias("values"),
    ).withColumnRenamed("row_ids", "ids")
    parsed = stored(parsed, "wide-rows")
    met, wrong = _labels(parsed, member, lambda c: F.trim(loosely(c)))
    pieces = parsed.where("ids is not null").select("pid", F.floor(F.col("row_index") / PIECE).alias("part"), "row_index", F.col("ids").alias("key"))
    order = order_check(pieces, ["key"]).where("n_bad > 0").select("pid", F.lit(None).cast("long").alias("row_index"), F.concat("n_bad", F.lit(" rows not after the one before")).alias("problem"))
    headless = dimension.select("pid").distinct().join(rows.where("row_index = 0").select("pid"), "pid", "left_anti").select("pid", F.lit(None).cast("long").alias("row_index"), F.lit("no header").alias("problem"))
    problems = bad.select("pid", F.lit(0).cast("long").alias("row_index"), "problem").union(parsed.where("problem is not null").select("pid", "row_index", "problem")).union(wrong).union(order).union(headless)
    problems = stored(problems, "wide-problems")
    each = parsed.where("ids is not null").join(problems.select("pid").distinct(), "pid", "left_anti").select("pid", "row_index", "ref_date", "dguid", "place", "ids", F.explode("values").alias("v"))
    marks, every = split_marks(F.col("v.marks")), F.concat("ids", F.array("v.id"))
    sound = each.select(
        "pid", "row_index", "ref_date", "dguid", F.concat_ws(".", "place", F.col("v.id").cast("string")).alias("coordinate"), F.col("v.value").alias("value"), parse_value(F.col("v.value")).alias("value_num"),
        marks["status"].alias("status"), marks["symbol"].alias("symbol"), *[F.get(every, F.lit(k)).alias(f"member_id_{k + 1}") for k in range(MAX_DIMENSIONS)],
    )
    loose = met.where("kind = 'loose'").groupBy("pid").agg(F.sum("n").alias("loose_labels"))
    report = parsed.where("ids is not null").groupBy("pid").agg(F.sum(F.size("values")).alias("n_rows"), F.sum(F.size(F.filter("values", lambda v: v["value"] == ""))).alias("blank_values")).join(loose, "pid", "left")
    return sound, problems, report.select("pid", "n_rows", "blank_values", F.coalesce("loose_labels", F.lit(0).cast("long")).alias("loose_labels"))
