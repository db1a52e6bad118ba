"""Metadata files of stacked blocks as tables: rectangular blocks by column name, member rows, loose text, and their checks.

A file's lines come as ``pid, line_no, line``. Nothing is dropped silently: what a rule refuses comes back as rows
``pid, line_no, problem`` beside the good ones, and a table with a problem yields no metadata in ``read_metadata``.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .storage import stored

#: Blocks by the column names of their files. Fixed values.
COLUMNS = {
    "cube": {"Cube Title": "cube_title", "Product Id": "product_id", "CANSIM Id": "cansim_id", "URL": "url", "Cube Notes": "cube_notes", "Archive Status": "archive_status", "Frequency": "frequency", "Start Reference Period": "start_reference_period", "End Reference Period": "end_reference_period", "Total number of dimensions": "total_dimensions", "Universe": "universe", "Variable List": "variable_list"},
    "dimension": {"Dimension ID": "dimension_id", "Dimension name": "dimension_name", "Dimension Notes": "dimension_notes", "Dimension Correction Notes": "dimension_correction_notes", "Dimension Definitions": "dimension_definitions"},
    "member": {"Dimension ID": "dimension_id", "Member Name": "member_name", "Classification Code": "classification_code", "Member ID": "member_id", "Parent Member ID": "parent_member_id", "Terminated": "terminated", "Member Notes": "member_notes", "Member Correction Notes": "member_correction_notes", "Member Geo Attribute Keys": "member_geo_attribute_keys", "Member Definitions": "member_definitions"},
    "symbol": {"Description": "description", "Symbol": "symbol"},
    "survey": {"Survey Code": "survey_code", "Survey Name": "survey_name"},
    "subject": {"Subject Code": "subject_code", "Subject Name": "subject_name"},
    "note": {"Note ID": "note_id", "Note": "note"},
    "correction": {"Correction ID": "correction_id", "Correction Date": "correction_date", "Correction Note": "correction_note"},
    "attribute": {"Dimension ID": "dimension_id", "Member ID": "member_id", "Attribute Key": "attribute_key", "Title": "title", "Label": "label", "Long Label": "long_label", "Value": "value"},
}
OPTIONAL = ("correction", "attribute")
INTEGERS = ("total_dimensions", "dimension_id", "member_id", "parent_member_id", "note_id")
#: Blocks of free text by the number of cells before a record's text: an id, and for corrections a date.
LOOSE = {"note": 1, "correction": 2}
LEGEND = "Symbol Legend"
PROBLEMS = "array<struct<line_no: int, problem: string>>"
#: A member line begins with its dimension and the quote before its name, and ends with a code without quotes, its id, a
#: parent's id or none, the mark of an ended member or none, and whatever fields the file has besides.
MEMBER_START, MEMBER_END = r'\A"?[0-9]+"?,"', r'\A("[^"]*"|[^",]*),"?[0-9]+"?,("[0-9]*"|[0-9]*),(t|"t"|""|)(,|\z)'


#: Lines of whole files that a task sorts at once.
LINES = 50_000


def _found(line: Column) -> Column:
    """The commas of a record that begins before ``line``, each with the cell after it; what belongs to no cell is left out."""
    return F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',(?:"[^"]*+(?:""[^"]*+)*+"[^,]*|[^",][^,]*|)'), F.lit(0))


def csv_cells(line: Column) -> Column:
    """The cells of a CSV record: a quoted cell's outer quotes removed and doubled ones halved; what follows the closing
    quote, and quotes within a cell that has none at its start, are text."""
    return _cells(line, _found(line))


def _cells(line: Column, found: Column) -> Column:
    quoted = r'(?s)\A,"([^"]*+(?:""[^"]*+)*+)"(.*)\z'
    plain = lambda c: F.substring(c, F.lit(2), F.length(c))
    inner = lambda c: F.substring(c, F.lit(3), F.length(c) - 3)
    unquoted = lambda c: F.concat(F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, quoted, 2))
    simple = lambda c: (F.length(c) > 2) & F.endswith(c, F.lit('"')) & ~F.contains(inner(c), F.lit('"'))
    cells = F.transform(found, lambda c: F.when(F.substring(c, 2, 1) != '"', plain(c)).when(simple(c), inner(c)).otherwise(unquoted(c)))
    return F.when(F.contains(line, F.lit('"')), cells).otherwise(F.split(line, ",", -1))


def pieces(lines: DataFrame) -> int:
    """In how many parts files are dealt out, so that a part has about LINES lines, however many there are in all."""
    return -(-lines.count() // LINES) or 1


def is_open(line: Column) -> Column:
    """Whether a record that begins with ``line`` goes on in the next one, inside quotes."""
    return _open(line, _found(line))


def _open(line: Column, found: Column) -> Column:
    return F.array_join(found, "") != F.concat(F.lit(","), line)


def dealt_out(files: DataFrame, lines: int) -> DataFrame:
    """``files``, a narrow row each with its ``pid``, in parts of about LINES lines where each has ``lines`` of them: lines that
    are made from these rows afterwards lie by file, and no task holds more of them, however many rows it has read."""
    return files.repartition(-(-files.count() * lines // LINES) or 1, "pid")


def named_blocks(lines: DataFrame, parts: int | None = None, dealt: bool = False) -> DataFrame:
    """``pid, line_no, line, block, places, width, is_header, record, alone, fresh``: lines with their block, where its header
    has the block's columns (-1: nowhere) and how many cells, the line that their CSV record begins with, whether that is
    all of it, and whether a record that begins with the line goes on in the next. Rows are narrow, as each window copies
    them: no cells are carried. Files are dealt out in ``parts``, by the number of lines where none is given, and sorted once:
    all windows are over one file in its order.

    A block starts at a line whose first cell, or first two, name it; the symbols' also at a bare ``Symbol Legend``, which
    is left out, and then has its header in the next line. A line is a function of whether it begins inside quotes: it ends
    there or not whatever came before, or keeps that state, or turns it over. So the state is the last fixed one, turned
    over as often as lines since then do; a header begins outside. A byte-order mark and carriage returns are taken off.
    """
    own = Window.partitionBy("pid").orderBy("line_no")
    text = F.when(F.endswith("line", F.lit("\r")), F.substring("line", F.lit(1), F.length("line") - 1)).otherwise(F.col("line"))
    lines = lines if dealt else lines.repartition(parts or pieces(lines), "pid")
    rows = lines.withColumn("line", F.when(F.lag("line_no").over(own).isNull(), F.regexp_replace(text, r"\A\x{FEFF}", "")).otherwise(text))
    quotes = F.contains("line", F.lit('"'))  # without any, a line ends as it begins
    rows = rows.withColumns({"fresh": quotes & is_open(F.col("line")), "inside": ~quotes | is_open(F.concat(F.lit('"'), F.col("line")))})
    # a first cell that names a block begins its line, but for quotes
    named = F.replace("line", F.lit('"'), F.lit("")).rlike(r"\A(?:" + "|".join({c for v in COLUMNS.values() for c in list(v)[:2]} | {LEGEND}) + ")")
    rows = rows.withColumn("cells", F.when(named, csv_cells(F.col("line"))))
    one, two = F.get("cells", F.lit(0)), F.get("cells", F.lit(1))
    name = F.lit(None).cast("string")
    for block, columns in COLUMNS.items():
        first, second = list(columns)[:2]
        if block == "symbol":
            found = ((one == first) & (two == second)) | ((one == second) & (two == first))
        else:
            found = (one == first) & (two == second) if first == "Dimension ID" else one == first
        name = F.when(found, block).otherwise(name)
    rows = rows.withColumn("name", name).withColumn("legend", F.coalesce(one == LEGEND, F.lit(False)))
    rows = rows.drop("cells")
    after = F.coalesce(F.lag("legend").over(own), F.lit(False)) & F.coalesce(F.col("name") == "symbol", F.lit(True))
    rows = rows.withColumn("is_header", F.coalesce(after | F.col("name").isNotNull(), F.lit(False)))
    rows = rows.withColumn("name", F.when(F.col("is_header"), F.coalesce("name", F.lit("symbol"))))
    rows = rows.withColumn("cells", F.when(F.col("is_header"), csv_cells(F.col("line"))))
    places = F.transform(_by_block({b: list(c) for b, c in COLUMNS.items()}, F.col("name")), lambda h: (F.array_position("cells", h) - 1).cast("int"))
    rows = rows.withColumns({"places": F.when(F.col("is_header"), places), "width": F.when(F.col("is_header"), F.size("cells"))}).drop("cells")
    rows = rows.withColumns({c: F.last(n, ignorenulls=True).over(own) for c, n in (("block", "name"), ("places", "places"), ("width", "width"))}).where("not legend").drop("name", "legend")

    fixed = F.coalesce(F.col("fresh") == F.col("inside"), F.lit(False))
    turn = F.coalesce((F.col("fresh") & ~F.col("inside")).cast("int"), F.lit(0))
    rows = rows.withColumn("turns", F.sum(turn).over(own))
    begun = F.when(fixed | F.col("is_header"), F.when(fixed, F.col("fresh").cast("int")).otherwise(0) + F.col("turns") - turn)
    rows = rows.withColumn("ends_open", (F.coalesce(F.last(begun, ignorenulls=True).over(own), F.lit(0)) + F.col("turns")) % 2 == 1)
    begins = F.col("is_header") | ~F.coalesce(F.lag("ends_open").over(own), F.lit(False))
    rows = rows.withColumn("begins", begins).withColumn("record", F.last(F.when(F.col("begins"), F.col("line_no")), ignorenulls=True).over(own))
    alone = (F.col("record") == F.col("line_no")) & ~F.col("ends_open")
    return rows.select("pid", "line_no", "line", "block", "places", "width", "is_header", "record", alone.alias("alone"), F.coalesce("fresh", F.lit(False)).alias("fresh"))


def _by_block(of: dict[str, list[str]], block: Column | None = None) -> Column:
    """The list of a row's block."""
    return F.element_at(F.create_map(*[x for b, v in of.items() for x in (F.lit(b), F.array(*map(F.lit, v)).cast("array<string>"))]), F.col("block") if block is None else block)


def checked_records(blocks: DataFrame) -> DataFrame:
    """``pid, line_no, block, kind, cells, values, problem, repeated, raw``: a row for each header (``head``, with its cells), each record
    (``record``, with its values by the block's columns), each line that belongs to none (``stray``), and the first line
    of a file where it is blank (``blank``); ``problem`` where a rule refuses it; ``repeated`` at the last
    header of a block that has several. A cube's rows have in ``raw`` the lines of the file's notes.

    Lines meet in their records where they are, as blocks are dealt out by file: they are sorted by record, not shuffled.
    """
    own = Window.partitionBy("pid").orderBy("line_no")
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    block, head = F.col("block"), F.col("is_header")
    loose, member = F.coalesce(block.isin(*LOOSE), F.lit(False)), F.coalesce(block == "member", F.lit(False)) & ~head
    odd = member & ((F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1)
    rows = with_anchored(blocks, odd).withColumn("odd", odd & F.col("anchored").isNull()).drop("anchored")
    rows = rows.withColumn("cells", F.when(loose & ~head, csv_cells(F.col("line"))))
    cell = lambda k: F.get("cells", F.lit(k))
    starts, rest = F.lit(False), F.col("line")
    for b, n in LOOSE.items():
        mine = (block == b) & ~head & (F.size("cells") > n) & cell(0).rlike(r"\A[0-9]+\z")
        mine = F.coalesce(mine & cell(1).rlike(r"\A[0-9-]+\z") if n > 1 else mine, F.lit(False))
        raw = _found(F.col("line"))
        rest = F.when(mine, F.substring("line", sum((F.length(F.get(raw, F.lit(k))) for k in range(n)), F.lit(1)), F.length("line"))).otherwise(rest)
        starts = starts | mine
    rows = rows.withColumns({"starts": starts, "rest": rest}).withColumn("ids", F.when(F.col("starts"), F.slice("cells", 1, 2))).drop("cells").withColumns(
        {"spans": F.coalesce(F.max("odd").over(own.rowsBetween(*whole)), F.lit(False)), "first": F.lag("line_no").over(own).isNull()}
        | {f"start_{b}": F.last(F.when(F.col("starts") & (block == b), F.col("line_no")), ignorenulls=True).over(own) for b in LOOSE}
    )
    start = functools.reduce(lambda c, b: F.when(block == b, F.col(f"start_{b}")).otherwise(c), LOOSE, F.lit(None).cast("int"))
    stray = ~head & (block.isNull() | (loose & start.isNull()))
    lone = head | stray | (~loose & F.col("alone")) | (member & ~F.col("spans"))
    rows = rows.withColumns({"stray": stray, "lone": lone, "key": F.when(lone, F.col("line_no")).when(loose, start).otherwise(F.col("record"))})
    empty = (F.translate("line", ',"', "") == "") & ~F.exists(csv_cells(F.col("line")), lambda c: c != "")
    rows = rows.withColumn("blank", F.coalesce(~head & F.col("lone") & F.when(F.col("stray"), F.trim("line") == "").otherwise(empty), F.lit(True)))

    # a line of the notes is in its record and in the notes as they stand, which are sorted beside the cube's own lines
    rows = rows.withColumn("notes", F.explode(F.when(block == "note", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))).where("notes or not blank or first")
    notes = F.col("notes")
    keep = ["pid", "line_no", "block", "places", "width", "is_header", "stray", "lone", "blank", "fresh", "notes", "spans", "ids"]
    # a file's headers of a block have one key, so that they are counted
    key = F.when(notes, -1).when(head, -2 - _by_number(block, lambda k: k)).otherwise(F.col("key"))
    rows = rows.select(*keep, key.alias("key"), F.when(notes, F.col("line")).otherwise(F.col("rest")).alias("text"))
    rows = rows.withColumn("side", F.when((block == "cube") | F.col("notes"), 0).otherwise(1))
    of = ["pid", "side", "key", F.col("is_header") & ~F.col("notes")]
    span = Window.partitionBy(*of).orderBy("line_no")
    several = F.collect_list(F.when(notes | ~F.col("lone"), F.col("text"))).over(span.rowsBetween(*whole))
    rows = rows.withColumns({"texts": several, "nth": F.row_number().over(span), "n": F.count("*").over(span.rowsBetween(*whole))}).where("nth = 1 or is_header and not notes")
    rows = rows.withColumns({"repeated": head & ~notes & (F.col("n") > 1) & (F.col("nth") == F.col("n")), "key": F.when(head, F.col("line_no")).otherwise(F.col("key"))})
    joined = F.when(loose, F.array_join("texts", "\n")).otherwise(F.array_join("texts", ""))
    rows = rows.withColumn("line", F.when(notes | ~F.col("lone"), joined).otherwise(F.col("text"))).drop("texts", "text", "nth", "n", "line_no")
    rows = rows.withColumn("raw", F.max(F.when(F.col("notes"), F.col("line"))).over(Window.partitionBy("pid", "side"))).where("not notes")

    rows = with_anchored(rows, member & ~F.col("spans") & ~F.col("blank"))
    cells = F.when(loose & ~head, F.col("ids")).otherwise(F.coalesce("anchored", csv_cells(F.col("line"))))
    unclosed = F.col("anchored").isNull() & F.when(F.col("lone"), F.col("fresh")).otherwise(F.contains("line", F.lit('"')) & is_open(F.col("line")))
    rows = rows.withColumn("cells", cells).withColumn("cells", F.when(member, member_cells(F.col("cells"), F.col("places"), F.col("width"))).otherwise(F.col("cells")))
    kind = F.when(F.col("blank"), "blank").when(head, "head").when(F.col("stray"), "stray").when(loose | F.exists("cells", lambda c: c != ""), "record").otherwise("blank")
    rows = rows.withColumn("kind", kind)
    plain = F.regexp_replace("line", r"\n+\z", "")
    plain = F.regexp_replace(plain, r'",\z', '"')
    plain = F.regexp_replace(plain, r'(?s)\A"(.*)"\z', "$1")
    own_cells = F.when(block == "note", F.array(cell(0), plain)).when(block == "correction", F.array(cell(0), cell(1), plain))
    by_name = F.transform("places", lambda k: F.get("cells", k))
    rows = rows.withColumn("values", F.when(F.col("kind") == "record", F.when(loose, own_cells).otherwise(by_name)))

    numbers = {b: [(k, c) for k, c in enumerate(v.values()) if c in INTEGERS] for b, v in COLUMNS.items() if b not in LOOSE}
    value = lambda k: F.get("values", F.lit(k))
    wrong = lambda own: F.array_compact(F.array(*[F.when((value(k) != "") & ~value(k).rlike(r"\A[0-9]+\z"), c) for k, c in own]))
    bad = functools.reduce(lambda c, b: F.when(block == b, wrong(numbers[b])).otherwise(c), [b for b in numbers if numbers[b]], F.array().cast("array<string>"))
    wide = (F.size("cells") > F.col("width")) & F.exists(F.slice("cells", F.col("width") + 1, F.greatest(F.size("cells") - F.col("width"), F.lit(0))), lambda c: c != "")
    refused = F.when(unclosed, "quotes never close").when(wide, "row wider than its header").when(F.size(bad) > 0, F.concat(F.lit("not an integer: "), F.array_join(bad, ",")))
    headed = functools.reduce(lambda c, b: F.when(block == b, F.slice("cells", 1, len(COLUMNS[b])) == F.array(*map(F.lit, COLUMNS[b]))).otherwise(c), LOOSE, F.lit(True))
    problem = F.when(F.col("kind") == "stray", F.when(loose, "text before the first record").otherwise("text before the first block"))
    problem = problem.when((F.col("kind") == "head") & ~headed, F.concat(F.lit("unexpected header of "), block)).when((F.col("kind") == "record") & ~loose, refused)
    return rows.select("pid", F.col("key").alias("line_no"), "block", "kind", F.when(F.col("kind") == "head", F.col("cells")).alias("cells"), "values", problem.alias("problem"), "repeated", F.when(block == "cube", F.col("raw")).alias("raw"))


def _by_number(block: Column, of: Callable[[int], int]) -> Column:
    """A number for each block, by its place among COLUMNS."""
    return functools.reduce(lambda c, kb: F.when(block == kb[1], of(kb[0])).otherwise(c), enumerate(COLUMNS), F.lit(None).cast("int"))


def _table(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """A block's good records by column names, integers cast."""
    value = [(F.get("values", F.lit(k)), c) for k, c in enumerate(COLUMNS[name].values())]
    return rows.where((F.col("block") == name) & F.col("good")).select("pid", *[(v.try_cast("int") if c in INTEGERS else v).alias(c) for v, c in value], *more)


def parse_block(blocks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """A block's rows by mapped column names, and its problems.

    Columns that a file's header lacks are null, rows of blanks are dropped, integers are cast. A row is refused where
    it has non-empty cells beyond its header, an integer that isn't one, or quotes that never close. A quoted cell may
    hold line ends, which are dropped, as its lines are one record. A file's member rows are a line each, unless one that
    ``with_anchored`` can't read has an odd number of quotes: then they are records like the other blocks'.
    """
    # all is stored before any is left out: rows and problems read that, and neither finds the cells again
    rows = checked_records(blocks.where(F.col("block") == name)).withColumn("good", F.expr("kind = 'record' and problem is null"))
    rows = stored(rows.select("pid", "line_no", "block", "values", "problem", "good"), f"{name}-records")
    return _table(rows, name), rows.where("problem is not null").select("pid", "line_no", "problem")


def with_anchored(rows: DataFrame, member: Column) -> DataFrame:
    """``rows`` with ``anchored``: the cells of a ``member`` line whose name stands in quotes, and may hold quotes and commas
    itself; null for any other line, and for one that begins without a quote and has an odd number of them.

    What follows the line's start is cut wherever a quote stands before a comma; the name ends at the first such cut after
    which the line goes on as a member line ends.
    """
    rest = lambda k: F.array_join(F.slice("pieces", k + 1, F.size("pieces")), '",')
    cut = F.filter(F.sequence(F.lit(1), F.size("pieces")), lambda k: rest(k).rlike(MEMBER_END))
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1
    start = member & F.col("line").rlike(MEMBER_START) & ~(odd & ~F.col("line").startswith('"'))
    rows = rows.withColumn("pieces", F.when(start, F.split(F.regexp_replace("line", MEMBER_START, ""), '",'))).withColumn("at", F.when(F.col("pieces").isNotNull(), F.get(cut, F.lit(0))))
    name = F.replace(F.array_join(F.slice("pieces", 1, F.col("at")), '",'), F.lit('""'), F.lit('"'))
    cells = F.concat(F.array(F.regexp_extract("line", "[0-9]+", 0), name), csv_cells(rest(F.col("at"))))
    return rows.withColumn("anchored", F.when(F.col("at").isNotNull(), cells)).drop("pieces", "at")


def member_cells(found: Column, places: Column, width: Column) -> Column:
    """A member row's cells under its header: a trailing comma is no field, and note ids that stand unquoted, ``2,3``, are
    one field, ``2;3``."""
    trimmed = F.when((F.size(found) > width) & (F.element_at(found, -1) == ""), F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    at = F.get(places, F.lit(list(COLUMNS["member"]).index("Member Notes"))) + 1
    tail = F.slice(trimmed, at, F.greatest(F.size(trimmed) - at + 1, F.lit(0)))
    loose = (at > 0) & (F.size(tail) > 1) & F.forall(tail, lambda c: c.rlike(r"\A[0-9]+\z"))
    return F.when(loose, F.concat(F.slice(trimmed, 1, at - 1), F.array(F.array_join(tail, ";")), F.array_repeat(F.lit(""), F.greatest(width - at, F.lit(0))))).otherwise(trimmed)


def loose_block(blocks: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Records of free text: one starts at each line with an id (and a date), and following lines belong to it.

    The outer pair of quotes is trimmed and nothing is unescaped. Text before the first record is a problem, and a header
    that doesn't begin with the block's own columns.
    """
    return parse_block(blocks, name)


def read_metadata(lines: DataFrame, optional: tuple[str, ...] = OPTIONAL, dealt: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """All blocks as tables, of the files without a problem, and the problems of the others.

    Besides what the blocks refuse, a file needs each block once, without unknown columns, exactly one cube row, and as many
    dimensions as that declares. Files of another family may lack further blocks: give them in ``optional``. A cube's row
    also has the block of its notes as it stands, ``note_block_raw``. Files are dealt out once, unless they are ``dealt``, and
    checked whole where they are; records and problems are stored, and all tables come from there.
    """
    rows = checked_records(named_blocks(lines, dealt=dealt))
    own = Window.partitionBy("pid")
    block, head, good = F.col("block"), F.col("kind") == "head", F.expr("kind = 'record' and problem is null")
    declared = F.get("values", F.lit(list(COLUMNS["cube"].values()).index("total_dimensions"))).try_cast("int")
    cube, dimension = good & (block == "cube"), good & (block == "dimension")
    # a header comes before a record of the same line
    place = F.col("line_no").cast("long") * 2 + (~head).cast("int")
    unknown = F.array_except("cells", _by_block({b: [*c, ""] for b, c in COLUMNS.items()}))
    wrong = F.col("problem").isNotNull() | F.col("repeated") | F.coalesce(head & (F.size(unknown) > 0), F.lit(False))
    facts = {"cubes": F.count_if(cube), "dimensions": F.count_if(dimension), "declared": F.max(F.when(cube, declared)), "leader": F.min(place)}
    # few facts of a file, as each row gets them all: its blocks are bits of one number
    facts |= {"named": F.bit_or(F.when(head, _by_number(block, lambda k: 1 << k)).otherwise(0)), "wrong": F.max(wrong)}
    rows = rows.withColumns({c: v.over(own) for c, v in facts.items()})

    needed = [b for b in COLUMNS if b not in {*OPTIONAL, *optional}]
    lacks = lambda b: F.col("named").bitwiseAND(F.lit(1 << list(COLUMNS).index(b))) == 0
    dimensions = F.col("dimensions").cast("int")
    differ = ~F.col("declared").eqNullSafe(dimensions)
    faulty = F.col("wrong") | (F.col("cubes") != 1) | differ | functools.reduce(lambda c, b: c | lacks(b), needed, F.lit(False))
    rows = rows.withColumn("faulty", faulty)

    at = lambda line, text: F.struct(F.lit(line).cast("int").alias("line_no") if line is None else F.col(line).alias("line_no"), text.alias("problem"))
    found = [F.when(F.col("problem").isNotNull(), at("line_no", F.col("problem")))]
    found.append(F.when(F.col("repeated"), at("line_no", F.concat(F.lit("repeated block "), block))))
    leads = F.col("leader").eqNullSafe(place)
    found += [F.when(leads & lacks(b), at(None, F.lit(f"missing block {b}"))) for b in needed]
    number = F.when(F.col("cubes") != 1, F.concat(F.col("cubes").cast("string"), F.lit(" cube rows")))
    number = number.when(differ, F.concat(dimensions.cast("string"), F.lit(" dimensions of "), F.coalesce(F.col("declared").cast("string"), F.lit("none"))))
    found.append(F.when(leads & number.isNotNull(), at(None, number)))
    other = F.when(head, F.transform(unknown, lambda c: F.struct(F.col("line_no").alias("line_no"), F.concat(F.lit("unknown column "), c).alias("problem"))))
    nothing = F.array().cast(PROBLEMS)
    problems = F.when(F.col("faulty"), F.concat(F.array_compact(F.array(*found)), F.coalesce(other, nothing))).otherwise(nothing)
    rows = rows.select("pid", "block", "values", "raw", (good & ~F.col("faulty")).alias("good"), problems.alias("problems"))
    rows = stored(rows.where(F.col("good") | (F.size("problems") > 0)), "metadata")
    tables = {name: _table(rows, name, *([F.col("raw").alias("note_block_raw")] if name == "cube" else [])) for name in COLUMNS}
    return tables, rows.where(F.size("problems") > 0).select("pid", F.explode("problems").alias("p")).select("pid", "p.line_no", "p.problem")


def split_coordinate(coordinate: Column, dimensions: Column) -> Column:
    """The member ids of a coordinate; null unless it has one part of digits for each dimension."""
    parts = F.split(coordinate, r"\.")
    good = (F.size(parts) == dimensions) & F.forall(parts, lambda p: p.rlike(r"\A[0-9]+\z"))
    return F.when(good, F.transform(parts, lambda p: p.try_cast("int")))
