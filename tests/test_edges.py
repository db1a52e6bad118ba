"""Operators on empty tables, gaps and ties."""

import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F

from cubewright.operators import matching, places, records, search, view, view_run
from cubewright.sources import archives, metadata, observations, storage

POINTS = "layer int, series string, period_start date, value double, status string"
D = dt.date


def test_empty_points(spark):
    none = spark.createDataFrame([], POINTS)
    for op in (view.coverage_bounds, view.null_runs, view.last_published, view.plot_ready, view.pct_change_window, lambda p: view.pct_change(p, 12), lambda p: view.densify(p, ["layer", "series"])):
        assert op(none).count() == 0


def test_gaps_split_by_mark(spark):
    rows = [(1, "a", D(2020, m, 1), v, s) for m, v, s in [(1, 0.5, ""), (2, None, "x"), (3, None, "F"), (4, 0.8, ""), (5, None, "x")]]
    got = view.null_runs(spark.createDataFrame(rows, POINTS)).orderBy("from").collect()
    assert [(r["mark"], r["from"].month, r["to"].month) for r in got] == [("x", 2, 2), ("F", 3, 3)]


def test_year_change_counts_the_layers_dates(spark):
    """A month that no series has shifts the lag, as positions are counted."""
    dates = [D(2020 + m // 12, m % 12 + 1, 1) for m in range(26) if m != 5]
    rows = [(1, "a", d, float(i + 1), "") for i, d in enumerate(dates)]
    got = {r["period_start"]: r["value"] for r in view.pct_change(spark.createDataFrame(rows, POINTS), 12).collect()}
    assert got[dates[12]] == (13 / 1 - 1) * 100 and got[dates[11]] is None


def test_loop_in_a_hierarchy_ends(spark):
    m = spark.createDataFrame([("p", 1, 1, 2), ("p", 1, 2, 1), ("p", 1, 3, 9)], "pid string, dimension_id int, member_id int, parent_member_id int")
    found = {r["member_id"]: r["depth"] for r in places.member_depth(m).collect()}
    assert found[3] == 0 and set(found) == {1, 2, 3}


def test_archive_source(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "10000001.zip", "w") as z:
        z.writestr("10000001.csv", "﻿REF_DATE,VALUE\r\n1992-01,83.0\r\n1992-02,\r\n")
        z.writestr("10000001_MetaData.csv", "x")
    spark.dataSource.register(archives.StatZip)
    rows = spark.read.format("statzip").option("paths", str(tmp_path / "10000001.zip")).load().orderBy("row_index").collect()
    assert [r["cells"] for r in rows] == [["REF_DATE", "VALUE"], ["1992-01", "83.0"], ["1992-02", ""]]
    assert {r["pid"] for r in rows} == {"10000001"} and [r["row_index"] for r in rows] == [0, 1, 2]


def test_archive_records_over_lines_and_only_asked_for(spark, tmp_path):
    for pid, text in (("10000001", b'A,B\r\n"one\r\nrecord, of ""two"" lines",2\r\n3,"4"\r\n'), ("10000002", b"A\n1\n\xff\n"), ("10000003", b"")):
        with zipfile.ZipFile(tmp_path / f"{pid}-eng.zip", "w") as z:
            z.writestr(f"{pid}.csv", text)
            z.writestr(f"{pid}_MetaData.csv", "x")
    spark.dataSource.register(archives.StatZip)
    reader = spark.read.format("statzip").option("paths", ",".join(str(p) for p in sorted(tmp_path.iterdir())))
    rows = reader.load().orderBy("pid", "row_index").collect()
    assert [r["cells"] for r in rows if r["pid"] == "10000001"] == [["A", "B"], ['one\r\nrecord, of "two" lines', "2"], ["3", "4"]]
    assert "unreadable" in [r for r in rows if r["pid"] == "10000002"][-1]["problem"] and not any(r["pid"] == "10000003" for r in rows)
    assert {r["pid"] for r in reader.option("pids", "10000001").load().collect()} == {"10000001"}
    assert reader.option("pids", "9").load().collect() == []
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = reader.option("pids", "10000001,10000002").option("pushdown", "true").load().where("pid = '10000001'")
        assert pushed.rdd.getNumPartitions() == 1 and pushed.count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_tables_without_header_or_metadata_have_problems(spark):
    records = spark.createDataFrame([("1", 0, None, "unreadable: x"), ("2", 0, ["A"], None), ("2", 1, ["b"], None)], "pid string, row_index long, cells array<string>, problem string")
    dimension = spark.createDataFrame([("1", 1, "Geo"), ("3", 1, "Geo")], "pid string, dimension_id int, dimension_name string")
    member = spark.createDataFrame([], "pid string, dimension_id int, member_id int, member_name string, classification_code string")
    rows, problems, report = observations.read_observations(records, dimension, member)
    assert sorted((r["pid"], r["problem"]) for r in problems.collect()) == [("1", "unreadable: x"), ("2", "no dimensions in the metadata"), ("3", "no header")]
    assert rows.count() == 0 and report.count() == 1
    nothing = observations.read_observations(records.limit(0), dimension.limit(0), member)
    assert [t.count() for t in nothing] == [0, 0, 0]


NAMES = ['plain', 'a, comma', '"very good" or "excellent"', 'Total, "very good"', '6" pipe', 'ends in a quote"', '"', 'a","b', 'codes [1]', '']


def test_member_names_come_back_whole(spark):
    """Names written as published, in quotes that are not doubled, are read as they were; so are proper CSV names."""
    head = "Dimension ID,Member Name,Classification Code,Member ID,Parent Member ID,Terminated,Member Notes"
    published = [f'"1","{n}","11-21","{k + 1}","",t,1;2,' for k, n in enumerate(NAMES)]
    doubled = ['1,"{}",11-21,{},,t,1;2'.format(n.replace('"', '""'), k + 1) for k, n in enumerate(NAMES)]
    for text in (published, doubled):
        lines = spark.createDataFrame([("1", i, t) for i, t in enumerate([head, *text])], "pid string, line_no int, line string")
        rows, problems = metadata.parse_block(metadata.named_blocks(lines), "member")
        assert [(r["member_name"], r["classification_code"], r["terminated"], r["member_notes"]) for r in rows.orderBy("member_id").collect()] == [(n, "11-21", "t", "1;2") for n in NAMES]
        assert problems.count() == 0


def test_quotes_that_never_close_are_a_problem(spark):
    head = "Dimension ID,Dimension name,Dimension Notes"
    text = [head, '1,"Geo', 'graphy" all "",x', '2,6" pipe,', '3,"open,', "4,more,"]
    lines = spark.createDataFrame([("1", i, t) for i, t in enumerate(text)], "pid string, line_no int, line string")
    rows, problems = metadata.parse_block(metadata.named_blocks(lines), "dimension")
    assert sorted((r["dimension_id"], r["dimension_name"]) for r in rows.collect()) == [(1, 'Geography all ""'), (2, '6" pipe')]
    assert [(r["line_no"], r["problem"]) for r in problems.collect()] == [(4, "quotes never close")]


def test_wide_rows_keep_blanks(spark):
    df = spark.createDataFrame([("1.1", ["100", "", None], ["", "r", ".."])], "coordinate string, v array<string>, s array<string>").withColumn("k", F.lit(1))
    got = archives.unpivot_wide(df, ["k"], [1, 2, 3], "v", "s").orderBy("coordinate").collect()
    assert [(r["coordinate"], r["value"], r["symbol"]) for r in got] == [("1.1.1", "100", ""), ("1.1.2", "", "r"), ("1.1.3", None, "..")]


def test_archive_with_other_members_is_refused(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "10000002.zip", "w") as z:
        z.writestr("10000001.csv", "REF_DATE\r\n")
        z.writestr("10000001_MetaData.csv", "x")
    spark.dataSource.register(archives.StatZip)
    with pytest.raises(Exception, match="10000002"):
        spark.read.format("statzip").option("paths", str(tmp_path / "10000002.zip")).load().collect()


def test_order_is_checked_across_keys_and_pieces(spark):
    keys = [("p", 0, 1, 1, 5), ("p", 0, 2, 2, 1), ("p", 0, 3, 1, 9), ("p", 1, 4, 1, 9), ("p", 1, 5, 3, 0), ("q", 0, 1, 1, 1), ("q", 1, 2, 2, 0)]
    rows = spark.createDataFrame(keys, "pid string, part int, row_index int, a int, b int")
    assert {r["pid"]: r["n_bad"] for r in records.order_check(rows, ["a", "b"]).collect()} == {"p": 2, "q": 0}


def test_a_repeated_cell_does_not_stand_in_for_a_missing_one(spark):
    obs = spark.createDataFrame([(1, 2.0, 0), (1, 2.0, 0), (2, 3.0, 1)], "m int, value_num double, scalar_id int")
    group = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 3)], "group_name string, member int")
    assert {r["group_name"]: r["value"] for r in view.group_sum(obs, group, "m", [], "scalar_id").collect()} == {"a": 32.0, "b": None}


def test_metadata_with_faults_yields_problems_and_no_rows(spark):
    text = ["Cube Title,Product Id,Total number of dimensions", "T,1,1", "Dimension ID,Dimension name", "1,Geo", "Note ID,Note", "early", "1,one", "more"]
    lines = spark.createDataFrame([("1", i, t) for i, t in enumerate(text)], "pid string, line_no int, line string")
    tables, problems = metadata.read_metadata(lines)
    found = {r["problem"] for r in problems.collect()}
    assert "text before the first record" in found and "missing block member" in found and tables["cube"].count() == 0
    tables, problems = metadata.read_metadata(lines.where("line <> 'early'"), ("member", "symbol", "survey", "subject", "correction", "attribute"))
    assert problems.count() == 0 and [tuple(r) for r in tables["note"].collect()] == [("1", 1, "one\nmore")]


def test_view_of_one_series_in_two_units_and_with_gaps(spark):
    rows = [(1, D(2020, m, 1), v, s, 0, u) for m, v, s, u in [(1, 1.0, "", 7), (2, None, "x", 7), (3, 4.0, "E", 7), (4, 5.0, "", 7)]] + [(2, D(2020, m, 1), 2.0, "", 0, 8) for m in (1, 2, 3, 4)]
    obs = spark.createDataFrame(rows, "m1 int, period_start date, value_num double, status string, scalar_id int, uom_id int")
    layer = {"obs": obs, "kind": "month", "dims": {"m1": {"use": "series", "members": [1, 2, 3]}}}
    found = view_run.run_view([layer])
    assert [(r["from"].month, r["to"].month, r["mark"]) for r in found["gaps"].collect()] == [(2, 2, "x")]
    assert {(r["series"], r["unit"], r["axis"], r["unpublished"], r["total"]) for r in found["series"].collect()} == {("m1=1", "7", 0, False, 3), ("m1=2", "8", 1, False, 3), ("m1=3", "7", 0, True, 3)}
    assert found["points"].where("series = 'm1=3'").count() == 4


OBS = "m1 int, period_start date, value_num double, status string, scalar_id int, uom_id int"


def one(obs, members, **more):
    return {"obs": obs, "kind": "month", "dims": {"m1": {"use": "series", "members": members, **more}}}


def test_axes_follow_the_selection_not_the_text(spark):
    rows = [(m, D(2020, 1, 1), 1.0, "", 0, u) for m, u in ((2, 7), (10, 8), (3, 9))]
    found = view_run.run_view([one(spark.createDataFrame(rows, OBS), [2, 10, 3])])["series"]
    assert {(r["series"], r["unit"], r["axis"]) for r in found.collect()} == {("m1=2", "7", 0), ("m1=10", "8", 1)}
    scaled = spark.createDataFrame([(1, D(2020, 1, 1), 1.0, "", 0, 7), (2, D(2020, 1, 1), 1.0, "", 3, 7)], OBS)
    assert {(r["series"], r["scale"], r["axis"]) for r in view_run.run_view([one(scaled, [1, 2])])["series"].collect()} == {("m1=1", "0", 0), ("m1=2", "3", 1)}


def test_the_first_forty_of_forty_five(spark):
    rows = [(m, D(2020, 1, 1), float(m), "", 0, 7) for m in range(1, 46)]
    found = view_run.run_view([one(spark.createDataFrame(rows, OBS), list(range(1, 46)))])
    assert sorted(int(r["series"][3:]) for r in found["series"].collect()) == list(range(1, 41)) and found["series"].first()["total"] == 45
    assert found["points"].count() == 40


def test_a_change_of_a_published_value_has_no_mark(spark):
    rows = [(1, D(2020, m, 1), v, s, 0, 7) for m, v, s in [(1, 5.0, "E"), (2, None, "x"), (3, 6.0, "A"), (4, 9.0, "B")]]
    found = view_run.run_view([one(spark.createDataFrame(rows, OBS), [1])], transform="pct_change_period")["points"]
    assert [(r["period_start"].month, r["value"], r["status"]) for r in found.orderBy("period_start").collect()] == [(1, None, ""), (2, None, "x"), (3, None, ""), (4, 50.0, "B")]


def test_tables_own_periods_fill_the_dates_and_the_window_is_shared(spark):
    rows = [(1, D(2020, m, 1), 1.0 * m, "", 0, 7) for m in (1, 2, 4, 5)]
    layer = one(spark.createDataFrame(rows, OBS), [1]) | {"periods": spark.createDataFrame([(D(2020, m, 1),) for m in (1, 2, 3, 5, 9)], "period_start date")}
    found = view_run.run_view([layer])
    assert [r["period_start"].month for r in found["points"].orderBy("period_start").collect()] == [1, 2, 3, 4, 5]
    assert [(r["from"].month, r["mark"]) for r in found["gaps"].collect()] == [(3, "")]
    latest = view_run.run_view([layer], {"preset": "latest"})["points"].collect()
    assert [(r["period_start"].month, r["value"]) for r in latest] == [(5, 5.0)]


def test_index_includes_the_cut_off_and_window_changes_use_the_shared_ends(spark):
    rows = [(1, D(y, 1, 1), float(v), "", 0, 7) for y, v in ((2017, 8), (2018, 5), (2019, 10), (2020, 20))] + [(2, D(2019, 1, 1), 4.0, "p", 0, 7)]
    layer = one(spark.createDataFrame(rows, OBS), [1, 2]) | {"kind": "year"}
    found = view_run.run_view([layer], {"preset": "2Y"}, "index_first")["points"].where("series = 'm1=1'")
    assert [r["value"] for r in found.orderBy("period_start").collect()] == [100.0, 200.0, 400.0]
    change = view_run.run_view([layer], transform="pct_change_window")["points"].collect()
    assert {(r["series"], r["value"]) for r in change} == {("m1=1", 150.0), ("m1=2", None)}


def test_views_of_nothing(spark):
    obs = spark.createDataFrame([(1, D(2020, 1, 1), 1.0, "", 0, 7)], OBS)
    empty = view_run.run_view([one(obs, [])])
    assert [empty[k].count() for k in ("points", "series", "gaps")] == [0, 0, 0]
    absent = view_run.run_view([one(obs.limit(0), [1, 2])])
    assert absent["points"].count() == 0 and [r["unpublished"] for r in absent["series"].collect()] == [True, True]
    x = {"obs": obs, "kind": "month", "dims": {"m1": {"use": "x", "members": [1]}}}
    with pytest.raises(ValueError, match="only one"):
        view_run.run_view([x, x])
    with pytest.raises(ValueError, match="begins with 1999"):
        view_run.run_view([x], {"at": "1999"})


def test_a_plan_reads_each_layer_once(spark, sf_dir):
    from cubewright.plans import run_queries

    found = run_queries.view_of_layers(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert found.count("FileScan") + found.count("Scan parquet") <= 10


def test_an_interrupted_build_goes_on_with_what_is_pending(spark, tmp_path):
    path = str(tmp_path / "build")
    rows = spark.createDataFrame([(k, f"v{k}-{i}") for k in range(12) for i in range(3)], "pid int, value string")
    failing = rows.withColumn("value", F.when(F.pmod(F.xxhash64("pid"), F.lit(4)) == 2, F.raise_error(F.lit("stopped")).cast("string")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stopped"):
        storage.build_parts(failing, path, "pid", "t1", batches=4)
    first = {r["pid"] for r in storage.done_parts(spark, path, "pid", "int").collect()}
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "build" / "parts").rglob("*.parquet")}
    assert 0 < len(first) < 12
    done = storage.build_parts(rows, path, "pid", "t1", batches=4)
    assert {r["pid"]: r["rows"] for r in done.collect()} == dict.fromkeys(range(12), 3)
    assert all((tmp_path / f).stat().st_mtime_ns == t for f, t in files.items() if int(f.split("pid=")[1].split("/")[0]) in first)
    assert sorted(map(tuple, spark.read.parquet(f"{path}/parts").select("pid", "value").collect())) == sorted(map(tuple, rows.collect()))
    again = storage.build_parts(rows.where("pid < 2").withColumn("value", F.lit("new")), path, "pid", "t2")
    assert {r["pid"] for r in again.where("tool = 't2'").collect()} == {0, 1} and again.count() == 12


def test_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    import hashlib

    texts = {"a": b"", "b": b"x" * 100_000, "c": bytes(range(256)) * 1000}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text)
    (tmp_path / "_SUCCESS").write_bytes(b"")
    found = storage.file_manifest(spark, str(tmp_path)).collect()
    assert {(r["path"].rsplit("/", 1)[-1], r["bytes"], r["sha256"]) for r in found} == {(n, len(t), hashlib.sha256(t).hexdigest()) for n, t in texts.items()}


def test_patterns_are_found_as_a_nested_loop_would(spark, monkeypatch):
    words = ["a", "ab", "abc", "bcd", "needle", "ne", "é", "𝄞x𝄞", "xx", "", None, "not there", "needle"]
    texts = [(i, t) for i, t in enumerate(["", None, "abcd", "a needle é", "𝄞x𝄞x𝄞", "xxxx", "ABC", "needless needle"])]
    expected = sorted((i, w) for i, t in texts for w in set(words) if w and t and w in t)
    rows = spark.createDataFrame(texts, "id int, text string")
    patterns = spark.createDataFrame([(w,) for w in words], "pattern string")
    for many, sought in ((20_000, 1), (1, 2_000), (1, 1)):
        monkeypatch.setattr(matching, "MANY", many)
        monkeypatch.setattr(matching, "SOUGHT", sought)
        found = matching.contained(rows, ["id"], patterns)
        assert sorted((r["id"], r["pattern"]) for r in found.collect()) == expected
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(matching, "MANY", 20_000)
    assert matching.contained(rows, ["id"], patterns.limit(0)).collect() == [] and matching.contained(rows.limit(0), ["id"], patterns).collect() == []


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.9, 0.0, 0.0]), (5, None), (6, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in search.vector_topk(v, v, 3).collect()}
    assert got == {(1, 2), (2, 1), (3, 4), (4, 3)}


def test_a_decile_is_no_month(spark):
    """With the lowest decile read as a month, only 2 of 3 labels are buckets."""
    rows = [("a", 1, n) for n in ("Lowest decile", "2nd decile", "Jan 2025")] + [("b", 1, n) for n in ("Lowest decile", "Decimals", "Dec")]
    member = spark.createDataFrame(rows, "pid string, dimension_id int, member_name string")
    assert {r["pid"]: r["ordinal"] for r in records.ordinal_dimensions(member).collect()} == {"a": True, "b": False}


def _parts(spark, folder, keys):
    """The tables on a folder where only ``part`` has rows, with the given keys; and the same for DuckDB."""
    import duckdb

    from cubewright.plans import cubes

    for t in cubes.TABLES:
        spark.range(0).write.parquet(f"{folder}/{t}.parquet") if t != "part" else spark.createDataFrame(
            [(k, f"part {k}", f"Brand#{k % 5}", "TIN", int(k % 7), 1.0) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
        ).write.parquet(f"{folder}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{folder}/part.parquet/*.parquet'")
    return con


def test_ids_of_large_part_keys(spark, tmp_path):
    """Numbers beyond eight digits are cut as SQL cuts them."""
    from cubewright.plans import registry

    con = _parts(spark, tmp_path, [1, 2499, 2500, 24_999, 1_200_001])
    expected = con.execute(registry.ORACLES["table_kind"]).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["table_kind"](spark, str(tmp_path)).collect()) == sorted(expected)


def test_tables_whose_ids_repeat_are_listed_once(spark, tmp_path):
    """1,000,001 and 10,000,011 have the six digits of other keys: each row has its own bounds, and none is repeated."""
    from cubewright.plans import registry

    con = _parts(spark, tmp_path, [100_000, 1_000_001, 1_000_004, 1_000_007, 10_000_011, 5])
    expected = con.execute(registry.ORACLES["table_list"]).fetchall()
    found = [tuple(r) for r in registry.QUERIES["table_list"](spark, str(tmp_path)).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_products_are_held_a_tile_at_a_time(spark, monkeypatch):
    """However many rows a batch has, no more than TILE products are made at once; ties, repeats and marks as by brute force."""
    import numpy as np

    rng = np.random.default_rng(3)
    own = rng.integers(-2, 3, (300, 3)).astype(float)
    own[7], own[8] = np.nan, np.inf
    monkeypatch.setattr(search, "TILE", 4_000)
    ids = np.arange(0, 300, 20)
    for top in (1, 5, 400):
        best = search.Nearest(ids, top)
        for at in range(0, 300, 37):
            with np.errstate(invalid="ignore"):
                best.add(own[ids] @ own[at : at + 37].T, np.arange(at, min(at + 37, 300)))
        got = [tuple(r.values()) for b in best.batches(7) for r in b.to_pylist()]
        with np.errstate(invalid="ignore"):
            expected = [r for q in ids for r in sorted(((int(q), v, float(own[q] @ own[v])) for v in range(300) if v != q and np.isfinite(own[q] @ own[v])), key=lambda r: (-r[2], r[1]))[:top]]
        assert got == expected
    made, add = [], search.Nearest.add
    monkeypatch.setattr(search.Nearest, "add", lambda self, score, ids: made.append(score.size) or add(self, score, ids))
    frame = spark.createDataFrame([(i, own[i].tolist()) for i in range(300) if i not in (7, 8)], "vec_id long, embedding array<double>").coalesce(1)
    import pyspark.sql.dataframe as dataframe

    tasks = []
    monkeypatch.setattr(dataframe.DataFrame, "mapInArrow", lambda self, f, schema, *a, **k: tasks.append((self, f)) or self.sparkSession.createDataFrame([], schema), raising=False)
    monkeypatch.setattr(type(frame), "mapInArrow", dataframe.DataFrame.mapInArrow, raising=False)
    search.vector_topk(frame, frame, 3)
    (rows, run), = tasks
    assert sum(b.num_rows for b in run(iter(rows.toArrow().to_batches()))) == 298 * 3 and max(made) <= 4_000


def test_files_are_dealt_out_by_their_lines_and_cells_found_once(spark, monkeypatch):
    """More lines make more parts, not larger ones; a block's good rows and problems read stored cells."""
    text = ["Dimension ID,Dimension name,Dimension Notes", '1,"a ""b"", c",1', '2,"over', 'two",', "x,bad,", "3,wide,,,y"]
    lines = spark.createDataFrame([(f"p{k}", i, t) for k in range(20) for i, t in enumerate(text)], "pid string, line_no int, line string")
    monkeypatch.setattr(metadata, "LINES", 10)
    blocks = metadata.named_blocks(lines)
    assert blocks.rdd.getNumPartitions() == 12
    good, bad = metadata.parse_block(blocks, "dimension")
    for df in (good, bad):
        assert "regexp_extract_all" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r["dimension_id"], r["dimension_name"]) for r in good.collect()} == {(1, 'a "b", c'), (2, "overtwo")} and good.count() == 40
    assert sorted({(r["line_no"], r["problem"]) for r in bad.collect()}) == [(4, "not an integer: dimension_id"), (5, "row wider than its header")]


def test_few_codes_and_names_gather_no_members(spark):
    """Members meet aliases and named places without being shuffled by these few keys."""
    from cubewright.operators import full_records

    members = spark.createDataFrame([(1, i, "Quebec", "[24]" if i % 2 else "", ["2021A000235"] if i % 3 else []) for i in range(60)], "pid int, member_id int, member_name string, code string, dguids array<string>")
    found = full_records.place_matches(members, spark.createDataFrame([("[24]", "0002", "24")], "code string, schema string, geo_code string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and found.count() == 60


def test_each_text_of_questions_is_read_once(spark, monkeypatch):
    from cubewright.operators import cues

    rows = [(i, ["prices since 2001", None, "jobs by province"][i % 3]) for i in range(30)]
    read, own = [], cues.text_cues
    monkeypatch.setattr(cues, "text_cues", lambda q, *a: read.append(q.count()) or own(q, *a))
    got = {r["question_id"]: (r["from_year"], r["geography"]) for r in cues.question_cues(spark.createDataFrame(rows, "question_id int, question string"), 2021).collect()}
    assert read == [3] and got == {i: [("2001", "one"), (None, "one"), (None, "provinces")][i % 3] for i in range(30)}


def test_a_file_is_checked_where_it_lies(spark, monkeypatch):
    """One table is stored for all blocks, and none of them is joined or shuffled again to leave faulty files out; a name
    over two lines and the notes as they stand come from the same pass."""
    from cubewright.plans import metadata_queries

    stores, own = [], metadata.stored
    monkeypatch.setattr(metadata, "stored", lambda df, name: stores.append(name) or own(df, name))
    tables, problems = metadata.read_metadata(metadata_queries.published_lines(spark, "/root/testdata/sf0.001").where("pid in ('10', '11', '15')"))
    assert stores == ["metadata"]
    for df in (*tables.values(), problems):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan
    assert {(r["pid"], r["line_no"]) for r in problems.collect()} == {("15", 12)}
    assert sorted(r["member_name"] for r in tables["member"].where("pid = '10' and member_id = 2").collect()) == ["Over two lines"]
    assert {r["pid"]: r["note_block_raw"].count("\n") for r in tables["cube"].collect()} == {"10": 5, "11": 5}


@pytest.mark.parametrize("name", ["parse_blocks", "published_cubes", "published_problems"])
def test_files_are_dealt_out_before_their_lines_are_made(spark, sf_dir, monkeypatch, name):
    """A task that deals out holds narrow rows of files, not all lines that it makes of them; lines then lie by file, in
    as many parts as there are lines for, and nothing is shuffled after."""
    from cubewright.plans import metadata_queries

    seen, own = [], metadata.stored
    monkeypatch.setattr(metadata, "LINES", 500)
    monkeypatch.setattr(metadata, "stored", lambda df, at: seen.append(df) or own(df, at))
    metadata_queries.REGISTRY.queries[name](spark, sf_dir)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("posexplode") < plan.index("Exchange")
    files = metadata_queries.tables(spark, sf_dir)["customer"].count()
    texts = metadata_queries.STACK if name == "parse_blocks" else metadata_queries.PUBLISHED
    assert seen[0].rdd.getNumPartitions() == -(-files * len(texts) // 500)


def test_a_file_is_checked_by_few_facts(spark, monkeypatch):
    """Each row of a file gets what is known of the whole, so that is little; a repeated block is told at its last header,
    beside what else is wrong, and other files stay good."""
    from cubewright.plans import metadata_queries

    seen, own = [], metadata.stored
    monkeypatch.setattr(metadata, "stored", lambda df, name: seen.append(df) or own(df, name))
    survey = [("10", k, t) for k, t in enumerate(["Survey Code,Survey Name", "8,More", "Survey Code,Survey Name,Colour", "9,Most", "Subject Code,Subject Name"], 100)]
    lines = metadata_queries.published_lines(spark, "/root/testdata/sf0.001").where("pid in ('10', '11')").union(spark.createDataFrame(survey, "pid string, line_no int, line string"))
    tables, problems = metadata.read_metadata(lines)
    windows = [p for p in seen[0]._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in p]
    assert windows and max(p.count("windowspecdefinition(") for p in windows) <= 8
    assert sorted((r["pid"], r["line_no"], r["problem"]) for r in problems.collect()) == [("10", 102, "repeated block survey"), ("10", 102, "unknown column Colour"), ("10", 104, "repeated block subject")]
    assert [r["pid"] for r in tables["cube"].collect()] == ["11"] and {r["pid"] for r in tables["survey"].collect()} == {"11"}
