"""Scalar functions on the shapes that the rules name."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cubewright.functions import periods, text

D = dt.date


PLAIN, EVERY_MONTH, EVERY_QUARTER, HALF_YEARS, WEEKS = 1, 6, 9, 11, 2


@pytest.mark.parametrize("year", [1971, 1988, 2031])
def test_period_of_every_kind(spark, year):
    """Each kind's end follows from its start by the calendar's own arithmetic."""
    leap = year % 4 == 0
    shown = {
        (f"{year}", PLAIN): (D(year, 1, 1), D(year, 12, 31), "year"), (f"{year}-02", EVERY_MONTH): (D(year, 2, 1), D(year, 2, 29 if leap else 28), "month"),
        (f"{year}-12", EVERY_QUARTER): (D(year, 12, 1), D(year + 1, 3, 1) - dt.timedelta(days=1), "quarter"), (f"{year}-07", HALF_YEARS): (D(year, 7, 1), D(year, 12, 31), "half_year"),
        (f"{year}-12-28", WEEKS): (D(year, 12, 28), D(year, 12, 28) + dt.timedelta(days=6), "week"), (f"{year}-06-17", PLAIN): (D(year, 6, 17), D(year, 6, 17), "day"),
        (f"{year}/{year + 1}", PLAIN): (D(year, 4, 1), D(year + 1, 3, 31), "fiscal_year"), (f"{year}/{year + 5}", PLAIN): (D(year, 1, 1), D(year + 5, 12, 31), "multi_year"),
        (f"{year}-02-29", PLAIN): (D(year, 2, 29), D(year, 2, 29), "day") if leap else (None, None, "other"),
    }
    shown |= {(bad, EVERY_MONTH): (None, None, "other") for bad in (f"{year}-00", f"{year}-1", f"{year}/{year}", f"{year}/{year - 3}", f"{year}/72", f"{year} ", f"x{year}", "0000", "", f"{year}-06-31")}
    rows = spark.createDataFrame([(r, f) for r, f in shown], "r string, f int")
    p = periods.period(F.col("r"), F.col("f"))
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in rows.select("r", "f", p["start"], p["end"], p["kind"]).collect()}
    assert got == shown


def test_period_of_nothing(spark):
    p = periods.period(F.col("r"), F.lit(PLAIN))
    assert tuple(spark.createDataFrame([(None,)], "r string").select(p["start"], p["end"], p["kind"]).first()) == (None, None, "other")


def test_years_before_leap_day(spark):
    rows = spark.createDataFrame([(D(2024, 2, 29),), (D(2024, 3, 31),)], "d date").select(periods.years_before(F.col("d"), 1)).collect()
    assert [r[0] for r in rows] == [D(2023, 3, 1), D(2023, 3, 31)]


def test_pct_and_base(spark):
    rows = spark.createDataFrame([(2.0, 1.0), (2.0, 0.0), (None, 1.0), (1.0, None)], "a double, b double").select(periods.pct(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in rows] == [100.0, None, None, None]
    day = spark.createDataFrame([(D(1996, 5, 2),)], "d date")
    got = day.select(*[periods.in_base(F.col("d"), b) for b in ("1996", "1996-05", "1996-Q2", "1996-Q3", "1996-05-02")]).first()
    assert tuple(got) == (True, True, True, False, True)


def test_text(spark):
    df = spark.createDataFrame([("2016A000011124", "Canada [35]", "r,E", "1;2;x;-3", "Café (old)", "18-10-0006-01")], "g string, b string, m string, n string, p string, t string")
    d, m = text.parse_dguid(F.col("g")), text.split_marks(F.col("m"))
    row = df.select(d["vintage"], d["schema"], d["geo_code"], text.place_level(d["schema"]), text.bracket_code(F.col("b")), m["status"], m["symbol"], text.note_ids(F.col("n")), text.fold_accents(text.short_place(F.col("p"))), text.table_pid(F.col("t"))).first()
    assert tuple(row) == (2016, "0000", "11124", "country", "35", "E", "r", [1, 2], "cafe", "18100006")


@pytest.mark.parametrize("value,number,error", [("83.0", 83.0, False), ("", None, False), ("1e3", None, True), ("-6", -6.0, False), ("12\n", None, True)])
def test_value(spark, value, number, error):
    assert tuple(spark.createDataFrame([(value,)], "v string").select(text.parse_value(F.col("v")), text.value_error(F.col("v"))).first()) == (number, error)
