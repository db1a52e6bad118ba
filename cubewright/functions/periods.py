"""Reference-date texts as periods, and period arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Frequency codes whose periods are longer than the text's shape says.
WEEKLY, QUARTERLY, SEMI_ANNUAL = (2,), (9, 19), (11,)
#: Positions back to the same period a year earlier, by kind; 1 for others.
YEAR_LAG = {"month": 12, "quarter": 4, "half_year": 2, "week": 52, "year": 1, "fiscal_year": 1}

_SHAPE = r"\A(\d{4})(?:-(\d{2})(?:-(\d{2}))?|/(\d{4}))?\z"


def period(ref_date: Column, frequency: Column) -> Column:
    """``struct(start, end, kind)``: the text gives the start, the frequency stretches the end where the shape is ambiguous.

    Texts of another shape, invalid dates and year 0000 give nulls and ``other``.
    """
    part = lambda i: F.regexp_extract(F.coalesce(ref_date, F.lit("")), _SHAPE, i)
    year, month, day, last = part(1), part(2), part(3), part(4)
    date = lambda *xs: F.try_to_date(F.concat_ws("-", *xs), "yyyy-MM-dd")
    start = F.when(last != "", date(year, F.when(last.try_cast("int") == year.try_cast("int") + 1, "04").otherwise("01"), F.lit("01")))
    start = start.when(day != "", date(year, month, day)).when(month != "", date(year, month, F.lit("01"))).when(year != "", date(year, F.lit("01"), F.lit("01")))
    gap = last.try_cast("int") - year.try_cast("int")
    span = F.when(frequency.isin(*QUARTERLY), 3).when(frequency.isin(*SEMI_ANNUAL), 6).otherwise(1)
    end = F.when(last != "", F.when(gap == 1, date(last, F.lit("03"), F.lit("31"))).when(gap > 1, date(last, F.lit("12"), F.lit("31"))))
    end = end.when(day != "", F.when(frequency.isin(*WEEKLY), F.date_add(start, 6)).otherwise(start))
    end = end.when(month != "", F.last_day(F.add_months(start, span - 1))).when(year != "", date(year, F.lit("12"), F.lit("31")))
    kind = F.when(last != "", F.when(gap == 1, "fiscal_year").otherwise("multi_year"))
    kind = kind.when(day != "", F.when(frequency.isin(*WEEKLY), "week").otherwise("day"))
    kind = kind.when(month != "", F.when(span == 3, "quarter").when(span == 6, "half_year").otherwise("month")).otherwise("year")
    good = start.isNotNull() & end.isNotNull() & (year != "0000")
    return F.struct(F.when(good, start).alias("start"), F.when(good, end).alias("end"), F.when(good, kind).otherwise("other").alias("kind"))


def shape(ref_date: Column) -> Column:
    """Digits masked by 9."""
    return F.regexp_replace(F.coalesce(ref_date, F.lit("")), "[0-9]", "9")


def years_before(date: Column, years: int) -> Column:
    """The same day ``years`` earlier; 29 February becomes 1 March where there is none."""
    moved = F.add_months(date, -12 * years)
    return F.when((F.date_format(date, "MM-dd") == "02-29") & (F.date_format(moved, "MM-dd") == "02-28"), F.date_add(moved, 1)).otherwise(moved)


def in_base(date: Column, base: str) -> Column:
    """Whether a date lies in ``YYYY``, ``YYYY-MM``, ``YYYY-Qn`` or ``YYYY-MM-DD``."""
    text = F.date_format(date, "yyyy-MM-dd")
    if "-Q" in base:
        return (F.year(date) == int(base[:4])) & (F.quarter(date) == int(base[-1]))
    return text.startswith(base)


def pct(now: Column, before: Column) -> Column:
    """Percentage change; null where either is missing or the earlier one is zero."""
    return F.when(before != 0, (now / F.nullif(before, F.lit(0.0)) - 1) * 100)
