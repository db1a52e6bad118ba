"""The parts of a view's result: names of series, warnings, notes on groups, citations, labels of units and bases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.functions.text import table_number


def _joined(rows: Column, order: str, text: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(rows & (F.trim(text) != ""), F.struct(order, F.trim(text).alias("text"))))), lambda x: x["text"]), by)


def series_names(coordinates: DataFrame, titles: DataFrame) -> DataFrame:
    """``pid, series_no, name``: labels of the dimensions that vary, else of the fixed measure, else the title.

    ``coordinates`` has a row for each series and dimension: ``pid, series_no, dimension_id, label, varying, measure``.
    Names that several series of the view have get their table's number.
    """
    labels = coordinates.groupBy("pid", "series_no").agg(_joined(F.col("varying"), "dimension_id", "label", " · ").alias("v"), _joined(F.col("measure"), "dimension_id", "label", " · ").alias("m"))
    named = labels.join(titles, "pid").withColumn("name", F.coalesce(F.nullif("v", F.lit("")), F.nullif("m", F.lit("")), F.col("title")))
    alike = F.count("*").over(Window.partitionBy("name"))
    return named.withColumn("n", alike).select("pid", "series_no", F.when(F.col("n") > 1, F.concat(F.col("name"), F.lit(" ("), table_number(F.col("pid")), F.lit(")"))).otherwise(F.col("name")).alias("name"))


def view_warnings(layers: DataFrame, series: DataFrame, groups: DataFrame, most_series: int = 40, most_axes: int = 2) -> DataFrame:
    """``code, subject`` rows of everything a view warns of.

    ``layers``: ``layer, title, family, frequency, n_selected, not_found`` (references that no member has), ``sum_refused,
    method_difference, substituted, proxy, chart_fallback``; ``series``: ``layer, name, unit, scale, unpublished,
    base_missing``; ``groups``: ``layer, label, warning, partial, missing``.
    """
    whole = lambda df, test, code: df.where(test).select(F.lit(code).alias("code"), F.lit("").alias("subject"))
    each = lambda df, test, code, subject: df.where(test).select(F.lit(code).alias("code"), F.col(subject).alias("subject"))
    kinds = layers.agg(F.count_distinct("family").alias("families"), F.count_distinct("frequency").alias("frequencies"))
    drawn = series.where("not unpublished").agg(F.count_distinct(F.struct("unit", "scale")).alias("axes"))
    total = series.agg(F.count("*").alias("n"))
    parts = [
        whole(kinds, F.col("families") > 1, "mixed_family"), whole(kinds, F.col("frequencies") > 1, "mixed_frequency"), whole(drawn, F.col("axes") >= most_axes, "mixed_units"),
        whole(total, F.col("n") > most_series, "series_capped"), each(series, F.col("unpublished"), "no_data", "name"), each(series, F.col("base_missing"), "index_base_missing", "name"),
        each(layers, F.col("sum_refused"), "sum_refused", "title"), each(layers, F.col("n_selected") == 0, "empty_selection", "title"),
        layers.select(F.lit("member_not_found").alias("code"), F.explode("not_found").alias("subject")),
        each(layers, F.col("method_difference"), "group_method_difference", "title"), each(layers, F.col("substituted"), "substituted_geography", "title"),
        each(layers, F.col("proxy"), "territory_proxy", "title"), each(layers, F.col("chart_fallback"), "chart_fallback", "title"),
        groups.where("warning is not null").select(F.col("warning").alias("code"), F.col("label").alias("subject")),
        each(groups, F.col("partial"), "group_partial", "label"), each(groups, F.col("missing"), "group_missing", "label"),
    ]
    return reduce(DataFrame.unionByName, parts)


def group_notes(groups: DataFrame, members: DataFrame, ratios: DataFrame) -> DataFrame:
    """``pid, group_name, method, members, formula`` of the groups that are shown.

    ``groups`` has ``pid, group_name, method, published_as``; ``ratios`` each table's ``numerator, denominator, scale``.
    """
    names = members.groupBy("pid", "group_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "member_name"))), lambda x: x["member_name"]), ", ").alias("members"))
    rows = groups.join(names, ["pid", "group_name"]).join(ratios, "pid", "left")
    ratio = F.concat(F.col("numerator"), F.lit(" ÷ "), F.col("denominator"), F.lit(" × "), F.col("scale").cast("string"))
    formula = F.when(F.col("method") == "ratio", ratio).when(F.col("method") == "published", F.concat(F.lit("published as "), "published_as"))
    formula = formula.when(F.col("method") == "sum", F.concat(F.lit("sum of "), "members")).otherwise("shown as individual members")
    return rows.select("pid", "group_name", "method", "members", formula.alias("formula"))


def citations(tables: DataFrame, notes: DataFrame, gaps: DataFrame, captured: DataFrame, most_gaps: int = 3) -> DataFrame:
    """``pid, captured, citation``: the table with its capture's date, how its groups were made, and its first gaps.

    ``notes`` is ``group_notes``; ``gaps`` has ``pid, series_name, meaning, from, to``; ``captured`` ``pid, captured_at``.
    """
    made = notes.groupBy("pid").agg(F.array_sort(F.collect_list(F.concat("group_name", F.lit(": "), "formula", F.lit("; members: "), "members"))).alias("made"))
    first = gaps.withColumn("n", F.row_number().over(Window.partitionBy("pid", "series_name").orderBy("from"))).where(F.col("n") <= most_gaps)
    text = F.concat("series_name", F.lit(": "), "meaning", F.lit(" "), F.col("from").cast("string"), F.lit("–"), F.col("to").cast("string"))
    listed = first.groupBy("pid").agg(F.transform(F.array_sort(F.collect_list(F.struct("series_name", "n", text.alias("text")))), lambda x: x["text"]).alias("listed"))
    rows = tables.join(captured, "pid", "left").join(made, "pid", "left").join(listed, "pid", "left")
    none = F.expr("cast(array() as array<string>)")
    base = F.concat(F.lit("Table "), table_number(F.col("pid")), F.lit(", "), F.col("title"))
    return rows.select("pid", F.substring("captured_at", 1, 10).alias("captured"), F.array_join(F.concat(F.array(base), F.coalesce("made", none), F.coalesce("listed", none)), "; ").alias("citation"))


def display_unit(unit: Column, scale: Column, scaled: bool) -> Column:
    """``struct(unit, scale)`` as shown: a unit whose text names its scale doesn't show it twice, and loses it, before,
    after or in brackets, where values are ``scaled``."""
    low, name = F.lower(unit), F.lower(scale)
    named = (scale != "units") & low.contains(name)
    size = F.length(unit)
    cut = F.when(low.startswith(F.concat(name, F.lit(" of "))), F.concat(F.upper(F.substring(unit, F.length(name) + 5, F.lit(1))), F.substring(unit, F.length(name) + 6, size)))
    cut = cut.when(low.endswith(F.concat(F.lit(" in "), name)), F.substring(unit, F.lit(1), size - F.length(name) - 4))
    cut = cut.when(low.endswith(F.concat(F.lit(" ("), name, F.lit(")"))), F.substring(unit, F.lit(1), size - F.length(name) - 3)).otherwise(unit)
    shown = F.when(named, cut).otherwise(unit) if scaled else unit
    return F.struct(shown.alias("unit"), F.lit("units").alias("scale") if scaled else F.when(named, "units").otherwise(scale).alias("scale"))


def base_label(base: Column) -> Column:
    """``2010``, ``Q2 2010``, ``Mar 2010`` or ``Mar 5, 2010`` of an index's base; ``first`` where there is none."""
    date = F.try_to_date(F.concat(F.substring(base, 1, 7), F.lit("-01")), "yyyy-MM-dd")
    quarter = F.concat(F.lit("Q"), F.substring(base, 7, 1), F.lit(" "), F.substring(base, 1, 4))
    day = F.date_format(F.try_to_date(base, "yyyy-MM-dd"), "MMM d, yyyy")
    return F.when(base.isNull() | (base == ""), "first").when(base.rlike(r"\A\d{4}\z"), base).when(base.rlike(r"\A\d{4}-Q[1-4]\z"), quarter).when(F.length(base) == 10, day).otherwise(F.date_format(date, "MMM yyyy"))
