"""Time and category operators of a view.

Points are rows ``layer, series, period_start, value, status`` (and ``category`` in category views). A layer's dates are
a small dimension, computed once by a distinct and joined back; windows over points are always within a series or a
layer and date, never over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.functions.periods import YEAR_LAG, in_base, pct, years_before
from cubewright.functions.text import scale_value


def layer_dates(points: DataFrame) -> DataFrame:
    """Distinct dates of each layer with their position."""
    order = Window.partitionBy("layer").orderBy("period_start")
    return points.select("layer", "period_start").distinct().withColumn("position", F.row_number().over(order))


def densify(points: DataFrame, keys: list[str]) -> DataFrame:
    """Every series at every date of its layer, missing cells as null values."""
    dates = layer_dates(points).drop("position")
    grid = points.select(*keys).distinct().join(dates, "layer")
    return grid.join(points, [*keys, "period_start"], "left")


def lookback(points: DataFrame, lag: int) -> DataFrame:
    """``layer, period_start, prior``: the date ``lag`` positions earlier among the layer's dates."""
    order = Window.partitionBy("layer").orderBy("period_start")
    return layer_dates(points).select("layer", "period_start", F.lag("period_start", lag).over(order).alias("prior"))


def pct_change(points: DataFrame, lag: int) -> DataFrame:
    """Percentage change against the layer's date ``lag`` positions earlier, for the same series."""
    steps = lookback(points, lag)
    before = points.select("layer", "series", F.col("period_start").alias("prior"), F.col("value").alias("before"))
    joined = points.join(steps, ["layer", "period_start"]).join(before, ["layer", "series", "prior"], "left")
    return joined.select("layer", "series", "period_start", pct(F.col("value"), F.col("before")).alias("value"))


def pct_change_daily_yoy(points: DataFrame) -> DataFrame:
    """Change against the same month and day a year earlier; 29 February has no partner."""
    return _against(points, layer_dates(points).select("layer", "period_start", _same_day().alias("prior")))


def _same_day() -> Column:
    return F.try_to_date(F.concat((F.year("period_start") - 1).cast("string"), F.date_format("period_start", "-MM-dd")))


def _against(points: DataFrame, steps: DataFrame) -> DataFrame:
    """Change of each value against that of its series at the ``prior`` date of ``layer, period_start, prior``."""
    before = points.select("layer", "series", F.col("period_start").alias("prior"), F.col("value").alias("before"))
    joined = points.join(steps, ["layer", "period_start"], "left").join(before, ["layer", "series", "prior"], "left")
    return joined.select("layer", "series", "period_start", pct(F.col("value"), F.col("before")).alias("value"))


def pct_change_yoy(points: DataFrame, kinds: DataFrame) -> DataFrame:
    """Change against a year earlier, by the kind of each layer's periods (``layer, kind``): so many of the layer's dates
    back as a year has such periods, or the same calendar day."""
    lag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in YEAR_LAG.items() for x in kv]), F.col("kind")), F.lit(1))
    dates = layer_dates(points)
    known = dates.join(kinds, "layer")
    earlier = dates.select("layer", "position", F.col("period_start").alias("prior"))
    steps = known.where("kind <> 'day'").select("layer", "period_start", (F.col("position") - lag).alias("position")).join(earlier, ["layer", "position"])
    daily = known.where("kind = 'day'").select("layer", "period_start", _same_day().alias("prior"))
    return _against(points, steps.select("layer", "period_start", "prior").union(daily))


def window_bounds(points: DataFrame, preset_years: int | None = None, from_: str | None = None, to: str | None = None, changes: bool = False, preset: str = "max", at: str | None = None) -> DataFrame:
    """Points in the window: bounds if given, else by the preset ``latest``, ``max`` or ``<n>Y``, which count back from the
    latest date that the points have.

    The cut-off is exclusive for levels and shares and inclusive for changes; ``to`` is compared as a prefix, and so is
    ``at``, the one period of a snapshot.
    """
    text = F.date_format("period_start", "yyyy-MM-dd")
    if at:
        return points.where(text.startswith(at))
    if from_ or to:
        low = text >= from_ if from_ else F.lit(True)
        high = F.substring(text, 1, len(to)) <= to if to else F.lit(True)
        return points.where(low & high)
    years = preset_years if preset_years is not None else int(preset[:-1]) if preset.endswith("Y") else None
    if years is None and preset == "max":
        return points
    latest = F.broadcast(points.agg(F.max("period_start").alias("latest")))  # one row
    if preset == "latest" and years is None:
        return points.join(latest).where("period_start = latest").drop("latest")
    cut = years_before(F.col("latest"), years)
    test = F.col("period_start") >= cut if changes else F.col("period_start") > cut
    return points.join(latest).where(test).drop("latest")


def pct_change_window(points: DataFrame) -> DataFrame:
    """One value a series: the window's last date against its first, null where either is missing."""
    ends = points.groupBy("layer").agg(F.min("period_start").alias("first"), F.max("period_start").alias("last"))
    at = lambda c: F.max(F.when(F.col("period_start") == F.col(c), F.col("value")))
    joined = points.join(ends, "layer").groupBy("layer", "series").agg(at("first").alias("a"), at("last").alias("b"), F.first("last").alias("period_start"))
    return joined.select("layer", "series", "period_start", pct(F.col("b"), F.col("a")).alias("value"))


def index_rebase(points: DataFrame, base: str | None = None, window: Column | None = None) -> DataFrame:
    """Values with the first published one in the base period, else of all, as 100; null where there is none or it is zero.

    The base may lie outside ``window``, which is applied last.
    """
    usable = F.col("value").isNotNull() & (in_base(F.col("period_start"), base) if base else F.lit(True))
    first = points.where(usable).groupBy("layer", "series").agg(F.min_by("value", "period_start").alias("base"))
    joined = points.join(first, ["layer", "series"], "left").where(window if window is not None else F.lit(True))
    return joined.select("layer", "series", "period_start", F.when(F.col("base") != 0, F.col("value") / F.nullif("base", F.lit(0.0)) * 100).alias("value"))


def group_sum(obs: DataFrame, group: DataFrame, member: str, keys: list[str], scalar: str | None = None) -> DataFrame:
    """Complete-case sums over groups of members: null unless every member is present and published.

    ``group`` (``group_name, member``) is a small table. A member that has several rows counts once, with its largest
    value; values are multiplied by ten to the power of ``scalar`` where that column is given.
    """
    size = group.groupBy("group_name").agg(F.count_distinct("member").alias("size"))
    value = scale_value(F.col("value_num"), F.coalesce(F.col(scalar), F.lit(0))) if scalar else F.col("value_num")
    rows = obs.join(group, F.col(member) == F.col("member")).groupBy("group_name", *keys, "member").agg(F.max(value).alias("value"))
    found = rows.groupBy("group_name", *keys).agg(F.sum("value").alias("total"), F.count("value").alias("n")).join(size, "group_name")
    return found.select("group_name", *keys, F.when(F.col("n") == F.col("size"), F.col("total")).alias("value"))


def group_ratio(parts: DataFrame, keys: list[str], numerator: str, denominator: str, scale: float, size: int) -> DataFrame:
    """Sum of numerators over sum of denominators, null unless all parts are there and the divisor isn't zero."""
    found = parts.groupBy(*keys).agg(
        F.sum(numerator).alias("a"), F.sum(denominator).alias("b"), F.count(numerator).alias("na"), F.count(denominator).alias("nb")
    )
    good = (F.col("na") == size) & (F.col("nb") == size) & (F.col("b") != 0)
    return found.select(*keys, F.when(good, F.col("a") / F.nullif("b", F.lit(0)) * scale).alias("value"))


def rule_ratio(obs: DataFrame, group: DataFrame, rule: dict, member: str, measure: str, keys: list[str], scalar: str) -> DataFrame:
    """A curated ratio of each group: the members' numerators over their denominators, both times ten to their scalar.

    ``rule`` has the measure's ``numerator`` and ``denominator`` members and the ``scale``; null unless all members have
    both and the denominators' sum isn't zero.
    """
    size = group.groupBy("group_name").agg(F.count_distinct("member").alias("size"))
    value = scale_value(F.col("value_num"), F.coalesce(F.col(scalar), F.lit(0)))
    of = lambda k: F.max(F.when(F.col(measure) == rule[k], value)).alias(k)
    rows = obs.where(F.col(measure).isin(rule["numerator"], rule["denominator"])).join(group, F.col(member) == F.col("member"))
    each = rows.groupBy("group_name", *keys, "member").agg(of("numerator"), of("denominator"))
    found = each.groupBy("group_name", *keys).agg(*[f(c).alias(f"{n}_{c}") for c in ("numerator", "denominator") for f, n in ((F.sum, "sum"), (F.count, "n"))]).join(size, "group_name")
    good = (F.col("n_numerator") == F.col("size")) & (F.col("n_denominator") == F.col("size"))
    return found.select("group_name", *keys, F.when(good, F.col("sum_numerator") / F.nullif("sum_denominator", F.lit(0.0)) * rule["scale"]).alias("value"))


#: Families of units that can be summed across members. Fixed values.
ADDITIVE = ("count", "currency", "mass", "volume", "area", "length", "energy")


def choose_group_method(choices: DataFrame, cells: DataFrame) -> DataFrame:
    """How each group is shown, and the warning that goes with it: its published aggregate, an additive sum, a curated
    ratio, or its members apart.

    ``choices`` has ``group_name, agg, published, missing``: what was asked (auto, published, sum, ratio), the member that
    publishes the group, and how many of its places the table lacks. ``cells`` has the observations of its members:
    ``group_name, member, part, uom_id, scalar_id, family, counts``, where ``part`` is own, numerator or denominator and
    ``counts`` marks tables that count people whatever their units. A sum needs one unit and scale and additive
    families; a ratio the same of its parts, and both parts of every member.
    """
    unit = F.concat_ws(":", F.col("uom_id").cast("string"), F.col("scalar_id").cast("string"))
    own, part = F.col("part") == "own", F.col("part") != "own"
    of = lambda test, value: F.when(test, value)
    additive = F.coalesce(F.col("family").isin(*ADDITIVE), F.lit(False))
    members = cells.groupBy("group_name", "member").agg(F.max(of(F.col("part") == "numerator", 1)).alias("a"), F.max(of(F.col("part") == "denominator", 1)).alias("b"))
    both = members.groupBy("group_name").agg(F.bool_and(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))
    facts = cells.groupBy("group_name").agg(
        F.count_distinct(of(own, unit)).alias("units"), F.bool_and(of(own, additive | F.col("counts"))).alias("adds"),
        F.count_distinct(of(part, unit)).alias("part_units"), F.bool_and(of(part, additive)).alias("parts_add"),
    ).join(both, "group_name")
    rows = choices.join(facts, "group_name", "left")
    whole = F.col("missing") == 0
    asked = lambda *kinds: F.col("agg").isin("auto", *kinds) | ((F.col("agg") == "published") & F.col("published").isNull())
    method = F.when(F.col("published").isNotNull() & F.col("agg").isin("auto", "published"), "published")
    method = method.when(asked("sum") & whole & (F.col("units") == 1) & F.col("adds"), "sum")
    method = method.when(asked("ratio") & whole & (F.col("part_units") == 1) & F.col("parts_add") & F.col("both"), "ratio").otherwise("members")
    warning = F.when(F.col("agg").eqNullSafe("published") & F.col("published").isNull(), "group_published_unavailable")
    return rows.select("group_name", method.alias("method"), F.when(method == "members", "group_not_combined").otherwise(warning).alias("warning"))


def category_share(points: DataFrame, by: list[str]) -> DataFrame:
    """Share in percent of each value in its group; null where any is missing or the sum is zero."""
    own = Window.partitionBy(*by)
    whole = (F.count("value").over(own) == F.count(F.lit(1)).over(own)) & (F.sum("value").over(own) != 0)
    return points.withColumn("share", F.when(whole, F.col("value") / F.nullif(F.sum("value").over(own), F.lit(0.0)) * 100))


def signed_stack_share(points: DataFrame, by: list[str]) -> DataFrame:
    """Share of positives in the positive total and of negatives in the negative total."""
    own = Window.partitionBy(*by)
    up, down = F.sum(F.greatest("value", F.lit(0.0))).over(own), F.sum(F.least("value", F.lit(0.0))).over(own)
    share = F.when((F.col("value") >= 0) & (up != 0), F.col("value") / F.nullif(up, F.lit(0.0)) * 100)
    return points.withColumn("share", share.when((F.col("value") < 0) & (down != 0), -(F.col("value") / F.nullif(down, F.lit(0.0))) * 100))


def coverage_bounds(points: DataFrame) -> DataFrame:
    """First and last published date of each series, and whether there is none."""
    there = F.when(F.col("value").isNotNull(), F.col("period_start"))
    return points.groupBy("layer", "series").agg(F.min(there).alias("first"), F.max(there).alias("last"), (F.count("value") == 0).alias("unpublished"))


def null_runs(points: DataFrame, legend: DataFrame | None = None) -> DataFrame:
    """Runs of missing values between a series' first and last published ones, parted by mark.

    With a ``legend`` (``status, meaning``) each run has its mark's meaning, the mark where the legend lacks it, and
    ``Not published`` where there is none.
    """
    own = Window.partitionBy("layer", "series").orderBy("period_start")
    run = Window.partitionBy("layer", "series", "mark", "missing").orderBy("period_start")
    bounds = coverage_bounds(points).where("not unpublished")
    inside = points.join(bounds, ["layer", "series"]).where("period_start > first and period_start < last")
    marked = inside.withColumn("mark", F.coalesce("status", F.lit(""))).withColumn("missing", F.col("value").isNull())
    islands = marked.withColumn("island", F.row_number().over(own) - F.row_number().over(run)).where("missing")
    runs = islands.groupBy("layer", "series", "mark", "island").agg(F.min("period_start").alias("from"), F.max("period_start").alias("to"), F.count("*").alias("n")).drop("island")
    if legend is None:
        return runs
    named = runs.join(legend.select(F.col("status").alias("mark"), "meaning"), "mark", "left")
    return named.withColumn("meaning", F.when(F.col("mark") == "", "Not published").otherwise(F.coalesce("meaning", "mark")))


def category_period(points: DataFrame, size: int) -> DataFrame:
    """One row: the latest date at which all ``size`` cells are published, else the latest date."""
    by_date = points.groupBy("period_start").agg(F.count("value").alias("n"))
    return by_date.agg(F.coalesce(F.max(F.when(F.col("n") == size, F.col("period_start"))), F.max("period_start")).alias("period_start"))


def sort_categories(points: DataFrame, descending: bool) -> DataFrame:
    """Categories with their rank by sum over series, missing as 0, ties in the original order."""
    total = points.groupBy("category").agg(F.sum(F.coalesce("value", F.lit(0.0))).alias("total"), F.min("position").alias("position"))
    ranked = Window.orderBy(F.desc("total") if descending else F.asc("total"), "position")
    return total.withColumn("rank", F.row_number().over(ranked))  # one row a category


def lead_order(points: DataFrame, lead: str) -> DataFrame:
    """Categories by the first drawn series, falling, missing last, ties in the original order."""
    ranked = Window.orderBy(F.col("value").desc_nulls_last(), "position")
    return points.where(F.col("series") == lead).select("category", "value", F.row_number().over(ranked).alias("rank"))


def assign_axes(series: DataFrame) -> DataFrame:
    """Axis 0 or 1 by order of the first series of each unit and scale; a third unit's published series are dropped."""
    first = Window.partitionBy("unit", "scale")
    seen = series.withColumn("first", F.min(F.when(~F.col("unpublished"), F.col("series_no"))).over(first))
    axis = F.dense_rank().over(Window.orderBy(F.col("first").asc_nulls_last())) - 1
    axes = seen.withColumn("axis", axis)  # one row a series of a view
    kept = axes.where("unpublished or axis < 2")
    return kept.select("series_no", "unit", "scale", "unpublished", F.when(F.col("first").isNull() | (F.col("axis") > 1), 0).otherwise(F.col("axis")).alias("axis"))


def series_cap(series: DataFrame, cap: int = 40) -> DataFrame:
    """The first ``cap`` series with the true total."""
    total = F.broadcast(series.agg(F.count("*").alias("total")))
    return series.orderBy("series_no").limit(cap).join(total)


def repeat_over_categories(single: DataFrame, categories: DataFrame) -> DataFrame:
    """A series without a category dimension has its value in every category."""
    return single.drop("category").join(categories.select("category").distinct())


def last_published(points: DataFrame) -> DataFrame:
    return points.where("value is not null").groupBy("layer", "series").agg(F.max("period_start").alias("period_start"), F.max_by("value", "period_start").alias("value"))


def pivot_view(points: DataFrame, series: list[str]) -> DataFrame:
    """Periods by series; the list of series is given, so that no job has to find it."""
    return points.groupBy("period_start").pivot("series", series).agg(F.first("value"))


def plot_ready(points: DataFrame) -> DataFrame:
    """Per series: nothing published, one value only, one period only."""
    return points.groupBy("layer", "series").agg(
        (F.count("value") == 0).alias("unpublished"), (F.count_distinct("value") == 1).alias("constant"), (F.count_distinct("period_start") == 1).alias("one_period")
    )


def view_ready(points: DataFrame) -> DataFrame:
    """Per view, over the points that aren't hidden: nothing published, one value in all, one period, nothing visible.

    ``points`` has ``view, series, period_start, value, hidden``.
    """
    shown = ~F.col("hidden")
    of = lambda c: F.when(shown, F.col(c))
    return points.groupBy("view").agg(
        (F.count(of("value")) == 0).alias("unpublished"), (F.count_distinct(of("value")) == 1).alias("constant"),
        (F.count_distinct(of("period_start")) == 1).alias("one_period"), (F.count_if(shown) == 0).alias("nothing_visible"),
    )


def layer_union(points: DataFrame, periods: DataFrame | None = None) -> DataFrame:
    """Union of the layers' dates; with the tables' own ``periods`` (``layer, period_start``) also those that lie within
    the span that the points observe, so that a date which no row has is a gap."""
    seen = points.select("period_start").distinct()
    if periods is None:
        return seen
    span = F.broadcast(points.agg(F.min("period_start").alias("low"), F.max("period_start").alias("high")))  # one row
    inside = periods.select("period_start").distinct().join(span).where("period_start between low and high")
    return seen.union(inside.select("period_start")).distinct()


def clipped_start(points: DataFrame, start: str) -> DataFrame:
    """One row: the requested start, or the latest first published date of the layers where that is later."""
    first = points.where("value is not null").groupBy("layer").agg(F.min("period_start").alias("first"))
    return first.agg(F.greatest(F.lit(start).cast("date"), F.max("first")).alias("start"))


def time_grain(points: DataFrame) -> DataFrame:
    """The grain of each layer by the least spacing of its dates."""
    order = Window.partitionBy("layer").orderBy("period_start")
    gap = layer_dates(points).withColumn("gap", F.datediff("period_start", F.lag("period_start").over(order)))
    least = gap.groupBy("layer").agg(F.min("gap").alias("gap"))
    g = F.col("gap")
    return least.select("layer", F.when(g < 5, "day").when(g < 20, "week").when(g < 80, "month").when(g < 150, "quarter").when(g < 300, "half").otherwise("year").alias("grain"))


def own_cadence(points: DataFrame) -> DataFrame:
    """Points without the missing ones that are off a series' own step in months; real gaps stay."""
    own = Window.partitionBy("layer", "series").orderBy("month")
    month = F.year("period_start") * 12 + F.month("period_start")
    there = points.where("value is not null").withColumn("month", month)
    step = there.withColumn("gap", F.col("month") - F.lag("month").over(own)).groupBy("layer", "series").agg(F.min("gap").alias("step"), F.min("month").alias("start"))
    joined = points.withColumn("month", month).join(step, ["layer", "series"], "left")
    on = F.col("value").isNotNull() | ((F.col("month") - F.col("start")) % F.coalesce(F.col("step"), F.lit(1)) == 0)
    return joined.where(on).select("layer", "series", "period_start", "value")


def kpi_cards(points: DataFrame, lag: int, keep: int = 60) -> DataFrame:
    """Latest published value of each series, its change against ``lag`` positions earlier and the previous date, the
    direction of the first of these that there is, and the last ``keep`` published points as ``date=value``."""
    order = Window.partitionBy("layer", "series").orderBy("period_start")
    there = points.where("value is not null")
    with_prior = there.withColumn("year_ago", F.lag("value", lag).over(order)).withColumn("previous", F.lag("value", 1).over(order))
    recent = with_prior.withColumn("from_end", F.row_number().over(Window.partitionBy("layer", "series").orderBy(F.desc("period_start"))))
    text = F.concat_ws("=", F.date_format("period_start", "yyyy-MM-dd"), F.round("value", 2).cast("decimal(30,2)").cast("string"))
    last = recent.groupBy("layer", "series").agg(
        F.max("period_start").alias("period_start"), F.max_by(F.struct("value", "year_ago", "previous"), "period_start").alias("l"), F.count("*").alias("n"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("from_end") <= keep, text))), ",").alias("points"),
    )
    yoy, step = pct(F.col("l.value"), F.col("l.year_ago")), pct(F.col("l.value"), F.col("l.previous"))
    change = F.coalesce(yoy, step)
    way = F.when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    return last.select("layer", "series", "period_start", F.col("l.value").alias("value"), yoy.alias("yoy"), step.alias("step"), way.alias("direction"), F.least("n", F.lit(keep)).alias("n_points"), "points")
