"""A whole view: layers of selected members and groups, their window, transform, coverage, gaps, axes and cap.

A layer is ``{"obs": frame, "dims": {column: selection}, "kind": period kind, "periods": frame or none}``; ``obs`` has the
member columns, ``period_start, value_num, status, uom_id, scalar_id`` and perhaps ``symbol``, and ``periods`` the table's own
``period_start``. A selection is ``{"use": "fixed" | "series" | "x" | "sum", "members": [ids], "groups": [{"label",
"members", "ratio"}], "labels": {id: text}}``: members each make a series or category, a sum adds all of them, and a group
adds its own, or divides them where ``ratio`` names another column's numerator and denominator and a scale.

Selections, and so the list of series, categories and dates, are as large as a view, never as the data. They are ordered
lists, from which the frame of the result is made; each layer's observations are read once and aggregated to that frame,
which is stored, and all else is left-joined to it.
"""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cubewright.functions.periods import years_before
from cubewright.functions.text import scale_value
from cubewright.sources.storage import stored

from .view import assign_axes, category_share, index_rebase, layer_union, null_runs, pct_change, pct_change_yoy, repeat_over_categories, sort_categories

CELLS = "layer int, n int, c int, period_start date, value double, status string, unit string, scale string, ratio boolean"


def _choices(selection: dict) -> list[dict]:
    """Key, label, members and ratio of what a selection makes series or categories of, in its order."""
    if selection["use"] in ("fixed", "sum"):
        return [{"key": "", "label": "", "members": sorted(set(selection["members"])), "ratio": None}]
    labels = selection.get("labels", {})
    single = [{"key": str(m), "label": labels.get(m, str(m)), "members": [m], "ratio": None} for m in selection["members"]]
    groups = [{"key": f"g:{g['label']}", "label": g["label"], "members": sorted(set(g["members"])), "ratio": g.get("ratio")} for g in selection.get("groups", []) if g["members"]]
    return single + groups


def _of_use(layer: dict, use: str) -> list[str]:
    return [c for c, s in layer["dims"].items() if s["use"] == use]


def _literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A frame of a list as large as a view, written into the plan."""
    names = [c.split()[0] for c in schema.split(",")]
    text = json.dumps([dict(zip(names, map(str, r), strict=True)) for r in rows])
    parsed = F.from_json(F.lit(text), f"array<struct<{', '.join(f'{n}: string' for n in names)}>>")
    each = spark.range(1).select(F.inline(parsed))
    return each.select(*[F.col(n).cast(c.split()[1]).alias(n) for n, c in zip(names, schema.split(","), strict=True)])


def layer_cells(layer: dict, number: int, offset: int, scaled: bool) -> DataFrame:
    """``CELLS`` of a layer: complete-case sums and ratios of its choices, series counted from ``offset`` in the order of
    the product of the choices, categories from 0.

    A value is null unless every cell of its members' product is published. Its mark is then that of the first such cell
    that has one, else of the first cell there is; otherwise the first cell's status, else the first there is.
    """
    dims = layer["dims"]
    choices = {c: _choices(s) for c, s in dims.items()}
    ratios = [x["ratio"] for cs in choices.values() for x in cs if x["ratio"]]
    rule = ratios[0] if ratios else None
    entries: dict[str, dict[int, list]] = {}
    for column, cs in choices.items():
        mine = entries.setdefault(column, {})
        for i, x in enumerate(cs):
            for m in x["members"]:
                mine.setdefault(m, []).append({"i": i, "size": len(x["members"]), "ratio": bool(x["ratio"]), "role": "own"})
            if rule and rule["column"] == column:
                for role in ("numerator", "denominator"):
                    mine.setdefault(rule[role], []).append({"i": i, "size": len(x["members"]), "ratio": False, "role": role})
    rows = layer["obs"].where(reduce(Column.__and__, [F.col(c).isin(*ms) for c, ms in entries.items()]))
    for column, mine in entries.items():
        known = F.from_json(F.lit(json.dumps({str(m): e for m, e in mine.items()})), "map<string, array<struct<i: int, size: int, ratio: boolean, role: string>>>")
        rows = rows.withColumn(f"__{column}", F.explode(F.try_element_at(known, F.col(column).cast("string"))))
    of = lambda c, field: F.col(f"__{c}")[field]
    product = lambda columns: reduce(lambda n, c: n * len(choices[c]) + of(c, "i"), columns, F.lit(0))
    ratio = reduce(Column.__or__, [of(c, "ratio") for c in dims])
    role = of(rule["column"], "role") if rule else F.lit("own")
    status = F.coalesce("status", F.lit(""))
    symbol = F.coalesce("symbol", F.lit("")) if "symbol" in layer["obs"].columns else F.lit("")
    rows = rows.select(
        (F.lit(offset) + product(_of_use(layer, "series"))).alias("n"), product(_of_use(layer, "x")).alias("c"), "period_start",
        F.col("value_num").alias("plain"), scale_value(F.col("value_num"), F.coalesce("scalar_id", F.lit(0))).alias("power"), status.alias("status"),
        F.when(status != "", status).otherwise(symbol).alias("mark"), F.struct(F.col("uom_id").cast("string").alias("unit"), F.coalesce("scalar_id", F.lit(0)).cast("string").alias("scale")).alias("unit"),
        F.struct(*dims).alias("cell"), ratio.alias("ratio"), role.alias("role"), reduce(Column.__mul__, [of(c, "size") for c in dims]).alias("size"),
    ).where("ratio or role = 'own'")
    own = F.col("role") == "own"
    source = F.when(F.col("ratio"), ~own).otherwise(own)
    missing = F.col("plain").isNull()
    earliest = lambda value, test: F.min_by(F.when(test, value), F.when(test, F.col("cell")))
    first = F.struct("status", "mark")
    cells = rows.groupBy("n", "c", "period_start").agg(
        F.max("ratio").alias("ratio"), F.max("size").alias("size"),
        F.count_distinct(F.when(own & ~missing, F.col("cell"))).alias("published"), F.sum(F.when(own, F.col("power" if scaled else "plain"))).alias("total"),
        F.count_distinct(F.when(~own & ~missing, F.col("cell"))).alias("parts"), *[F.sum(F.when(F.col("role") == k, F.col("power"))).alias(k) for k in ("numerator", "denominator")],
        earliest(F.col("mark"), source & missing & (F.col("mark") != "")).alias("missing_mark"), F.coalesce(earliest(first, own), earliest(first, source)).alias("first"),
        earliest(F.col("status"), source & (F.col("status") != "")).alias("any_status"), F.coalesce(earliest(F.col("unit"), own), earliest(F.col("unit"), source)).alias("unit"),
    )
    divided = F.when(F.col("parts") == 2 * F.col("size"), F.col("numerator") / F.nullif("denominator", F.lit(0.0)) * F.lit(float(rule["scale"] if rule else 1)))
    value = F.when(F.col("ratio"), divided).otherwise(F.when(F.col("published") == F.col("size"), F.col("total")))
    shown = F.when(value.isNull(), F.coalesce("missing_mark", "first.mark")).otherwise(F.coalesce(F.nullif("first.status", F.lit("")), "any_status"))
    return cells.select(F.lit(number).alias("layer"), "n", "c", "period_start", value.alias("value"), F.coalesce(shown, F.lit("")).alias("status"), F.col("unit.unit").alias("unit"), F.col("unit.scale").alias("scale"), "ratio")


def _window(spark: SparkSession, dates: list, time: dict, inclusive: bool) -> list:
    """The dates between the bounds if there are any, else those of the preset ``latest``, ``max`` or ``<n>Y``, counted back
    from the last date. ``to`` is compared as a prefix; the cut-off itself belongs to the window where ``inclusive``."""
    low, high, preset = time.get("from"), time.get("to"), time.get("preset", "max")
    if low or high:
        return [d for d in dates if (not low or d.isoformat() >= low) and (not high or d.isoformat()[: len(high)] <= high)]
    if preset == "latest":
        return dates[-1:]
    if not preset.endswith("Y") or not dates:
        return dates
    cut = spark.range(1).select(years_before(F.lit(dates[-1]), int(preset[:-1]))).first()[0]
    return [d for d in dates if d > cut or inclusive and d == cut]


def _transformed(cells: DataFrame, kinds: DataFrame, transform: str, index_base: str | None, window: list) -> DataFrame:
    """``layer, series, period_start, value`` after the transform; ``series`` names a series and category."""
    if not window:
        return cells.select("layer", "series", "period_start", "value").limit(0)
    if transform == "pct_change_yoy":
        return pct_change_yoy(cells, kinds)
    if transform == "pct_change_period":
        return pct_change(cells, 1)
    inside = F.col("period_start").between(F.lit(window[0]), F.lit(window[-1]))
    if transform == "pct_change_window":
        at = lambda d: F.max(F.when(F.col("period_start") == F.lit(d), F.col("value")))
        ends = cells.groupBy("layer", "series").agg(at(window[0]).alias("a"), at(window[-1]).alias("b"))
        change = F.when(F.col("a") != 0, (F.col("b") / F.nullif("a", F.lit(0.0)) - 1) * 100)
        return ends.select("layer", "series", F.lit(window[-1]).alias("period_start"), change.alias("value"))
    if transform == "index_first":
        return index_rebase(cells if index_base else cells.where(inside), index_base)
    return cells.select("layer", "series", "period_start", "value")


def _snapshot(cells: DataFrame, window: list, size: int, at: str | None):
    """The one date of a category view: the last in the window with the prefix ``at``, else the last at which all ``size``
    cells are published, else the last."""
    if at:
        found = [d for d in window if d.isoformat().startswith(at)]
        if not found:
            raise ValueError(f"no date of the window begins with {at}")
        return found[-1]
    full = cells.where(F.col("period_start").between(F.lit(window[0]), F.lit(window[-1]))).groupBy("period_start").agg(F.count("value").alias("published"))
    return full.where(F.col("published") == size).agg(F.max("period_start")).first()[0] or window[-1]


def run_view(layers: list[dict], time: dict | None = None, transform: str = "level", index_base: str | None = None, scaled: bool = False, most_series: int = 40, sort: str = "none") -> dict[str, DataFrame]:
    """``points``, ``series`` and ``gaps`` of a view.

    Series are the product of each layer's choices, in order, the first ``most_series`` of all; a series without rows is
    one, unpublished. ``points`` has ``layer, series, category, period_start, value, status, position, category_position``:
    every series at every date of the window, which all layers share, their observed dates and the tables' own within
    these; with categories, all of them at one date, sorted by their sums where ``sort`` is ``asc`` or ``desc``, and a layer
    without categories repeated in each. A change has its own layer's dates for steps. Where a transform makes a published
    value null, its mark is blank. ``series`` has ``position, layer, series, unit, scale, first, last, unpublished, axis,
    total``: axes 0 and 1 by the order in which units and scales of published series appear; published series of a third
    are left out of all, unpublished ones stay; ``total`` counts the whole product. ``gaps`` are runs of missing values at
    a layer's own periods. Layers without any choice make no series; two dimensions of categories are refused.
    """
    time = time or {}
    spark = layers[0]["obs"].sparkSession
    categories: list[str] = []
    listed, whole, total = [], [], 0  # position, layer, series key; each layer's cells; size of the product
    for i, layer in enumerate(layers):
        choices = {c: _choices(s) for c, s in layer["dims"].items()}
        if not all(choices.values()):
            continue
        names = _of_use(layer, "series")
        whole.append(layer_cells(layer, i, total, scaled))
        for k, combo in enumerate(itertools.islice(itertools.product(*[choices[c] for c in names]), max(0, most_series - len(listed)))):
            listed.append((total + k, i, ",".join(f"{c}={x['key']}" for c, x in zip(names, combo, strict=True))))
        for c in _of_use(layer, "x"):
            categories += [x["label"] for x in choices[c]]
        total += reduce(lambda n, c: n * len(choices[c]), names, 1)
    by_x = {i for i, layer in enumerate(layers) if _of_use(layer, "x")}
    if sum(len(_of_use(layer, "x")) for layer in layers) > 1:
        raise ValueError("only one dimension of a view makes categories")
    cells = stored(reduce(DataFrame.unionByName, whole), "view-cells") if whole else spark.createDataFrame([], CELLS)
    own_dates = cells.select("layer", "period_start").distinct()
    given = [layer["periods"].select(F.lit(i).alias("layer"), "period_start") for i, layer in enumerate(layers) if layer.get("periods") is not None]
    own_dates = reduce(DataFrame.union, given, own_dates).distinct()
    dates = sorted(r[0] for r in layer_union(cells, own_dates).collect())  # as many as the view has dates
    window = _window(spark, dates, time, transform not in ("level", "share_of_x"))

    keyed = cells.withColumn("series", F.concat_ws(":", "n", "c"))
    kinds = _literal(spark, [(i, layer["kind"]) for i, layer in enumerate(layers)], "layer int,kind string")
    made = _transformed(keyed, kinds, transform, index_base, window).select("series", "period_start", "value")
    series = _literal(spark, listed, "position int,layer int,series string")
    shown = window[-1:] if transform == "pct_change_window" else window
    if by_x and window and transform != "pct_change_window":
        kept = keyed.where(F.col("n").isin(*[n for n, *_ in listed]))
        shown = [_snapshot(kept, window, sum(len(categories) if i in by_x else 1 for _, i, _ in listed), time.get("at"))]
    width = F.when(F.col("layer").isin(*by_x), len(categories)).otherwise(1) if by_x else F.lit(1)
    frame = series.withColumn("category_position", F.explode(F.sequence(F.lit(0), width - 1)))
    frame = frame.withColumn("period_start", F.explode(F.array(*[F.lit(d) for d in shown]).cast("array<date>")))
    frame = frame.withColumn("key", F.concat_ws(":", "position", "category_position"))
    raw = keyed.select(F.col("series").alias("key"), "period_start", F.col("value").alias("raw"), "status")
    points = frame.join(made.withColumnRenamed("series", "key"), ["key", "period_start"], "left").join(raw, ["key", "period_start"], "left")
    blank = F.col("value").isNull() & F.col("raw").isNotNull()
    if transform == "pct_change_window":
        blank = F.col("value").isNotNull()
    points = points.withColumn("status", F.when(blank, "").otherwise(F.coalesce("status", F.lit("")))).drop("key", "raw")
    if by_x:
        named = _literal(spark, list(enumerate(categories)), "category_position int,category string")
        inside = points.where(F.col("layer").isin(*by_x)).join(named, "category_position")
        outside = points.where(~F.col("layer").isin(*by_x)).drop("category_position")
        repeated = repeat_over_categories(outside.withColumn("category", F.lit("")), named).join(named, "category")
        points = inside.unionByName(repeated)
        if transform == "share_of_x":
            points = category_share(points, ["layer", "series", "period_start"]).withColumn("value", F.col("share")).drop("share")
        if sort != "none":
            ranked = sort_categories(points.withColumn("position", F.col("category_position")), sort == "desc").select("category", (F.col("rank") - 1).alias("category_position"))
            points = points.drop("category_position").join(ranked, "category")
    else:
        points = points.withColumn("category", F.lit(""))
    points = stored(points.select("layer", "series", "category", "period_start", "value", "status", "position", "category_position"), "view-points")

    there = F.when(F.col("value").isNotNull(), F.col("period_start"))
    bounds = points.groupBy("position").agg(F.min(there).alias("first"), F.max(there).alias("last"))
    measured = cells.where(F.col("period_start").between(F.lit(window[0]), F.lit(window[-1]))) if window else cells
    unit = F.struct("unit", "scale", "ratio")
    units = measured.groupBy(F.col("n").alias("position")).agg(F.min_by(unit, F.struct("c", "period_start")).alias("u"))
    fallback = cells.groupBy("layer").agg(F.min_by(unit, F.struct("period_start", "n", "c")).alias("any_u"))
    told = series.join(bounds, "position", "left").join(units, "position", "left").join(fallback, "layer", "left").withColumn("u", F.coalesce("u", "any_u"))
    fixed = {"share_of_x": "%", "index_first": "index"}.get(transform, "%" if transform.startswith("pct") else None)
    scale = F.lit("0") if fixed or scaled else F.when(F.col("u.ratio"), "0").otherwise(F.col("u.scale"))
    told = told.select("position", "layer", "series", (F.lit(fixed) if fixed else F.col("u.unit")).alias("unit"), scale.alias("scale"), "first", "last", F.col("first").isNull().alias("unpublished"))
    axes = assign_axes(told.withColumnRenamed("position", "series_no")).select(F.col("series_no").alias("position"), "axis")
    told = told.join(axes, "position").withColumn("total", F.lit(total).cast("long"))
    kept = points.join(told.select("position"), "position", "left_semi")
    inside = kept.join(own_dates, ["layer", "period_start"], "left_semi")
    return {"points": kept, "series": told, "gaps": null_runs(inside) if not by_x else null_runs(inside).limit(0)}
