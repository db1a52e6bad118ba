"""Series built from observations, and the checks over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["pid", "key_kind", "series_key"]


def with_series_key(obs: DataFrame) -> DataFrame:
    """A series is its vector, or its coordinate where the vector is empty; the kind keeps the two apart."""
    none = F.col("vector") == ""
    return obs.withColumn("key_kind", F.when(none, "coordinate").otherwise("vector")).withColumn("series_key", F.when(none, F.col("coordinate")).otherwise(F.col("vector")))


def build_series(obs: DataFrame, period: DataFrame) -> DataFrame:
    """One row a series: bounds of what must not change, period bounds, counts and the last status.

    The periods are joined by ``pid, ref_date``; the grouping is by the series, so a table with most of the rows
    spreads over its series, and Spark sums within tasks first.
    """
    pairs = ["uom_id", "scalar_id", "decimals", "terminated", "dguid", "coordinate"]
    both = [f(c).alias(f"{c}_{n}") for c in pairs for f, n in ((F.min, "min"), (F.max, "max"))]
    joined = with_series_key(obs).join(period, ["pid", "ref_date"])
    return joined.groupBy(*KEY).agg(
        *both, F.min("period_kind").alias("kind_min"), F.max("period_kind").alias("kind_max"),
        F.min("period_start").alias("period_min"), F.max("period_end").alias("period_max"),
        F.count("*").alias("n_obs"), F.count_if(F.col("value") != "").alias("n_published"),
        F.max_by("status", F.struct("ref_date", "row_index")).alias("last_status"),
    )


def series_labels(series: DataFrame, family: DataFrame) -> DataFrame:
    """Series with their unit's family, and ``other`` where the period kind is mixed."""
    kind = F.when(F.col("kind_min") == F.col("kind_max"), F.col("kind_min")).otherwise("other")
    return series.join(family, F.col("uom_id_min") == F.col("uom_code"), "left").select(*KEY, "family", kind.alias("period_kind"), "n_obs", "n_published", "last_status")


def direct_series(obs: DataFrame, period: DataFrame) -> DataFrame:
    """Tables of one observation a series: a projection, without grouping."""
    return with_series_key(obs).join(period, ["pid", "ref_date"]).select(
        *KEY, "period_kind", F.col("period_start").alias("period_min"), F.col("period_end").alias("period_max"),
        F.lit(1).cast("long").alias("n_obs"), (F.col("value") != "").cast("long").alias("n_published"), F.col("status").alias("last_status"),
    )


def series_variation(series: DataFrame) -> DataFrame:
    """How many series change a property that should be constant, per table."""
    names = ["uom_id", "scalar_id", "decimals", "terminated", "dguid", "coordinate"]
    return series.groupBy("pid").agg(*[F.count_if(~F.col(f"{n}_min").eqNullSafe(F.col(f"{n}_max"))).alias(f"{n}_changes") for n in names], F.count_if(F.col("kind_min") != F.col("kind_max")).alias("kind_changes"))


def series_count_check(series: DataFrame, obs: DataFrame) -> DataFrame:
    """Series whose count differs from an independent count of the observations."""
    counted = with_series_key(obs).groupBy(*KEY).agg(F.count("*").alias("n_seen"))
    return series.join(counted, KEY, "full").where(~F.col("n_obs").eqNullSafe(F.col("n_seen"))).select(*KEY, "n_obs", "n_seen")


def table_stats(series: DataFrame, family: DataFrame) -> DataFrame:
    joined = series.join(family, F.col("uom_id_min") == F.col("uom_code"), "left")
    return joined.groupBy("pid").agg(
        F.sum("n_obs").alias("n_rows"), F.count("*").alias("n_series"), F.min("period_min").alias("period_min"), F.max("period_max").alias("period_max"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"),
    )


def period_kind_counts(series: DataFrame) -> DataFrame:
    return series.groupBy(F.col("kind_min").alias("period_kind")).agg(F.count("*").alias("n_series"), F.sum("n_obs").alias("n_obs"))


def status_profile(obs: DataFrame) -> DataFrame:
    """Observations and blanks by status."""
    return obs.groupBy("pid", "status").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "").alias("n_blank"))


def unknown_shapes(obs: DataFrame, shape: Column, known: Column) -> DataFrame:
    return obs.where(~known).groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))


def duplicate_keys(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return obs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def distinct_units(series: DataFrame) -> DataFrame:
    low, high = (series.select("pid", F.col(f"uom_id_{x}").alias("uom_id")) for x in ("min", "max"))
    return low.union(high).distinct()


def code_coverage(used: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Used codes that a code set lacks."""
    return used.select(column).distinct().join(known.select(column).distinct(), column, "left_anti")


def null_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column whether it is null in every row, and the number of rows."""
    return df.agg(*[(F.count(c) == 0).alias(f"{c}_null") for c in columns], F.count("*").alias("n_rows"))


def row_count_check(series: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tables whose series don't add up to the rows their manifest states."""
    counted = series.groupBy("pid").agg(F.sum("n_obs").alias("n_rows"))
    return manifest.join(counted, "pid", "left").where(~F.col("n_rows").eqNullSafe(F.col("rows"))).select("pid", "rows", "n_rows")
