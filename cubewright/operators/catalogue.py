"""Joins and lookups between observations, series and the catalogue, and a table's detail records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.functions.text import strip_html


def join_period(obs: DataFrame, period: DataFrame) -> DataFrame:
    return obs.join(period, ["pid", "ref_date"])


def join_labels(obs: DataFrame, member: DataFrame, dimensions: int) -> DataFrame:
    """``label_k`` of every dimension's member: one left join a dimension, each against its own slice of the catalogue."""
    out = obs
    for k in range(1, dimensions + 1):
        own = member.where(F.col("dimension_id") == k).select("pid", F.col("member_id").alias(f"m{k}"), F.col("member_name").alias(f"label_{k}"))
        out = out.join(own, ["pid", f"m{k}"], "left")
    return out


def label_codes(df: DataFrame, codes: DataFrame, column: str, label: str) -> DataFrame:
    return df.join(codes.select(F.col("code").alias(column), F.col("en").alias(label)), column, "left")


def label_lists(df: DataFrame, key: str, column: str, codes: DataFrame) -> DataFrame:
    """A list of codes as the list of their labels, in the same order; a missing code is a null slot."""
    each = df.select(key, F.posexplode(column).alias("position", "code")).join(codes, "code", "left")
    lists = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "en"))), lambda x: x["en"]).alias("labels"))
    return df.select(key).join(lists, key, "left")


def filter_observations(obs: DataFrame, from_: str | None = None, to: str | None = None, members: dict[str, int] | None = None) -> DataFrame:
    """Inclusive bounds on the text of the date, and equal members; plain comparisons, which reach the scan."""
    tests: list[Column] = []
    if from_:
        tests.append(F.col("ref_date") >= from_)
    if to:
        tests.append(F.col("ref_date") <= to)
    tests += [F.col(c) == v for c, v in (members or {}).items() if c in obs.columns]
    return obs.where(reduce(Column.__and__, tests, F.lit(True)))


def page(obs: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page in member order; labels are joined to the page afterwards. At most 1000 rows."""
    return obs.orderBy(*order).offset(offset).limit(min(limit, 1000))


def total_with_page(df: DataFrame, order: list[str], limit: int) -> DataFrame:
    total = F.broadcast(df.agg(F.count("*").alias("total")))
    return df.orderBy(*order).limit(limit).join(total)


def limits_guard(df: DataFrame, most: int) -> DataFrame:
    """One row: whether there are more than ``most`` rows, found without counting them all."""
    return df.limit(most + 1).agg((F.count("*") > most).alias("refused"))


def member_select(member: DataFrame, rule: dict) -> Column:
    """A boolean expression of a selection: eq, in, contains, all, childrenOf, any, and, not."""
    (kind, value), *_ = rule.items()
    name = F.lower("member_name")
    if kind == "all":
        return F.lit(True)
    if kind == "eq":
        return name == value.lower()
    if kind == "in":
        return name.isin(*[v.lower() for v in value])
    if kind == "contains":
        return name.contains(value.lower())
    if kind == "childrenOf":
        return F.coalesce(F.col("parent_member_id") == value, F.lit(False))
    if kind == "not":
        return ~member_select(member, value)
    parts = [member_select(member, v) for v in value]
    return reduce(Column.__or__ if kind == "any" else Column.__and__, parts)


def member_roles(member: DataFrame) -> DataFrame:
    """``roles`` of each member: total for a single root, root, leaf; an orphan is a root."""
    key = ["pid", "dimension_id"]
    parents = member.select(*key, F.col("parent_member_id").alias("member_id")).where("member_id is not null").distinct().withColumn("has_children", F.lit(True))
    known = member.select(*key, F.col("member_id").alias("parent_member_id")).withColumn("has_parent", F.lit(True))
    joined = member.join(parents, [*key, "member_id"], "left").join(known, [*key, "parent_member_id"], "left")
    root = F.col("has_parent").isNull()
    flagged = joined.withColumn("root", root).withColumn("roots", F.count_if(root).over(Window.partitionBy(*key)))
    roles = F.array_compact(F.array(F.when(F.col("root") & (F.col("roots") == 1) & F.coalesce("has_children", F.lit(False)), "total"), F.when(F.col("root"), "root"), F.when(F.col("has_children").isNull(), "leaf")))
    return flagged.select(*key, "member_id", F.array_join(roles, ",").alias("roles"))


def derive_member_roles(member: DataFrame, territories: tuple[str, ...] = ("60", "61", "62")) -> DataFrame:
    """``pid, dimension_id, member_id, roles, own_code``: what a member is by its hierarchy and its place.

    ``member`` has ``parent_member_id, level, geo_code, place_id``. A root with children is a total, a member without any a
    leaf; a parent that isn't a member counts as none. Levels give country, province, territory (provinces of the given
    codes) and region; a province found only by its code is a region where another member of the dimension has the same
    code by its id. ``own_code`` is the code of provinces and territories found by id.
    """
    key = ["pid", "dimension_id"]
    parents = member.select(*key, F.col("parent_member_id").alias("member_id")).where("member_id is not null").distinct().withColumn("has_children", F.lit(True))
    known = member.select(*key, F.col("member_id").alias("parent_member_id"), F.lit(True).alias("has_parent"))
    joined = member.join(parents, [*key, "member_id"], "left").join(known, [*key, "parent_member_id"], "left")
    by_code, province = F.coalesce(F.col("place_id").startswith("code:"), F.lit(False)), F.coalesce(F.col("level") == "province", F.lit(False))
    twin = F.max(F.when(province & ~by_code, True)).over(Window.partitionBy(*key, "geo_code"))
    level = F.when(F.col("level") == "country", "country").when(province & by_code & F.coalesce("twin", F.lit(False)), "region")
    level = level.when(province, F.when(F.coalesce(F.col("geo_code").isin(*territories), F.lit(False)), "territory").otherwise("province")).when(F.col("level").isNotNull(), "region")
    flagged = joined.withColumn("twin", twin).withColumn("level_role", level)
    total = F.when(F.col("has_parent").isNull() & F.coalesce("has_children", F.lit(False)), "total")
    roles = F.array_compact(F.array(total, F.col("level_role"), F.when(F.col("has_children").isNull(), "leaf")))
    own = F.when(F.col("level_role").isin("province", "territory") & F.col("place_id").isNotNull() & ~by_code, F.col("geo_code"))
    return flagged.select(*key, "member_id", roles.alias("roles"), own.alias("own_code"))


def selectable(member: DataFrame, roles: DataFrame, paths: DataFrame) -> DataFrame:
    """Members with all that ``selection`` asks about: roles, own code, and the ids and names of what is above them.

    ``paths`` has ``pid, dimension_id, member_id, ancestor, distance``, each member itself included.
    """
    key = ["pid", "dimension_id"]
    names = member.select(*key, F.col("member_id").alias("ancestor"), F.lower("member_name").alias("name"))
    up = paths.where("distance > 0").join(names, [*key, "ancestor"]).groupBy(*key, "member_id").agg(F.collect_list(F.struct(F.col("ancestor").alias("id"), "name", "distance")).alias("above"))
    none = F.expr("cast(array() as array<struct<id:int,name:string,distance:int>>)")
    return member.join(roles, [*key, "member_id"]).join(up, [*key, "member_id"], "left").withColumn("above", F.coalesce("above", none))


def selection(rule: dict, regions: dict[str, list[str]] | None = None) -> Column:
    """A test of ``selectable`` members by a rule: eq and in (id or label), role, region, contains, all, childrenOf,
    descendantsOf, any, and, not. Labels agree without case, whole."""
    (kind, value), *_ = rule.items()
    is_ref = lambda ref, id_, name: id_ == ref if isinstance(ref, int) else name == ref.lower()
    name = F.lower("member_name")
    if kind == "all":
        return F.lit(True)
    if kind == "eq":
        return is_ref(value, F.col("member_id"), name)
    if kind == "in":
        return reduce(Column.__or__, [is_ref(v, F.col("member_id"), name) for v in value], F.lit(False))
    if kind == "role":
        return F.array_contains("roles", value)
    if kind == "region":
        return F.coalesce(F.col("own_code").isin(*(regions or {}).get(value, [])), F.lit(False))
    if kind == "contains":
        return name.contains(value.lower())
    if kind == "childrenOf":
        return F.exists("above", lambda a: (a["distance"] == 1) & is_ref(value, a["id"], a["name"]))
    if kind == "descendantsOf":
        return F.exists("above", lambda a: is_ref(value, a["id"], a["name"])) & ~is_ref(value, F.col("member_id"), name)
    if kind == "not":
        return ~selection(value, regions)
    parts = [selection(v, regions) for v in value]
    return reduce(Column.__or__ if kind == "any" else Column.__and__, parts)


def references(rule: dict) -> list:
    """The ids and labels that a rule names."""
    (kind, value), *_ = rule.items()
    if kind in ("eq", "childrenOf", "descendantsOf"):
        return [value]
    if kind == "in":
        return list(value)
    return [r for part in (value if kind in ("any", "and") else [value] if kind == "not" else []) for r in references(part)]


def missing_references(member: DataFrame, rule: dict) -> DataFrame:
    """``pid, dimension_id, reference`` of ids and labels that a rule names and a dimension lacks."""
    wanted = F.array(*[F.lit(str(r).lower()) for r in references(rule)])
    have = F.array_distinct(F.flatten(F.collect_list(F.array(F.lower("member_name"), F.col("member_id").cast("string")))))
    return member.groupBy("pid", "dimension_id").agg(F.explode(F.array_except(wanted, have)).alias("reference"))


def ranked_default(obs: DataFrame, ranks: DataFrame, dates: DataFrame, dimensions: int) -> DataFrame:
    """``pid, m1..``: the first published recent coordinate, by each dimension's rank in turn: its default member, its
    other roots, the rest, then the id. ``ranks`` has ``pid, dimension_id, member_id, rank``; ``dates`` the recent
    ``pid, ref_date``, such as a monthly table's last twelve or another's latest."""
    there = obs.where("value_num is not null").join(dates, ["pid", "ref_date"], "left_semi")
    order = []
    for k in range(1, dimensions + 1):
        own = ranks.where(F.col("dimension_id") == k).select("pid", F.col("member_id").alias(f"m{k}"), F.col("rank").alias(f"r{k}"))
        there = there.join(own, ["pid", f"m{k}"])
        order += [F.col(f"r{k}"), F.col(f"m{k}")]
    return there.groupBy("pid").agg(F.min(F.struct(*order)).alias("c")).select("pid", *[f"c.m{k}" for k in range(1, dimensions + 1)])


def default_ranks(member: DataFrame, roles: DataFrame) -> DataFrame:
    """The rank of each member as its dimension's default: 0 for the only total, else the first root, 1 for other roots, 2 else."""
    key = ["pid", "dimension_id"]
    known = member.select(*key, F.col("member_id").alias("parent_member_id"), F.lit(True).alias("has_parent"))
    own = Window.partitionBy(*key)
    rows = member.join(known, [*key, "parent_member_id"], "left").join(roles, [*key, "member_id"])
    root, total = F.col("has_parent").isNull(), F.array_contains("roles", "total")
    first = F.when(F.count_if(total).over(own) == 1, F.min(F.when(total, F.col("member_id"))).over(own)).otherwise(F.coalesce(F.min(F.when(root, F.col("member_id"))).over(own), F.min("member_id").over(own)))
    return rows.withColumn("first", first).select(*key, "member_id", F.when(F.col("member_id") == F.col("first"), 0).when(root, 1).otherwise(2).alias("rank"))


def dimension_roles(member: DataFrame, mapped: DataFrame, measures: DataFrame) -> DataFrame:
    """Geography where at least half of the members have a place, else measure if the dimension carries units, else category."""
    has = mapped.where("place_id is not null").select("pid", F.lit(1).alias("dimension_id"), "member_id", F.lit(True).alias("placed"))
    joined = member.join(has, ["pid", "dimension_id", "member_id"], "left").groupBy("pid", "dimension_id").agg(F.count("*").alias("n"), F.count("placed").alias("placed"))
    unit = measures.withColumn("has_uom", F.lit(True))
    role = F.when(F.col("placed") * 2 >= F.col("n"), "geography").when(F.col("has_uom"), "measure").otherwise("category")
    return joined.join(unit, ["pid", "dimension_id"], "left").select("pid", "dimension_id", role.alias("role"))


def default_coordinate(obs: DataFrame, recent: int) -> DataFrame:
    """The first published coordinate of the latest ``recent`` dates of each table, by member ids."""
    ids = F.struct("m1", "m2", "m3")
    order = Window.partitionBy("pid").orderBy(F.desc("ref_date"))
    dates = obs.select("pid", "ref_date").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= recent).drop("n")
    there = obs.where("value_num is not null").join(dates, ["pid", "ref_date"])
    return there.groupBy("pid").agg(F.min(ids).alias("c")).select("pid", "c.*")


def table_detail(member: DataFrame) -> DataFrame:
    """One record a table: its dimensions with their members, as JSON."""
    rows = member.groupBy("pid", "dimension_id").agg(F.array_sort(F.collect_list(F.struct("member_id", "member_name"))).alias("members"))
    tables = rows.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("dimension_id", "members"))).alias("dimensions"))
    return tables.select("pid", F.size("dimensions").cast("long").alias("n_dimensions"), F.to_json("dimensions").alias("detail"))


def ordered_text(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    """Labels by id without tags, joined by `` | ``."""
    return df.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda x: strip_html(x[column])), " | ").alias("text"))


def note_scope(notes: DataFrame, references: DataFrame) -> DataFrame:
    """The widest scope of each note: the table if nothing refers to it, else dimension before member."""
    refs = references.select("pid", F.explode(F.split("note_ids", ";")).alias("note_id"), "scope").where("note_id <> ''")
    least = refs.groupBy("pid", "note_id").agg(F.min(F.when(F.col("scope") == "dimension", 1).otherwise(2)).alias("rank"))
    scope = F.when(F.col("rank") == 1, "dimension").when(F.col("rank") == 2, "member").otherwise("table")
    return notes.join(least, ["pid", "note_id"], "left").select("pid", "note_id", scope.alias("scope"))


def marks_legend(points: DataFrame, legend: DataFrame) -> DataFrame:
    """Distinct marks of shown points with their meaning, the mark itself where there is none."""
    marks = points.where("status <> ''").select("status").distinct()
    return marks.join(legend, "status", "left").select("status", F.coalesce("meaning", "status").alias("meaning"))


def reconcile(inventory: DataFrame, captured: DataFrame, built: DataFrame, failures: DataFrame) -> DataFrame:
    """Counts of tables by family along the chain, with the last failure of each family's missing ones."""
    last = failures.groupBy("pid").agg(F.max_by("reason", "attempt").alias("reason"), F.count("*").alias("attempts"))
    flag = lambda df, name: df.select("pid").distinct().withColumn(name, F.lit(1))
    joined = inventory.join(flag(captured, "captured"), "pid", "left").join(flag(built, "built"), "pid", "left").join(last, "pid", "left")
    return joined.groupBy("family").agg(
        F.count("*").alias("inventory"), F.count("captured").alias("captured"), F.count("built").alias("built"), F.count_if(F.col("captured").isNull()).alias("gaps"), F.coalesce(F.sum(F.when(F.col("captured").isNull(), F.col("attempts"))), F.lit(0)).alias("attempts")
    )


def series_slice(obs: DataFrame, member: DataFrame) -> DataFrame:
    """Coordinates with their number of points and a name from the labels that differ among them."""
    labelled = join_labels(obs, member, 3)
    spread = labelled.groupBy("pid").agg(*[(F.count_distinct(f"m{k}") > 1).alias(f"v{k}") for k in (1, 2, 3)])
    name = F.concat_ws(" · ", *[F.when(F.col(f"v{k}"), F.col(f"label_{k}")) for k in (1, 2, 3)])
    return labelled.join(spread, "pid").groupBy("pid", "m1", "m2", "m3", name.alias("name")).agg(F.count("*").alias("n_points"), F.count("value_num").alias("n_published"))


def cube_list(tables: DataFrame) -> DataFrame:
    from cubewright.functions.text import table_number

    return tables.where("queryable").select("pid", table_number(F.col("pid")).alias("number"), "title", "period_min", "period_max")
