"""Many patterns in many texts, so that neither side is compared with the whole other: an automaton of the patterns in every
task while they are few, and beyond that a gram index with verification."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Code points of a gram; shorter patterns have one gram, themselves.
GRAM = 3
#: Different patterns up to which every task gets an automaton of them all; their code points together.
MANY, LONG = 20_000, 2_000_000
#: Distinct grams sought up to which texts' other grams are left out before they become rows; the result is the same.
SOUGHT = 2_000


def _grams(text: Column, width: int) -> Column:
    """All runs of ``width`` code points, overlapping, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{width}}}))"), F.lit(1))


def _by_automaton(texts: DataFrame, keys: list[str], text: str, patterns: list[str]) -> DataFrame:
    """One pass over each text, whatever the number of patterns."""
    shared = texts.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(shared.value):
            automaton.add_word(p, i)
        automaton.make_automaton()
        for b in batches:
            rows, found = [], []
            for k, t in enumerate(b.column(b.num_columns - 1)):
                held = sorted({i for _, i in automaton.iter(t.as_py())}) if t.is_valid else []
                rows += [k] * len(held)
                found += [shared.value[i] for i in held]
            taken = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], [*b.schema.names, "pattern"])

    rows = texts.select(*keys, F.col(text).alias("text"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("pattern", StringType())]))


def contained(texts: DataFrame, keys: list[str], patterns: DataFrame, text: str = "text", pattern: str = "pattern") -> DataFrame:
    """``keys, text, pattern``: each row of ``texts`` with each different pattern that its text contains, literally.

    Up to MANY patterns of LONG code points together are an automaton in every task, and each text is read once. Beyond
    that a pattern is looked for by that of its grams which the fewest patterns have, the first of equal ones; a text meets
    it where it has that gram too, and is then searched for the whole pattern. Both sides meet in equi-joins then, on grams
    and on ``keys``, which should name a text. The rows are the same. Empty and null patterns are in no text, null texts
    hold nothing; repeated rows and keys keep their rows.
    """
    wanted = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    some = [r["pattern"] for r in wanted.limit(MANY + 1).collect()]
    if not some:
        return texts.select(*keys, F.col(text).alias("text"), F.lit(None).cast("string").alias("pattern")).limit(0)
    if len(some) <= MANY and sum(map(len, some)) <= LONG:
        return _by_automaton(texts, keys, text, sorted(some))
    width = lambda n: F.length("pattern") >= n
    own = F.when(width(GRAM), _grams(F.col("pattern"), GRAM)).otherwise(F.array("pattern"))
    grams = wanted.select("pattern", F.explode(F.array_distinct(own)).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    anchors = grams.join(shared, "gram").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    few = [r["gram"] for r in anchors.select("gram").distinct().limit(SOUGHT + 1).collect()]
    every = len(few) > SOUGHT
    widths = range(1, GRAM + 1) if every else sorted({len(g) for g in few})

    def held(n: int) -> Column:
        found = F.array_distinct(_grams(F.col(text), n))
        return found if every else F.array_intersect(found, F.array(*[F.lit(g) for g in few if len(g) == n]))

    met = texts.where(F.col(text).isNotNull()).select(*keys, F.explode(F.concat(*map(held, widths))).alias("gram"))
    met = met.join(anchors, "gram").select(*keys, "pattern").distinct()
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    both = texts.select(*keys, F.col(text).alias("text")).alias("t").join(met.alias("m"), same)
    return both.select(*[F.col(f"t.{k}").alias(k) for k in keys], F.col("t.text").alias("text"), F.col("m.pattern").alias("pattern")).where(F.col("text").contains(F.col("pattern")))
