"""Batch search and retrieval over catalogue and document tables, and question cues.

Queries are a stated set; documents are read once, whatever their number, meet them on words or in blocks of vectors,
and are ranked by windows within a query, never over the whole table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cubewright.functions.text import content_hash

from .matching import contained


#: Distinct words of all queries up to which documents' other words are left out before the join.
SOUGHT = 256
#: Products of queries and vectors that a task holds at once.
TILE = 1 << 20
#: What people say, and what tables call it; what the price index has parts of.
SAID = {"quality of life": "life satisfaction", "well being": "life satisfaction", "wellbeing": "life satisfaction", "inflation": "consumer price index all-items", "cost of living": "consumer price index all-items", "cpi": "consumer price index"}
INDEX, WHOLE = "consumer price index", "all-items"
PARTS = "all items|allitems|alcohol|clothing|education|energy|excluding|food|footwear|gas|gasoline|goods|health|housing|mortgage|recreation|rent|services|shelter|tobacco|transport".split("|")


def rewrite_query(text: Column) -> Column:
    """A search in the tables' own words; the price index without a part is its all-items. Phrases stand at word ends, in
    any case, their words parted by white space or hyphens."""
    loosely = lambda phrase: rf"(?i)\b{phrase.replace(' ', chr(92) + 's*[-' + chr(92) + 's]' + chr(92) + 's*')}\b"
    found = F.trim(text)
    for said, own in SAID.items():
        found = F.regexp_replace(found, loosely(said), own)
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(found), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    part = F.lit(False)
    for p in PARTS:
        part = part | F.contains(words, F.lit(f" {p} "))
    return F.when(F.contains(words, F.lit(f" {INDEX} ")) & ~part, F.concat(found, F.lit(f" {WHOLE}"))).otherwise(found)


def query_terms(query: Column, most_terms: int = 8) -> Column:
    return F.slice(F.filter(F.split(F.lower(F.trim(query)), r"\s+"), lambda t: t != ""), 1, most_terms)


def table_search(records: DataFrame, queries: DataFrame, most_terms: int = 8) -> DataFrame:
    """Tables in which every term of a query occurs, with hits by title, dimensions, members and notes, and their rank.

    ``records`` has ``pid, cansim_id, queryable, title, dimensions, members, notes``; ``queries`` has ``query_id, query``.
    Terms are literal texts without case, or a whole id. Records and terms meet on grams and on ids, so no record is
    compared with all terms; only terms that occur are joined to their queries.
    """
    fields = ("title", "dimensions", "members", "notes")
    asked = queries.select("query_id", query_terms(F.col("query"), most_terms).alias("terms")).where(F.size("terms") > 0)
    each = asked.select("query_id", F.size("terms").alias("n"), F.posexplode("terms").alias("position", "term"))
    terms = each.select(F.col("term").alias("pattern")).distinct()
    texts = records.select("pid", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.coalesce(f, F.lit(""))).alias("text")) for f in fields])).alias("x")).select("pid", "x.*")
    inside = contained(texts, ["pid", "field"], terms).select("pid", "pattern", "field")
    ids = records.select("pid", F.explode(F.array_distinct(F.array_compact(F.array("pid", F.lower("cansim_id"))))).alias("pattern")).join(terms, "pattern").select("pid", "pattern", F.lit("").alias("field"))
    found = inside.union(ids).groupBy("pid", F.col("pattern").alias("term")).agg(*[F.max((F.col("field") == f).cast("int")).alias(f"{f}_hits") for f in fields])
    sums = each.join(found, "term").groupBy("query_id", "pid").agg(F.count("*").alias("held"), F.max("n").alias("n"), *[F.sum(f"{f}_hits").alias(f"{f}_hits") for f in fields]).where("held = n")
    rows = sums.join(records.select("pid", "title", "queryable"), "pid").withColumn("text_hits", F.col("dimensions_hits") + F.col("members_hits") + F.col("notes_hits"))
    order = Window.partitionBy("query_id").orderBy(F.desc("title_hits"), F.desc("queryable"), F.desc("text_hits"), "title", "pid")
    return rows.select("query_id", "pid", "title", *[f"{f}_hits" for f in fields], "text_hits", F.row_number().over(order).alias("rank"))


def ranked(df: DataFrame, by: list[str], order: list[Column], top: int, name: str = "rank") -> DataFrame:
    """The first ``top`` rows of each group with their rank; Spark keeps only that many a task before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= top)


def lexical_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Whole-word hits of each query's words, four times the title's and once the text's, of documents with any.

    Words of documents and queries meet in an equi-join, after the words that no query has are left out.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    asked = queries.select("query_id", F.explode(tokens("query")).alias("word"))
    few = [r["word"] for r in asked.select("word").distinct().limit(SOUGHT + 1).collect()]
    # with few words in all queries, others are left out before a document's words become rows; the join is the same
    sought = (lambda c: F.array_intersect(tokens(c), F.array(*map(F.lit, few)))) if 0 < len(few) <= SOUGHT else tokens
    weighted = lambda c, n: F.transform(sought(c), lambda w: F.struct(w.alias("word"), F.lit(n).alias("weight")))
    own = docs.select("pid", F.explode(F.concat(weighted("title", 4), weighted("text", 1))).alias("w"))
    return own.select("pid", "w.word", "w.weight").join(asked, "word").groupBy("query_id", "pid").agg(F.sum("weight").cast("int").alias("score"))


class Nearest:
    """The ``top`` best of each query among the vectors seen so far, by score and then the smaller id."""

    def __init__(self, ids: np.ndarray, top: int):
        self.ids, self.top = ids, top
        self.least = np.full(len(ids), -np.inf)  # what a vector's score must reach
        self.rows = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        self.waiting: list[tuple] = []

    def add(self, score: np.ndarray, own: np.ndarray) -> None:
        """``score`` of all queries with the vectors ``own``; nothing that is not finite counts, nor a vector's own."""
        with np.errstate(invalid="ignore"):
            q, v = np.nonzero((score >= self.least[:, None] - 1e-8) & np.isfinite(score))
        other = self.ids[q] != own[v]
        q, v = q[other], v[other]
        self.waiting.append((q, own[v], np.round(score[q, v], 9)))
        if sum(len(w[0]) for w in self.waiting) > TILE // 4:
            self.settle()

    def settle(self) -> None:
        q, own, score = (np.concatenate(c) for c in zip(self.rows, *self.waiting, strict=True))
        order = np.lexsort((own, -score, q))
        q, own, score = q[order], own[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.top
        self.rows, self.waiting = (q[keep], own[keep], score[keep]), []
        full = place == self.top - 1
        self.least[q[full]] = score[full]

    def batches(self, size: int = 10_000) -> Iterator[pa.RecordBatch]:
        self.settle()
        q, own, score = self.rows
        for at in range(0, len(q), size):
            part = slice(at, at + size)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q[part]]), pa.array(own[part]), pa.array(score[part])], ["query_id", "vec_id", "score"])


def vector_topk(vectors: DataFrame, queries: DataFrame, top: int, metric: str = "cosine", block: int = 4096) -> DataFrame:
    """The ``top`` nearest vectors of each query vector by cosine (0 where a norm is 0) or dot product, itself left out.

    Queries are taken ``block`` at a time as one matrix a length; a task multiplies its vectors of that length with it, TILE
    products at a time, and keeps the best of each query, so what is ranked at the end is at most ``top`` rows a query and
    task, and a task's memory is that of a block and a tile, whatever the rows. Null and empty
    vectors are left out, and vectors of different lengths are not compared.
    """
    spark = vectors.sparkSession
    usable = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("size(v) > 0")
    asked = usable(queries)
    parts, found = -(-asked.count() // block) or 1, []

    def unit(m: np.ndarray) -> np.ndarray:
        size = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0) if metric == "cosine" else m

    def by_length(ids: list, vectors: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        lists: dict[int, tuple[list, list]] = {}
        for i, v in zip(ids, vectors, strict=True):
            both = lists.setdefault(len(v), ([], []))
            both[0].append(i)
            both[1].append(v)
        return {n: (np.array(i, dtype=np.int64), unit(np.array(v, dtype=np.float64))) for n, (i, v) in lists.items()}

    for k in range(parts):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k).collect()  # about a block
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(by_length([r["vec_id"] for r in rows], [r["v"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kept = {length: Nearest(ids, top) for length, (ids, _) in shared.value.items()}
            for b in batches:
                lists = [v.values.to_numpy(zero_copy_only=False) for v in b.column("v")]
                for length, (own, v) in by_length(b.column("vec_id").to_pylist(), lists).items():
                    if length not in kept:
                        continue
                    matrix = shared.value[length][1]
                    step = max(1, TILE // len(matrix))
                    for at in range(0, len(own), step):
                        kept[length].add(matrix @ v[at : at + step].T, own[at : at + step])
            for best in kept.values():
                yield from best.batches()

        found.append(usable(vectors).mapInArrow(run, "query_id long, vec_id long, score double"))
    whole = reduce(DataFrame.union, found) if found else vectors.select(F.col("vec_id").cast("long").alias("query_id"), F.col("vec_id").cast("long"), F.lit(0.0).alias("score")).limit(0)
    return ranked(whole, ["query_id"], [F.desc("score"), F.col("vec_id")], top)


def rrf_fuse(rankings: list[tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of rankings ``query_id, id, rank`` with weights."""
    parts = [df.select("query_id", "id", (F.lit(weight) / (k + F.col("rank"))).alias("part")) for df, weight in rankings]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def retrieval_eval(ranking: DataFrame, queries: DataFrame, cuts: tuple[int, ...] = (1, 5, 12, 100)) -> DataFrame:
    """Recall at cuts and mean reciprocal rank of the first ``relevant`` row of each query's ranking.

    ``ranking`` has ``query_id, rank, relevant``; ``queries`` are those that have anything relevant at all.
    """
    hit = ranking.where("relevant").groupBy("query_id").agg(F.min("rank").alias("rank"))
    every = queries.select("query_id").distinct().join(hit, "query_id", "left")
    recall = [F.avg(F.when(F.col("rank") <= c, 1.0).otherwise(0.0)).alias(f"r{c}") for c in cuts]
    return every.agg(F.count("*").alias("n_queries"), *recall, F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def stale_documents(docs: DataFrame, index: DataFrame, model: str, dimensions: int) -> DataFrame:
    """Documents that the stored index lacks, or has with another content, model or number of dimensions, and why."""
    now = docs.select("doc_id", content_hash(F.col("text")).alias("now"))
    both = now.join(index, "doc_id", "left")
    why = F.when(F.col("hash").isNull(), "missing").when(F.col("hash") != F.col("now"), "content").when(F.col("model") != model, "model").when(F.col("dimensions") != dimensions, "dimensions")
    return both.withColumn("why", why).where("why is not null").select("doc_id", F.col("now").alias("hash"), "why")


def concept_documents(concepts: DataFrame, tables: DataFrame) -> DataFrame:
    """Concept texts attached to each table a concept lists."""
    each = concepts.select("text", F.explode(F.split("pids", ";")).alias("pid"))
    listed = each.groupBy("pid").agg(F.array_join(F.array_sort(F.collect_set("text")), "; ").alias("concepts"))
    return tables.join(listed, "pid")


def concept_match(questions: DataFrame, concepts: DataFrame) -> DataFrame:
    """The best concept of each question: twice its label's words and once its description's; a label word is needed and a score above 1.

    Questions and concepts meet on their words.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    asked = questions.select("question_id", F.explode(tokens("question")).alias("word"))
    weighted = lambda c, w: F.transform(tokens(c), lambda x: F.struct(x.alias("word"), F.lit(w).alias("weight")))
    own = concepts.select("concept_no", "label", F.explode(F.concat(weighted("label", 2), weighted("description", 1))).alias("w")).select("concept_no", "label", "w.word", "w.weight")
    scored = asked.join(own, "word").groupBy("question_id", "concept_no", "label").agg(F.sum("weight").cast("int").alias("score"), F.max("weight").alias("most")).where("most = 2 and score > 1")
    return scored.groupBy("question_id").agg(F.min_by(F.struct("label", "score"), F.struct(-F.col("score"), F.col("concept_no"))).alias("c")).select("question_id", "c.label", "c.score")


def cluster_cut(scores: DataFrame, floor: float = 0.52, span: float = 0.27, drop: float = 0.15, most: int = 12) -> DataFrame:
    """Scores of a query near its top one, up to the first large drop."""
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    kept = scores.withColumn("top", F.max("score").over(Window.partitionBy("query_id"))).withColumn("n", F.row_number().over(own))
    cut = kept.withColumn("cut", F.coalesce(F.lag("score").over(own) - F.col("score") >= drop, F.lit(False)))
    seen = cut.withColumn("after", F.max("cut").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return seen.where((F.col("score") >= floor) & (F.col("top") - F.col("score") <= span) & (F.col("n") <= most) & ~F.col("after")).select("query_id", "id", "score")


def spell_fix(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Words of five or more letters replaced by the only known word at the least distance: 1, or 2 for places of seven
    letters on. A misspelled place keeps its last letter, unless the place's is an s.

    ``vocabulary`` has ``word, place``. Words meet on what is left of them without up to two letters: two words within that
    distance share such a rest, so no word is compared with the whole vocabulary.
    """
    known = vocabulary.where(F.length("word") >= 5).groupBy(F.col("word").alias("known")).agg(F.max(F.col("place").cast("boolean")).alias("place"))
    words = tokens.select("word").where(F.length("word") >= 5).distinct().join(vocabulary, "word", "left_anti")

    def rests(c: str) -> Column:
        without = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))
        one = F.concat(F.array(F.col(c)), without(F.col(c)))
        two = F.flatten(F.transform(without(F.col(c)), without))
        return F.explode(F.array_distinct(F.concat(one, two)))

    met = words.select("word", rests("word").alias("rest")).join(known.select("known", "place", rests("known").alias("rest")), "rest").select("word", "known", "place").distinct()
    limit = F.when(F.col("place") & (F.length("word") >= 7), 2).otherwise(1)
    ends = ~F.col("place") | (F.right("word", F.lit(1)) == F.right("known", F.lit(1))) | F.col("known").endswith("s")
    near = met.withColumn("d", F.levenshtein("word", "known")).where((F.col("d") <= limit) & ends)
    best = near.groupBy("word", "d").agg(F.count("*").alias("n"), F.min("known").alias("known"))
    return best.groupBy("word").agg(F.min(F.struct("d", "n", "known")).alias("b")).where("b.n = 1").select("word", F.col("b.known").alias("fixed"))


def strip_phrases(text: Column, places: list[str] | None = None) -> Column:
    """The question without its time phrases, and without the given places at word boundaries."""
    gone = F.regexp_replace(F.lower(text), r"\b(?:(?:over|in|for|during) )?(?:the )?(?:last|past) (?:\d+ )?(?:years?|months?)\b|\b(?:from )?(?:19|20)\d\d\s*(?:to|through|[-–—])\s*(?:19|20)\d\d\b|\b(?:since|starting in|beginning in|from|to|until|in) (?:19|20)\d\d\b", " ")
    for place in sorted(places or [], key=len, reverse=True):
        gone = F.regexp_replace(gone, rf"(?<![\p{{L}}\p{{N}}])\Q{place.lower()}\E(?![\p{{L}}\p{{N}}])", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(gone, r"\s+", " "), r",\s*$", ""))


def scorecard(results: DataFrame) -> DataFrame:
    """Accuracy and nearest-rank latencies of labelled questions, by split."""
    return results.groupBy("split").agg(
        F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("accuracy"),
        *[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY latency)").alias(f"p{p}") for p in (50, 95)],
    )


def stable_rank(seed: str, key: Column) -> Column:
    """An order by SHA-256 that reruns and machines share."""
    return F.sha2(F.concat(F.lit(seed + "\0"), key.cast("string")), 256)


def stratified_sample(df: DataFrame, stratum: list[str], key: str, size: int, seed: str) -> DataFrame:
    """``size`` rows over strata: one each where possible, then in proportion by largest remainder, in hash order within.

    The allocation is arithmetic over one row a stratum; the rows are ranked within their stratum only.
    """
    counts = df.groupBy(*stratum).agg(F.count("*").alias("n"))
    shares = counts.withColumn("strata", F.count("*").over(Window.partitionBy())).withColumn("total", F.sum("n").over(Window.partitionBy()))
    rest = F.greatest(F.lit(size) - F.col("strata"), F.lit(0))
    quota = rest * F.col("n") / F.col("total")
    first = shares.withColumn("base", F.floor(quota)).withColumn("part", quota - F.floor(quota))
    given = F.sum("base").over(Window.partitionBy())
    order = Window.orderBy(F.desc(F.round("part", 9)), stable_rank(seed, F.concat_ws("|", *stratum)))
    alloc = first.withColumn("extra", (F.row_number().over(order) <= rest - given).cast("int"))
    alloc = alloc.select(*stratum, F.least(F.col("n"), 1 + F.col("base") + F.col("extra")).alias("take"))
    ranked_rows = df.withColumn("position", F.row_number().over(Window.partitionBy(*stratum).orderBy(stable_rank(seed, F.col(key)), key)))
    return ranked_rows.join(alloc, stratum).where("position <= take").drop("take", "position")


def size_percentiles(df: DataFrame, by: str, size: str) -> DataFrame:
    return df.groupBy(by).agg(
        *[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY {size})").alias(f"p{p}") for p in (25, 50, 75)],
        F.min(size).alias("least"), F.max(size).alias("most"), F.sum(size).alias("total"), F.count_if(F.col(size).isNull()).alias("unknown"),
    )


def edge_cohort(df: DataFrame, key: str, categories: dict[str, Column], top: int = 3) -> DataFrame:
    """The first rows of each category by its own order, each row once with the union of its labels."""
    parts = []
    for name, order in categories.items():
        parts.append(df.orderBy(order, key).limit(top).select(key, F.lit(name).alias("label")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
