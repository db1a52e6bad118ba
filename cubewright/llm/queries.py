"""The registered queries of the corpus operators and their SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, divergence, embeddings, fingerprints, lines, mixing, pages, pii, secrets, simhash, tokens, toxicity, vectorcodes
from .common import small_batches

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.summary(lines.line_matches(table(spark, sf_dir, "documents")))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path(), tokens.read_digests)


def train_toxicity(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.held_out() & F.col("toxic").isNotNull())
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.train(texts.join(toxicity.sampled(labels, "doc_id"), "doc_id").select("text", "toxic"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), train_toxicity(spark, sf_dir))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.report(F.col("base")), 256).alias("base_sha256"), pii.report(F.col("found")).alias("spans"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.find(docs, secrets.train(docs))
    counts = [pii.count_of(F.col("base"), k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])]
    report = lambda c: pii.report(F.col(c), secrets.KINDS)
    return found.select("doc_id", *counts, F.sha2(report("base"), 256).alias("base_sha256"), report("found").alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_simhash, op3_lines, op4_token_ids, op5_toxicity, op6_decontaminate, op7_pii, op8_embeddings, op9_pages, op10_secrets,
        op11_vector_codes, op12_divergence, op13_fingerprints,
    )
}


def _vector_codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The rounds one after another, every part against every entry."""
    steps = [f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT id, part, x[1 + part * (len(x) // {parts}) : (part + 1) * (len(x) // {parts})] AS x FROM v, range({parts}) AS r(part)
), c0 AS (
  SELECT part, id - 1 AS entry, x FROM s WHERE id <= {entries}
)"""]
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT id, s.part, min(list_sum(list_transform(list_zip(s.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) * {entries} + c.entry) AS best, any_value(s.x) AS x
  FROM s JOIN c{k} AS c ON s.part = c.part GROUP BY id, s.part
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY place) AS x FROM (
    SELECT part, best % {entries} AS entry, place, sum(x[place]) AS total, count(*) AS n FROM a{k}, range(1, len(x) + 1) AS r(place) GROUP BY ALL
  ) GROUP BY ALL
), c{k + 1} AS (
  SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} AS c LEFT JOIN m{k} AS m ON c.part = m.part AND c.entry = m.entry
)""")
    steps.append(f"""e AS (
  SELECT id, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, CAST(sum(best // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY id
), l AS (
  SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM v JOIN e USING (id) GROUP BY label
), h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, label_error, codebooks_sha256 FROM v JOIN e USING (id) JOIN l ON v.label IS NOT DISTINCT FROM l.label, h""")
    return ", ".join(steps)


ORACLES = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below,
         sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
         sum(source_size) OVER () AS total
  FROM s
), l AS (
  SELECT (1.5::DOUBLE * total::DOUBLE - coalesce(below, 0)::DOUBLE) / open_w::DOUBLE AS level
  FROM r WHERE (1.5::DOUBLE * total::DOUBLE - coalesce(below, 0)::DOUBLE) / open_w::DOUBLE * w <= 2 * source_size
  ORDER BY source_size / w, source NULLS LAST LIMIT 1
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w::DOUBLE * l.level) AS target FROM s, l
), b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS repeats
  FROM t
), o AS (
  SELECT doc_id, size, source_size, target, repeats, budget - repeats * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(repeats * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
""",
    "op6_decontaminate": r"""
WITH i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT item_id, least(10, len(w)) AS k, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS p, w FROM i WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p + 1 : p + k], ' ') AS s FROM iw
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), dw AS (
  SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), m AS (
  SELECT doc_id, item_id, p, dw.k FROM dw JOIN win USING (k, s)
), n AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
""",
    "op8_embeddings": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT DISTINCT a AS id, a AS reached FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.reached = l.a
), n AS (
  SELECT a, count(*) AS n_links FROM l GROUP BY a
), c AS (
  SELECT id, min(reached) AS component_id FROM r GROUP BY id
)
SELECT e.vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, e.vec_id) AS component_id, coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.id
""",
    "op11_vector_codes": _vector_codes_sql(),
    "op12_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT id, lang, source, unnest(w) AS term FROM d
), k AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10
), v AS (
  SELECT lang, count(*) AS terms, sum(n) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(o.n, 0) AS n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) AS o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
), p AS (
  SELECT c.lang, source, term, c.n, 1 + (1000000000::HUGEINT * (c.n + 2)) // (sum(c.n) OVER (PARTITION BY c.lang, source) + 2 * terms) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 2)) // (total + 2 * terms) AS q
  FROM c JOIN v ON c.lang = v.lang
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item,
         coalesce((SELECT sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term WHERE a.lang = g.lang AND a.source = g.source AND b.source = h.source), 0) AS value
  FROM g JOIN g AS h ON g.lang = h.lang AND g.source <> h.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
""",
}
