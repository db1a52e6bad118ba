"""A corpus pipeline: toxicity, near duplicates, decontamination, source mixing, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's rows as Parquet in
the shared folder and reads them again as the next stage's documents, and removes them once that stage's rows are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cubewright.llm import decontaminate, mixing, simhash, tokens, toxicity
from cubewright.llm.common import discard, materialize
from cubewright.llm.queries import table, tokenizer_path, train_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, train_toxicity(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.write_and_read(docs, tokenizer_path(), tokens.read_digests)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token ids", write_token_ids),
]

#: A trained classifier decides the first stage, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not given:
            discard(before)
    return docs
