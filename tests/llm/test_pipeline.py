"""The pipeline, stage by stage, on the smallest tables, and the queries with SQL oracles."""

import duckdb
import pytest

import corpus_pipeline
from cubewright.llm import decontaminate, queries, simhash
from cubewright.llm.common import materialize


def test_stages_keep_their_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "test")
        assert docs.columns == columns
        seen.append(docs.count())
        if name.startswith("simhash"):
            assert simhash.near_duplicates(docs).where("doc_id <> component_id").count() == 0 and seen[-1] < seen[-2]
        if name == "decontamination":
            found = decontaminate.matches(docs, queries.table(spark, sf_dir, "benchmark"))
            assert found.where("n_hit > 0").count() == 0
            assert before.join(docs, "doc_id", "left_anti").count() == seen[-2] - seen[-1]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == seen[-1] and last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(name, spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    names = [d[0] for d in result.description]
    df = queries.QUERIES[name](spark, sf_dir).select(*names)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


def test_stages_of_empty_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        assert found.columns == docs.columns and found.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0


def test_toxicity_on_held_out_labels(spark):
    """Labels that were never trained on: rank, precision and recall of what is called toxic."""
    sf_dir = "/root/testdata/sf0.01"
    labels = queries.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    rows = queries.op5_toxicity(spark, sf_dir).join(labels, "doc_id").where("held_out and toxic is not null").collect()
    bad, good = ([r["score"] for r in rows if r["toxic"] == k] for k in (1, 0))
    above = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    called = [r["toxic"] for r in rows if r["predicted"]]
    assert above > 0.8 and sum(called) / len(called) > 0.9 and sum(called) / len(bad) > 0.6
