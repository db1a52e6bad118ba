"""Every registered query of the statistical operators against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from cubewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 4))
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return None if v is None else str(v)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(name, spark, sf_dir, db):
    df = registry.QUERIES[name](spark, sf_dir)
    result = db.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert table([tuple(r) for r in df.collect()], df.columns) == table(result.fetchall(), names)


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
