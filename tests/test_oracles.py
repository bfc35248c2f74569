"""Every query of the library against its SQL on the same tables: columns, types and values."""

import os

import duckdb
import pytest

from tessera import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(cols).collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = duck.sql(sql)
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    assert {c: KINDS[k] for c, k in df.dtypes} == kinds
    want = sorted((tuple(r) for r in rel.project(", ".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert len(got) == len(want)
    assert got == want


def test_near_dup_pairs_have_every_copy(spark, sf_dir):
    from tessera.operators import dedup

    prints = [tuple(r) for r in dedup.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "h").collect()]
    first = {}
    for i, h in sorted(prints):
        first.setdefault(h, i)
    ids = sorted((i, h) for h, i in first.items())
    want = [(first[h], i, 0) for i, h in prints if i != first[h]]
    assert want
    want += [(a, b, d) for k, (a, x) in enumerate(ids) for b, y in ids[k + 1 :] if (d := ((x ^ y) & (2**64 - 1)).bit_count()) <= 3]
    got = registry.queries()["near_dup_pairs"](spark, sf_dir)
    assert sorted(map(tuple, got.select("a", "b", "distance").collect())) == sorted(want)
