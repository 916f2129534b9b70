"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from matchbench.plans.oracle import ORACLE
from matchbench.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    r = sql.execute(ORACLE[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == names
    want = sorted((tuple(plain(row[at.index(c)]) for c in names) for row in r.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(a == b or all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(a, b, strict=True)) for a, b in zip(got, want, strict=True))


def test_every_query_without_sql_is_listed():
    fitted = {"pca_project", "lda_project", "procrustes", "classify_svm_linear", "classify_svm_rbf"}
    assert set(QUERIES) - set(ORACLE) == fitted
