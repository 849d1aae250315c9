"""Each query of the plans against its SQL, over whole tables."""

import collections
import math

import duckdb
import pytest

from placeweave import plans

BASE = plans.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(BASE.QUERIES))
def test_query(name, spark, sf_dir, db):
    df = BASE.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = collections.Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in BASE.ORACLES:  # runs; its results are checked in test_core or may be empty here
        return
    out = db.execute(BASE.ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == collections.Counter(tuple(plain(r[k]) for k in order) for r in out.fetchall())
