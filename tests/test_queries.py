"""Registered queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillgrid.operators import stats
from quillgrid.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cells(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "NA"
        if isinstance(x, bool):
            return str(x)
        return repr(float(x)) if isinstance(x, (int, float)) else str(x)

    return sorted(tuple(cell(x) for x in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    found = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in catalog.ORACLES:
        assert found
        return
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert _cells(found) == _cells([tuple(r[names.index(c)] for c in columns) for r in want.fetchall()])


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables are not here")
def test_intervals_have_all_replicates(spark, monkeypatch):
    """The registered intervals are of as many replicates as the library's own, in code and in SQL."""
    seen, own = [], stats.replicate_means
    monkeypatch.setitem(stats.DRAWS, "md5", lambda scores, value, order, by, replicates, seed: seen.append(replicates) or own(scores, value, order, by, replicates, seed))
    catalog.QUERIES["bootstrap_ci"](spark, SF)
    assert seen == [stats.REPLICATES] == [1000] and "range(1000)" in catalog.ORACLES["bootstrap_ci"]
