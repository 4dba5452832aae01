"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerloom.plans import evidence, flows, relational, textual

MODULES = (relational, textual, evidence, flows)
PAIRS = [(m, name) for m in MODULES for name in m.oracle_sql()]


def _rows(rows):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(data="/root/testdata/sf0.001"):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize(("module", "name"), PAIRS, ids=[n for _, n in PAIRS])
def test_query_equals_oracle(spark, duck, data, module, name):
    got = module.queries()[name](spark, data)
    want = duck.sql(module.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert _rows(got.select(columns).collect()) == _rows([[r[k] for k in order] for r in want.fetchall()])


def test_all_queries_give_rows_or_an_oracle(spark, data):
    for name, query in textual.queries().items():
        if name not in textual.oracle_sql():
            assert query(spark, data).limit(1).count() == 1, name
