"""Every query of the catalogue against its SQL on the smallest tables, and what its plan may hold."""

import datetime
import decimal
import math
import os
import re

import duckdb
import pytest

from docforge import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries whose partial ratios have no native form, and those that read the objects of files.
ARROW = {"token_coverage", "text_cross_validation", "pdf_graph", "pdf_orphans", "pdf_images"}
#: Queries that meet a few versions of a rate.
NESTED_LOOPS = {"asof_rate", "statutory_rate_check"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        p = f"{DIR}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name, capsys):
    df = catalog.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    df.explain()
    plan = capsys.readouterr().out
    assert not re.search("CartesianProduct" if name in ARROW else "CartesianProduct|Python|Pandas|ArrowEval", plan)
    assert name in NESTED_LOOPS or "BroadcastNestedLoopJoin" not in plan
    if name in catalog.oracle_sql():
        con.execute(catalog.oracle_sql()[name])
        names = [d[0] for d in con.description]
        assert sorted(names) == columns
        assert sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall()), key=repr) == rows
