"""Every registered query of the panel library against its SQL in DuckDB, and the rows of those that SQL can't express."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tessera import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = os.environ.get("TEST_LARGER_DIR", "/root/testdata/sf0.01")
#: Queries of pairs and baskets inside sectors: the smallest tables have none, so these run on the next larger ones.
PAIRED = {"a05", "j10", "j11", "a37", "a39", "a40", "a41", "a43", "a45", "a47", "a58", "a68", "a69", "a70", "a81", "t05", "w37", "w38", "w47", "w48"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    """Values as text that both engines agree on; doubles to five significant digits."""
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else "0" if abs(v) < 1e-9 else f"{v:.5g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def con():
    out = {}
    for sf in {SF, LARGER}:
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return out


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    sf = LARGER if name.split("_")[0] in PAIRED else SF
    df = registry.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in names]).collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rel = con[sf].sql(sql)
    columns = list(rel.columns)
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    want = sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert got == want and got


def test_names_follow_the_inventory():
    import re

    ids = {re.match(r"[a-z]+[0-9]+", n)[0] for n in registry.queries()}
    assert {"w03", "j06", "a46", "p20", "s05", "u04", "t05", "f09", "r03"} <= ids
    assert set(registry.oracle_sql()) <= set(registry.queries())
