import math
import os

import duckdb
import pytest

from funcframe import queries_io  # noqa: F401
from funcframe.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(rows):
    def one(v):
        return "NaN" if isinstance(v, float) and math.isnan(v) else v

    return sorted(repr(tuple(map(one, r))) for r in rows)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    got = QUERIES[name](spark, D)
    names = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(names)} FROM ({ORACLES[name]})").fetchall()
    assert canon(tuple(r) for r in got.select(*names).collect()) == canon(want)


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
def test_whole_tables(spark):
    n = {t: spark.read.parquet(f"{D}/{t}.parquet").count() for t in ("events", "orders", "part")}
    for how in ("floor", "nearest", "linear"):
        assert QUERIES[f"max_gap_{how}"](spark, D).count() == n["events"] + 3 * (n["events"] // 2 - 1)
    assert QUERIES["append"](spark, D).count() == QUERIES["resample"](spark, D).count() == n["orders"]
    assert sum(r["count"] for r in QUERIES["group_by_bin"](spark, D).collect()) == n["part"]
