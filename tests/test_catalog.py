"""Every query with SQL equals DuckDB's result over the whole tables; the others run."""

import math
import os

import duckdb
import pandas as pd
import pytest

from lodeline.plans import catalog, code_catalog  # noqa: F401  (adds its queries to the catalogue)

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        return plain(v.item())
    if isinstance(v, float):
        return round(v, 9)
    return str(v.tz_localize(None) if v.tz else v) if isinstance(v, pd.Timestamp) else v


def rows(frame):
    return sorted((tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    if name in catalog.ORACLE:
        want = duck.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_deletions_cover_all_suppliers(spark):
    d = DIR.replace("sf0.001", "sf0.01")
    suppliers = {r[0] for r in catalog.table(spark, d, "supplier").select("s_suppkey").collect()}
    asked = {n: {r[0] for r in catalog.QUERIES[n](spark, d).select("request_id").distinct().collect()} for n in ("delete_candidates", "delete_candidates_fuzzy", "multi_delete")}
    assert asked["multi_delete"] == suppliers - {max(suppliers)}
    con = duckdb.connect()
    for t in ("part", "supplier"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for n in ("delete_candidates", "multi_delete"):
        assert rows(catalog.QUERIES[n](spark, d).toPandas()) == rows(con.sql(catalog.ORACLE[n]).df())
    assert len(suppliers) > 20 and all(max(ids) > 20 for ids in asked.values())


def test_vectors_are_ranked_for_all_rows(spark):
    ids = {r[0] for r in catalog.table(spark, DIR, "embeddings").select("vec_id").collect()}
    got = catalog.QUERIES["vector_topk"](spark, DIR).toPandas()
    assert set(got["request_id"]) == ids and len(got) == 10 * len(ids) and any(i % 50 for i in ids)
