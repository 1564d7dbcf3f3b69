"""The queries of the subpackage against SQL, and their results on the smallest data."""

import glob
import os

import pandas as pd
import pytest

from tidemark.llm.queries import ORACLE, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")
COLUMNS = {"p4_found": {"row_id_a", "row_id_b"}, "p7_found": {"doc_id", "item_id"}, "p8_found": {"doc_id"}}


@pytest.fixture(scope="module")
def duck():
    c = pytest.importorskip("duckdb").connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLE[name]).df()
    a, b = (x[sorted(x.columns)].sort_values(sorted(x.columns)).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


def test_columns_and_whole_results(spark):
    for name, columns in COLUMNS.items():
        assert set(QUERIES[name](spark, DIR).columns) == columns
    documents = spark.read.parquet(f"{DIR}/documents.parquet")
    judged = QUERIES["p8_judged"](spark, DIR).toPandas()
    assert len(judged) == documents.filter("length(text) > 0").count()
    cut = judged[judged["is_cut"]]
    sources = QUERIES["p8_sources"](spark, DIR).toPandas()
    assert sources["n"].sum() == len(judged) and sources["n_cut"].sum() == len(cut) == QUERIES["p8_found"](spark, DIR).count()
    near = QUERIES["p4_neighbours"](spark, DIR).toPandas()
    assert near.groupby("row_id").size().max() == 5 and (near["distance"] >= 0).all()
    leaks = QUERIES["p7_leaks"](spark, DIR).toPandas()
    assert ((leaks["containment"] > 0) & (leaks["containment"] <= 1)).all()
