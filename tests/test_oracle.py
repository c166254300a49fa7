"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pandas as pd
import pytest

from asofworks.plans import catalogue

SF = "/root/testdata/sf0.001"


def rows(frame):
    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if isinstance(v, float):  # pandas makes floats of whole numbers beside nulls
            return str(int(v)) if v.is_integer() else str(round(v, 5))
        return str(v)

    return sorted(str([cell(v) for v in r]) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The same tables as folders of several files."""
    top = tmp_path_factory.mktemp("parts")
    for f in os.listdir(SF):
        spark.read.parquet(f"{SF}/{f}").repartition(3).write.parquet(str(top / f))
    return str(top)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, parts, name):
    """Spark reads folders of files, DuckDB the single ones."""
    got, want = catalogue.QUERIES[name](spark, parts).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_scoped_union_searches_all_vectors(spark):
    """Vectors of high ids are found, and the best of all vectors are there."""
    sf = SF.replace("0.001", "0.01")
    got = catalogue.QUERIES["scoped_union_dedup"](spark, sf).toPandas()
    best = catalogue.QUERIES["vector_topk"](spark, sf).toPandas()
    assert len(got) == 40 and got.vec_id.is_unique and got.vec_id.max() >= 100
    assert set(best.vec_id) <= set(got.vec_id) and (got.first_source == 0).sum() == 8


@pytest.mark.parametrize("name", ["intent_detection", "hop_depth", "question_type", "temporal_constraints"])
def test_analysis_reads_every_user_turn(spark, name):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").where("role = 'user'").count()
    assert turns > 9 and catalogue.QUERIES[f"{name}_turns"](spark, SF).count() == turns


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql(spark, parts, name):
    assert catalogue.QUERIES[name](spark, parts).count() > 0


def test_ingestion_of_a_single_file(spark):
    assert catalogue.QUERIES["live_micro_batch"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").distinct().count()
