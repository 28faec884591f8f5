"""The registered queries over the smallest tables, their SQL, and the pipeline."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from quillon.llm.oracles import ORACLE_SQL
from quillon.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(name, spark, sf):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    out = QUERIES[name](spark, sf)
    columns = sorted(out.columns)
    found = duck.execute(ORACLE_SQL[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert sorted(map(repr, (tuple(r[i] for i in at) for r in found.fetchall()))) == sorted(map(repr, map(tuple, out.select(*columns).collect())))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(name, spark, sf):
    out = QUERIES[name](spark, sf)
    if "doc_id" in out.columns:
        assert out.select("doc_id").distinct().count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    else:
        assert out.count() > 0


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() > 0
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_of_nothing(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_pipeline_of_odd_rows(spark, sf):
    """Nulls in any column, blanks, ties, repeated rows and columns with the operators' own names."""
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    texts = [(1, clean), (2, None), (3, ""), (None, other), (4, clean), (4, clean), (5, clean.replace("word3 ", "changed ")), (6, other[::-1] + " " + benchmark), (7, "x " * 30_000)]
    rows = [(i, t, None, None, None, 1, "k", True, "c", [1], 0) for i, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, key string, kept boolean, clean_text string, removed array<int>, __words int"
    docs = spark.createDataFrame(rows, schema)
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        docs = out.cache()
        seen.append(sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()))
    assert seen[0] == [(False, 1), (False, 4), (False, 4), (False, 5), (False, 6), (True, 0)]
    assert seen[-1] == [(False, 1), (True, 0)]
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(placed) == 2 and all(r.n_words == 80 for r in placed)
