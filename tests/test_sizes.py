"""What larger tables showed, on small ones."""

import hashlib
import shutil
import tracemalloc
from pathlib import Path
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import lines
from quillon.operators import evidence, graph, research, retrieval, structure
from quillon.plans import casework, passages  # noqa: F401
from quillon.plans.catalog import QUERIES, SQL
from quillon.sources import stores
from quillon.sources.shared import shared_dir


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def long_keys(spark, sf, tmp_path_factory):
    """The smallest tables with orders' keys of seven digits."""
    folder = tmp_path_factory.mktemp("long-keys")
    shutil.copy(f"{sf}/customer.parquet", folder)
    spark.read.parquet(f"{sf}/orders.parquet").withColumn("o_orderkey", F.col("o_orderkey") + 1_234_567).write.parquet(f"{folder}/orders.parquet")
    return str(folder)


def test_bates_numbers_of_seven_digits(spark, long_keys):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW customer AS SELECT * FROM '{long_keys}/customer.parquet'")
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{long_keys}/orders.parquet/*.parquet'")
    wanted = sorted(connection.execute(SQL["bates_extract"]).fetchall())
    got = QUERIES["bates_extract"](spark, long_keys).select("id", "bates", "prefix", "number")
    assert sorted(tuple(r) for r in got.collect()) == wanted


def test_page_furniture_joins_nothing(spark, sf):
    assert "Join" not in plan_of(QUERIES["page_furniture"](spark, sf))


def test_lines_come_in_chunks_of_bounded_size():
    texts = pa.RecordBatch.from_pydict({"text": [" ".join(f"w{i}x{k}" for k in range(50)) + "\n" for i in range(2_000)]})
    chunks = list(lines._chunks(iter([texts]), lines.SIMILARITY))
    assert sum(len(c.hashes) for c in chunks) == 2_000
    assert max(c.held for c in chunks) <= lines.CHUNK_WORDS + 50
    assert sorted(b for c in chunks for b in c.counted()[0].tolist()) == sorted(b for c in [_one_chunk(texts)] for b in c.counted()[0].tolist())


def _one_chunk(texts):
    chunk = lines._Chunk(lines.SIMILARITY)
    for text in texts.column(0).to_pylist():
        for _, line in lines.plain_lines(text.encode()):
            chunk.add(lines._hash_of(line), line, line.count(b" ") + 1)
    return chunk


def test_keys_are_counted_in_all_documents(spark):
    """Each document has 16 pairs of its own and three that 37 documents have, whatever part of the documents they stand in."""
    docs = lines._keyed(spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(16)) + ("\nalpha beta gamma delta " + f"v{i}" if i < 37 else "")) for i in range(60)], "doc_id long, text string").repartition(5))
    texts = pa.RecordBatch.from_pydict({"text": [r.text for r in docs.collect()]})
    wanted = np.bincount(_one_chunk(texts).slots(), minlength=lines.SLOTS)
    ranks = lines.rank_table(docs, lines.SIMILARITY)
    assert sorted(wanted[wanted > 1].tolist()) == [37, 37, 37]
    assert (np.round(np.exp2(ranks / lines._STEP) - 1) == np.where(wanted > 1, wanted, 0)).all()


@pytest.mark.parametrize("n", [5, 300])
def test_lines_are_compared_by_words_whatever_is_repeated(n):
    one = ["a", "b"] * n
    assert lines.similar(" ".join(one), " ".join(one[1:]), 0.8)
    assert not lines.similar(" ".join(one), " ".join(["a"] * n + ["a"] * n), 0.8)
    assert lines.similar(" ".join(one), " ".join(["x"] * (n * 2 // 5) + one[n * 2 // 5 :]), 0.8)


def test_pages_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(casework, "PAGES_A_TASK", 100)
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert casework.production_pages(spark, sf).rdd.getNumPartitions() == n // 100 + 1


def test_edges_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr(graph, "EDGES_A_TASK", 1_000)
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert QUERIES["relationship_edges"](spark, sf).rdd.getNumPartitions() == n // 1_000 + 1
    edges = spark.createDataFrame([(1, 2), (2, 2), (None, 1), (3, None), (1, 2)], "source long, target long")
    found = graph.edges_of(edges, spark.createDataFrame([(2,), (2,), (None,), (1,)], "document_id long"))
    assert sorted(map(str, found.collect())) == sorted(f"Row(document_id={d}, other={o}, kind='{k}')" for d, o, k in [(1, 2, "out"), (1, 2, "out"), (2, 2, "out"), (2, 1, "in"), (2, 1, "in"), (2, 2, "in"), (1, None, "in")])


def test_facts_of_an_exhibit_come_together(spark, sf, monkeypatch):
    monkeypatch.setattr(casework, "FACTS_A_TASK", 300, raising=False)
    found = QUERIES["exhibit_fact_links"](spark, sf).groupBy(F.spark_partition_id().alias("task")).agg(F.collect_set("exhibit_id").alias("exhibits")).collect()
    parts = [set(r.exhibits) for r in found]
    assert len(parts) > 1
    assert sum(map(len, parts)) <= len(set().union(*parts)) + len(parts) - 1


def odd_lines(spark, folder):
    """Spans that are equal, without a start, an end or a document, and lengths that round."""
    rows = [(1, 7, 3.0), (1, 7, 3.0), (1, 8, 3.5), (1, 30, 2.5), (1, None, 4.0), (1, None, 4.0), (2, None, 1.0), (3, 5, None), (3, 5, 2.0), (3, 20, 6.0), (3, 25, 1.0), (None, 4, 3.0), (None, 40, 5.0), (4, 49, 6.0), (5, 9, None), (5, 9, None), (5, 12, None), (6, 3, None), (6, 3, 3.0), (6, 4, 3.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    connection = duckdb.connect(config={"threads": 1})  # with more, the two windows of the SQL may order equal spans differently
    connection.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    return connection


def test_odd_spans_merge_as_in_sql(spark, tmp_path):
    wanted = odd_lines(spark, tmp_path).execute(SQL["interval_merge"]).fetchall()
    got = QUERIES["interval_merge"](spark, str(tmp_path)).select("doc_id", "start", "end")
    assert got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got.collect())


def test_odd_spans_are_covered_as_in_sql(spark, tmp_path):
    wanted = odd_lines(spark, tmp_path).execute(SQL["gap_fill"]).fetchall()
    got = QUERIES["gap_fill"](spark, str(tmp_path)).select("doc_id", "start", "end", "kind")
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in got.collect())


def exhibits(spark, folder, facts, rows):
    spark.createDataFrame([(k,) for k in facts], "o_orderkey long").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(k,) for k in rows], "s_suppkey long").write.parquet(f"{folder}/supplier.parquet")
    return QUERIES["exhibit_fact_links"](spark, str(folder)).select("fact_id", "exhibit_id", "exhibit_row")


@pytest.mark.parametrize("broadcast", [0, 500_000])
def test_exhibits_of_any_size_meet_all_their_facts(spark, tmp_path, monkeypatch, broadcast):
    """Keys that come twice, below zero or not at all; exhibits with more rows, and with more facts, than are taken at once, and without any."""
    monkeypatch.setattr(casework, "EXHIBIT_ROWS", broadcast)
    monkeypatch.setattr(casework, "ROWS_TOGETHER", 7, raising=False)
    monkeypatch.setattr(casework, "FACTS_POWER", 3, raising=False)
    got = exhibits(spark, tmp_path, [*range(0, 1600, 40), *range(30), 5, 5, -3, -43, None, None], [*range(0, 800, 40), *range(20, 40), 25, 25, -3, None])
    connection = duckdb.connect()
    for name in ("orders", "supplier"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got.collect()) == sorted(connection.execute(SQL["exhibit_fact_links"]).fetchall())


def test_links_of_large_exhibits_take_little_room(spark, tmp_path):
    exhibits(spark, tmp_path, range(7, 4_000, 40), range(7, 360_000, 40)).write.parquet(f"{tmp_path}/links")
    written = sum(f.stat().st_size for f in (tmp_path / "links").glob("*.parquet"))
    assert spark.read.parquet(f"{tmp_path}/links").count() == 900_000
    assert written < 0.5 * 900_000


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_searches_hold_little_whatever_is_asked():
    r = np.random.default_rng(0)
    asked = SimpleNamespace(value=(np.arange(4096), r.standard_normal((4096, 8))))
    rows = pa.RecordBatch.from_pydict({"id": np.arange(10_000), "vector": r.standard_normal((10_000, 8)).tolist()})
    assert peak_mb(lambda: list(retrieval._nearest(asked, 5)(iter([rows])))) < 200
    by_store = SimpleNamespace(value={"a": asked.value})
    assert peak_mb(lambda: list(research._nearest(by_store, 5)(iter([rows.append_column("store", pa.array(["a"] * 10_000))])))) < 200


def test_the_driver_gets_ranked_slots_only(spark):
    docs = spark.createDataFrame([(i, "alpha beta gamma " + " ".join(f"w{i}x{k}" for k in range(9))) for i in range(40)], "doc_id long, text string")
    assert peak_mb(lambda: lines.rank_table(docs, lines.SIMILARITY)) < 20


@pytest.mark.parametrize(("held", "products", "cells"), [(4096, 1 << 20, 1 << 20), (4, 5, 16)])
def test_sparse_search_deals_no_pairs(spark, monkeypatch, held, products, cells):
    monkeypatch.setattr(research, "HELD", held)
    monkeypatch.setattr(research, "PRODUCTS", products)
    monkeypatch.setattr(retrieval, "CELLS", cells)
    r = np.random.default_rng(1)
    vectors = {(s, i): {int(b): round(float(r.uniform(0.1, 1)), 1) for b in r.choice(30, int(r.integers(0, 5)), replace=False)} for s in "ab" for i in range(40)}
    asked = {(q, s): {int(b): round(float(r.uniform(0.1, 1)), 1) for b in r.choice(30, 4, replace=False)} for q in range(7) for s in "abc" if (q + ord(s)) % 3}
    stored = spark.createDataFrame([(s, i, [(b, w) for b, w in v.items()]) for (s, i), v in vectors.items()], "store string, id long, keywords array<struct<bucket: long, weight: double>>").repartition(3)
    rows = spark.createDataFrame([(q, s, b, w) for (q, s), v in asked.items() for b, w in v.items()], "question_id long, store string, bucket long, weight double")
    found = research.sparse(stored, rows, 3)
    got = {}
    for x in sorted(found.collect(), key=lambda x: x["rank"]):
        got.setdefault((x.question_id, x.store), []).append((x.id, round(x.score, 9)))
    wanted = {}
    for (q, s), v in asked.items():
        scores = sorted((-round(sum(w * v[b] for b, w in vectors[t, i].items() if b in v), 9), i) for t, i in vectors if t == s and v.keys() & vectors[t, i].keys())
        if scores:
            wanted[q, s] = [(i, -n) for n, i in scores[:3]]
    assert got == wanted
    assert "Aggregate" not in plan_of(found)


def test_tokens_take_little_room_however_many_there_are():
    rows = [pa.RecordBatch.from_pydict({"id": [at], "content": [" ".join(f"w{at}x{k}" for k in range(20_000)).encode()]}) for at in range(20)]
    found = []
    assert peak_mb(lambda: found.extend(b.num_rows for b in retrieval._encoder(100_000, ["id"], False)(iter(rows)))) < 60
    buckets = retrieval._Buckets(1_000)
    assert buckets[b"abc"] == buckets[b"abc"] == int(hashlib.sha256(b"abc").hexdigest(), 16) % 1_000


def test_facts_of_one_set_of_words_are_compared_once():
    names, lists = ["alpha gamma"], {"alpha": np.array([0]), "gamma": np.array([0])}
    rows = pa.RecordBatch.from_pydict({"fact_id": list(range(20_000, 0, -1)), "words": ["alpha gamma delta", "beta", "alpha"] * 6_666 + ["gamma", "alpha gamma"]})
    widths = []

    class Watched(retrieval.Best):
        def add(self, ids, scores):
            widths.append(len(ids))
            super().add(ids, scores)

    evidence.Best, was = Watched, evidence.Best
    try:
        (found,) = evidence._most_shared(SimpleNamespace(value=(names, lists)), 3)(iter([rows]))
    finally:
        evidence.Best = was
    assert sum(widths) <= 5 * 3
    assert list(zip(found["fact_id"].to_pylist(), found["shared"].to_pylist(), strict=True)) == [(1, 2), (5, 2), (8, 2)]


def test_chunks_are_made_some_texts_at_a_time(spark, sf):
    assert "MapInPandas" not in plan_of(QUERIES["chunk_documents"](spark, sf))


def test_citations_are_those_of_all_spans(spark):
    texts = ["12 F. 2 3 and x12 F. 3", "1 US 2 3 US 4", "see 410 U.S. 113, a v. b", "a1 b 2 3", "7  F.  8d  9", "", None, "no 12\n34. 56", "é5 ü 6 7_8 9 10"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wanted = structure.structure_spans(docs).where("kind = 'citation'")
    assert sorted(structure.citations(docs).collect()) == sorted(wanted.collect())
    for text in filter(None, texts):
        if "v." not in text:
            assert [m.span() for m in structure.NUMBERED.finditer(text)] == [m.span() for m in structure.CITATION.finditer(text)]


def test_upserts_and_deletes_copy_no_parts(spark, tmp_path):
    def copies():
        return set(Path(shared_dir(spark).removeprefix("file://")).glob("store-parts-*"))

    before, path = copies(), f"{tmp_path}/store"
    rows = spark.range(40).select(F.lit("a").alias("store"), F.col("id").cast("string").alias("id"), F.lit(1).alias("version"), (F.col("id") * 2).alias("value"))
    stores.upsert(path, rows)
    stores.upsert(path, rows.where("value < 20").withColumn("version", F.lit(2)).withColumn("value", F.lit(-1).cast("long")))
    assert stores.delete(path, spark, stores._schema(rows), F.col("value") > 60) == 9
    assert sorted(r.value for r in stores.read(spark, path, stores._schema(rows)).collect()) == [-1] * 10 + list(range(20, 61, 2))
    assert copies() == before
