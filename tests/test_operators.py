"""Operators on small tables with known results."""

import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.operators import boundaries, chunking, graph, motions, ranges, records, stats
from quillon.sources import files
from quillon.streaming import progress


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n", min_size=0, max_size=6000))
def test_chunks_cover_the_text(content):
    sizes = chunking.Sizes(200, 40, 30, 50)
    spans = chunking.cut(content, sizes)
    assert all(0 <= a < b <= len(content) for a, b in spans)
    assert all(b1 > b0 for (_, b0), (_, b1) in zip(spans, spans[1:], strict=False))


def test_chunks_end_at_sentences():
    content = "This is a test document. " * 500
    spans = chunking.cut(content.strip(), chunking.Sizes(1400, 200, 200, 500))
    assert spans and all(re.search(r"[.]\s*$", content[a:b]) for a, b in spans) and all(b - a <= 2100 for a, b in spans)


def test_coverage(spark):
    segments = spark.createDataFrame([(1, 2, 5), (1, 8, 10)], "doc_id int, start int, end int")
    totals = spark.createDataFrame([(1, 15), (2, 3)], "doc_id int, pages int")
    got = sorted((r.doc_id, r.start, r.end, r.kind) for r in boundaries.cover(segments, totals).collect())
    assert got == [(1, 0, 1, "fragment"), (1, 2, 5, "document"), (1, 6, 7, "fragment"), (1, 8, 10, "document"), (1, 11, 14, "fragment"), (2, 0, 2, "fragment")]


def test_email_page_is_a_boundary(spark):
    pages = spark.createDataFrame([(1, 0, "x"), (1, 1, "From: a@b.com\nTo: c@d.org\nPlease"), (1, 2, "FORM A-1\nFrom: a@b.com\nSubject: y")], "doc_id int, page int, text string")
    got = {(r.page, r.confidence) for r in boundaries.hard_boundaries(boundaries.page_features(pages)).collect()}
    assert got == {(2, 0.9)}


def test_range_lookup_across_buckets(spark):
    spans = spark.createDataFrame([(1, "A", 0, 500), (2, "A", 400, 900), (3, "B", 5, 5)], "doc_id int, prefix string, start long, end long")
    points = spark.createDataFrame([("A", 450), ("A", 899), ("A", 901), ("B", 5)], "prefix string, n long")
    assert {(r.prefix, r.n, r.doc_id) for r in ranges.lookup(points, spans).collect()} == {("A", 450, 1), ("A", 899, 2), ("B", 5, 3)}


def test_expanded_numbers_keep_all_digits(spark):
    spans = spark.createDataFrame([(1, "A", 9, 10), (2, "A", 99_999, 100_001)], "doc_id long, prefix string, start long, end long")
    assert {r.bates for r in ranges.expand(spans).collect()} == {"A00009", "A00010", "A99999", "A100000", "A100001"}


def test_isolation(spark):
    rows = spark.createDataFrame([("Smith",), (None,)], "case_name string")
    assert graph.isolated(rows, "Smith").first().isolated and not graph.isolated(rows, "Doe").first().isolated


def test_upsert_takes_the_last_change(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "id int, content string")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, content string, seq int")
    assert sorted(map(tuple, records.upsert(state, changes, "id").collect())) == [(1, "a"), (2, "d"), (3, "e")]


def test_stream_equals_batch(spark, sf, tmp_path):
    events = progress.read_events(spark, sf)
    progress.run_once(progress.windowed_counts(events, "1 hour", "0 seconds").where("n > 0"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = progress.windowed_counts(progress.with_time(spark.read.parquet(f"{sf}/events.parquet")))
    # the last window is still open on the stream
    assert got.count() > 0.9 * batch.count() and got.exceptAll(batch).count() == 0


def test_latest_state_on_a_stream(spark, sf):
    query = progress.latest_state(progress.read_events(spark, sf)).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = progress.latest_state(progress.with_time(spark.read.parquet(f"{sf}/events.parquet")))
    assert spark.table("latest").exceptAll(batch).count() == 0 and spark.table("latest").count() == batch.count()


def test_scan_of_folders(spark, tmp_path):
    for name in ("cases/A/x.pdf", "cases/A/sub/y.pdf", "cases/z.pdf", "cases/A/n.txt"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"text of " + name.encode())
    rows = {r.name: (r.case_name, r.folder) for r in files.scan(spark, str(tmp_path / "cases")).collect()}
    assert rows == {"x.pdf": ("A", None), "y.pdf": ("A", "sub"), "z.pdf": (None, None)}
    text = files.extracted(files.scan(spark, str(tmp_path / "cases")), [("utf8", files.decoded)])
    assert {r.method for r in text.collect()} == {"utf8"}


@pytest.mark.parametrize("times", [1, 3])
def test_partition_sink_is_idempotent(spark, tmp_path, times):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    for _ in range(times):
        files.write_partitioned(rows, str(tmp_path / "t"), "day")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_embedding_and_search(spark):
    import numpy as np

    from quillon.functions import models

    docs = spark.createDataFrame([(1, "the brakes failed on the truck"), (2, "weather was clear"), (3, None), (4, "truck brakes failed again")], "id long, content string")
    embedded = {r.id: r.vector for r in models.embed(docs, "content", models.HashEmbedder(32)).collect()}
    assert embedded[3] is None and np.isclose(np.linalg.norm(embedded[1]), 1)
    found = [r.id for r in models.search(docs, "brakes failed", models.HashEmbedder(256), 2).orderBy("rrf_rank").collect()]
    assert set(found) == {1, 4}
    typed = {r.id: r.document_type for r in models.classify(docs, "content").collect()}
    assert typed[1] == "other"


def test_progress_state_over_a_stream(spark, tmp_path):
    from quillon.streaming import state

    kinds = ["view", "signup", "click", "other", "purchase", "view"]
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [(i, at(i), 1, k, 0.0, "") for i, k in enumerate(kinds)] + [(9, at(0), 2, "error", 0.0, ""), (10, at(1), None, "view", 0.0, "")]
    later = [(20, at(9), 1, "click", 0.0, ""), (21, at(9), 3, "other", 0.0, "")]
    for name, part in (("a", rows), ("b", later)):
        spark.createDataFrame(part, progress.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = state.stage_progress(progress.read_events(spark, str(tmp_path / "in"), "*.parquet"))
        seen = {}
        query = stream.writeStream.outputMode("update").foreachBatch(lambda df, n, seen=seen: seen.update({r.user_id: tuple(r)[1:] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        expected = {1: ("purchase", 2, 5), 2: ("error", 0, 1), None: ("view", 0, 1)} if name == "a" else {1: ("purchase", 3, 6)}
        assert seen == expected


def test_partitions(spark):
    from quillon.operators import partitions

    ranges_ = partitions.monthly_ranges(spark, "2024-01-01", 3)
    rows = spark.createDataFrame([(1, "2024-01-31"), (2, "2024-02-01"), (3, "2023-12-31")], "id int, d string").selectExpr("id", "cast(d as date) d")
    assert {r.id: r.partition for r in partitions.assigned(rows, ranges_, "d").collect()} == {1: "p_2024_01", 2: "p_2024_02", 3: None}


def test_reconcile(spark):
    rows = [(1, 0, 5, 0.8, "a"), (1, 4, 9, 0.7, "a"), (1, 9, 12, 0.9, "b"), (1, 20, 30, 0.6, None), (1, 25, 40, 0.65, None), (2, 1, 1, 0.5, "x")]
    out = boundaries.reconcile(spark.createDataFrame(rows, "doc_id int, start int, end int, confidence double, kind string"))
    got = sorted(map(tuple, out.collect()), key=lambda r: r[:2])
    assert got == [(1, 9, 12, 0.9, "b"), (1, 25, 40, 0.65, None), (2, 1, 1, 0.5, "x")]


def test_pages_of_offsets(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0, [10, 20]), (10, [10, 20]), (11, [10, 20]), (99, [10, 20])], "o int, e array<int>")
    assert [r[0] for r in rows.select(boundaries.page_of_offset(F.col("o"), F.col("e"))).collect()] == [1, 1, 2, 2]


def test_statute_sections(spark):
    from quillon.operators import statutes

    text = "CHAPTER 768\n768.81 Comparative fault.\nSee s. 768.72 on damages.\n768.72 Pleading.\nNothing.\n"
    found = statutes.sections(spark.createDataFrame([(768, text)], "chapter int, content string"))
    rows = {r.number: (r.title, r.content) for r in found.collect()}
    assert rows == {"768.81": ("Comparative fault", "See s. 768.72 on damages."), "768.72": ("Pleading", "Nothing.")}
    assert [tuple(r) for r in statutes.reference_graph(found).collect()] == [("768.81", "768.72")]


def test_edits_fold_in_order_and_extend_the_history(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    schema = "id long, content string, user_id string, reason string, seq long"
    once = records.edit(state, spark.createDataFrame([(1, "a2", "u", "late", 2), (1, "a1", "u", "early", 1)], schema))
    rows = {r.id: r for r in once.collect()}
    assert rows[1].content == "a2" and [(h.old_content, h.new_content) for h in rows[1].history] == [("a", "a1"), ("a1", "a2")]
    assert rows[2].content == "b" and not rows[2].is_edited and rows[2].history == []
    again = records.edit(once, spark.createDataFrame([(1, "a3", "v", None, 1)], schema))
    assert [(r.content, len(r.history)) for r in again.where("id = 1").collect()] == [("a3", 3)]


def test_upserts_take_the_last_change(spark):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    changes = spark.createDataFrame([(2, "late", 5), (2, "early", 1), (3, None, 2)], "id long, x string, seq long")
    assert sorted((r.id, r.x) for r in records.upsert(state, changes, "id").collect()) == [(1, "a"), (2, "late"), (3, None)]


def test_scan_takes_any_case_and_the_first_root_alone(spark, tmp_path):
    for name in ("Smith/data/x.PDF", "Roe/y.pdf", "z.txt"):
        path = tmp_path / "data" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"text")
    rows = {r.name: (r.case_name, r.folder) for r in files.scan(spark, str(tmp_path / "data")).collect()}
    assert rows == {"x.PDF": ("Smith", "data"), "y.pdf": ("Roe", None)}


def test_median_of_a_whole_table(spark):
    for values in ([5.0], [1.0, 2.0], [3.0] * 10 + [9.0], [float(x * 7 % 101) for x in range(100)]):
        rows = spark.createDataFrame([(v,) for v in values], "v double")
        assert stats.median_of(rows, "v", cells=8).first()[0] == sorted(values)[len(values) // 2]
    assert stats.median_of(spark.createDataFrame([], "v double"), "v").count() == 0


def test_adjacent_boundaries(spark):
    rows = spark.createDataFrame([(1, 0, 4, 0.9, "memo"), (1, 3, 8, 0.8, "letter"), (1, 9, 9, 0.7, "letter"), (1, 20, 21, 0.7, "letter"), (2, 0, 5, 0.5, "other"), (2, 1, 4, 0.9, "memo")], "doc_id int, start int, end int, confidence double, kind string")
    got = sorted((r.doc_id, r.start, r.end, r.kind) for r in boundaries.reconcile_adjacent(rows).collect())
    assert got == [(1, 0, 2, "memo"), (1, 3, 9, "letter"), (1, 20, 21, "letter"), (2, 0, 5, "memo")]


def test_word_budgets_keep_their_limits(spark):
    rows = spark.createDataFrame([(1, 1, "introduction", 1.0), (1, 2, "argument", 99.0), (1, 3, "argument", 1.0)], "motion_id int, ordinal int, kind string, weight double")
    assert [r.budget for r in motions.word_budget(rows, 5000).orderBy("ordinal").collect()] == [350, 3000, 100]
