"""Structure, stored indexes, batched search, dates, entities, layouts, hierarchies, joined streams, sketches and payloads against plain versions."""

import collections
import datetime as dt
import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import dates, layouts
from quillon.operators import entities, evidence, hierarchy, postings, research, retrieval, sketches, storage, structure, vector_index
from quillon.streaming import joins, progress

# ---- structure

PIECES = ["# Title", "FACTS OF THE CASE", "A. first item", "  • dot", "1. one", "plain words go on. And on! ", "12 Foo 34", "x" * 700, "Smith v. Jones said so. ", "", "   ", "word " * 90, "Ünï cödé. ", "ORDERED", "\t", "é" * 2500]
TEXTS = st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from(["\n", "\n\n", " ", "\n \n"])), max_size=25).map(lambda xs: "".join(a + b for a, b in xs))


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_elements_are_what_the_lines_say(text):
    found = structure.elements(text)
    covered = [c for e in found for c in range(e.start, e.end)]
    assert len(covered) == len(set(covered)) and {i for i, c in enumerate(text) if not c.isspace()} <= set(covered)
    assert all(a.end <= b.start for a, b in zip(found, found[1:], strict=False))
    for e in found:
        piece = text[e.start : e.end]
        assert piece and not piece[0].isspace() and not piece[-1].isspace()
        lines = piece.split("\n")
        assert all(line.strip() for line in lines)
        if e.kind == "header":
            assert len(lines) == 1
        assert not any(structure.HEADER.fullmatch(line.rstrip()) for line in lines[1:]) and not any(structure.LIST_ITEM.match(line) for line in lines[1:])


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.sampled_from([structure.Limits(), structure.Limits(60, 15, 10, 100), structure.Limits(300, 0, 50, 400)]))
def test_chunks_cover_the_text_within_limits(text, limits):
    parts = structure.elements(text)
    for optimise in (False, True):
        chunks = structure.packed(text, parts, limits)
        chunks = structure.optimised(text, chunks, limits) if optimise else chunks
        covered = {c for a, b in chunks for c in range(a, b)}
        assert {i for i, c in enumerate(text) if not c.isspace()} <= covered
        assert all(a < c and b < d for (a, b), (c, d) in zip(chunks, chunks[1:], strict=False)) and all(a < b for a, b in chunks)
        assert all(max(0, b - c) <= limits.overlap for (_, b), (c, _) in zip(chunks, chunks[1:], strict=False))
        if optimise:
            assert all(b - a <= limits.most for a, b in chunks)


def plain_packed(parts, limits):
    """Element by element, each chunk as a list of elements."""
    chunks, now, start = [], [], None
    for p in parts:
        begin = start if now else p.start
        if now and p.end - begin > limits.target:
            chunks.append((start, now[-1].end))
            start, now = max(start + 1, now[-1].end - limits.overlap), [p]
        else:
            start, now = begin, [*now, p]
    return chunks + ([(start, now[-1].end)] if now else [])


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_packing_is_the_plain_one(text):
    parts = structure.elements(text)
    assert structure.packed(text, parts) == plain_packed(parts, structure.Limits())


def test_semantic_chunks_of_odd_rows(spark):
    texts = [None, "", " \n ", "one", "FACTS\n\n" + "He testified. " * 300 + "\n\nSmith v. Jones, 12 Foo 34.\n\ntail", "x" * 300_000]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in enumerate(texts)] + [(3, "one", None, None), (None, "nobody's", None, None)], "doc_id long, text string, kind string, chunk_index int")
    rows = structure.semantic_chunks(docs).collect()
    by_doc = collections.Counter(r.doc_id for r in rows)
    assert by_doc[3] == 2 and by_doc[None] == 1 and set(by_doc) == {3, 4, 5, None}
    assert all(r.content == texts[r.doc_id][r.start_char : r.end_char] for r in rows if r.doc_id is not None)
    assert sum(r.n_citations for r in rows if r.doc_id == 4) == len(structure.CITATION.findall(texts[4]))
    assert sum(r.n_elements for r in rows if r.doc_id == 4) == len(structure.elements(texts[4]))
    assert structure.semantic_chunks(docs.where("false")).collect() == [] and structure.structure_spans(docs.where("doc_id < 3")).collect() == []


def test_a_long_text_takes_time_by_its_length():
    text = ("A sentence of some words goes here. " * 40 + "\n\n") * 200
    took = []
    for many in (1, 4):
        began = time.perf_counter()
        structure.optimised(text * many, structure.packed(text * many, structure.elements(text * many)))
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * max(took[0], 0.01) and len(text) * 4 > 1_000_000


def test_kinds():
    kind = structure.chunk_kind
    assert [kind(t) for t in ("see 12 Foo 34", "it is ordered", "# Top", "a. item", "| a |", '"said"', "note [3]", "the plaintiff testified", "defendant will argue", "whereof", "")] == ["legal_citation", "procedural", "header", "list_item", "table", "quote", "footnote", "fact_statement", "argument", "paragraph", "paragraph"]


# ---- stored indexes


def plain_top(vectors, asked, k):
    scores = {i: sum(w * asked.get(b, 0) for b, w in v.items()) for i, v in vectors.items()}
    met = [i for i, v in vectors.items() if set(v) & set(asked)]
    return sorted(met, key=lambda i: (-round(scores[i], 9), i))[:k]


def rows_of(spark, vectors):
    return spark.createDataFrame([(i, b, w) for i, v in vectors.items() for b, w in v.items()], "id long, bucket long, weight double"), spark.createDataFrame([(i,) for i in vectors], "id long")


def test_postings_after_upserts_and_deletes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "BLOCK", 4)
    monkeypatch.setattr(postings, "LIST", 60)  # several lists a bucket
    r = random.Random(1)
    make = lambda: {r.choice([1, 2, r.randrange(40)]): r.random() + 0.01 for _ in range(r.randrange(8))}
    vectors = {i: make() for i in range(200)}
    path = str(tmp_path / "store")
    postings.write(path, 0, *rows_of(spark, vectors))
    for segment, changed in ((1, {i: make() for i in range(0, 200, 9)}), (2, {i: {} for i in range(0, 200, 13)} | {500: {1: 0.5}}), (2, {i: {} for i in range(0, 200, 13)} | {500: {1: 0.7}})):
        postings.write(path, segment, *rows_of(spark, changed))
        vectors |= changed
    for asked in ({1: 1.0}, {1: 0.2, 2: 0.9, 7: 3.0}, {b: 1.0 + b / 50 for b in range(40)}, {99: 1.0}, {1: -1.0, 2: 1.0}, {}):
        for k in (1, 5, 300):
            assert [x.id for x in postings.search(spark, path, asked, k).collect()] == plain_top(vectors, asked, k), (asked, k)
    again = {(x.id, x.bucket): x.weight for x in postings.vectors_of(spark, path).collect()}
    assert again == {(i, b): w for i, v in vectors.items() for b, w in v.items()}


def test_search_reads_asked_folders_and_winning_blocks(spark, tmp_path):
    n = 5000
    rows = spark.range(n).select(F.col("id"), F.lit(64).cast("long").alias("bucket"), ((F.col("id") + 1) / n).alias("weight")).unionByName(spark.range(n).select(F.col("id"), (F.col("id") % 50).alias("bucket"), F.lit(0.5).alias("weight")))
    path = str(tmp_path / "store")
    postings.write(path, 0, rows, spark.range(n))
    plan = postings.blocks_for(spark, path, {64: 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan.split("PartitionFilters: [")[1][:80] and "EqualTo(bucket,64)" in plan
    whole = postings.blocks_for(spark, path, {64: 1.0}).count()
    needed = {64: 1 - 21 / n}
    assert whole == math.ceil(n / postings.BLOCK) and postings.blocks_for(spark, path, {64: 1.0}, needed).count() == 1
    assert [r.id for r in postings.search(spark, path, {64: 1.0}, 20).collect()] == list(range(n - 1, n - 21, -1))


def test_vector_index_finds_nine_tenths(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    path = str(tmp_path / "v")
    vector_index.write(rows, path, vector_index.fit(rows))
    found = {(r.query_id, r.id) for r in vector_index.search(spark, path, rows, queries).collect()}
    exact = {(r.query_id, r.id) for r in retrieval.dense_join(rows, queries, 10).collect()}
    print("recall", len(found & exact) / len(exact))
    assert len(found & exact) / len(exact) >= 0.9 and len(found) == len(exact)
    stored = spark.read.parquet(f"{path}/blocks").select(F.explode("ids").alias("id"))
    assert stored.count() == rows.count() == stored.distinct().count()


def test_vector_index_of_odd_rows(spark, tmp_path):
    r = np.random.default_rng(0)
    vectors = [r.standard_normal(8).tolist() for _ in range(300)] + [[1.0] * 8] * 700 + [[0.0] * 8, None, [1.0, 2.0]]
    rows = spark.createDataFrame([(i, v, "x") for i, v in enumerate(vectors)], "id long, vector array<double>, cell string").repartition(3)
    path = str(tmp_path / "v")
    fitted = vector_index.fit(rows.where("id < 1000"), cells=20, sample=500)
    assert len(fitted.centres) <= 20 and 1 <= fitted.probes <= 20
    vector_index.write(rows.where("id < 900"), path, fitted)
    vector_index.write(rows.where("id >= 900"), path, fitted, mode="append")
    assert vector_index.fit(rows.where("false")).probes == 1
    queries = rows.where("id in (0, 7, 500)").select(F.col("id").alias("query_id"), "vector")
    found = collections.defaultdict(list)
    for x in vector_index.search(spark, path, rows.where("size(vector) = 8"), queries, 5, probes=20).orderBy("query_id", "rank").collect():
        found[x.query_id].append(x.id)
    assert found[0][0] == 0 and found[7][0] == 7 and set(found[500]) <= set(range(300, 1000)) and len(found[500]) == 5
    assert spark.read.parquet(f"{path}/blocks").select(F.explode("ids")).count() == len(vectors)
    assert vector_index.search(spark, path, rows, queries.where("false")).collect() == []


# ---- batched search


def test_batched_search_is_one_search_each(spark, monkeypatch):
    r = np.random.default_rng(3)
    stores = ["a", "b", "firm"]
    held = [(stores[min(2, int(r.integers(0, 9)) // 2)], i, r.standard_normal(6).tolist()) for i in range(200)] + [("a", 900 + i, [1.0] * 6) for i in range(4)]
    asked = [(q, s, r.standard_normal(6).tolist()) for q in range(11) for s in stores if (q + len(s)) % 3]
    points = spark.createDataFrame(held, "store string, id long, vector array<double>").repartition(4)
    rows = spark.createDataFrame(asked, "question_id long, store string, vector array<double>")
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    expected = {(q, s): [i for _, i in sorted((-round(cos(v, w), 9), i) for t, i, w in held if t == s)[:5]] for q, s, v in asked}
    for most in (4096, 4):
        monkeypatch.setattr(research, "HELD", most)
        found = collections.defaultdict(list)
        for x in research.dense(points, rows, 5).orderBy("question_id", "store", "rank").collect():
            found[x.question_id, x.store].append(x.id)
        assert found == expected
    assert research.dense(points, rows.where("false"), 5).collect() == []


def test_routes_and_fan_in(spark):
    stores = spark.createDataFrame([("s1", "smith", "case"), ("s2", "smith", "case"), ("d", "doe", "case"), ("f", None, "firm")], "store string, case_name string, kind string")
    questions = spark.createDataFrame([(1, "smith", "case"), (2, "doe", "both"), (3, "nobody", "case"), (4, None, "firm")], "question_id long, case_name string, reads string")
    got = sorted((r.question_id, r.store) for r in research.routed(questions, stores).collect())
    assert got == [(1, "s1"), (1, "s2"), (2, "d"), (2, "f"), (4, "f")]
    results = spark.createDataFrame([(1, "s1", 10, 0.5), (1, "s2", 10, 0.7), (1, "s2", 11, 0.6), (2, "f", 10, 0.1), (2, "s1", 12, 0.2)], "question_id long, store string, id long, score double")
    assert [(r.id, r.store, r["rank"]) for r in research.gathered(results).where("question_id = 1").orderBy("rank").collect()] == [(10, "s2", 1), (11, "s2", 2)]
    assert research.gathered(results, None, once=False).count() == 5 and research.gathered(results, 1).count() == 2
    assert [(r.question_id, r.id) for r in research.foreign(results, questions, stores).collect()] == [(2, 12)]
    lists = {"a": spark.createDataFrame([(1, "s", 5, 1), (1, "s", 6, 2)], "question_id long, store string, id long, rank int"), "b": spark.createDataFrame([(1, "s", 6, 1)], "question_id long, store string, id long, rank int")}
    assert [(r.id, round(r.score, 9)) for r in research.fused(lists).orderBy("rank").collect()] == [(6, round(1 / 61 + 1 / 62, 9)), (5, round(1 / 61, 9))]


def test_shared_words_are_the_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(evidence, "POINTS", 3)
    r = random.Random(0)
    words = ["common", *(f"word{i}" for i in range(12))]
    texts = [(i, " ".join(["common", *r.choices(words, k=6)]) if i % 7 else None) for i in range(60)]
    facts = spark.createDataFrame(texts, "fact_id long, content string").repartition(3)
    asked = [(i, t) for i, t in texts if i % 9 == 1]
    sets = {i: set((t or "").split()) for i, t in texts}
    for most in (None, 20):
        few = {w for w in words if most is None or sum(w in s for s in sets.values()) <= most}
        expected = {i: [(-n, j) for n, j in sorted((-len(sets[i] & s & few), j) for j, s in sets.items() if sets[i] & s & few)[:4]] for i, _ in asked}
        found = collections.defaultdict(list)
        for x in evidence.shared_words(spark.createDataFrame(asked, "point_id long, content string"), facts, 4, most_documents=most).orderBy("point_id", F.desc("shared"), "fact_id").collect():
            found[x.point_id].append((x.shared, x.fact_id))
        assert dict(found) == {i: v for i, v in expected.items() if v}


# ---- dates, entities, layouts


def test_dates(spark):
    texts = [None, "", "on 02/30/2020 and 13/01/2020 and 1/2/69 and 1-2-68, 4/5/123", "March 5 2021, MAY 32, 2020", "2020-02-29 2021-02-29", "It was in june of 1999 that. He may come. In 2001, March. Later", "From 2024-13-01"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", dates.date_references(F.col("t")).alias("r"), dates.document_date(dates.date_references(F.col("t"))).alias("d")).orderBy("id").collect()
    shown = [[(x.date_text, str(x.date) if x.date else None, x.is_approximate) for x in r.r] for r in rows]
    assert shown[0] == shown[1] == [] and rows[0].d is None
    assert shown[2] == [("02/30/2020", None, False), ("13/01/2020", "2020-01-13", False), ("1/2/69", "1969-01-02", False), ("1-2-68", "2068-01-02", False), ("4/5/123", None, False)]
    assert shown[3] == [("March 5 2021", "2021-03-05", False), ("MAY 32, 2020", None, False), ("March 5 2021, MAY 32, 2020", "2021-03-01", True)]
    assert shown[4] == [("2020-02-29", "2020-02-29", False), ("2021-02-29", None, False)]
    assert shown[5] == [("It was in june of 1999 that", "1999-06-01", True)]
    assert str(rows[2].d) == "2020-01-13" and str(rows[5].d) == "1999-06-01" and rows[6].d is None


def plain_resolved(ranked):
    kept = []
    for group in ranked:
        for e in sorted(group, key=lambda e: (e.start, -e.end)):
            if e.start < e.end and all(e.end <= k.start or k.end <= e.start for k in kept):
                kept.append(e)
    return sorted(kept, key=lambda e: e.start)


SPANS = st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 12)), max_size=8), max_size=5)


@settings(max_examples=200, deadline=None)
@given(SPANS)
def test_resolution_by_precedence(groups):
    ranked = [[entities.Entity(str(k), a, a + n) for a, n in g] for k, g in enumerate(groups)]
    assert entities.resolved(60, ranked) == plain_resolved(ranked)


def test_entities_of_a_corpus(spark):
    texts = [
        "Plaintiff Anna Alpha and Defendant BETA CORP met ACME Freight Inc. near Miami, Florida on March 3, 2020.",
        "anna said: Anna Alpha, the Plaintiff, drove a 2019 Volvo truck; 1,000 dollars, $1,000 and $1,000.00; a fracture",
        None, "", "Plaintiff PLAINTIFF 12/12/2020", "Anna  Alpha, Plaintiff",
    ]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kind string")
    found = entities.entities(docs)
    got = collections.defaultdict(list)
    for r in found.orderBy("doc_id", "start_char").collect():
        assert texts[r.doc_id][r.start_char : r.end_char] == r.entity
        got[r.doc_id].append((r.kind, r.name))
    assert got[0] == [("person", "anna alpha"), ("organization", "acme freight inc"), ("location", "miami, florida"), ("date", "march 3, 2020")]
    assert got[1] == [("person", "anna alpha"), ("vehicle", "2019 volvo truck"), ("monetary_amount", "000.00"), ("monetary_amount", "1000.00"), ("monetary_amount", "1000.00"), ("medical_condition", "fracture")]
    assert set(got) == {0, 1, 4, 5} and got[4] == [("date", "12/12/2020")]
    known = {(r.kind, r.name): tuple(r)[2:] for r in entities.registry(found).collect()}
    assert known["person", "anna alpha"] == ("Anna Alpha", 3, 2, 3)


def test_layouts(spark):
    box = "array<struct<kind:int,x0:double,y0:double,x1:double,y1:double>>"
    a, b, picture = (0, 1.9, 2.2, 11.9, 12.1), (0, 100.0, 2.0, 120.0, 9.0), (1, 5.0, 5.0, 6.0, 6.0)
    rows = spark.createDataFrame([(1, [a, b]), (2, [b, picture, a]), (3, None), (4, []), (5, [a])], f"id int, b {box}").select("id", layouts.block_hash(F.col("b")).alias("h")).collect()
    h = {r.id: r.h for r in rows}
    import hashlib

    assert h[1] == h[2] == hashlib.md5(b"100:2:20:7|1:2:10:9").hexdigest()[:8] and h[3] == h[4] == hashlib.md5(b"").hexdigest()[:8] and h[5] != h[1]
    words = spark.createDataFrame([(1, 10.0, 20.0, 14.0, 24.0), (1, 30.0, 50.5, 6.0, 14.0), (1, 5.0, 6.0, 25.0, 30.0), (2, 1.0, 2.0, 0.0, 3.0)], "page int, x0 double, x1 double, top double, bottom double")
    assert {r.page: r.layout for r in layouts.word_lines_hash(words, "page").collect()}[1] == hashlib.md5(b"|".join(sorted([b"10:10:40:9", b"5:20:1:5"]))).hexdigest()[:8]
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, None), (1, 4, None), (1, 5, "x"), (2, 1, None)], "doc_id int, page int, layout string")
    assert sorted((r.doc_id, r["run"], r.first_page, r.last_page) for r in layouts.runs(pages).collect()) == [(1, 1, 1, 2), (1, 2, 3, 4), (1, 3, 5, 5), (2, 1, 1, 1)]


# ---- hierarchies


def test_reach_is_a_walk(spark):
    r = random.Random(7)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(90)] + [(5, i) for i in range(200)] + [(3, 3), (9, None)]
    visible = [i for i in range(200) if i % 4]
    table = spark.createDataFrame(edges, "source long, target long")
    start = spark.createDataFrame([(1,), (1,), (4,), (5,)], "node long")
    shown = spark.createDataFrame([(i,) for i in visible], "node long")
    for seen in (None, shown):
        may = (lambda x: True) if seen is None else set(visible).__contains__
        for depth in (0, 1, 3, None):
            found = {x: 0 for x in (1, 4, 5) if may(x)}
            frontier, step = set(found), 0
            while frontier and (depth is None or step < depth):
                step += 1
                frontier = {b for a, b in edges if a in frontier and b is not None and may(b)} - set(found)
                found |= dict.fromkeys(frontier, step)
            assert {x.node: x.depth for x in hierarchy.reach(table, start, seen, depth).collect()} == found
    assert hierarchy.reach(table, start.where("false")).collect() == []
    cases = spark.createDataFrame([(1, 10, "x"), (2, 10, "y"), (3, 11, "x"), (4, None, None)], "case_id long, matter_id long, case_name string")
    ids = lambda df: sorted(r.case_id for r in df.collect())
    assert ids(hierarchy.scope(cases, [3, 9])) == [3] and ids(hierarchy.scope(cases, matter_ids=[10])) == [1, 2] and ids(hierarchy.scope(cases)) == []
    assert {r.case_name: r.case_id for r in hierarchy.case_named(cases, spark.createDataFrame([("x",), ("z",)], "case_name string")).collect()} == {"x": 1, "z": None}


# ---- streams and sketches


def test_joined_streams_let_late_rows_and_old_state_go(spark, tmp_path):
    at = lambda h, m=0: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h, minutes=m)
    batches = [
        [(1, at(0), 1, "view"), (2, at(0, 30), 1, "purchase"), (3, at(0), 2, "view")],
        [(10 * h + k, at(h, k), 1, kind) for h in range(5, 60) for k, kind in ((0, "view"), (2, "purchase"))],
        [(900, at(0, 40), 2, "purchase"), (901, at(59, 30), 1, "purchase"), (902, at(59, 59), 1, "purchase")],
        [(990, at(80), 1, "view")],
    ]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    sizes = []
    for rows in batches:
        spark.createDataFrame([(*x, 0.0, "") for x in rows], progress.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = progress.read_events(spark, source, "*.parquet")
        of = lambda kind, events=events: events.where(F.col("event_type") == kind)
        query = joins.followed(of("view"), of("purchase"), "1 hour", "10 minutes").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(sink)
        query.awaitTermination()
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    found = {(r.first_id, r.second_id) for r in spark.read.parquet(sink).collect()}
    everything = spark.read.schema(progress.SCHEMA).parquet(source)
    whole = joins.followed(progress.with_time(everything.where("event_type = 'view'")), progress.with_time(everything.where("event_type = 'purchase'")), "1 hour")
    expected = {(r.first_id, r.second_id) for r in whole.collect()}
    assert expected - found == {(3, 900)} and found <= expected  # the late row, and only that
    assert max(sizes) <= 8 + 2 * 55 and sizes[-1] <= 6  # what no row can match any more is gone


def test_merged_sketches_are_the_whole(spark):
    r = np.random.default_rng(2)
    rows = [(int(d), "ab"[int(d) % 2] if d % 5 else None, float(v)) for d, v in zip(r.integers(0, 30, 4000), np.exp(r.standard_normal(4000) * 3), strict=True)] + [(1, "b", 0.0), (1, "b", -3.0), (1, "b", None), (1, "b", float("nan")), (99, "b", None)]
    table = spark.createDataFrame(rows, "day int, kind string, value double").repartition(7)
    days = sketches.sketched(table, "value", "day", "kind")
    merged = {x.kind: (x.n, bytes(x.sketch)) for x in sketches.merge(days, "kind").collect()}
    whole = {x.kind: (x.n, bytes(x.sketch)) for x in sketches.sketched(table, "value", "kind").collect()}
    assert merged == whole and set(whole) == {"a", "b", None}
    for kind, (n, sketch) in whole.items():
        values = sorted(v for _, k, v in rows if k == kind and v is not None and not math.isnan(v))
        assert n == len(values)
        for q in (0, 0.1, 0.5, 0.9, 0.99, 1):
            true = values[math.floor(q * (n - 1))]
            assert sketches.quantile(sketch, q) == pytest.approx(max(true, 0), rel=sketches.ACCURACY + 1e-9)
    assert sketches.sketched(table.where("false"), "value", "day").collect() == []
    users = spark.range(20_000).select((F.col("id") % 31).alias("day"), (F.col("id") % 5000).alias("user"))
    counted = sketches.distinct_counts(sketches.distinct_sketches(users, "user", "day").withColumn("month", F.lit(1)), "month").first().n_distinct
    assert abs(counted - 5000) < 300


def test_payloads(spark):
    docs = spark.createDataFrame([("a", ["x", "y/z"], None, "replaced", dt.datetime(2024, 1, 2, 3, 4, 5, 678), ["f"]), ("b", [], "sum", None, None, None)], "id string, folder_path array<string>, summary string, status string, last_modified timestamp, key_facts array<string>")
    stored = storage.to_storage(docs)
    broken = stored.unionByName(spark.createDataFrame([("c", "no json"), ("d", None), ("e", '{"status": "odd", "document_date": "yesterday", "document_type": "memo"}')], "id string, payload string"))
    back = {r.id: r for r in storage.from_storage(broken, ["motion"]).collect()}
    assert (back["a"].folder_path, back["a"].status, back["a"].last_modified, back["a"].key_facts) == (["x", "y", "z"], "replaced", dt.datetime(2024, 1, 2, 3, 4, 5, 678), ["f"])
    assert (back["b"].folder_path, back["b"].search_text, back["b"].status, back["b"].last_modified) == ([], "sum", "active", None)
    assert [back[k].is_valid for k in "abcde"] == [True, True, False, False, True]
    assert (back["e"].status, back["e"].document_date, back["e"].document_type) == ("active", None, "other")
