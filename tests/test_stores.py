"""The store against a dictionary, and what findings and passages are read as."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import passages
from quillon.operators import motion_quality, sinks
from quillon.sources import stores

ROWS = "store string, id string, version int, content string, metadata map<string,string>"


def state(spark, path, schema):
    return {(r.store, r.id): (r.version, r.content, r.metadata) for r in stores.read(spark, path, schema).collect()}


def test_batches_in_any_order_and_deletes(spark, tmp_path, monkeypatch):
    r, path, kept = random.Random(4), str(tmp_path / "s"), {}
    empty = spark.createDataFrame([], ROWS)
    schema = stores._schema(empty)
    assert state(spark, path, schema) == {}
    batches = []
    for b in range(4):
        names = [(r.choice(["hot", "hot", "hot", "b", "c d/e"]), f"i{r.randrange(40)}") for _ in range(40)]
        batches.append([(s, i, r.randrange(5), r.choice(["x", "y", None]), {"n": str(b)}) for s, i in dict.fromkeys(names)])
    for most, rows in ((2000, batches[2]), (2000, batches[0]), (1, batches[2]), (2000, batches[1]), (2000, batches[3]), (2000, batches[0])):
        monkeypatch.setattr(stores, "NAMED", most)
        stores.upsert(path, spark.createDataFrame(rows, ROWS).repartition(2), parts=3)
        for s, i, v, c, m in rows:
            was = kept.get((s, i))
            if was is None or (v, c is not None, c or "") >= (was[0], was[1] is not None, was[1] or ""):
                kept[s, i] = (v, c, m)
        found = state(spark, path, schema)
        assert {k: v[:2] for k, v in found.items()} == {k: v[:2] for k, v in kept.items()}
    assert stores.delete(path, spark, schema, (F.col("store") == "hot") & (F.col("content") == "x")) == sum(k[0] == "hot" and v[1] == "x" for k, v in kept.items())
    kept = {k: v for k, v in kept.items() if not (k[0] == "hot" and v[1] == "x")}
    assert stores.delete(path, spark, schema, F.col("store") == "b") == sum(k[0] == "b" for k in kept)
    kept = {k: v for k, v in kept.items() if k[0] != "b"}
    assert stores.delete(path, spark, schema, F.col("store") == "b") == 0 and {k: v[:2] for k, v in state(spark, path, schema).items()} == {k: v[:2] for k, v in kept.items()}
    stores.upsert(path, spark.createDataFrame([("b", "again", 1, None, None)], ROWS), parts=3)
    assert ("b", "again") in state(spark, path, schema)
    ids = [k[1] for k in kept if k[0] == "hot"][:3]
    assert sorted(x.id for x in stores.get(spark, path, schema, "hot", [*ids, "none"], parts=3).collect()) == sorted(ids) and stores.get(spark, path, schema, "hot", [], parts=3).count() == 0
    seen, last = [], None
    rows = stores.read(spark, path, schema).where("store = 'hot'").select("id", "content")
    while page := stores.after(rows, None if last is None else F.lit(last), 7).collect():
        seen += [x.id for x in page]
        last = seen[-1]
    assert seen == sorted(k[1] for k in kept if k[0] == "hot")
    with pytest.raises(ValueError, match="need a store"):
        stores.upsert(path, spark.createDataFrame([(None, "i", 1, None, None)], ROWS))


def test_a_filter_on_stores_reads_their_folders(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(100).select(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("store"), F.col("id").cast("string").alias("id"), F.lit(1).alias("version"))
    stores.upsert(path, rows)
    plan = stores.read(spark, path, stores._schema(rows)).where("store = 's3'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "store" in plan.split("PartitionFilters: [")[1][:60]
    digests = {r.store: (r.rows, r.digest) for r in stores.exported(stores.read(spark, path, stores._schema(rows))).collect()}
    assert digests == {r.store: (r.rows, r.digest) for r in stores.exported(rows.select("version", "id", "store").select(*stores.read(spark, path, stores._schema(rows)).columns)).collect()}


def test_metadata(spark):
    row = spark.createDataFrame([({"a": None, "folder_name": "x", "b": "1"}, "n" * 70), (None, "short")], "m map<string,string>, name string")
    out = row.select(stores.with_defaults(F.col("m"), {"a": F.lit("d"), "b": F.lit("d"), "c": F.lit(3)}).alias("m"), stores.without_reserved(F.col("m")).alias("w"), stores.case_stores(F.col("name")).alias("s")).collect()
    assert out[0].m == {"a": "d", "b": "1", "c": "3", "folder_name": "x"} and out[1].m == {"a": "d", "b": "d", "c": "3"}
    assert out[0].w == {"a": None, "b": "1"} and out[1].w is None
    assert [len(x) for x in out[0].s] == [63] * 4 and out[1].s == ["short", "short_facts", "short_timeline", "short_depositions"]


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def test_passages(spark):
    c, d = F.col("c"), F.col("d")
    assert one(spark, passages.has_header(c), c="Case 1 Page 3\na\nb") and not one(spark, passages.has_header(c), c="Case 1 Page 3\na") and not one(spark, passages.has_header(c), c=None)
    assert one(spark, passages.has_footer(c), c="a\nb\nc\nd\ne\nf\nCONFIDENTIAL") and not one(spark, passages.has_footer(c), c="Page 3\n1\n2\n3\n4\n5") and not one(spark, passages.has_footer(c), c="")
    assert one(spark, passages.stitched(c, d), c="One. Two goes on", d="three") == "Two goes on three" and one(spark, passages.stitched(c, d), c=None, d="x") == "x" and one(spark, passages.stitched(c, d), c="no end", d="x") == "no end x"
    asked = one(spark, passages.questions(c), c="Q. Before any page, what was it?\nA. none\nPage 2\nQ. Too short?\nA. x\n  Q. What did you see at the corner that day?\nA. " + "long " * 200)
    assert [(a.page, a.question, len(a.answer)) for a in asked] == [(0, "Before any page, what was it?", 7), (2, "What did you see at the corner that day?", 500)]
    assert one(spark, passages.questions(c), c=None) is None and one(spark, passages.questions(c), c="") == []
    assert tuple(one(spark, passages.deposition_metadata(c), c="x" * 2000 + "DEPOSITION OF A B\nPage 7")) == (None, None, 7) and tuple(one(spark, passages.deposition_metadata(c), c="")) == (None, None, None)
    assert one(spark, passages.exhibit_kind(c), c=None) == "document" and one(spark, passages.exhibit_kind(c), c="letter about a photo") == "photograph"
    assert one(spark, passages.exhibit_description(c, d), c="Exhibit A.1+: a long description here. x", d="A.1+") == "a long description here" and one(spark, passages.exhibit_description(c, d), c="Exhibit B: short", d="B") == "Exhibit B"
    cites = one(spark, passages.typed_citations(c), c="Aa Bb Cc Dd Ee Ff Gg Hh v. X, 1 U.S. 2; 5 U.S.C. § 6(a)(1), " + "word " * 30_000)
    assert [(x.citation, x.case_name, x.kind) for x in cites] == [("Cc Dd Ee Ff Gg Hh v. X, 1 U.S. 2", "Cc Dd Ee Ff Gg Hh v. X", "case"), ("5 U.S.C. § 6(a)(1)", None, "statute")]
    assert one(spark, passages.kind_of(c, d), c=None, d="x" * 1000 + "motion for") == "other"


def test_essentials_of_odd_items(spark):
    kind = "array<struct<type:string,label:string,value:string,items:array<string>>>"
    items = [
        ("field", "Summary", "s1", None), ("list", "AUTHORITIES on facts", None, list("abcdefg")), ("list", "facts", None, None), ("list", "Fact list", None, ["f"] * 9), ("field", "Theme", 'Option 1 no colon || Option 2: x', None),
        ("field", "Label", '"' + "v" * 400 + '"', None), ("list", None, None, ["p" * 300, "q", "r", "s"]), ("field", "Summary", "s2", None), ("other", "x", "y", None),
    ]
    rows = spark.createDataFrame([(1, items), (2, []), (3, None)], f"id int, i {kind}").select("id", passages.essential_content(F.col("i")).alias("e")).orderBy("id").collect()
    e = rows[0].e
    assert e.key_points == ["s2", "s1", "Label: " + "v" * 300, "p" * 200, "q", "r"]
    assert (e.authorities, e.facts, e.themes) == (list("abcde"), ["f"] * 5, ["Option 1 no colon"])
    assert tuple(rows[1].e) == ([], [], [], []) and tuple(rows[2].e) == (None, None, None, None)


def test_metrics_of_motions_without_parts(spark):
    sections = spark.createDataFrame([(1, 1, "introduction", 10), (1, 2, "argument", 80), (1, 3, "conclusion", 10), (2, 1, "argument", 0), (3, 1, "facts", 0)], "motion_id int, ordinal int, kind string, words long")
    cites = spark.createDataFrame([(1, 2, "deposition", 3, None, None, None), (1, 2, "case_law", None, None, None, None), (1, 1, "exhibit", None, None, "A", None)], "motion_id int, ordinal int, kind string, page int, line int, exhibit string, date string")
    got = {r.motion_id: r for r in motion_quality.quality_metrics(sections, cites).collect()}
    assert (got[1].density, got[1].specificity, got[1].strength) == (2.5, 0.5, round(1 / 3, 6))
    assert got[1].coherence == pytest.approx((1.0 + 0.5 + 2.5 / 3 + 1 / 3) / 4, abs=1e-6)
    assert (got[2].coherence, got[3].coherence) == (0.0, 0.7)


def test_rows_of_findings(spark):
    facts = spark.createDataFrame([(1, "x", ["2020-01-01"], {"k": "v"}), (2, None, None, None)], "fact_id int, content string, dates array<string>, entities map<string,string>")
    assert [tuple(r) for r in sinks.fact_rows(facts).orderBy("fact_id").collect()] == [(1, "x", True, "2020-01-01", '{"k":"v"}'), (2, None, False, None, None)]
    events = spark.createDataFrame([(1, 2, dt.date(2020, 1, 2), "b"), (1, 1, None, "a")], "case_id int, event_id int, day date, description string")
    assert [(r.event_index, r.narrative) for r in sinks.timeline_rows(events).orderBy("event_index").collect()] == [(0, "a"), (1, "On January 02, 2020: b")]
    docs = spark.createDataFrame([(1, "t", None, ["", "f"]), (2, None, None, None)], "document_id int, title string, description string, key_facts array<string>")
    assert [r.embed_text for r in sinks.document_rows(docs).orderBy("document_id").collect()] == ["t\nf", ""]
