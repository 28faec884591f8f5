"""Queries over what is stored and structured: chunks that follow a text's structure, indexes, batched search, dates, entities, layouts, hierarchies, joined streams, sketches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import dates, layouts
from quillon.operators import entities, hierarchy, postings, research, retrieval, sketches, storage, structure, vector_index
from quillon.plans.catalog import SPARSE_SQL, SPARSE_TOP, corpus, points, query, table
from quillon.plans.casework import PAGES_SQL, pick, production_pages
from quillon.sources.shared import kept, new_folder
from quillon.streaming import joins, progress, state

# ---- structure and chunks

LINES_SQL = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l),
k AS (SELECT *, length(line) - length(ltrim(line, E' \t\r\f\x0b')) AS pad, length(rtrim(line, E' \t\r\f\x0b')) AS stop, CASE WHEN trim(line, E' \t\r\f\x0b') = '' THEN '' WHEN regexp_full_match(rtrim(line, E' \t\r\f\x0b'), '#+\s+.*|[A-Z][A-Z\s]+') THEN 'header'
  WHEN regexp_matches(line, '^(?:\s*[\p{L}\p{N}_]\.\s+|\s*[•\-*]\s+)') THEN 'list_item' ELSE 'paragraph' END AS kind FROM o),
f AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY n) AS was FROM k),
s AS (SELECT *, sum(CASE WHEN kind <> '' AND (kind IN ('header', 'list_item') OR was IS NULL OR was IN ('', 'header')) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS part FROM f)"""


@query(f"""WITH {LINES_SQL} SELECT doc_id, arg_min(kind, n) AS kind, CAST(min(pos + pad) AS BIGINT) AS start_char, CAST(max(pos + stop) AS BIGINT) AS end_char FROM s WHERE kind <> '' GROUP BY doc_id, part""")
def structure_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, list items and paragraphs of every text with their places."""
    found = structure.structure_spans(table(spark, sf_dir, "documents"))
    return found.where("kind <> 'citation'").select("doc_id", "kind", "start_char", "end_char")


@query(rf"WITH {PAGES_SQL} SELECT doc_id * 1000 + page AS doc_id, unnest(regexp_extract_all(text, '\b[0-9]+\s+\w+\.?\s+[0-9]+')) AS citation FROM pg")
def citation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads like volume and page in the pages of productions."""
    pages = production_pages(spark, sf_dir).select((F.col("doc_id") * 1000 + F.col("page")).alias("doc_id"), "text")
    return structure.citations(pages).select("doc_id", F.col("content").alias("citation"))


@query()
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.semantic_chunks(table(spark, sf_dir, "documents"))


@query()
def semantic_chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What boundary optimisation changes: chunks by kind before and after, and their sizes."""
    docs = table(spark, sf_dir, "documents")
    out = None
    for name, optimise in (("packed", False), ("optimised", True)):
        chunks = structure.semantic_chunks(docs, optimise=optimise).select("kind", F.length("content").alias("n"))
        one = chunks.groupBy(F.lit(name).alias("step"), "kind").agg(F.count(F.lit(1)).alias("chunks"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))
        out = one if out is None else out.unionByName(one)
    return out


# ---- stored indexes


def _store(spark: SparkSession, docs: DataFrame, segment: int = 0, path: str | None = None) -> str:
    path = path or new_folder(spark, "postings")
    postings.write(path, segment, kept(retrieval.sparse_vectors(docs), "vectors"), docs.select("id"))
    return path


def _asked(docs: DataFrame) -> dict[int, float]:
    return {r.bucket: r.weight for r in retrieval.sparse_vectors(docs).collect()}  # one text's


@query(f"{SPARSE_SQL}, {SPARSE_TOP} SELECT id, round(score, 6) AS score FROM top")
def postings_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of sparse_topk from the stored index."""
    docs = corpus(spark, sf_dir)
    found = postings.search(spark, _store(spark, docs), _asked(docs.where("id = 1")))
    return found.select("id", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN coalesce((SELECT any_value(text) FROM documents AS o WHERE o.doc_id = d.doc_id - 6), '') ELSE text END AS text FROM documents d WHERE doc_id % 10 <> 3),
"""
    + SPARSE_SQL.removeprefix("WITH ").replace("FROM documents)", "FROM t)").replace("FROM tok GROUP BY ALL), b", "FROM tok GROUP BY ALL), b")
    + ", "
    + SPARSE_TOP
    + " SELECT id, round(score, 6) AS score FROM top")
def postings_after_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents deleted and a tenth given another's text, in segments of their own, one of them sent twice."""
    docs = corpus(spark, sf_dir)
    path = _store(spark, docs)
    gone = docs.where("id % 10 = 3")
    postings.write(path, 1, retrieval.sparse_vectors(docs.where("false")), gone.select("id"))
    others = docs.where("id % 10 = 1").groupBy((F.col("id") + 6).alias("id")).agg(F.first("content").alias("content"))
    changed = docs.where("id % 10 = 7").select("id").join(others, "id", "left")
    for _ in range(2):
        _store(spark, changed, 2, path)
    found = postings.search(spark, path, _asked(docs.where("id = 1")))
    return found.select("id", F.round("score", 6).alias("score"))


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's ten nearest by the approximate index; recall is measured in the tests."""
    rows = points(spark, sf_dir)
    path = new_folder(spark, "vectors")
    vector_index.write(rows, path, vector_index.fit(rows))
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return vector_index.search(spark, path, rows, asked).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


# ---- batched search

READS = ["case", "firm", "both"]
STORES_SQL = """st AS (SELECT DISTINCT CASE WHEN label % 4 = 0 THEN 'firm' ELSE 'case_' || (label % 4) END AS store, CASE WHEN label % 4 = 0 THEN 'firm' ELSE 'case' END AS kind FROM embeddings),
qs AS (SELECT vec_id AS question_id, embedding, 'case_' || (1 + (vec_id // 100) % 3) AS case_name, ['case', 'firm', 'both'][CAST((vec_id // 100) % 3 AS INTEGER) + 1] AS reads FROM embeddings WHERE vec_id % 100 = 0),
ask AS (SELECT question_id, embedding, store FROM qs, st WHERE (reads IN ('case', 'both') AND kind = 'case' AND store = case_name) OR (reads IN ('firm', 'both') AND kind = 'firm')),
pt AS (SELECT vec_id AS id, embedding, CASE WHEN label % 4 = 0 THEN 'firm' ELSE 'case_' || (label % 4) END AS store FROM embeddings),
de AS (SELECT question_id, ask.store, id, row_number() OVER (PARTITION BY question_id, ask.store ORDER BY round(list_cosine_similarity(CAST(pt.embedding AS DOUBLE[]), CAST(ask.embedding AS DOUBLE[])), 9) DESC, id) AS rank FROM ask JOIN pt USING (store) QUALIFY rank <= 20),
sq AS (SELECT question_id, ask.store, bucket, weight FROM ask JOIN sparse ON sparse.id = question_id),
sp AS (SELECT question_id, sq.store, p.id, row_number() OVER (PARTITION BY question_id, sq.store ORDER BY round(sum(p.weight * sq.weight), 9) DESC, p.id) AS rank FROM sq JOIN (SELECT sparse.*, store FROM sparse JOIN pt USING (id)) p ON p.store = sq.store AND p.bucket = sq.bucket GROUP BY question_id, sq.store, p.id QUALIFY rank <= 20),
fu AS (SELECT question_id, store, id, CAST(sum(1.0::DOUBLE / (60 + rank)) AS DOUBLE) AS score FROM (SELECT * FROM de UNION ALL SELECT * FROM sp) GROUP BY question_id, store, id QUALIFY row_number() OVER (PARTITION BY question_id, store ORDER BY round(CAST(sum(1.0::DOUBLE / (60 + rank)) AS DOUBLE), 9) DESC, id) <= 3)"""


def _searched(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Results of all questions over all stores, the questions, and the stores: vectors and texts are paired by id, a label is a store."""
    store = F.when(F.col("label") % 4 == 0, "firm").otherwise(F.concat(F.lit("case_"), (F.col("label") % 4).cast("string")))
    held = points(spark, sf_dir).withColumn("store", store)
    stores = held.select("store", F.col("store").alias("case_name"), F.when(F.col("store") == "firm", "firm").otherwise("case").alias("kind")).distinct()
    hundred = F.floor(F.col("id") / 100)
    questions = held.where("id % 100 = 0").select(F.col("id").alias("question_id"), "vector", F.concat(F.lit("case_"), (1 + hundred % 3).cast("string")).alias("case_name"), F.element_at(F.array(*(F.lit(r) for r in READS)), (hundred % 3 + 1).cast("int")).alias("reads"))
    asked = kept(research.routed(questions, stores), "asked")
    texts = corpus(spark, sf_dir)
    stored = retrieval.sparse_lists(texts.join(held.select("id", "store"), "id").select("id", "store", "content"))
    words = retrieval.sparse_vectors(texts.join(asked.select(F.col("question_id").alias("id")), "id", "left_semi")).withColumnRenamed("id", "question_id")
    asked_words = asked.select("question_id", "store").join(words, "question_id")
    lists = {"dense": research.dense(held, asked), "sparse": research.sparse(stored, asked_words)}
    return research.fused(lists), questions, stores


@query(f"{SPARSE_SQL}, {STORES_SQL} SELECT question_id, store, id, round(score, 9) AS score, row_number() OVER (PARTITION BY question_id, store ORDER BY round(score, 9) DESC, id) AS rank FROM fu")
def batched_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three results for each question and each store that it may ask, in one plan."""
    return _searched(spark, sf_dir)[0].select("question_id", "store", "id", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"{SPARSE_SQL}, {STORES_SQL}, one AS (SELECT * FROM fu QUALIFY row_number() OVER (PARTITION BY question_id, id ORDER BY round(score, 9) DESC, store) = 1) SELECT question_id, store, id, substring(d.text, 1, 1000) AS content, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id, store) AS rank FROM one LEFT JOIN documents d ON d.doc_id = one.id QUALIFY rank <= 4".replace("one AS (SELECT *", "best AS (SELECT *").replace("FROM one LEFT", "FROM best LEFT").replace("= one.id", "= best.id"))
def research_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's best results over its stores, each document once, with the beginning of its text."""
    results, _, _ = _searched(spark, sf_dir)
    best = research.gathered(results, 4)
    return research.with_content(best, corpus(spark, sf_dir)).select("question_id", "store", "id", "content", F.col("rank").cast("long").alias("rank"))


@query(f"{SPARSE_SQL}, {STORES_SQL} SELECT CAST(count(*) AS BIGINT) AS results, CAST(count(DISTINCT question_id) AS BIGINT) AS questions, CAST(count(*) FILTER (store <> 'firm' AND store <> case_name) AS BIGINT) AS foreign_rows FROM fu JOIN qs USING (question_id)")
def research_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many results there are, and how many come from another case's store."""
    results, questions, stores = _searched(spark, sf_dir)
    results = kept(results, "results")
    foreign = research.foreign(results, questions, stores).count()
    return results.agg(F.count(F.lit(1)).alias("results"), F.count_distinct("question_id").alias("questions")).withColumn("foreign_rows", F.lit(foreign).cast("long"))


# ---- dates, entities, layouts

DATED = ["filed {mdy}", "heard on {written} at noon", "stamped {iso}", "due {bad}", "In {month} of {year} it began. Nothing else", "filed {mdy} and heard on {written}"]


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    shown = {"mdy": F.date_format(day, "MM/dd/yyyy"), "written": F.date_format(day, "MMMM d, yyyy"), "iso": F.date_format(day, "yyyy-MM-dd"), "bad": F.concat(F.lit("02/30/"), F.date_format(day, "yyyy")), "month": F.date_format(day, "MMMM"), "year": F.date_format(day, "yyyy")}
    texts = []
    for t in DATED:
        out = F.lit(t)
        for name, value in shown.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        texts.append(out)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*texts), (F.col("o_orderkey") % len(DATED) + 1).cast("int")).alias("content"))


DATED_SQL = """d AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_orderdate AS day, strftime(o_orderdate, '%m/%d/%Y') AS mdy, strftime(o_orderdate, '%B %-d, %Y') AS written, strftime(o_orderdate, '%Y-%m-%d') AS iso, '02/30/' || strftime(o_orderdate, '%Y') AS bad FROM orders),
r AS (SELECT id, 'numeric' AS form, mdy AS date_text, CAST(day AS DATE) AS date, false AS is_approximate, 0.9 AS confidence FROM d WHERE k IN (0, 5) UNION ALL SELECT id, 'written', written, CAST(day AS DATE), false, 0.9 FROM d WHERE k IN (1, 5)
UNION ALL SELECT id, 'iso', iso, CAST(day AS DATE), false, 0.9 FROM d WHERE k = 2 UNION ALL SELECT id, 'numeric', bad, NULL, false, 0.9 FROM d WHERE k = 3
UNION ALL SELECT id, 'sentence', CASE k WHEN 1 THEN 'heard on ' || written || ' at noon' WHEN 4 THEN 'In ' || strftime(day, '%B') || ' of ' || strftime(day, '%Y') || ' it began' ELSE 'filed ' || mdy || ' and heard on ' || written END, CAST(date_trunc('month', day) AS DATE), true, 0.7 FROM d WHERE k IN (1, 4, 5))"""


@query(f"WITH {DATED_SQL} SELECT id, form, date_text, strftime(date, '%Y-%m-%d') AS date, is_approximate, CAST(confidence AS DOUBLE) AS confidence FROM r")
def date_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date that a text names, in all its forms; what the calendar doesn't have is null."""
    found = _dated(spark, sf_dir).select("id", F.explode(dates.date_references(F.col("content"))).alias("r"))
    return found.select("id", "r.form", "r.date_text", F.date_format("r.date", "yyyy-MM-dd").alias("date"), "r.is_approximate", "r.confidence")


@query(f"WITH {DATED_SQL} SELECT d.id, strftime(coalesce(min(date) FILTER (NOT is_approximate), min(date)), '%Y-%m-%d') AS document_date FROM d LEFT JOIN r USING (id) GROUP BY d.id")
def document_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = _dated(spark, sf_dir).select("id", dates.document_date(dates.date_references(F.col("content"))).alias("date"))
    return dated.select("id", F.date_format("date", "yyyy-MM-dd").alias("document_date"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of orders: a party named after its customer's segment, a date, an amount, a vehicle and what happened."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    name = F.concat(F.initcap(F.lower("c_mktsegment")), F.lit(" "), F.element_at(F.array(*(F.lit(x) for x in ("Smith", "Doe", "Garcia"))), (F.col("c_custkey") % 3 + 1).cast("int")))
    role = pick("o_orderkey", ["Plaintiff", "Defendant"])
    happened = pick("o_orderkey", ["an injury", "a fracture after surgery", "a trailer swerved near Miami, Florida", "ACME Freight Inc. paid"])
    text = F.concat(role, F.lit(" "), name, F.lit(" says that on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" a 2019 Volvo truck lost $"), F.floor("o_totalprice").cast("long").cast("string"), F.lit(": "), happened, F.lit("."))
    return joined.select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


STATED_SQL = """p AS (SELECT o_orderkey AS doc_id, upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2)) AS segment, ['Smith', 'Doe', 'Garcia'][CAST(c_custkey % 3 AS INTEGER) + 1] AS family, o_orderdate AS day, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price, o_orderkey % 4 AS k FROM orders JOIN customer ON c_custkey = o_custkey),
e AS (SELECT doc_id, 'person' AS kind, segment || ' ' || family AS entity FROM p UNION ALL SELECT doc_id, 'date', strftime(day, '%B %-d, %Y') FROM p UNION ALL SELECT doc_id, 'vehicle', '2019 Volvo truck' FROM p UNION ALL SELECT doc_id, 'monetary_amount', '$' || price FROM p
UNION ALL SELECT doc_id, 'medical_condition', unnest(CASE k WHEN 0 THEN ['injury'] WHEN 1 THEN ['fracture', 'surgery'] ELSE [] END) FROM p UNION ALL SELECT doc_id, 'vehicle', 'trailer' FROM p WHERE k = 2 UNION ALL SELECT doc_id, 'location', 'Miami, Florida' FROM p WHERE k = 2 UNION ALL SELECT doc_id, 'organization', 'ACME Freight Inc.' FROM p WHERE k = 3)"""


@query(f"WITH {STATED_SQL} SELECT doc_id, kind, entity FROM e")
def fact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.entities(_statements(spark, sf_dir)).select("doc_id", "kind", "entity")


@query(f"WITH {STATED_SQL} SELECT kind, CASE WHEN kind = 'monetary_amount' THEN entity[2:] || '.00' ELSE rtrim(lower(entity), '.') END AS name, min(entity) AS shown, count(*) AS mentions, count(DISTINCT doc_id) AS documents, count(DISTINCT entity) AS spellings FROM e GROUP BY 1, 2")
def entity_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity of the corpus once, with how often and where it stands."""
    return entities.registry(entities.entities(_statements(spark, sf_dir)))


@query("""WITH b AS (SELECT page_id, unnest(list_filter(list_transform(string_split(html, '<'), lambda t, i: CASE WHEN i % 3 <> 0 THEN ((i * 7) % 50) || ':' || (i * 12) || ':' || length(t) || ':12' END), lambda x: x IS NOT NULL)) AS box FROM pages)
SELECT p.page_id, substring(md5(coalesce(string_agg(box, '|' ORDER BY box), '')), 1, 8) AS layout FROM pages p LEFT JOIN b USING (page_id) GROUP BY p.page_id""")
def block_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of boxes that are made of a page's tags: every third is a picture, the others are text."""
    parts = F.split("html", "<", -1)

    def box(t: F.Column, i: F.Column) -> F.Column:
        x, y = ((i + 1) * 7 % 50).cast("double"), ((i + 1) * 12).cast("double")
        return F.struct(F.when((i + 1) % 3 == 0, 1).otherwise(0).alias("kind"), (x + 0.25).alias("x0"), (y + 0.5).alias("y0"), (x + 0.25 + F.length(t)).alias("x1"), (y + 12.5).alias("y1"))

    return table(spark, sf_dir, "pages").select("page_id", layouts.block_hash(F.transform(parts, box)).alias("layout"))


@query("""WITH w AS (SELECT o_orderkey, l_linenumber, CAST(l_linenumber * 7.5 + l_suppkey % 5 AS DOUBLE) AS top, CAST(l_partkey % 300 AS DOUBLE) AS x0, CAST(l_partkey % 300 + l_quantity AS DOUBLE) AS x1, CAST(8 + l_linenumber % 4 AS DOUBLE) AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
b AS (SELECT o_orderkey, CAST(round_even(top / 10, 0) * 10 AS BIGINT) AS line, min(x0) AS x0, max(x1) AS x1, avg(h) AS h FROM w GROUP BY 1, 2)
SELECT o_orderkey AS page_id, substring(md5(string_agg(CAST(floor(x0) AS BIGINT) || ':' || line || ':' || CAST(floor(x1 - x0) AS BIGINT) || ':' || CAST(floor(h) AS BIGINT), '|' ORDER BY CAST(floor(x0) AS BIGINT) || ':' || line || ':' || CAST(floor(x1 - x0) AS BIGINT) || ':' || CAST(floor(h) AS BIGINT))), 1, 8) AS layout FROM b GROUP BY 1""")
def word_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of lines of words: an order's rows are the words of a page."""
    rows = table(spark, sf_dir, "lineitem")
    top, x0 = F.col("l_linenumber") * F.lit(7.5) + F.col("l_suppkey") % 5, (F.col("l_partkey") % 300).cast("double")
    words = rows.select(F.col("l_orderkey").alias("page_id"), top.alias("top"), (top + 8 + F.col("l_linenumber") % 4).alias("bottom"), x0.alias("x0"), (x0 + F.col("l_quantity").cast("double")).alias("x1"))
    return layouts.word_lines_hash(words, "page_id")


@query("""WITH pg AS (SELECT doc_id, k + 1 AS page, substring(text, CAST(k * 500 + 1 AS BIGINT), 500) AS text FROM (SELECT doc_id, text, CAST(unnest(range(0, CAST(ceil(length(text) / 500.0) AS BIGINT))) AS INTEGER) AS k FROM documents)),
h AS (SELECT doc_id, page, substring(md5(coalesce(array_to_string(list_sort(list_filter(list_transform(string_split(text, chr(10))[1:20], lambda l, i: CASE WHEN trim(l) <> '' THEN '0:' || ((i - 1) * 20) || ':' || (length(l) * 10) || ':12' END), lambda x: x IS NOT NULL)), '|'), '')), 1, 8) AS layout FROM pg),
c AS (SELECT *, sum(CASE WHEN layout IS DISTINCT FROM was OR page = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM (SELECT *, lag(layout) OVER (PARTITION BY doc_id ORDER BY page) AS was FROM h))
SELECT doc_id, CAST(run AS BIGINT) AS run, min(page) AS first_page, max(page) AS last_page, count(*) AS n_pages, any_value(layout) AS layout FROM c GROUP BY doc_id, run""")
def layout_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of pages of one layout in each document."""
    from quillon.operators import chunking

    pages = chunking.fixed_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), 500)
    return layouts.runs(pages.select("doc_id", "page", layouts.text_hash(F.col("text")).alias("layout")))


# ---- hierarchies

EDGES_SQL = """ed AS (SELECT DISTINCT source, target FROM (SELECT l_orderkey AS source, lead(l_orderkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS target FROM lineitem) WHERE target IS NOT NULL AND source <> target),
vis AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey % 5 <= 2), st AS (SELECT o_orderkey AS node FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (3, 8) AND o_orderkey % 5 <= 2)"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is related to the next one of the same part."""
    nxt = F.lead("l_orderkey").over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), nxt.alias("target")).where("target is not null")


def _hierarchy(spark: SparkSession, sf_dir: str, depth: int | None, **asked: list) -> DataFrame:
    """Nations are matters, customers cases, orders documents; the level of an order is its number modulo five."""
    orders = table(spark, sf_dir, "orders")
    junctions = orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("document_id"))
    cases = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("matter_id"))
    documents = orders.select(F.col("o_orderkey").alias("document_id"), (F.col("o_orderkey") % 5).alias("level"))
    return hierarchy.search(junctions, cases, documents, _relations(spark, sf_dir), F.col("level") <= 2, depth=depth, **asked)


@query(f"WITH RECURSIVE {EDGES_SQL}, re AS (SELECT node, 0 AS depth FROM st UNION SELECT target, depth + 1 FROM re JOIN ed ON source = node JOIN vis ON vis.node = target WHERE depth < 2) SELECT node AS document_id, CAST(min(depth) AS INTEGER) AS depth FROM re GROUP BY node")
def hierarchical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two matters and what their relations reach in two steps, of those that the reader may see."""
    return _hierarchy(spark, sf_dir, 2, matter_ids=[3, 8])


@query(f"WITH RECURSIVE {EDGES_SQL}, one AS (SELECT o_orderkey AS node FROM orders WHERE o_custkey IN (1, 2, 4) AND o_orderkey % 5 <= 2), re AS (SELECT node FROM one UNION SELECT target FROM re JOIN ed ON source = node JOIN vis ON vis.node = target) SELECT node AS document_id FROM re")
def relation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that relations reach from the documents of three cases."""
    return _hierarchy(spark, sf_dir, None, case_ids=[1, 2, 4]).select("document_id")


SEGMENTS_SQL = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2), sg AS (SELECT l_orderkey AS production_id, l_linenumber AS segment_id, ['motion', 'deposition', NULL][CAST(l_partkey % 3 AS INTEGER) + 1] AS document_type, l_linenumber * 10 AS start_page, l_linenumber * 10 + CAST(l_quantity AS BIGINT) AS end_page, CASE WHEN l_partkey % 2 = 0 THEN l_suppkey % 2 END AS part_of, CAST(l_discount AS DOUBLE) AS confidence, substring(sha256(l_orderkey || '|' || l_linenumber), 1, 32) AS document_id FROM li)"


def _normalised(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.min(c).alias(c) for c in ("l_partkey", "l_suppkey")), *(F.max(c).alias(c) for c in ("l_quantity", "l_discount")))
    segments = rows.select(
        F.col("l_orderkey").alias("production_id"), F.col("l_linenumber").alias("segment_id"), F.when(F.col("l_partkey") % 3 == 0, "motion").when(F.col("l_partkey") % 3 == 1, "deposition").alias("document_type"), (F.col("l_linenumber") * 10).alias("start_page"),
        (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("long")).alias("end_page"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 2).alias("part_of"), F.col("l_discount").cast("double").alias("confidence"),
    )
    return hierarchy.normalised(segments, F.col("production_id") % 7)


@query(f"WITH {SEGMENTS_SQL} SELECT document_id, production_id % 7 AS case_id, coalesce(document_type, 'other') AS document_type, end_page - start_page + 1 AS n_pages FROM sg")
def normalised_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _normalised(spark, sf_dir)
    return made["documents"].join(made["junctions"], "document_id").select("document_id", "case_id", "document_type", "n_pages")


@query(f"WITH {SEGMENTS_SQL}, nx AS (SELECT document_id AS source, lead(document_id) OVER w AS target, least(confidence, lead(confidence) OVER w) AS confidence FROM sg WHERE part_of IS NOT NULL WINDOW w AS (PARTITION BY production_id, part_of ORDER BY start_page, document_id)) SELECT * FROM nx WHERE target IS NOT NULL")
def discovery_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _normalised(spark, sf_dir)["relations"]


@query("SELECT c_name AS case_name, c_custkey AS case_id FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_name || ' of none', NULL FROM customer WHERE c_custkey % 10 = 1")
def cases_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    asked = customers.where("c_custkey % 10 = 0").select(F.col("c_name").alias("case_name")).unionByName(customers.where("c_custkey % 10 = 1").select(F.concat("c_name", F.lit(" of none")).alias("case_name")))
    return hierarchy.case_named(customers.select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("case_name")), asked)


# ---- streams and sketches


@query("SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'view' AND b.event_type = 'purchase'")
def views_followed_by_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of views joined with a stream of purchases by the same user within six hours, brought up to date once and read back."""
    events = progress.read_events(spark, sf_dir)
    of = lambda kind: events.where(F.col("event_type") == kind)
    joined = joins.followed(of("view"), of("purchase"), "6 hours", "1 hour").select("user_id", "first_id", "second_id")
    sink = new_folder(spark, "followed")
    progress.run_once(joined, sink, new_folder(spark, "followed-state"))
    return spark.read.schema("user_id long, first_id long, second_id long").parquet(sink)


@query("""WITH s AS (SELECT user_id, ts, event_id, list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) AS stage FROM events),
m AS (SELECT user_id, stage, max(stage) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS reached FROM s WHERE stage > 0)
SELECT user_id, ['view', 'click', 'signup', 'purchase', 'error'][max(stage)] AS furthest, count(*) FILTER (stage < reached) AS steps_back, count(*) AS n FROM m GROUP BY user_id""")
def stage_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's furthest stage from keyed state of the stream of events; the last row that a user's state gave."""
    sink, at = new_folder(spark, "stages"), new_folder(spark, "stages-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a trigger that is run again takes its own place

    stream = state.stage_progress(progress.read_events(spark, sf_dir))
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{state.OUTPUT}, batch long").option("basePath", sink).parquet(sink)
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("furthest", "steps_back", "n"), "batch").alias("r"))
    return last.select("user_id", "r.furthest", "r.steps_back", "r.n")


QUANTILES_SQL = """b AS (SELECT strftime(ts, '%Y-%m') AS month, event_type, CASE WHEN value < 1e-9 THEN NULL ELSE ceil(ln(value) / ln(1.01 / 0.99)) END AS bucket, count(*) OVER (PARTITION BY strftime(ts, '%Y-%m'), event_type) AS n,
row_number() OVER (PARTITION BY strftime(ts, '%Y-%m'), event_type ORDER BY value) AS k FROM events WHERE value IS NOT NULL)"""
_AT = "round(coalesce(max(CASE WHEN k - 1 = floor({q} * (n - 1)) THEN coalesce(2 * pow(1.01 / 0.99, bucket) / (1.01 / 0.99 + 1), 0) END), 0), 6) AS {name}"


@query(f"WITH {QUANTILES_SQL} SELECT month, event_type, CAST(max(n) AS BIGINT) AS n, {_AT.format(q=0.5, name='median')}, {_AT.format(q=0.95, name='p95')} FROM b GROUP BY month, event_type")
def monthly_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a month from the sketches of its days, which are stored and merged."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    days = kept(sketches.sketched(rows, "value", "day", "event_type"), "day-sketches")
    months = sketches.merge(days.withColumn("month", F.substring("day", 1, 7)), "month", "event_type")
    return sketches.read(months, {"median": 0.5, "p95": 0.95}).select("month", "event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@query()
def monthly_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About how many users a month had, from stored sketches of days."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "user_id")
    days = kept(sketches.distinct_sketches(rows, "user_id", "day"), "day-users")
    return sketches.distinct_counts(days.withColumn("month", F.substring("day", 1, 7)), "month")


# ---- stored documents


@query("""SELECT CAST(doc_id AS VARCHAR) AS id, lang AS case_name, sha256(text) AS document_hash, n_chars AS file_size, CASE WHEN doc_id % 3 = 0 THEN 'motion' ELSE 'deposition' END AS document_type, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * doc_id, '%Y-%m-%dT%H:%M:%S') AS first_seen_at,
source || '>' || lang AS path, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 40) ELSE '' END AS search_text, 'active' AS status, true AS is_valid FROM documents""")
def storage_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as payloads and read back."""
    docs = table(spark, sf_dir, "documents")
    seen = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("doc_id"))
    given = docs.select(
        F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("case_name"), F.sha2("text", 256).alias("document_hash"), F.col("n_chars").alias("file_size"), F.when(F.col("doc_id") % 3 == 0, "motion").otherwise("deposition").alias("document_type"),
        seen.alias("first_seen_at"), F.array("source", "lang").alias("folder_path"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 40)).alias("summary"),
    )
    back = storage.from_storage(kept(storage.to_storage(given), "payloads"), ["motion", "deposition"])
    return back.select("id", "case_name", "document_hash", "file_size", "document_type", F.date_format("first_seen_at", "yyyy-MM-dd'T'HH:mm:ss").alias("first_seen_at"), F.array_join("folder_path", ">").alias("path"), "search_text", "status", "is_valid")
