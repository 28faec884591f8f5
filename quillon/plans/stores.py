"""Queries over stores: batches that are written, sent again, deleted and read back, and what each kind of finding is stored as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import hashing
from quillon.operators import chunking, dedup, retrieval, sinks
from quillon.plans.catalog import TOKENS_SQL, corpus, points, query, table
from quillon.sources import stores
from quillon.sources.shared import kept, new_folder


def _stored_chunks(spark: SparkSession, sf_dir: str) -> tuple[str, T.StructType]:
    """Pages of all documents, a tenth of them revised: the revision comes first, then the first version late, then the revision again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pages = chunking.fixed_pages(docs, keep=("lang",))
    kind = F.create_map(F.lit("document_type"), F.when(F.col("doc_id") % 2 == 0, "motion"), F.lit("language"), F.col("lang"))
    given = pages.select(F.col("lang").alias("store"), F.col("doc_id").alias("document_id"), (F.col("page") - 1).alias("chunk_index"), F.col("text").alias("content"), kind.alias("metadata"))
    first = sinks.chunk_rows(given.withColumn("version", F.lit(1)))
    revised = sinks.chunk_rows(given.where("document_id % 10 = 0").withColumn("content", F.concat(F.lit("revised "), "content")).withColumn("version", F.lit(2)))
    path = new_folder(spark, "store")
    for batch in (revised, first, revised):
        stores.upsert(path, batch)
    return path, first.schema


CHUNKS_SQL = """ch AS (SELECT doc_id, lang, k, CASE WHEN doc_id % 10 = 0 THEN 'revised ' ELSE '' END || substring(text, k * 3000 + 1, 3000) AS content FROM (SELECT doc_id, lang, text, CAST(unnest(range(0, CAST(ceil(length(text) / 3000.0) AS BIGINT))) AS INTEGER) AS k FROM documents)),
sc AS (SELECT lang AS store, substring(sha256(doc_id || chr(31) || k), 1, 32) AS id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END AS version, CAST(doc_id AS VARCHAR) AS document_id, content, CASE WHEN doc_id % 2 = 0 THEN 'motion' ELSE 'unknown' END AS document_type, doc_id || '_' || k AS chunk_reference FROM ch)"""


@query(f"WITH {CHUNKS_SQL} SELECT store, id, version, document_id, md5(content) AS content_md5, document_type, chunk_reference, store AS language FROM sc")
def stored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = _stored_chunks(spark, sf_dir)
    of = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return stores.read(spark, path, schema).select("store", "id", "version", "document_id", F.md5("content").alias("content_md5"), of("document_type"), of("chunk_reference"), of("language"))


@query(f"WITH {CHUNKS_SQL} SELECT store, count(*) AS rows, min(id) AS first_id, max(id) AS last_id FROM sc GROUP BY store")
def stored_chunk_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = _stored_chunks(spark, sf_dir)
    return stores.exported(stores.read(spark, path, schema)).drop("digest")


@query(f"WITH {CHUNKS_SQL}, gone AS (SELECT count(*) AS deleted FROM sc WHERE store = 'en' AND (CAST(document_id AS BIGINT) % 3 = 0 OR content LIKE 'revised%')) SELECT store, count(*) AS rows, any_value(deleted) AS deleted FROM sc, gone WHERE NOT (store = 'en' AND (CAST(document_id AS BIGINT) % 3 = 0 OR content LIKE 'revised%')) GROUP BY store")
def stored_chunk_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes by predicate, in two calls, the second of them twice; how many rows went and what is left."""
    path, schema = _stored_chunks(spark, sf_dir)
    english = F.col("store") == "en"
    n = stores.delete(path, spark, _with_parts(schema), english & (F.col("document_id").cast("long") % 3 == 0))
    n += sum(stores.delete(path, spark, _with_parts(schema), english & F.startswith("content", F.lit("revised"))) for _ in range(2))
    return stores.read(spark, path, schema).groupBy("store").agg(F.count(F.lit(1)).alias("rows")).withColumn("deleted", F.lit(n).cast("long"))


def _with_parts(schema: T.StructType) -> T.StructType:
    return T.StructType([*(f for f in schema if f.name not in ("store", "part")), T.StructField("store", T.StringType()), T.StructField("part", T.IntegerType())])


@query(f"WITH {CHUNKS_SQL} SELECT id, md5(content) AS content_md5 FROM sc WHERE store = 'en' QUALIFY row_number() OVER (ORDER BY id) BETWEEN 101 AND 200")
def stored_chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second hundred rows of a scan, which goes on after the last id of the first."""
    path, schema = _stored_chunks(spark, sf_dir)
    rows = stores.read(spark, path, schema).where("store = 'en'").select("id", "content")
    last = stores.after(rows, None).agg(F.max("id")).first()[0]
    return stores.after(rows, F.lit(last)).select("id", F.md5("content").alias("content_md5"))


@query(f"WITH {CHUNKS_SQL} SELECT id, document_id, md5(content) AS content_md5 FROM sc WHERE store = 'en' AND document_id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id < 40) AND chunk_reference LIKE '%\\_0' ESCAPE '\\'")
def stored_chunk_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by key: only the folders of the asked ids are read."""
    path, schema = _stored_chunks(spark, sf_dir)
    ids = [r.id for r in spark.range(40).select(stores.point_id(F.col("id"), F.lit(0)).alias("id")).collect()]
    return stores.get(spark, path, _with_parts(schema), "en", ids).select("id", "document_id", F.md5("content").alias("content_md5"))


@query("SELECT CAST(vec_id AS VARCHAR) AS id, 'case_' || (label % 3) AS folder_name, CAST(vec_id AS VARCHAR) AS document_id, 'kept' AS note FROM embeddings")
def stored_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single documents whose metadata try to overwrite what only the store may set."""
    folder, number = F.concat(F.lit("case_"), (F.col("label") % 3).cast("string")), F.col("id").cast("string")
    given = stores.without_reserved(F.create_map(F.lit("folder_name"), F.lit("forged"), F.lit("document_id"), F.lit("forged"), F.lit("note"), F.lit("kept")))
    rows = points(spark, sf_dir).select(folder.alias("store"), number.alias("id"), F.lit(1).alias("version"), "vector", F.map_concat(given, F.create_map(F.lit("folder_name"), folder, F.lit("document_id"), number)).alias("metadata"))
    path = new_folder(spark, "store")
    stores.upsert(path, rows)
    of = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return stores.read(spark, path, rows.schema).select("id", of("folder_name"), of("document_id"), of("note"))


@query(f"WITH tok AS ({TOKENS_SQL}), n AS (SELECT id, count(DISTINCT token) AS n FROM tok GROUP BY id) SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS semantic, len(embedding) AS legal_concepts, coalesce(n, 0) > 0 AS has_keywords FROM embeddings JOIN documents ON doc_id = vec_id LEFT JOIN n ON n.id = vec_id")
def stored_hybrid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with two dense vectors and a sparse one in one row."""
    vectors = points(spark, sf_dir)
    words = retrieval.sparse_lists(corpus(spark, sf_dir).select("id", "content").join(vectors.select("id"), "id", "left_semi"))
    both = vectors.join(words, "id")
    rows = both.select(F.lit("hybrid").alias("store"), F.col("id").cast("string").alias("id"), F.lit(1).alias("version"), F.col("vector").alias("semantic"), F.transform("vector", lambda x: -x).alias("legal_concepts"), "keywords")
    path, rows = new_folder(spark, "store"), kept(rows, "hybrid")
    for _ in range(2):
        stores.upsert(path, rows)
    return stores.read(spark, path, rows.schema).select("id", F.size("semantic").cast("long").alias("semantic"), F.size("legal_concepts").cast("long").alias("legal_concepts"), (F.coalesce(F.size("keywords"), F.lit(0)) > 0).alias("has_keywords"))


@query("WITH c AS (SELECT c_custkey AS id, regexp_replace(lower(c_name || repeat('x', CAST(c_custkey % 60 AS INTEGER))), '[^a-z0-9]+', '_', 'g') AS n FROM customer) SELECT id, substring(n, 1, 63) AS main, substring(n, 1, 57) || '_facts' AS facts, substring(n, 1, 54) || '_timeline' AS timeline, substring(n, 1, 51) || '_depositions' AS depositions FROM c")
def case_store_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.regexp_replace(F.lower(F.concat("c_name", F.repeat(F.lit("x"), (F.col("c_custkey") % 60).cast("int")))), "[^a-z0-9]+", "_")
    named = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), stores.case_stores(name).alias("s"))
    return named.select("id", *(F.col("s")[i].alias(n) for i, n in enumerate(("main", "facts", "timeline", "depositions"))))


@query("SELECT sha256(text) AS id, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1")
def stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of contents kept in a store by hash: half of the documents, then all of them, then the half again."""
    path, out = new_folder(spark, "registry"), None
    docs = corpus(spark, sf_dir)
    for version, some in ((1, docs.where("id % 2 = 0")), (2, docs), (1, docs.where("id % 2 = 0"))):
        out = dedup.registry(some).select(F.lit("registry").alias("store"), F.col("content_hash").alias("id"), F.lit(version).alias("version"), "first_id", "copies")
        stores.upsert(path, out)
    return stores.read(spark, path, out.schema).select("id", "first_id", "copies")


# ---- rows of findings


@query("SELECT o_orderkey AS fact_id, o_orderkey % 4 > 0 AS has_dates, CASE WHEN o_orderkey % 4 > 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS primary_date, '{\"kind\":\"' || o_orderstatus || '\"}' AS entities FROM orders")
def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    dates = F.when(F.col("o_orderkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(day, F.lit("2000-01-01")))
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id"), F.lit("x").alias("content"), dates.alias("dates"), F.create_map(F.lit("kind"), F.col("o_orderstatus")).alias("entities"))
    return sinks.fact_rows(facts).drop("content")


@query("SELECT doc_id AS testimony_id, lang AS deponent, CASE WHEN doc_id % 2 = 0 THEN lang || ',' || source ELSE source END AS topics, md5(substring(text, 1, 500)) AS excerpt_md5 FROM documents")
def stored_testimony(spark: SparkSession, sf_dir: str) -> DataFrame:
    topics = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array("source"))
    rows = sinks.deposition_rows(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("testimony_id"), F.col("lang").alias("deponent"), topics.alias("topics"), F.col("text").alias("excerpt")))
    return rows.select("testimony_id", "deponent", "topics", F.md5("excerpt").alias("excerpt_md5"))


@query("SELECT p_partkey AS exhibit_id, p_brand || ': ' || p_name AS embed_text, '[' || p_size || ',' || (p_size + 1) || ']' AS pages FROM part")
def stored_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return sinks.exhibit_rows(part.select(F.col("p_partkey").alias("exhibit_id"), F.col("p_brand").alias("number"), F.col("p_name").alias("description"), F.array(F.col("p_size").cast("int"), (F.col("p_size") + 1).cast("int")).alias("pages")))


@query("SELECT p_partkey AS document_id, p_name AS title, p_name || CASE WHEN p_partkey % 3 > 0 THEN chr(10) || p_type ELSE '' END || chr(10) || p_brand || chr(10) || p_size AS embed_text FROM part")
def stored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).otherwise(" ").alias("description"), F.array("p_brand", F.col("p_size").cast("string")).alias("key_facts"))
    return sinks.document_rows(rows)


@query("SELECT o_custkey AS case_id, o_orderkey AS event_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS event_index, 'On ' || strftime(o_orderdate, '%B %d, %Y') || ': ' || o_orderpriority AS narrative FROM orders")
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return sinks.timeline_rows(orders.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("description")))


@query("SELECT 'Fla. Stat. § ' || doc_id || '.01' AS identifier, lang || '. ' || substring(text, 1, 500) AS embed_text, md5(text) AS content_md5, length(substring(text, 1, 500)) AS preview_length FROM documents")
def stored_statutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sinks.statute_rows(table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".01")).alias("number"), F.col("lang").alias("title"), F.col("text").alias("content")))
    return rows.select("identifier", "embed_text", F.md5("content").alias("content_md5"), F.length("preview").cast("long").alias("preview_length"))


@query("SELECT '49 CFR § ' || (s_suppkey % 30) || '.' || s_suppkey AS identifier, coalesce(n_name, 'Unknown part') AS part_title, substring(s_name, 1, 500) AS preview FROM supplier LEFT JOIN nation ON n_nationkey = s_suppkey % 30")
def stored_regulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 30).cast("long").alias("part"), F.col("s_suppkey").alias("section"), F.col("s_name").alias("content"))
    titles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("part"), F.col("n_name").alias("title"))
    return sinks.regulation_rows(sections, titles).drop("content")


KINDS = ["deposition", "interrogatory_response", "expert_report", "medical_record", "safety_manual", "motion"]


@query(f"SELECT o_orderkey AS id, [{', '.join(repr(k) for k in ('testimony', 'testimony', 'expert_opinion', 'expert_opinion', 'procedural'))}, NULL][CAST(o_orderkey % 6 AS INTEGER) + 1] AS semantic_type FROM orders")
def testimony_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), sinks.testimony_type(kind).alias("semantic_type"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_discount >= 0.03 THEN CASE l_linenumber % 3 WHEN 0 THEN CASE l_partkey % 3 WHEN 0 THEN 'Use to establish chronology: ' WHEN 1 THEN 'Cite to support damages claim: ' ELSE 'Reference to support factual assertion: ' END
WHEN 1 THEN 'Quote ' || CASE WHEN l_partkey % 2 = 0 THEN 'Smith' ELSE 'witness' END || '''s testimony: ' ELSE 'Reference ' || CASE WHEN l_partkey % 2 = 0 THEN 'Smith' ELSE 'document' END || ': ' END || 'Ex. ' || l_suppkey END AS suggestion FROM lineitem""")
def usage_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda n, values: F.element_at(F.array(*(F.lit(v) for v in values)), (n + 1).cast("int"))
    kind, category = one(F.col("l_linenumber") % 3, ["fact", "deposition", "exhibit"]), one(F.col("l_partkey") % 3, ["timeline", "damages", "other"])
    source = F.when(F.col("l_partkey") % 2 == 0, "Smith")
    told = sinks.usage_suggestion(kind, category, source, F.concat(F.lit("Ex. "), F.col("l_suppkey").cast("string")), F.col("l_discount") * 10)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), told.alias("suggestion"))


@query("SELECT doc_id AS id, 'legal:document:' || doc_id || ':summary' AS cache_key, sha256(text) AS chunk_hash, substring(sha256(lang || '|' || source), 1, 16) AS outline_id, sha256('draft:' || lang) AS motion_key, lang || '_' || source AS partition FROM documents")
def stored_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names under which results are kept: of documents, chunks, outlines, motions and partitions."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), hashing.cache_key("legal", "document", F.col("doc_id").cast("string"), F.lit("summary")).alias("cache_key"), hashing.content_hash(F.col("text")).alias("chunk_hash"),
        F.substring(F.sha2(F.concat_ws("|", "lang", "source"), 256), 1, 16).alias("outline_id"), F.sha2(F.concat(F.lit("draft:"), "lang"), 256).alias("motion_key"), F.concat_ws("_", "lang", "source").alias("partition"),
    )
