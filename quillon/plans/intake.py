"""Queries of intake: files scanned, decoded and read, what comes in checked and named, models with their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import hashing, legal, models, predicates, text, vectors
from quillon.operators import partitions, research
from quillon.plans.casework import PAGES_SQL, pick, production_pages
from quillon.plans.catalog import SPARSE_SQL, _cascade, query, table
from quillon.plans.catalog import LEGAL_SQL
from quillon.plans.catalog import legal as legal_texts
from quillon.plans.library import STORES_SQL, _searched
from quillon.sources import files
from quillon.sources.shared import new_folder

# ---- files: a folder a language, below it a folder a source, in it text files of the documents' first lines


def _folder(spark: SparkSession, sf_dir: str) -> str:
    root = new_folder(spark, "files")
    lines = table(spark, sf_dir, "documents").select("lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.substring_index("text", "\n", 1)).alias("line"))
    lines.repartition("lang", "source").write.partitionBy("lang", "source").text(root)
    return root


LINE_SQL = "l AS (SELECT lang, source, doc_id, doc_id || '|' || string_split(text, chr(10))[1] AS line FROM documents)"


@query(f"WITH {LINE_SQL} SELECT 'lang=' || lang AS case_name, 'source=' || source AS folder, CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS size FROM l GROUP BY ALL")
def scanned_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below a root with their case and folder, by the names of the folders above them."""
    return files.scan(spark, _folder(spark, sf_dir), ".txt").groupBy("case_name", "folder").agg(F.sum("size").alias("size"))


@query("SELECT DISTINCT 'lang=' || lang AS case_name, 'source=' || source AS folder FROM documents WHERE lang = 'de'")
def subfolders_of_a_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.subfolders(files.scan(spark, _folder(spark, sf_dir), ".TXT")).where("case_name = 'lang=de'")


@query(f"WITH {LINE_SQL} SELECT lang, line FROM l")
def decoded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all files, from their bytes."""
    found = files.scan(spark, _folder(spark, sf_dir), ".txt").select(F.regexp_replace("case_name", "lang=", "").alias("lang"), files.decoded(F.col("content")).alias("t"))
    return found.select("lang", F.explode(F.split(F.rtrim("t", F.lit("\n")), "\n")).alias("line"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'second' WHEN doc_id % 3 = 1 THEN 'first' ELSE 'failed' END AS method, CASE WHEN doc_id % 3 = 2 THEN 0 ELSE length(text) END AS n FROM documents")
def extracted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first extractor whose text isn't blank, and its name."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    first = lambda c: F.when(F.col("id") % 3 == 1, files.decoded(c))
    second = lambda c: F.when(F.col("id") % 3 == 0, files.decoded(c)).otherwise("  ")
    found = files.extracted(rows, [("first", first), ("second", second)])
    return found.select("id", "method", F.length("text").alias("n"))


@query("SELECT doc_id AS id, length(text) // 2000 + 1 AS pages, md5(text) AS text_md5 FROM documents")
def uploaded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploads in Base64, whose pages form feeds part."""
    docs = table(spark, sf_dir, "documents")
    sent = docs.select(F.col("doc_id").alias("id"), F.base64(F.encode("text", "UTF-8")).alias("upload"), (F.length("text") / 2000).cast("int").alias("feeds"))
    read = sent.select("id", "feeds", files.decoded(hashing.bytes_of_base64(F.col("upload"))).alias("text"))
    return read.select("id", files.form_feed_pages(F.concat(F.col("text"), F.repeat(F.lit("\f"), F.col("feeds")))).cast("long").alias("pages"), F.md5("text").alias("text_md5"))


@query("SELECT o_orderkey AS id, o_totalprice > 300000 OR o_orderkey % 4 = 0 AS is_production FROM orders")
def production_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 4 == 0, "RFP responses.pdf").otherwise("letter.pdf")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), files.is_production((F.col("o_totalprice") * 10485760 / 300000).cast("double"), name).alias("is_production"))


# ---- checks and names


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, page > 0 AND o_orderkey % 3 = 0 AS has_letterhead FROM pg")
def letterheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = production_pages(spark, sf_dir)
    key = F.regexp_extract("text", r"DEF(\d{7})", 1).cast("long")
    headed = F.when(key % 3 == 0, F.concat(F.lit("Acme Corporation\n1 Main Street\n"), "text")).otherwise(F.replace("text", F.lit("load"), F.lit("x")))
    return pages.select("doc_id", "page", text.has_letterhead(headed, F.col("page")).alias("has_letterhead"))


@query("SELECT s_suppkey AS id, s_suppkey % 3 = 0 AS shared, CASE WHEN s_suppkey % 3 > 0 THEN s_name END AS own FROM supplier")
def shared_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which tables all cases share, and the names of the others."""
    name = F.when(F.col("s_suppkey") % 3 == 0, " Florida_Statutes ").otherwise(F.col("s_name"))
    is_shared = predicates.is_shared(name)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), is_shared.alias("shared"), F.when(~is_shared, name).alias("own"))


@query("SELECT p_partkey AS id, p_partkey % 3 > 0 AS usable_context, CASE WHEN p_partkey % 2 = 0 THEN 'token=*** of ' || p_brand ELSE 'nothing of ' || p_brand END AS log FROM part")
def context_and_log_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = F.when(F.col("p_partkey") % 3 == 0, "As an AI, I cannot say").otherwise(F.concat(F.lit("About the part "), "p_name"))
    line = F.concat(F.when(F.col("p_partkey") % 2 == 0, "token: abc").otherwise("nothing"), F.lit(" of "), "p_brand")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), predicates.valid_context(context).alias("usable_context"), text.redacted(line).alias("log"))


@query("SELECT p_partkey AS id, array_to_string(list_filter(['answer', 'score'], lambda k: (k = 'answer' AND p_partkey % 2 > 0) OR (k = 'score' AND p_partkey % 5 = 0)), ',') AS missing, p_partkey % 5 > 0 AND p_partkey % 7 > 0 AS sure FROM part")
def response_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers: keys that they lack, and whether the confidence is one."""
    n = F.col("p_partkey")
    answer = F.create_map(F.lit("answer"), F.when(n % 2 == 0, "yes"), F.lit("score"), F.when(n % 5 > 0, F.when(n % 7 > 0, "0.5").otherwise("1.5")))
    sure = F.coalesce(F.try_element_at(answer, F.lit("score")).try_cast("double").between(0, 1), F.lit(False))
    return table(spark, sf_dir, "part").select(n.alias("id"), F.array_join(predicates.missing_keys(answer, ["answer", "score"]), ",").alias("missing"), sure.alias("sure"))


@query("SELECT o_orderkey AS id, substring(sha256('{\"a\":' || o_custkey || ',\"b\":\"' || o_orderstatus || '\"}' || 'db'), 1, 16) AS outline_id, sha256('draft:{\"a\":' || o_custkey || '}') AS motion_key FROM orders")
def outline_and_motion_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    outline = F.to_json(F.struct(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")))
    motion = F.to_json(F.struct(F.col("o_custkey").alias("a")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring(F.sha2(F.concat(outline, F.lit("db")), 256), 1, 16).alias("outline_id"), F.sha2(F.concat(F.lit("draft:"), motion), 256).alias("motion_key"))


@query("SELECT o_orderkey AS id, 'facts_' || strftime(o_orderdate, '%Y_%m') AS partition, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2024-01-31' END AS day FROM orders")
def partition_names_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's partition by name, and the first of three texts that is a date."""
    day = F.col("o_orderdate")
    given = [F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise("none"), F.when(F.col("o_orderkey") % 3 == 1, "01/31/2024").otherwise("2024-99-99"), F.lit("unknown")]
    parsed = F.coalesce(*(F.coalesce(F.try_to_date(g, "yyyy-MM-dd"), F.try_to_date(g, "MM/dd/yyyy")) for g in given))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("_", F.lit("facts"), F.date_format(day, "yyyy_MM")).alias("partition"), F.date_format(parsed, "yyyy-MM-dd").alias("day"))


@query("WITH m AS (SELECT min(date_trunc('month', o_orderdate)) AS first FROM orders), r AS (SELECT CAST(first + INTERVAL 1 MONTH * k AS DATE) AS start FROM m, range(0, 24) t(k)) SELECT 'p_' || strftime(start, '%Y_%m') AS partition, strftime(start, '%Y-%m-%d') AS start, count(o_orderkey) AS n FROM r LEFT JOIN orders ON date_trunc('month', o_orderdate) = start GROUP BY ALL")
def partition_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of monthly ranges from the first order on, and the rows that each takes."""
    orders = table(spark, sf_dir, "orders")
    first = orders.agg(F.date_format(F.trunc(F.min("o_orderdate").cast("date"), "month"), "yyyy-MM-dd")).first()[0]
    ranges_ = partitions.monthly_ranges(spark, first, 24)
    taken = partitions.assigned(orders, ranges_, "o_orderdate").groupBy("partition").agg(F.count(F.lit(1)).alias("n"))
    return ranges_.join(taken, "partition", "left").select("partition", F.date_format("start", "yyyy-MM-dd").alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


# ---- kinds and models


@query("SELECT o_orderkey AS id, ['case_database', 'firm_knowledge', 'both'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS store, ['evidence', 'case_law', 'general'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS expected FROM orders")
def stores_and_expected_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    question = pick("o_orderkey", ["what happened: which evidence is there", "successful argument and strategy", "hello"])
    kind = pick("o_orderkey", ["case_facts", "legal_precedents", "other"])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), legal.store_of(question).alias("store"), legal.expected_result(kind).alias("expected"))


TYPE_SQL = _cascade([text.DOCUMENT_RULES[0], *text.DOCUMENT_RULES[1:]], "'model says so'")


@query(f"WITH {LEGAL_SQL} SELECT id, {TYPE_SQL} AS document_type FROM t")
def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the patterns say goes before a model's answer."""
    return models.classify(legal_texts(spark, sf_dir), "content", lambda c: F.lit("model says so")).select("id", "document_type")


@query(r"WITH s AS (SELECT doc_id AS id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) BETWEEN 20 AND 400)[1:10] AS f FROM documents) SELECT id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS n, unnest(f) AS fact FROM s")
def mined_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return models.facts(docs)


@query(r"WITH s AS (SELECT doc_id AS id, text, regexp_extract(text, '^\s*([^.!?]{1,300}[.!?]?)', 1) AS c FROM documents) SELECT id, md5(CASE WHEN length(c) >= 10 AND NOT regexp_matches(lower(c), 'i cannot|i can''t|unable to|as an ai') THEN c || chr(10) || '---' || chr(10) || text ELSE text END) AS text_md5 FROM s")
def contextual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return models.with_context(docs, "text").select("id", F.md5("embedding_text").alias("text_md5"))


@query("SELECT vec_id AS id, round(greatest(0, least(1, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST((SELECT embedding FROM embeddings WHERE vec_id = 3) AS DOUBLE[])))), 6) AS relevance FROM embeddings")
def relevance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance to a question's vector, from 0 to 1: the default where no model judges."""
    rows = table(spark, sf_dir, "embeddings")
    asked = [float(x) for x in rows.where("vec_id = 3").select("embedding").first()[0]]
    return rows.select(F.col("vec_id").alias("id"), F.round(vectors.clamped_cosine(F.col("embedding"), F.lit(asked)), 6).alias("relevance"))


@query(f"{SPARSE_SQL}, {STORES_SQL} SELECT question_id, store, id, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, id, store) AS rank FROM fu")
def research_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's results over its stores in one list, what several stores have as often as they have it."""
    return research.gathered(_searched(spark, sf_dir)[0], None, once=False).select("question_id", "store", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT doc_id AS id, CASE WHEN trim(text) <> '' THEN 64 END AS dimension, CASE WHEN trim(text) <> '' THEN true END AS is_scaled FROM documents")
def embedded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all texts by the default embedder, in batches, of length 1, or 0 where a text's words cancel out; a blank text has none."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    embedded = models.embed(docs, "text", models.HashEmbedder(64))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return embedded.select("id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimension"), F.round(length, 6).isin(0.0, 1.0).alias("is_scaled"))
