"""Queries over passages: cleaned and stitched texts, kinds, citations, transcripts, exhibits, outlines, drafts, and the progress of their processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import legal, passages, predicates, text
from quillon.operators import chunking, motion_quality, research
from quillon.plans.casework import PAGES_SQL, SECTIONS_SQL, pick, pick_sql, production_pages, sections
from quillon.plans.catalog import CITED_SQL, LEGAL_SQL, _cascade, cited, legal as legal_texts, query, table
from quillon.sources.shared import new_folder
from quillon.streaming import progress

# ---- texts


@query(r"WITH t AS (SELECT doc_id AS id, replace(text, '. ', '.   [Page 3]' || chr(10) || chr(10) || chr(10) || chr(10)) AS text FROM documents) SELECT id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '\[Page \d+\]', '', 'g'), '^\s+', ''), '\s+$', '')) AS clean_md5 FROM t")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.replace("text", F.lit(". "), F.lit(".   [Page 3]\n\n\n\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5(text.clean_text(marked)).alias("clean_md5"))


@query("SELECT doc_id AS id, greatest(1, CAST(floor(length(text) / 3000) AS INTEGER)) AS pages, CAST(floor(length(text) / 4) AS BIGINT) AS tokens, length(text) // 3000 > 50 AS is_large FROM documents")
def size_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text.page_estimate(F.col("text"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), pages.alias("pages"), legal.estimated_tokens(F.col("text")).cast("long").alias("tokens"), predicates.is_large(pages).alias("is_large"))


@query(r"""WITH p AS (SELECT doc_id, k + 1 AS page, substring(text, k * 1000 + 1, 1000) AS text FROM (SELECT doc_id, text, CAST(unnest(range(0, CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS INTEGER) AS k FROM documents)),
w AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY page) AS was FROM p), t AS (SELECT *, right(was, 200) AS tail FROM w)
SELECT doc_id, page, md5(CASE WHEN was IS NULL OR trim(was) = '' THEN text ELSE CASE WHEN regexp_matches(tail, '(?s)[.!?]\s+\S') THEN regexp_replace(tail, '(?s)\A.*?[.!?]\s+', '') ELSE tail END || ' ' || text END) AS stitched_md5 FROM t""")
def stitched_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page after the end of the one before."""
    pages = chunking.fixed_pages(table(spark, sf_dir, "documents").select("doc_id", "text"), 1000)
    was = F.lag("text").over(Window.partitionBy("doc_id").orderBy("page"))
    return pages.select("doc_id", "page", F.md5(passages.stitched(was, F.col("text"))).alias("stitched_md5"))


CHUNK_TEXTS = ["see 12 U.S.C. § 34", "1. first of a list", "the plaintiff testified to it", "the defendant will argue", "therefore the ruling stands", "plain words only"]


@query(f"SELECT o_orderkey AS id, {['legal_citation', 'list_item', 'fact_statement', 'argument', 'conclusion', 'paragraph']}[CAST(o_orderkey % 6 AS INTEGER) + 1] AS kind FROM orders")
def chunk_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), legal.chunk_type(pick("o_orderkey", CHUNK_TEXTS)).alias("kind"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'ABC' || lpad(CAST(o_custkey AS VARCHAR), 6, '0') ELSE 'DEF' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') END AS bates FROM orders")
def bates_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number by the file's name, where it has one, else by the text."""
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("ABC"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit(".pdf"))).otherwise("scan.pdf")
    content = F.concat(F.lit("page of DEF"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), passages.bates_of(name, content).alias("bates"))


@query(f"WITH {LEGAL_SQL}, k AS (SELECT id, {_cascade([text.DOCUMENT_RULES[0], *text.DOCUMENT_RULES[1:]], 'NULL')} AS kind FROM t) SELECT id, CASE WHEN id % 5 = 0 THEN 'deposition' ELSE coalesce(kind, 'other') END AS kind FROM k")
def kinds_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind by the file's name, else by the beginning of the text, else other."""
    named = F.when(F.col("id") % 5 == 0, "deposition")
    return legal_texts(spark, sf_dir).select("id", passages.kind_of(named, F.col("content")).alias("kind"))


FILINGS = ["Motion for relief", "Complaint of the plaintiff", "Answer: the defendant admits", "Legal memorandum", "Brief of the appellant", "Order of the court", "Interrogatory no. 1", "Patient name: X", "Invoice 9", "plain"]


@query(f"SELECT o_orderkey AS id, {['motion', 'complaint', 'answer', 'memorandum', 'brief', 'order', 'interrogatory', 'medical_record', 'invoice', '']!r}[CAST(o_orderkey % 10 AS INTEGER) + 1] AS filing FROM orders")
def filing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.coalesce(legal.filing_type(pick("o_orderkey", FILINGS)), F.lit("")).alias("filing"))


@query(f"WITH {LEGAL_SQL} SELECT id, regexp_extract(content, 'Plaintiff: ([^,;]+)', 1) AS parties, strftime(o_orderdate, '%m/%d/%Y') AS dates, 1 AS n_parties FROM t")
def party_and_date_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = legal_texts(spark, sf_dir).select("id", text.parties(F.col("content")).alias("p"), text.dates(F.col("content")).alias("d"))
    return found.select("id", F.array_join("p", "|").alias("parties"), F.array_join("d", "|").alias("dates"), F.size("p").alias("n_parties"))


# ---- citations and transcripts


@query(f"WITH {CITED_SQL} SELECT o_orderkey AS id, 'Smith Dep. ' || (o_orderkey % 200) || ':' || (o_custkey % 25) || CASE WHEN o_orderkey % 2 = 0 THEN '-26' ELSE '' END || '|Doe v. Roe|' || '49 C.F.R. § ' || (o_orderkey % 7) || '.' || (o_custkey % 9) AS citations, 3 AS n FROM orders")
def fact_citation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cited(spark, sf_dir).select("id", passages.fact_citations(F.col("content")).alias("c"))
    return found.select("id", F.array_join("c", "|").alias("citations"), F.size("c").alias("n"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(least(1.0, 0.8 + CASE WHEN l_linenumber % 3 > 0 THEN 0.1 ELSE 0 END + CASE WHEN l_partkey % 2 > 0 THEN 0.05 ELSE 0 END + CASE WHEN l_suppkey % 3 > 0 THEN 0.05 ELSE 0 END)::DOUBLE, 6) AS confidence FROM lineitem")
def fact_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = legal.fact_confidence(F.col("l_linenumber") % 3, F.col("l_partkey") % 2, F.col("l_suppkey") % 3)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(sure, 6).alias("confidence"))


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's deposition: a page for each of three questions."""
    name = F.concat(F.lit("Witness "), F.element_at(F.array(*(F.lit(x) for x in ("Alpha", "Beta", "Gamma"))), (F.col("c_custkey") % 3 + 1).cast("int")))
    page = lambda k: F.concat(F.lit(f"Page {k}\nQ. What happened to the order number "), F.col("c_custkey").cast("string"), F.lit("?\nA. It was late by "), (F.col("c_custkey") % (k + 5)).cast("string"), F.lit(" days.\nQ. Short one?\nA. Yes.\n"))
    head = F.concat(F.lit("DEPOSITION OF "), name, F.lit("\ntaken March 3, 2021\n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(head, *(page(k) for k in (1, 2, 3))).alias("content"))


@query("SELECT c_custkey AS id, 'Witness ' || ['Alpha', 'Beta', 'Gamma'][CAST(c_custkey % 3 AS INTEGER) + 1] AS witness, 'March 3, 2021' AS taken_on, 3 AS pages FROM customer")
def deposition_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("id", passages.deposition_metadata(F.col("content")).alias("m")).select("id", "m.*")


@query("SELECT c_custkey AS id, k AS page, 'What happened to the order number ' || c_custkey || '?' AS question, 'A. It was late by ' || (c_custkey % (k + 5)) || ' days.' AS answer FROM customer, (VALUES (1), (2), (3)) v(k)")
def transcript_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("id", F.explode(passages.questions(F.col("content"))).alias("q")).select("id", "q.*")


@query(f"WITH {CITED_SQL} SELECT o_orderkey AS id, 'Smith Dep. ' || (o_orderkey % 200) || ':' || (o_custkey % 25) || CASE WHEN o_orderkey % 2 = 0 AND o_custkey % 25 <> 26 THEN '-26' ELSE '' END AS short, 'Deposition of Smith at page ' || (o_orderkey % 200) || ', lines ' || (o_custkey % 25) || CASE WHEN o_orderkey % 2 = 0 THEN '-26' ELSE '' END AS long FROM orders")
def deposition_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each piece of testimony in its short and its long form."""
    found = cited(spark, sf_dir).select("id", F.explode(legal.depositions(F.col("content"))).alias("d")).select("id", "d.*")
    form = lambda full: legal.deposition_citation(F.col("deponent"), F.col("page"), F.col("line"), F.col("line_end"), full)
    return found.select("id", form(False).alias("short"), form(True).alias("long"))


EXHIBITS = ["a photo and a picture of the hospital", "medical treatment notes", "signed agreement", "a letter", "an analysis report", "thing"]


@query(f"SELECT p_partkey AS id, {['photograph', 'medical_record', 'contract', 'correspondence', 'report', 'document']}[CAST(p_partkey % 6 AS INTEGER) + 1] AS kind FROM part")
def exhibit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), passages.exhibit_kind(pick("p_partkey", EXHIBITS)).alias("kind"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'the ' || p_name || ' itself' WHEN 1 THEN 'A copy of ' || p_name ELSE 'Exhibit 7' END AS description FROM part")
def exhibit_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("See Exhibit 7: the "), "p_name", F.lit(" itself. Exhibit 8: none"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("So. A copy of "), "p_name", F.lit(" was marked as Exhibit 7."))).otherwise("Exhibit 7. Nothing")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), passages.exhibit_description(content, F.lit("7")).alias("description"))


@query("SELECT p_partkey AS id, 'Ex. ' || p_size AS standard, 'Exhibit ' || p_size || ' (' || p_name || ')' AS formal, 'Ex. ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' at 3, ' || p_size ELSE '' END AS with_pages FROM part")
def exhibit_citation_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("p_size").cast("string")
    pages = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit(3).cast("long"), F.col("p_size").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(passages.exhibit_citation(number, F.col("p_name"), pages, s).alias(s) for s in ("standard", "formal", "with_pages")))


CASES = ["Smith Jones v. Acme Corp, 12 F.3d 345 (2d Cir. 1999)", "Doe v. Roe, 5 U.S. 137", "under 49 C.F.R. § 395.8 and 28 U.S.C. § 1332(a)", "Miller v. State, 7 So. 2d 9; Miller v. State, 7 So. 2d 9", "no citation v. here"]
CASES_SQL = """u AS (SELECT o_orderkey AS id, unnest(CASE o_orderkey % 5 WHEN 0 THEN [['Smith Jones v. Acme Corp, 12 F.3d 345 (2d Cir. 1999)', 'Smith Jones v. Acme Corp', 'case']] WHEN 1 THEN [['Doe v. Roe, 5 U.S. 137', 'Doe v. Roe', 'case']]
WHEN 2 THEN [['49 C.F.R. § 395.8', NULL, 'statute'], ['28 U.S.C. § 1332(a)', NULL, 'statute']] WHEN 3 THEN [['Miller v. State, 7 So. 2d 9', 'Miller v. State', 'case']] ELSE [] END) AS c FROM orders)"""


@query(f"WITH {CASES_SQL} SELECT id, c[1] AS citation, c[2] AS case_name, c[3] AS kind FROM u")
def typed_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case law and statutes of filings, each once."""
    content = F.concat(F.lit("so says "), pick("o_orderkey", CASES), F.lit(". and more"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.explode(passages.typed_citations(content)).alias("c")).select("id", "c.*")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE 'Doe v. Roe' END AS name, CASE WHEN p_partkey % 3 > 0 THEN p_size || ' F.3d 7' END AS cite, CASE WHEN p_partkey % 3 > 0 THEN 'the rule of ' || p_brand END AS principle, CASE WHEN p_partkey % 3 = 2 THEN 'it binds' END AS why FROM part")
def authority_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.concat(F.lit("Doe v. Roe – "), F.col("p_size").cast("string"), F.lit(" F.3d 7: the rule of "), "p_brand")
    given = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, rule).otherwise(F.concat(rule, F.lit(" (it binds)")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), legal.authority_parts(given).alias("a")).select("id", "a.*")


# ---- outlines and drafts


@query("""SELECT p_partkey AS id, 'first ' || p_type || '|' || p_brand || ': ' || p_type || '|a|b|c' AS key_points, p_brand || '|x|y|z|w' AS authorities, 'f1|f2' AS facts, p_name AS themes FROM part""")
def essential_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of an outline's section goes into a draft."""
    item = lambda kind, label, value=None, items=None: F.struct(F.lit(kind).alias("type"), label.alias("label"), (F.lit(None).cast("string") if value is None else value).alias("value"), (F.lit(None).cast("array<string>") if items is None else items).alias("items"))
    made = F.array(
        item("field", F.lit("Theme"), F.col("p_name")), item("field", F.col("p_brand"), F.concat(F.lit('"'), "p_type", F.lit('"'))), item("list", F.lit("Key Authorities"), items=F.array(F.col("p_brand"), *(F.lit(x) for x in "xyzwv"))),
        item("list", F.lit("Facts"), items=F.array(F.lit("f1"), F.lit("f2"))), item("list", F.lit("Points"), items=F.array(*(F.lit(x) for x in "abcd"))), item("field", F.lit("Summary"), F.concat(F.lit("Option A: first "), "p_type", F.lit(" || second"))),
    )
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), passages.essential_content(made).alias("e"))
    return found.select("id", *(F.array_join(f"e.{c}", "|").alias(c) for c in ("key_points", "authorities", "facts", "themes")))


METRICS_SQL = f"""{SECTIONS_SQL}, ci AS (SELECT motion_id, ordinal, kind AS section, words, unnest(citations) AS c FROM sc), q AS (SELECT motion_id, ordinal, any_value(words) AS words, count(*) AS n, count(*) FILTER (c % 2 = 0) AS exact,
(max(CASE WHEN c % 4 = 0 THEN 1 ELSE 0 END) + max(CASE WHEN c % 4 = 1 THEN 1 ELSE 0 END) + max(CASE WHEN c % 4 = 2 THEN 1 ELSE 0 END)) / 3.0::DOUBLE AS strength FROM ci WHERE section = 'argument' GROUP BY motion_id, ordinal),
m AS (SELECT motion_id, avg(CASE WHEN words > 0 THEN n / words::DOUBLE * 100 ELSE 0 END) AS density, avg(exact / n::DOUBLE) AS specificity, avg(strength) AS strength FROM q GROUP BY motion_id),
s AS (SELECT motion_id, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (words > 0) AS complete, sum(CASE WHEN kind = 'introduction' THEN words ELSE 0 END) / sum(words)::DOUBLE AS o, sum(CASE WHEN kind = 'argument' THEN words ELSE 0 END) / sum(words)::DOUBLE AS a, sum(CASE WHEN kind IN ('conclusion', 'prayer') THEN words ELSE 0 END) / sum(words)::DOUBLE AS c FROM sc GROUP BY motion_id),
j AS (SELECT *, CASE WHEN o BETWEEN 0.05 AND 0.10 THEN 0.5 WHEN o <= 0.15 THEN 0.3 ELSE 0.0 END + CASE WHEN a BETWEEN 0.75 AND 0.85 THEN 0.5 WHEN a >= 0.70 THEN 0.3 ELSE 0.0 END AS balance FROM s LEFT JOIN m USING (motion_id))"""


@query(f"WITH {METRICS_SQL} SELECT motion_id, words, complete, round(o * 100, 1) AS opening_share, round(a * 100, 1) AS argument_share, round(c * 100, 1) AS closing_share, round(coalesce(density, 0), 6) AS density, round(coalesce(specificity, 0), 6) AS specificity, round(coalesce(strength, 0), 6) AS strength, round(CAST(CASE WHEN specificity IS NULL THEN balance ELSE (balance + specificity + least(density / 3, 1) + strength) / 4 END AS DOUBLE), 6) AS coherence FROM j")
def motion_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density, specificity, strength, balance and coherence of drafts."""
    rows = sections(spark, sf_dir)
    c = F.col("c")
    kind = F.when(c % 4 == 0, "deposition").when(c % 4 == 1, "exhibit").when(c % 4 == 2, "expert_report").otherwise("case_law")
    cites = rows.select("motion_id", "ordinal", F.explode("citations").alias("c")).select("motion_id", "ordinal", kind.alias("kind"), F.when(c % 4 == 0, c).alias("page"), F.lit(None).cast("int").alias("line"), F.when(c % 4 == 2, "A").alias("exhibit"), F.lit(None).cast("string").alias("date"))
    return motion_quality.quality_metrics(rows.select("motion_id", "ordinal", "kind", "words"), cites)


# ---- predicates and validation

HEADED = ["Smith v. Jones  Page 3", "plain top"]


@query(rf"WITH {PAGES_SQL}, h AS (SELECT doc_id, page, {pick_sql('o_orderkey', HEADED)} || chr(10) || text AS text FROM pg) SELECT doc_id, page, regexp_matches(array_to_string(string_split(text, chr(10))[1:5], chr(10)), '(?m)^\s*\S+.*\s+Page\s+\d+') AS has_header, regexp_matches(array_to_string(string_split(text, chr(10))[-5:], chr(10)), '(?i)Page\s+\d+|©|\d{{4}}\s+\w+|Confidential') AS has_footer, false AS has_letterhead FROM h")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers, footers and letterheads of pages of productions."""
    pages = production_pages(spark, sf_dir, HEADED)  # head and text are of one row, so nothing is joined
    return pages.select("doc_id", "page", passages.has_header(F.col("text")).alias("has_header"), passages.has_footer(F.col("text")).alias("has_footer"), text.has_letterhead(F.col("text"), F.col("page")).alias("has_letterhead"))


@query("SELECT vec_id AS id, list_max(list_transform(embedding, lambda x: abs(x))) <= 1 AS in_range, len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) <= 1 AND vec_id % 200 BETWEEN 1 AND 100 AS valid_search FROM embeddings")
def vector_and_search_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors within [-1, 1], and searches whose vector and limit are valid."""
    vectors_ = table(spark, sf_dir, "embeddings")
    inside = F.coalesce(F.forall("embedding", lambda x: F.abs(x) <= 1), F.lit(False))
    limit = F.col("vec_id") % 200
    return vectors_.select(F.col("vec_id").alias("id"), inside.alias("in_range"), (inside & (F.size("embedding") == 64) & limit.between(1, 100)).alias("valid_search"))


@query(r"SELECT p_partkey AS id, regexp_replace(p_name, ' ', '_', 'g') || '_' || p_size || '.pdf' AS filename, p_partkey % 2 = 0 AS complete, p_partkey % 3 > 0 AS usable_context, p_partkey % 5 < 4 AS valid_response, 'password=*** for ' || p_brand AS log FROM part")
def input_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files, metadata, contexts, responses and log lines as they come in."""
    name = F.concat(F.lit(" ."), F.replace("p_name", F.lit(" "), F.lit("?")), F.lit("/"), F.col("p_size").cast("string"), F.lit(".pdf. "))
    metadata = F.create_map(F.lit("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(" "), F.lit("kind"), F.lit("x"))
    context = F.when(F.col("p_partkey") % 3 == 0, "As an AI, I cannot say").otherwise(F.concat(F.lit("About the part "), "p_name"))
    confidence = F.when(F.col("p_partkey") % 5 == 4, 1.5).otherwise(0.5)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), text.safe_filename(name).alias("filename"), (F.size(predicates.missing_keys(metadata, ["title", "kind"])) == 0).alias("complete"), predicates.valid_context(context).alias("usable_context"),
        confidence.between(0, 1).alias("valid_response"), text.redacted(F.concat(F.lit("password=s3cret for "), "p_brand")).alias("log"),
    )


# ---- progress of processing


def _progress(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """A stream's rows put into a folder a case, batch by batch, and read back."""
    sink = new_folder(spark, "rooms")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "room").parquet(sink)  # a batch that comes again takes its own place

    rows.withColumn("room", F.coalesce(F.col("user_id") % 20, F.lit(-1))).writeStream.foreachBatch(keep).option("checkpointLocation", new_folder(spark, "rooms-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


@query("SELECT event_id, user_id, event_type, user_id % 20 AS room FROM events WHERE user_id % 20 IN (3, 7)")
def room_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What subscribers of two rooms see: the stream's sink has a folder for each room."""
    seen = _progress(spark, sf_dir, progress.read_events(spark, sf_dir).select("event_id", "user_id", "event_type"))
    return seen.where("room in (3, 7)").select("event_id", "user_id", "event_type", F.col("room").cast("long").alias("room"))


PAYLOADS_SQL = "SELECT event_id, user_id, ['chunking', 'embedding', 'stored', 'completed', 'failed'][list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type)] AS stage, round(100.0 * list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type) / 4, 2)::DOUBLE AS percent FROM events"


@query(f"{PAYLOADS_SQL} WHERE event_type IN ('view', 'click')")
def chunk_and_embedding_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir, ["view", "click"])


@query(f"{PAYLOADS_SQL} WHERE event_type IN ('signup', 'purchase')")
def stored_and_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(spark, sf_dir, ["signup", "purchase"])


@query("SELECT event_id, user_id, 'failed' AS stage, 'room ' || (user_id % 20) AS message FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, user_id, 'failed', 'everyone' FROM events WHERE event_type = 'error' AND event_id % 10 = 0")
def error_and_global_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors go to their room; every tenth is told to everyone too."""
    errors = progress.read_events(spark, sf_dir).where("event_type = 'error'")
    to = F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.concat(F.lit("room "), (F.col("user_id") % 20).cast("string")), F.lit("everyone"))).otherwise(F.array(F.concat(F.lit("room "), (F.col("user_id") % 20).cast("string")))))
    return _progress(spark, sf_dir, errors.select("event_id", "user_id", F.lit("failed").alias("stage"), to.alias("message"))).select("event_id", "user_id", "stage", "message")


def _stages(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    place = F.array_position(F.array(*(F.lit(s) for s in progress.STAGES)), F.col("event_type"))
    stage = F.element_at(F.array(*(F.lit(s) for s in ("chunking", "embedding", "stored", "completed", "failed"))), place.cast("int"))
    events = progress.read_events(spark, sf_dir).where(F.col("event_type").isin(kinds))
    return _progress(spark, sf_dir, events.select("event_id", "user_id", stage.alias("stage"), F.round(place * 100 / 4, 2).alias("percent"))).select("event_id", "user_id", "stage", "percent")


@query("WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS last, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id) SELECT user_id, CASE last WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status, n, errors FROM l")
def job_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job's status by its last event, with counters, from a stream in complete mode."""
    key = F.struct("ts", "event_id")
    jobs = progress.read_events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_type", key).alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    sink = new_folder(spark, "jobs")
    jobs.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(sink)).option("checkpointLocation", new_folder(spark, "jobs-state")).trigger(availableNow=True).start().awaitTermination()
    status = F.when(F.col("last") == "error", "failed").when(F.col("last") == "purchase", "completed").otherwise("processing")
    return spark.read.parquet(sink).select("user_id", status.alias("status"), "n", "errors")


@query("SELECT user_id % 20 AS folder, count(*) AS files, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS done, round(100.0 * count(*) FILTER (event_type IN ('error', 'purchase')) / count(*), 4)::DOUBLE AS percent FROM events GROUP BY 1")
def folder_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of folders, file by file as the stream brings them; batches are summed when they are read."""
    one = lambda kind: F.when(F.col("event_type") == kind, 1).otherwise(0)
    rows = progress.read_events(spark, sf_dir).select("user_id", one("error").alias("failed"), one("purchase").alias("done"))
    summed = _progress(spark, sf_dir, rows).groupBy(F.col("room").cast("long").alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum("failed").alias("failed"), F.sum("done").alias("done"))
    return summed.withColumn("percent", F.round(100 * (F.col("failed") + F.col("done")) / F.col("files"), 4))


@query("SELECT doc_id AS id FROM documents WHERE NOT (source IN ('src1', 'src7') OR lang = 'de')")
def untagged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of kept results when three tags are invalidated: an entry goes if any of its tags is among them."""
    tags = F.array("source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").where(~F.arrays_overlap(tags, F.array(F.lit("src1"), F.lit("src7"), F.lit("de")))).select(F.col("doc_id").alias("id"))


# ---- routing of searches


@query("SELECT o_orderkey AS question_id, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['case_' || (o_custkey % 5)] WHEN 1 THEN ['firm'] ELSE ['case_' || (o_custkey % 5), 'firm'] END) AS store FROM orders")
def routed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which stores each question asks."""
    orders = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("case_"), (F.col("o_custkey") % 5).cast("string"))
    cases = orders.select(name.alias("store")).distinct().select("store", F.col("store").alias("case_name"), F.lit("case").alias("kind"))
    stores_ = cases.unionByName(cases.limit(1).select(F.lit("firm").alias("store"), F.lit("firm").alias("case_name"), F.lit("firm").alias("kind")))
    questions = orders.select(F.col("o_orderkey").alias("question_id"), name.alias("case_name"), pick("o_orderkey", ["case", "firm", "both"]).alias("reads"))
    return research.routed(questions, stores_).select("question_id", "store")
