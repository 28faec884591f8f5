"""More of the catalogue: pages of productions, motions, facts, migrations and reports, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import citing, hashing, legal, outlines, text, titles
from quillon.operators import boundaries, evidence, facts, migration, motions, partitions, retrieval, stats
from quillon.plans.catalog import corpus, points, query, table


def pick(n: str, values: list[str]) -> F.Column:
    """One of values by a number's remainder."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(n) % len(values) + 1).cast("int"))


def pick_sql(n: str, values: list[str]) -> str:
    quoted = (" || chr(10) || ".join(f"'{part}'" for part in v.split("\n")) for v in values)
    return f"[{', '.join(quoted)}][CAST(({n}) % {len(values)} AS INTEGER) + 1]"


# ---- pages of productions: each customer's orders are the pages of one file

SIGNS = ["From: a@x.org\nTo: b@y.org\nSubject: load", "FORM A-1\nPlease complete", "plain words", "DEPOSITION of a driver", "plain again", "MAINTENANCE log"]
PAGES_SQL = f"""pg AS (SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS page, o_orderkey,
{pick_sql('o_orderkey', SIGNS)} || chr(10) || repeat('word ', CAST(o_orderkey % 5 AS INTEGER) * 150) || chr(10) || 'Page ' || (o_orderkey % 3 + 1) || ' of 9' || chr(10) || 'DEF' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') AS text FROM orders),
ft AS (SELECT *, o_orderkey % 6 AS sign, least(1.0, length(text) / 3000.0) AS density, o_orderkey % 3 + 1 AS number, o_orderkey AS bates FROM pg),
w AS (SELECT *, lag(bates) OVER d AS was_bates, lag(density) OVER d AS was_density, lag(number) OVER d AS was_number FROM ft WINDOW d AS (PARTITION BY doc_id ORDER BY page)),
hard AS (SELECT doc_id, page, least(1.0, CASE WHEN sign IN (3, 5) THEN 0.4 ELSE 0 END + CASE WHEN sign = 0 THEN 0.5 ELSE 0 END + CASE WHEN sign = 1 THEN 0.4 ELSE 0 END + CASE WHEN was_bates IS NOT NULL AND bates <> was_bates + 1 THEN 0.3 ELSE 0 END) AS confidence FROM w),
soft AS (SELECT doc_id, page, CASE WHEN abs(density - was_density) > 0.3 THEN 0.2 ELSE 0 END + CASE WHEN was_number > 1 AND number = 1 THEN 0.4 ELSE 0 END AS confidence FROM w)"""


#: Pages that one task numbers and reads: tables of any size come in as many tasks as this asks for, so a task's memory doesn't grow with them.
PAGES_A_TASK = 25_000


def production_pages(spark: SparkSession, sf_dir: str, heads: list[str] | None = None) -> DataFrame:
    """(doc_id, page, text), under a line of heads if there are any."""
    page = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).alias("page")
    content = F.concat_ws("\n", pick("o_orderkey", SIGNS), F.repeat(F.lit("word "), (F.col("o_orderkey") % 5 * 150).cast("int")), F.concat(F.lit("Page "), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit(" of 9")), F.concat(F.lit("DEF"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")))
    if heads:
        content = F.concat(pick("o_orderkey", heads), F.lit("\n"), content)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    dealt = orders.repartition(orders.count() // PAGES_A_TASK + 1, "o_custkey")  # the count is in the files' footers
    return dealt.select(F.col("o_custkey").alias("doc_id"), page, content.alias("text"))


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, round(confidence, 6) AS confidence FROM hard WHERE confidence > 0.5")
def hard_boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.hard_boundaries(boundaries.page_features(production_pages(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, round(confidence, 6) AS confidence FROM soft WHERE confidence > 0.3")
def soft_boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.soft_boundaries(boundaries.page_features(production_pages(spark, sf_dir))).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {PAGES_SQL} SELECT doc_id, page, round(density, 6) AS density, CAST(number AS INTEGER) AS page_number, 'DEF' || lpad(CAST(bates AS VARCHAR), 7, '0') AS bates, sign = 0 AS is_email, sign = 1 AS is_form, sign IN (3, 5) AS has_marker FROM ft")
def page_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = boundaries.page_features(production_pages(spark, sf_dir))
    return out.select("doc_id", "page", F.round("density", 6).alias("density"), F.col("page_number").cast("int").alias("page_number"), "bates", "is_email", "is_form", "has_marker")


@query(f"""WITH {PAGES_SQL}, s AS (SELECT doc_id, page, max(confidence) AS c FROM (SELECT * FROM hard WHERE confidence > 0.5 UNION ALL SELECT * FROM soft WHERE confidence > 0.3) GROUP BY ALL),
k AS (SELECT doc_id, page AS start, coalesce(lead(page) OVER (PARTITION BY doc_id ORDER BY page) - 1, n - 1) AS stop, c, n FROM s JOIN (SELECT doc_id, count(*) AS n FROM pg GROUP BY 1) USING (doc_id)),
sure AS (SELECT * FROM k WHERE c >= 0.7), g AS (SELECT doc_id, start, stop, n, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), -1) AS before, lead(start) OVER (PARTITION BY doc_id ORDER BY start) AS next FROM sure)
SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end", 'document' AS kind FROM sure UNION ALL SELECT doc_id, CAST(before + 1 AS INTEGER), CAST(start - 1 AS INTEGER), 'fragment' FROM g WHERE start > before + 1
UNION ALL SELECT doc_id, CAST(stop + 1 AS INTEGER), CAST(n - 1 AS INTEGER), 'fragment' FROM g WHERE next IS NULL AND stop < n - 1
UNION ALL SELECT doc_id, 0, CAST(count(*) - 1 AS INTEGER), 'fragment' FROM pg WHERE doc_id NOT IN (SELECT doc_id FROM sure) GROUP BY doc_id""")
def production_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole production cut into documents by its pages' signs."""
    return boundaries.split_production(production_pages(spark, sf_dir)).select("doc_id", "start", "end", "kind")


SPANS_SQL = "sp AS (SELECT o_custkey AS doc_id, CAST(o_orderkey % 40 AS INTEGER) AS start, CAST(o_orderkey % 40 + o_orderkey % 4 AS INTEGER) AS stop, o_orderkey FROM orders)"


@query("SELECT o_custkey AS doc_id, CAST(min(o_orderkey % 40) AS INTEGER) AS start, CAST(max(o_orderkey % 40) AS INTEGER) AS \"end\", 0.9 AS confidence, 'letter' AS kind FROM orders GROUP BY 1")
def same_kind_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of one kind that all touch end as one document."""
    ends = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.min(F.col("o_orderkey") % 40).cast("int").alias("low"), F.max(F.col("o_orderkey") % 40).cast("int").alias("high"))
    parts = ends.select("doc_id", F.explode(F.sequence("low", "high")).alias("start")).select("doc_id", "start", F.col("start").alias("end"), F.lit(0.9).alias("confidence"), F.lit("letter").alias("kind"))
    return boundaries.reconcile_adjacent(parts)


@query("SELECT o_custkey AS doc_id, CAST(k * 10 AS INTEGER) AS start, CAST(CASE WHEN k < 2 THEN k * 10 + 9 ELSE 29 END AS INTEGER) AS \"end\", kind FROM (SELECT DISTINCT o_custkey FROM orders), (VALUES (0, 'memo'), (1, 'invoice'), (2, 'memo')) AS v(k, kind)")
def cut_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of different kinds that overlap a little: each ends where the next begins."""
    one = F.array(*(F.struct(F.lit(k * 10).alias("start"), F.lit(min(k * 10 + 11, 29)).alias("end"), F.lit(kind).alias("kind")) for k, kind in enumerate(("memo", "invoice", "memo"))))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id")).distinct().select("doc_id", F.explode(one).alias("b")).select("doc_id", "b.*").withColumn("confidence", F.lit(0.8))
    return boundaries.reconcile_adjacent(rows).select("doc_id", "start", "end", "kind")


@query("SELECT o_custkey AS doc_id, CAST(s AS INTEGER) AS section, CAST(ceil(pages / 25.0) AS INTEGER) AS sections, CAST((s - 1) * 25 AS INTEGER) AS first, CAST(least(s * 25, pages) AS INTEGER) AS last FROM (SELECT o_custkey, count(*) * 7 AS pages, unnest(range(1, CAST(ceil(count(*) * 7 / 25.0) AS BIGINT) + 1)) AS s FROM orders GROUP BY 1)")
def large_document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundaries.large_sections(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg((F.count(F.lit(1)) * 7).alias("pages"))).select("doc_id", "section", "sections", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


@query(f"WITH {PAGES_SQL} SELECT doc_id, 'DEF' || lpad(CAST(min(bates) AS VARCHAR), 7, '0') AS first_bates, 'DEF' || lpad(CAST(max(bates) AS VARCHAR), 7, '0') AS last_bates FROM ft GROUP BY doc_id")
def bates_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last number on a document's pages."""
    pages = boundaries.page_features(production_pages(spark, sf_dir))
    return pages.groupBy("doc_id").agg(F.min_by("bates", "page").alias("first_bates"), F.max_by("bates", "page").alias("last_bates"))


HEADS = ["NOTICE OF HEARING\nbody", "a short line that names nobody at all\nbody", "x\ny", "Police Report no 5\nbody", "\n\nMOTION TO COMPEL ANSWERS"]
HEAD_TITLES = ["Notice Of Hearing", "a short line that names nobody at all", None, "Police Report no 5", "Motion To Compel Answers"]


@query(f"SELECT o_orderkey AS id, [{', '.join('NULL' if t is None else repr(t) for t in HEAD_TITLES)}][CAST(o_orderkey % 5 AS INTEGER) + 1] AS title FROM orders")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), titles.page_title(pick("o_orderkey", HEADS)).alias("title"))


SEGMENTS = ["MOTION FOR RELIEF\nbody of it", "body only RE: the lost trailer of May\nmore", "nothing here", "SUBJECT: brakes and tyres\nmore"]
SEGMENT_TITLES = ["MOTION FOR RELIEF", "the lost trailer of May", "Expert Report", "brakes and tyres"]


@query(f"SELECT o_orderkey AS id, {pick_sql('o_orderkey', SEGMENT_TITLES)} AS title FROM orders")
def segment_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), titles.segment_title(pick("o_orderkey", SEGMENTS), F.lit("expert_report")).alias("title"))


NUMBERS = ["Page 3 of 9", "page 12", "7 / 20", "- 4 -", "none"]


@query("SELECT o_orderkey AS id, [3, 12, 7, 4, NULL][CAST(o_orderkey % 5 AS INTEGER) + 1] AS number FROM orders")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.page_number(pick("o_orderkey", NUMBERS)).cast("int").alias("number"))


MARKERS = ["Affidavit of loss", "the invoice", "Trip Report", "letter", "Hours of Service log", "accident photo"]
MARKER_KINDS = ["AFFIDAVIT", "INVOICE", "TRIP_REPORT", None, "HOS_LOG", "ACCIDENT_INVESTIGATION_REPORT"]


@query(f"SELECT kind, count(*) AS n FROM (SELECT [{', '.join('NULL' if t is None else repr(t) for t in MARKER_KINDS)}][CAST(o_orderkey % 6 AS INTEGER) + 1] AS kind FROM orders) GROUP BY kind")
def marker_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(titles.marker_type(pick("o_orderkey", MARKERS)).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


KINDS = ["deposition", "expert_report", "medical_record", "motion"]


@query("SELECT kind, count(*) AS n FROM (SELECT ['expert_report', 'medical_record', 'other', 'motion'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS kind FROM orders) GROUP BY kind")
def hinted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    hint = titles.type_of_hint(pick("o_orderkey", ["Expert Report", "medical", "spreadsheet", "MOTION"]), KINDS)
    return table(spark, sf_dir, "orders").groupBy(hint.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'Dr. ' || s_name END AS author FROM supplier")
def document_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parties = F.array(F.col("s_name"), F.concat(F.lit("Dr. "), F.col("s_name")))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), titles.author(parties, pick("s_suppkey", ["deposition", "expert_report", "motion"])).alias("author"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 5 WHEN 0 THEN 'Motion to Dismiss' WHEN 1 THEN 'Motion for Summary Judgment' WHEN 2 THEN 'Deposition of ' || s_name WHEN 3 THEN 'Medical Records - ' || s_name ELSE 'Fuel Receipt' END AS title FROM supplier")
def generated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = pick("s_suppkey", ["c/x/mtd_final.pdf", "c/Summary.pdf", "c/d.pdf", "c/m.pdf", "c/fuel_receipt.pdf"])
    kind = pick("s_suppkey", ["motion", "motion", "deposition", "medical_record", "other"])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), titles.generated_title(path, kind, F.array("s_name")).alias("title"))


@query("SELECT kind, count(*) AS n FROM (SELECT ['deposition', 'motion', 'request_for_production', 'expert_report', 'unknown'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS kind FROM orders) GROUP BY kind")
def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick("o_orderkey", ["Deposition_of_X.pdf", "MOTION.pdf", "a request.pdf", "Report.pdf", "photo.pdf"])
    return table(spark, sf_dir, "orders").groupBy(titles.kind_of_file(name).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey AS id, 'invoice document. Pages ' || (o_orderkey % 9) || '-' || (o_orderkey % 9 + 3) || '. Confidence: 0.85' || CASE WHEN o_orderkey % 2 = 0 THEN '. Bates: DEF1-DEF' || o_orderkey ELSE '' END AS summary FROM orders")
def segment_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = lambda x: F.when(F.col("o_orderkey") % 2 == 0, x)
    summary = titles.segment_summary(F.lit("invoice"), F.col("o_orderkey") % 9, F.col("o_orderkey") % 9 + 3, F.lit(0.85), even(F.lit("DEF1")), even(F.concat(F.lit("DEF"), F.col("o_orderkey").cast("string"))))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), summary.alias("summary"))


@query("SELECT o_custkey AS doc_id, CASE WHEN count(*) > 1 THEN '1,' || count(*) ELSE '1' END AS pages FROM orders GROUP BY 1")
def segment_key_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("doc_id", F.array_join(titles.key_pages(F.col("n")), ",").alias("pages"))


# ---- citations and tables


def _results(spark: SparkSession, sf_dir: str, names: list[str], kinds: list[str], contents: list[str]) -> DataFrame:
    page = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 50)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), citing.of_result(pick("o_orderkey", names), pick("o_orderkey", contents), pick("o_orderkey", kinds), page).alias("citation"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 2 WHEN 0 THEN 'Ann Lee Dep.' || ' ' || (o_orderkey % 50) ELSE 'Poe Dep. 12:3-9' END AS citation FROM orders")
def deposition_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, ["Deposition of Ann Lee, vol 1", "Poe_depo"], ["deposition", "transcript"], ["she said so", "at 12:3-9 he said"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'Expert Report of Dr. Ray at ' || (o_orderkey % 50) ELSE 'Expert Report of Kim, Ex. 7' END AS citation FROM orders")
def expert_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, ["Dr. Ray_final", "Kim_report Ex. 7"], ["expert_report", "expert_report"], ["a", "b"])


@query("SELECT o_orderkey AS id, ['Ex. 4', 'Ex. 12 (Trip Log)', 'Ex. ?'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS citation FROM orders")
def exhibit_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick("o_orderkey", ["exhibit", "trip_log", "exhibit"])
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), citing.exhibit(pick("o_orderkey", ["Exhibit 4", "file 12", "file"]), kind).alias("citation"))


@query("SELECT o_orderkey AS id, ['Email from joe dated 1/2/2020', 'Company Policy (3/4/2021)', 'Company Manual', 'Gate Memo'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS citation FROM orders")
def internal_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, ["m1", "p1", "q1", "gate_memo"], ["email", "policy", "manual", "memo"], ["From: joe, on 1/2/2020", "as of 3/4/2021", "no day", "no day"])


@query("SELECT o_orderkey AS id, 'Fuel Receipt' || CASE WHEN o_orderkey % 2 = 0 THEN ' at ' || (o_orderkey % 50) ELSE '' END || CASE WHEN o_orderkey % 2 = 1 THEN ' (5/6/2022)' ELSE '' END AS citation FROM orders")
def document_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir, ["fuel_receipt"] * 2, ["receipt"] * 2, ["nothing", "paid 5/6/2022"])


@query("SELECT o_orderkey AS id, 'Doe v. Roe, 12 F.3d ' || (o_orderkey % 900) || CASE WHEN o_orderkey % 2 = 0 THEN ', 15' ELSE '' END || ' (1999)' || CASE WHEN o_orderkey % 3 = 0 THEN ' (en banc)' ELSE '' END AS citation FROM orders")
def case_law_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    cited = citing.case_law(F.lit("Doe v. Roe"), F.concat(F.lit("12 F.3d "), (n % 900).cast("string")), F.lit("1999"), F.when(n % 2 == 0, "15"), F.when(n % 3 == 0, "en banc"))
    return table(spark, sf_dir, "orders").select(n.alias("id"), cited.alias("citation"))


@query("SELECT p_partkey AS id, repeat('    ', CAST(p_size % 3 AS INTEGER)) || p_name || ' ' || repeat('.', CAST(greatest(3, 70 - 4 * (p_size % 3) - length(p_name) - length(CAST(p_partkey AS VARCHAR))) AS INTEGER)) || ' ' || p_partkey AS line FROM part")
def contents_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), citing.contents_line(F.col("p_name"), F.col("p_partkey"), (F.col("p_size") % 3 + 1).cast("int")).alias("line"))


@query("SELECT s_suppkey AS id, '  1  ' || s_name || chr(10) || chr(10) || '  2  ' || s_suppkey AS numbered FROM supplier")
def numbered_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat_ws("\n", F.col("s_name"), F.lit(""), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), citing.numbered_lines(content).alias("numbered"))


@query("SELECT doc_id AS id, md5('[Document Context: ' || lang || ' of ' || source || ']' || chr(10) || chr(10) || text) AS digest FROM documents")
def contextual_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.md5(citing.with_context(F.col("text"), F.concat("lang", F.lit(" of "), "source"))).alias("digest"))


@query("SELECT p_brand AS class, string_agg(p_name, '; ' ORDER BY p_name, p_partkey) AS authorities FROM part GROUP BY 1")
def authorities_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of authorities: each class's names in order."""
    held = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("class")).agg(F.sort_array(F.collect_list(F.struct("p_name", "p_partkey"))).alias("a"))
    return held.select("class", F.array_join(F.transform("a", lambda x: x["p_name"]), "; ").alias("authorities"))


# ---- motions: orders are motions, their lines grouped by part the sections

SECTION_KINDS = ["argument", "introduction", "facts", "conclusion", "legal_standard", "prayer"]
HEADINGS = ["First point", "Introduction", "The facts", "Conclusion", "Standard", "Prayer for relief"]
SECTIONS_SQL = f"sc AS (SELECT l_orderkey AS motion_id, l_partkey AS ordinal, {pick_sql('l_partkey', SECTION_KINDS)} AS kind, {pick_sql('l_partkey', HEADINGS)} AS heading, sum(CAST(l_quantity AS BIGINT)) AS words, list_sort(list_distinct(list(l_suppkey))) AS citations FROM lineitem GROUP BY ALL)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("motion_id"), F.col("l_partkey").alias("ordinal")).agg(F.sum(F.col("l_quantity").cast("long")).alias("words"), F.array_sort(F.collect_set("l_suppkey")).alias("citations"))
    return grouped.withColumn("kind", pick("ordinal", SECTION_KINDS)).withColumn("heading", pick("ordinal", HEADINGS))


@query(f"WITH {SECTIONS_SQL} SELECT motion_id, ordinal, kind FROM sc QUALIFY kind NOT IN ('conclusion', 'prayer', 'introduction') OR row_number() OVER (PARTITION BY motion_id, kind ORDER BY ordinal) = 1")
def sections_kept_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motions.keep_first_sections(sections(spark, sf_dir)).select("motion_id", "ordinal", "kind")


RANK_SQL = "list_position(['introduction', 'facts', 'legal_standard', 'argument', 'conclusion', 'prayer'], kind)"


@query(f"WITH {SECTIONS_SQL}, r AS (SELECT *, {RANK_SQL} AS rank FROM sc) SELECT motion_id, ordinal, kind FROM r QUALIFY rank < max(rank) OVER (PARTITION BY motion_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def section_order_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motions.order_issues(sections(spark, sf_dir))


@query(f"WITH {SECTIONS_SQL} SELECT motion_id, kind FROM (SELECT DISTINCT motion_id FROM sc), (VALUES ('introduction'), ('argument'), ('conclusion')) AS v(kind) EXCEPT SELECT motion_id, kind FROM sc")
def missing_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motions.missing_kinds(sections(spark, sf_dir), ["introduction", "argument", "conclusion"])


@query(f"""WITH {SECTIONS_SQL}, k AS (SELECT *, {RANK_SQL} AS rank FROM sc QUALIFY kind = 'argument' OR row_number() OVER (PARTITION BY motion_id, kind ORDER BY ordinal) = 1)
SELECT motion_id, kind, row_number() OVER (PARTITION BY motion_id ORDER BY rank) AS position, CAST(words AS BIGINT) AS words, cites FROM (SELECT motion_id, kind, rank, sum(words) AS words, array_to_string(list_sort(list_distinct(flatten(list(citations)))), ',') AS cites FROM k GROUP BY ALL)""")
def regrouped_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motions.regrouped(sections(spark, sf_dir)).withColumn("cites", F.array_join("citations", ",")).drop("citations")


@query(f"""WITH {SECTIONS_SQL}, s AS (SELECT motion_id, ordinal, words, CASE kind WHEN 'introduction' THEN 0.07 WHEN 'conclusion' THEN 0.07 WHEN 'prayer' THEN 0.06 END::DOUBLE AS share FROM sc)
SELECT motion_id, ordinal, CAST(least(greatest(floor(round(CASE WHEN share IS NOT NULL THEN 5000 * share ELSE 5000 * (1 - coalesce(sum(share) OVER m, 0)) * words / sum(CASE WHEN share IS NULL THEN words END) OVER m END, 6)), 100), 3000) AS BIGINT) AS budget FROM s WINDOW m AS (PARTITION BY motion_id)""")
def word_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motions.word_budget(sections(spark, sf_dir).withColumnRenamed("words", "weight"), 5000).select("motion_id", "ordinal", "budget")


@query(f"WITH {SECTIONS_SQL} SELECT motion_id, ordinal, (row_number() OVER (PARTITION BY motion_id ORDER BY ordinal) - 1) // 3 AS batch FROM sc")
def outline_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motions.batches(sections(spark, sf_dir)).select("motion_id", "ordinal", "batch")


@query(f"WITH {SECTIONS_SQL} SELECT motion_id, ordinal, coalesce(string_agg(heading, '|') OVER (PARTITION BY motion_id ORDER BY ordinal ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS summaries FROM sc")
def recent_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = motions.recent_context(sections(spark, sf_dir).withColumnRenamed("heading", "summary"))
    return out.select("motion_id", "ordinal", F.array_join("summaries", "|").alias("summaries"))


@query("""SELECT o_orderkey AS id, round((least(words / 100.0, 1) * 30 + CASE WHEN o_orderkey % 2 = 0 THEN 25 ELSE 12.5 END + CASE WHEN o_orderkey % 3 = 0 THEN 25 ELSE 0 END + CASE WHEN o_orderkey % 2 = 0 THEN 4 ELSE 2 END) / 100, 6) AS confidence
FROM (SELECT o_orderkey, o_orderkey % 130 AS words FROM orders)""")
def section_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    content = F.concat(F.when(n % 2 == 0, "However the brakes failed; therefore speed").otherwise("Moreover the brakes failed"), F.when(n % 3 == 0, " under 49CFR395").otherwise(""))
    got = motions.section_confidence(content, n % 130, F.lit(100), F.array(F.lit("brakes of a truck"), F.lit("speed in rain")), F.array(F.lit("49 CFR 395")))
    return table(spark, sf_dir, "orders").select(n.alias("id"), F.round(got, 6).alias("confidence"))


@query("""SELECT draft_id, round(least(1.0, found / greatest(required, 1)), 6) AS accuracy, round(strength, 6) AS strength, CASE WHEN coherence > 0.7 THEN 0.9 ELSE 0.6 END AS consistency,
CAST(floor(round((coherence * 0.4 + least(1.0, found / greatest(required, 1)) * 0.3 + strength * 0.3) * 10, 9)) AS BIGINT) AS readiness
FROM (SELECT l_orderkey AS draft_id, max(l_orderkey % 10 / 10.0)::DOUBLE AS coherence, sum(l_linenumber)::DOUBLE AS required, sum(l_linenumber % 3)::DOUBLE AS found, avg(l_discount::DOUBLE * 10) AS strength FROM lineitem GROUP BY 1)""")
def draft_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft_id"), (F.col("l_orderkey") % 10 / 10.0).alias("coherence"), F.col("l_linenumber").alias("required"), (F.col("l_linenumber") % 3).alias("found"), (F.col("l_discount").cast("double") * 10).alias("confidence"))
    return motions.readiness(rows).select("draft_id", F.round("accuracy", 6).alias("accuracy"), F.round("strength", 6).alias("strength"), "consistency", "readiness")


@query("SELECT l_orderkey AS id, CAST(greatest(15, least(40, floor((count(*) * 3 + sum(l_linenumber) * 1.5) * [1.5, 0.8, 1.0][CAST(l_orderkey % 3 AS INTEGER) + 1]))) AS BIGINT) AS pages FROM lineitem GROUP BY l_orderkey")
def outline_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_linenumber").alias("subs"))
    return grouped.select(F.col("l_orderkey").alias("id"), motions.page_estimate(F.col("n"), F.col("subs"), pick("l_orderkey", ["summary_judgment", "compel", "dismiss"])).alias("pages"))


@query("SELECT p_size AS section_id, p_partkey AS ordinal, p_name AS point FROM part WHERE NOT contains(lower(p_brand || p_type), lower(substring(p_name, 1, 5))) QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) <= 7")
def unused_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("section_id"), F.col("p_partkey").alias("ordinal"), F.col("p_name").alias("point"), F.concat("p_brand", "p_type").alias("content"))
    return motions.unused_content(rows, prefix=5)


@query("WITH a AS (SELECT conv_id, min(turn) AS head FROM conversations WHERE turn % 5 = 1 GROUP BY 1), z AS (SELECT c.conv_id, min(turn) AS stop FROM conversations c JOIN a USING (conv_id) WHERE turn % 5 = 3 AND turn > head GROUP BY 1) SELECT c.conv_id AS doc_id, turn AS line FROM conversations c JOIN a USING (conv_id) LEFT JOIN z USING (conv_id) WHERE turn > head AND (stop IS NULL OR turn < stop)")
def lines_between_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("turn") % 5 == 1, "STATEMENT OF FACTS").when(F.col("turn") % 5 == 3, "ARGUMENT").otherwise("words")
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), content.alias("content"))
    return motions.between_headings(lines, "statement of facts", "argument").select("doc_id", "line")


# ---- research, evidence and reports


@query("SELECT l_suppkey AS type, l_orderkey * 10 + l_linenumber AS id, max(l_discount) AS score FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_discount) DESC, l_orderkey * 10 + l_linenumber) <= 3")
def top_three_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("section_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id")).agg(F.max("l_discount").alias("score"))
    return evidence.best_for_sections(scored, 3).select(F.col("section_id").alias("type"), F.col("evidence_id").alias("id"), "score")


@query("SELECT l_partkey AS id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def best_per_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result's best score, the 15 best of all."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_extendedprice").alias("score")).orderBy(F.desc("score"), "id").limit(15)


EVIDENCE = ["deposition", "exhibit", "regulatory", "document", "unheard of"]


@query("SELECT o_orderkey AS id, round([1.0, 0.9, 0.7, 0.5, 0.5][CAST(o_orderkey % 5 AS INTEGER) + 1] + CASE WHEN o_orderkey % 2 = 0 THEN 0.1 ELSE 0 END, 6)::DOUBLE AS priority FROM orders")
def evidence_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = F.when(F.col("o_orderkey") % 2 == 0, "X Dep. 1:2").otherwise("X Dep. 1")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(titles.evidence_priority(pick("o_orderkey", EVIDENCE), cited), 6).alias("priority"))


@query("SELECT o_custkey AS case_id, ['deposition', 'exhibit', 'regulatory', 'document', 'unheard of'][CAST(o_orderkey % 5 AS INTEGER) + 1] AS bucket, count(*) AS n, round(avg(CAST(o_totalprice AS DOUBLE)), 6) AS mean_score FROM orders GROUP BY ALL")
def research_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a case routed to buckets by type."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id"), pick("o_orderkey", EVIDENCE).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("o_totalprice").cast("double")), 6).alias("mean_score"))


@query("SELECT o_custkey AS case_id, concat_ws(', ', CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN count(*) FILTER (o_orderstatus = 'F') || ' facts' END, CASE WHEN count(*) FILTER (o_orderstatus = 'O') > 0 THEN count(*) FILTER (o_orderstatus = 'O') || ' opinions' END) AS summary FROM orders GROUP BY 1")
def research_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts that aren't zero, as text."""
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    shown = lambda s, name: F.when(n(s) > 0, F.concat(n(s).cast("string"), F.lit(f" {name}")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.concat_ws(", ", shown("F", "facts"), shown("O", "opinions")).alias("summary"))


@query("SELECT l_suppkey AS argument_id, count(*) AS items, round(avg(CAST(l_discount AS DOUBLE)) * 100, 4) AS mean_percent, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS types FROM lineitem GROUP BY 1")
def evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("argument_id")).agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.col("l_discount").cast("double")) * 100, 4).alias("mean_percent"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("types"))
    return grouped


@query("SELECT p_partkey AS id, array_to_string(list_filter(['negligence', 'liability', 'duty', 'breach', 'damages', 'causation'], lambda t: contains('duty of care, ' || CASE WHEN p_partkey % 2 = 0 THEN 'damages' ELSE 'breach' END || ', liability', t))[1:5], ',') AS terms FROM part")
def key_terms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("Duty of Care, "), F.when(F.col("p_partkey") % 2 == 0, "damages").otherwise("Breach"), F.lit(", liability"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(titles.key_terms(content), ",").alias("terms"))


@query("SELECT o_custkey AS case_id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey AS event_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 15")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 15 events a case in the order in which they were found."""
    nth = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("nth", nth).where("nth <= 15").select(F.col("o_custkey").alias("case_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").alias("event_id"))


@query("SELECT question_id, query_no, CAST(5 - query_no AS INTEGER) AS priority FROM (SELECT o_orderkey AS question_id, unnest([0, 1, 2]) AS query_no FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10)) ORDER BY priority DESC, question_id LIMIT 20")
def question_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries for each of ten questions, the first ones of all before the second ones, 20 in all: the feature is a short queue."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("question_id")).orderBy("question_id").limit(10)
    queue = asked.select("question_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("query_no"))
    return queue.withColumn("priority", 5 - F.col("query_no")).orderBy(F.desc("priority"), "question_id").limit(20)


@query("WITH c AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS cited FROM lineitem) SELECT id, count(*) FILTER (cited IN (SELECT ps FROM (SELECT p_partkey AS ps FROM part WHERE p_size > 25))) AS known, count(*) AS n FROM c GROUP BY id")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a section's citations are among the known authorities."""
    cited = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("cited")).distinct()
    known = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("cited"), F.lit(True).alias("known"))
    return cited.join(known, "cited", "left").groupBy("id").agg(F.count("known").alias("known"), F.count(F.lit(1)).alias("n"))


#: Facts that one task joins, and rows of exhibits up to which they are broadcast. Of 2 ** FACTS_POWER facts as they come those of an exhibit are one
#: group, which meets ROWS_TOGETHER rows of it at once: Spark holds what comes of one such pair, 258,048 rows at most.
FACTS_A_TASK, EXHIBIT_ROWS, FACTS_POWER, ROWS_TOGETHER = 25_000, 500_000, 10, 252


@query("SELECT o_orderkey AS fact_id, 'EX_' || (o_orderkey % 40) AS exhibit_id, s_suppkey AS exhibit_row FROM orders JOIN supplier ON s_suppkey % 40 = o_orderkey % 40")
def exhibit_fact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that name an exhibit, joined with the exhibit's rows by its normalised id. A task has the facts of few exhibits, and they meet an
    exhibit's rows a few at a time, so that the result repeats what stands shortly before: Parquet compresses pages of 20,000 rows alone."""
    orders, suppliers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier")
    named = orders.select(F.col("o_orderkey").alias("fact_id"), legal.exhibit_id(F.concat(F.lit("Exhibit "), (F.col("o_orderkey") % 40).cast("string"))).alias("exhibit_id"))
    block = F.shiftright(F.monotonically_increasing_id(), FACTS_POWER)
    dealt = named.withColumn("block", block).repartitionByRange(orders.count() // FACTS_A_TASK + 1, "exhibit_id", "block")
    facts_ = dealt.groupBy("exhibit_id", "block").agg(F.collect_list("fact_id").alias("facts"))
    rows = suppliers.select(F.col("s_suppkey").alias("exhibit_row"), legal.exhibit_id(F.concat(F.lit("EXH "), (F.col("s_suppkey") % 40).cast("string"))).alias("exhibit_id"))
    part = F.floor((F.row_number().over(Window.partitionBy("exhibit_id").orderBy("exhibit_row")) - 1) / ROWS_TOGETHER)
    parts = rows.withColumn("part", part).groupBy("exhibit_id", "part").agg(F.collect_list("exhibit_row").alias("rows"))
    few = suppliers.count() <= EXHIBIT_ROWS
    met = facts_.join(F.broadcast(parts) if few else parts, "exhibit_id").sortWithinPartitions("exhibit_id", "part")
    return met.select("exhibit_id", "rows", F.explode("facts").alias("fact_id")).select("fact_id", "exhibit_id", F.explode("rows").alias("exhibit_row"))


@query("SELECT l_suppkey AS firm, count(DISTINCT l_orderkey) AS cases, count(DISTINCT l_partkey) AS issues, round(avg(CAST(l_quantity AS DOUBLE)), 4) AS mean_size FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_orderkey) > 1")
def cross_case_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("firm")).agg(F.count_distinct("l_orderkey").alias("cases"), F.count_distinct("l_partkey").alias("issues"), F.round(F.avg(F.col("l_quantity").cast("double")), 4).alias("mean_size"))
    return grouped.where("cases > 1")


# ---- stores, logs and partitions


@query("SELECT source AS collection, count(*) AS points, round(count(*) * 0.01, 6)::DOUBLE AS size_mb, round(sum(strlen(text)) / 1024.0 / count(*), 4)::DOUBLE AS mean_kb FROM documents GROUP BY 1")
def collection_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("collection")).agg(F.count(F.lit(1)).alias("points"), F.round(F.count(F.lit(1)) * 0.01, 6).alias("size_mb"), F.round(F.sum(F.octet_length("text")) / 1024 / F.count(F.lit(1)), 4).alias("mean_kb"))


@query("SELECT o_custkey AS collection, CAST(date_diff('day', min(d), max(d)) AS INTEGER) AS span_days, round(count(*) / greatest(1, date_diff('day', min(d), max(d))), 6)::DOUBLE AS per_day FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE ELSE o_orderdate::DATE + 10 END AS d FROM orders) GROUP BY 1")
def temporal_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span and growth by the first of several date fields that is given."""
    first = F.when(F.col("o_orderkey") % 3 == 0, F.to_date("o_orderdate"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("collection"), F.coalesce(first, F.date_add(F.to_date("o_orderdate"), 10)).alias("d"))
    span = F.datediff(F.max("d"), F.min("d"))
    return rows.groupBy("collection").agg(span.alias("span_days"), F.round(F.count(F.lit(1)) / F.greatest(F.lit(1), span), 6).alias("per_day"))


@query("WITH h AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY 1) SELECT user_id, hits, misses, round(CASE WHEN hits + misses = 0 THEN 0 ELSE hits / (hits + misses) END, 6)::DOUBLE AS hit_rate FROM h")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t: F.count_if(F.col("event_type") == t)
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(n("view").alias("hits"), n("error").alias("misses"))
    return rows.withColumn("hit_rate", F.round(F.when(F.col("hits") + F.col("misses") == 0, 0.0).otherwise(F.col("hits") / (F.col("hits") + F.col("misses"))), 6))


@query("SELECT event_type AS step, count(*) AS n, round(sum(value), 4) AS total, round(100 * sum(value) / (SELECT sum(value) FROM events), 4) AS percent FROM events GROUP BY 1")
def step_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("x"))
    share = F.sum("x").over(Window.partitionBy())  # a row a step
    return rows.select("step", "n", F.round("x", 4).alias("total"), F.round(100 * F.col("x") / share, 4).alias("percent"))


@query("SELECT event_type AS step, max(value) AS longest FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def slowest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("step")).agg(F.max("value").alias("longest")).orderBy(F.desc("longest"), "step").limit(3)


@query("SELECT event_id, value AS median FROM (SELECT event_id, value, row_number() OVER (ORDER BY value, event_id) AS k, count(*) OVER () AS n FROM events) WHERE k = n // 2 + 1")
def median_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of all events' values, and the first event in order that has it and stands at its place."""
    events = table(spark, sf_dir, "events")
    median = stats.median_of(events, "value")
    below = events.join(F.broadcast(median), F.col("value") < F.col("median")).count()
    return events.join(F.broadcast(median), F.col("value") == F.col("median")).orderBy("event_id").offset(events.count() // 2 - below).limit(1).select("event_id", "median")


@query("SELECT count(*) AS documents, CAST(sum(greatest(1, length(text) // 1200)) AS BIGINT) AS chunks, count(*) - count(DISTINCT sha256(text)) AS duplicates FROM documents")
def migration_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.estimates(table(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.sha2("text", 256).alias("content_hash")))


TITLED = ["Exhibit A", "Answer with attachment", "Amended response", "Letter"]


@query("SELECT CAST(sum([1, 2, 2, 0][CAST(o_orderkey % 4 AS INTEGER) + 1]) AS BIGINT) AS relations FROM orders")
def expected_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(F.sum(migration.expected_relations(pick("o_orderkey", TITLED))).alias("relations"))


@query("SELECT c_custkey % 4 AS kind, count(*) AS unused FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1")
def unused_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What nothing used (an anti-join with the log of uses), counted by kind."""
    used = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(used, "c_custkey", "left_anti").groupBy((F.col("c_custkey") % 4).alias("kind")).agg(F.count(F.lit(1)).alias("unused"))


@query("SELECT o_orderkey AS id, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS rank_share, round(cume_dist() OVER w, 6) AS below FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def rank_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("rank_share"), F.round(F.cume_dist().over(w), 6).alias("below"))


@query("SELECT o_orderkey AS id, CAST(sum(o_orderkey % 7) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_three, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM orders")
def framed_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.sum(F.col("o_orderkey") % 7).over(w.rowsBetween(-2, 0)).alias("last_three"), F.count(F.lit(1)).over(w.rangeBetween(-100, 0)).alias("near"))


# ---- sparse vectors and chunks


@query("""WITH t AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM documents),
c AS (SELECT id, len(w) AS n, len(list_filter(w, lambda x: x = 'and')) AS a, len(list_filter(w, lambda x: x = 'der')) AS b FROM t)
SELECT id, round(CASE WHEN a > 0 THEN ln(1000 / (1 + a)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / 1000.0)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1000 / (1 + b)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / 1000.0)) ELSE 0 END, 6)::DOUBLE AS score FROM c""")
def bm25_fixed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.col("content")), "[^a-z0-9]+"), lambda w: w != "")
    return corpus(spark, sf_dir).select("id", F.round(retrieval.bm25_fixed(["and", "der"], words), 6).alias("score"))


@query("SELECT vec_id AS id, array_to_string(list_sort([CAST(vec_id % 7 AS BIGINT), 3 + vec_id % 5, 100]), ',') AS indices FROM embeddings")
def sparse_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of indices to weights as two lists in the order of the indices."""
    n = F.col("id")
    entries = F.array_sort(F.array(*(F.struct(i.cast("long").alias("i"), F.lit(1.0).alias("w")) for i in (n % 7, n % 5 + 3, F.lit(100)))))
    return points(spark, sf_dir).select("id", F.array_join(F.transform(entries, lambda e: e["i"].cast("string")), ",").alias("indices"))


@query("SELECT conv_id || '_' || turn AS chunk_id, sha256(coalesce(text, '')) AS chunk_hash, CAST(turn + 1 AS INTEGER) AS page, CASE WHEN role = 'user' THEN 'question' ELSE 'paragraph' END AS kind FROM conversations")
def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("text", F.lit(""))
    row = migration.chunk_row(F.col("conv_id"), F.col("turn"), content, (F.col("turn") + 1).cast("int"), F.when(F.col("role") == "user", "question"))
    return table(spark, sf_dir, "conversations").select(row.alias("r")).select("r.chunk_id", "r.chunk_hash", "r.page", "r.kind")


@query("SELECT doc_id AS id, CASE WHEN len(s) >= 2 THEN trim(s[1]) || '... ' || trim(s[-1]) ELSE trim(s[1]) END AS summary FROM (SELECT doc_id, string_split_regex(substring(text, 1, 200), '[.!?]+[ \\n]+') AS s FROM documents)")
def chunk_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk's first and last sentence; chunks are the first 200 characters of texts."""
    parts = F.split(F.left("text", F.lit(200)), r"[.!?]+[ \n]+", -1)
    shown = F.when(F.size(parts) >= 2, F.concat(F.trim(parts[0]), F.lit("... "), F.trim(F.element_at(parts, -1)))).otherwise(F.trim(parts[0]))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), shown.alias("summary"))


# ---- facts, registries, grants: requests against tables


@query("""WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey % 20 END AS case_name, 'fact ' || (o_orderkey % 50) AS content FROM orders)
SELECT id, CASE WHEN case_name IS NULL THEN 'rejected' WHEN content = 'fact 3' AND case_name < 10 OR row_number() OVER (PARTITION BY case_name, content ORDER BY id) > 1 THEN 'duplicate' ELSE 'created' END AS outcome FROM n""")
def fact_creations(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    new = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 20).alias("case_name"), F.concat(F.lit("fact "), (F.col("o_orderkey") % 50).cast("string")).alias("content"))
    state = spark.range(10).select(F.col("id").alias("case_name"), F.lit(" FACT 3").alias("content"))
    return facts.created(state, new)


def _fact_state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    state = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("open").alias("category"), F.lit(False).alias("reviewed"), (F.col("c_custkey") % 9 == 0).alias("deleted"))
    action = pick("o_orderkey", ["review", "categorize", "delete", "shred"])
    return state, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), action.alias("action"), F.concat(F.lit("kind "), (F.col("o_orderkey") % 5).cast("string")).alias("value"))


@query("""SELECT c_custkey AS id, coalesce(arg_max('kind ' || (o_orderkey % 5), o_orderkey) FILTER (o_orderkey % 4 = 1), 'open') AS category, coalesce(bool_or(o_orderkey % 4 = 0), false) AS reviewed,
c_custkey % 9 = 0 OR coalesce(bool_or(o_orderkey % 4 = 2), false) AS deleted FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def bulk_fact_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.apply_actions(*_fact_state(spark, sf_dir))


@query("SELECT o_custkey AS id, o_orderkey AS seq, o_orderkey % 4 <> 3 AND o_custkey % 9 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer) AS ok FROM orders")
def bulk_action_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.outcomes(*_fact_state(spark, sf_dir))


@query("""WITH f AS (SELECT md5(CAST(o_custkey AS VARCHAR)) AS hash, o_orderkey AS seq, 'p' || o_orderkey AS path, o_orderstatus AS case_name FROM orders)
SELECT hash, arg_min(path, seq) AS primary_path, arg_min(case_name, seq) AS primary_case, array_to_string((list(path ORDER BY seq))[2:], ',') AS duplicates, max(seq) AS last_found FROM f GROUP BY hash""")
def duplicate_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.locations(_found(spark, sf_dir)).withColumn("duplicates", F.array_join("duplicates", ","))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.md5(F.col("o_custkey").cast("string")).alias("hash"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderstatus").alias("case_name"))


@query("SELECT o_orderstatus AS case_name, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def registry_without_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.without_case(_found(spark, sf_dir), "F").groupBy("case_name").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN length(n) > 50 THEN 'name too long' WHEN o_orderkey % 10 = 0 THEN 'no such firm' WHEN o_custkey % 30 = 1 OR row_number() OVER (PARTITION BY o_orderkey % 10, n ORDER BY o_orderkey) > 1 THEN 'name taken' ELSE 'created' END AS outcome
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 17 = 0 THEN repeat('x', 60) ELSE 'case ' || (o_custkey % 30) END AS n FROM orders)""")
def case_creations(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("o_orderkey") % 17 == 0, F.repeat(F.lit("x"), F.lit(60))).otherwise(F.concat(F.lit("case "), (F.col("o_custkey") % 30).cast("string")))
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), name.alias("name"), (F.col("o_orderkey") % 10).alias("firm_id"))
    firms = spark.range(10).select(F.col("id").alias("firm_id"), (F.col("id") > 0).alias("is_active"))
    known = spark.range(10).select(F.col("id").alias("firm_id"), F.lit("case 1").alias("name"))
    return facts.admitted_cases(asked, known, firms)


def _permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 20).alias("case_id"), pick("c_custkey", ["read", "write", "admin"]).alias("level"))


@query("""WITH p AS (SELECT c_custkey AS user_id, c_custkey % 20 AS case_id, ['read', 'write', 'admin'][CAST(c_custkey % 3 AS INTEGER) + 1] AS level FROM customer),
r AS (SELECT o_custkey AS user_id, o_orderkey % 20 AS case_id, ['read', 'write', 'root'][CAST(o_orderkey % 3 AS INTEGER) + 1] AS level, o_orderkey AS seq, o_orderkey % 150 AS who FROM orders),
g AS (SELECT user_id, case_id, arg_max(level, seq) AS level FROM r WHERE level <> 'root' AND EXISTS (SELECT 1 FROM p WHERE p.user_id = r.who AND p.case_id = r.case_id AND p.level = 'admin') GROUP BY ALL)
SELECT user_id, case_id, level FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = p.user_id AND g.case_id = p.case_id) UNION ALL SELECT * FROM g""")
def permission_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 20).alias("case_id"), pick("o_orderkey", ["read", "write", "root"]).alias("level"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 150).alias("by"))
    return facts.granted(_permissions(spark, sf_dir), asked)


@query("""WITH p AS (SELECT c_custkey AS user_id, c_custkey % 20 AS case_id FROM customer WHERE c_custkey % 3 > 0), r AS (SELECT o_custkey % 20 AS case_id, o_orderstatus AS status, o_custkey AS user_id, o_orderkey AS seq FROM orders)
SELECT c.case_id, coalesce(s.status, 'new') AS status FROM (SELECT unnest(range(0, 25)) AS case_id) c LEFT JOIN (SELECT case_id, arg_max(status, seq) AS status FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.user_id = r.user_id AND p.case_id = r.case_id) GROUP BY 1) s USING (case_id)""")
def case_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("case_id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("seq"))
    return facts.with_status(spark.range(25).select(F.col("id").alias("case_id"), F.lit("new").alias("status")), asked, _permissions(spark, sf_dir))


# ---- migrations


def _case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = pick("c_custkey", [" v. Acme Corp", " v Roe", ""])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.concat("c_name", mark).alias("case_name"))


NAMES_SQL = "cn AS (SELECT c_custkey AS case_id, c_name || [' v. Acme Corp', ' v Roe', ''][CAST(c_custkey % 3 AS INTEGER) + 1] AS case_name, c_name, ['Acme Corp', 'Roe', NULL][CAST(c_custkey % 3 AS INTEGER) + 1] AS opponent FROM customer)"


@query(f"WITH {NAMES_SQL} SELECT case_name, c_name AS client, opponent, 'MIGRATED_C' || lpad(CAST(row_number() OVER (ORDER BY case_name) AS VARCHAR), 4, '0') AS matter_number FROM cn")
def matters_from_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return migration.matters_and_cases(_case_names(spark, sf_dir))


@query(f"WITH {NAMES_SQL} SELECT count(*) FILTER (case_id % 5 <> 0) AS migrated, count(*) FILTER (case_id % 5 = 0) AS skipped FROM cn")
def migrated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of cases that are known, and how many were left behind."""
    names = _case_names(spark, sf_dir)
    moved, left = migration.migrated(names.select(F.col("case_id").alias("id"), "case_name"), names.where("case_id % 5 <> 0"))
    return moved.agg(F.count(F.lit(1)).alias("migrated")).crossJoin(left.agg(F.count(F.lit(1)).alias("skipped")))  # one row each


@query("""WITH h AS (SELECT doc_id, lang, text, min(doc_id) OVER (PARTITION BY text) AS document_id FROM documents) SELECT lang AS case_id, document_id, count(*) AS copies FROM h GROUP BY ALL""")
def normalised_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("case_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("kind"))
    return migration.normalised(docs)[2]


@query("SELECT min(doc_id) AS document_id, sha256(text) AS content_hash, length(text) AS size FROM documents GROUP BY text")
def normalised_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("case_id"), F.col("text").alias("content"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("kind"))
    return migration.normalised(docs)[0]


@query("SELECT min(doc_id) AS document_id, CASE WHEN min(doc_id) % 2 = 0 THEN 'T' || min(doc_id) ELSE 'Untitled' END AS title, 'other' AS kind FROM documents GROUP BY text")
def normalised_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("T"), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("case_id"), F.col("text").alias("content"), title.alias("title"), F.lit(None).cast("string").alias("kind"))
    return migration.normalised(docs)[1]


@query("SELECT c_custkey || '_chunks' AS name FROM customer WHERE c_custkey % 4 = 3")
def chunk_table_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = pick("c_custkey", ["_facts", "_timeline", "_registry_x", "_chunks"])
    return migration.chunk_tables(table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), ending).alias("name")))


# ---- names, hashes, predicates


@query("SELECT p_partkey AS id, substring(md5('store::' || array_to_string(list_sort([p_brand, p_type]), ',') || '::' || 'date'), 1, 16) AS signature FROM part")
def query_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hashing.query_signature(F.lit("store"), F.array("p_brand", "p_type"), F.array(F.lit("date"))).alias("signature"))


@query("SELECT p_partkey AS id, ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX', 'X', 'XI', 'XII'][CAST(p_partkey % 12 AS INTEGER) + 1] AS roman FROM part")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hashing.roman((F.col("p_partkey") % 12 + 1).cast("int")).alias("roman"))


@query("SELECT s_suppkey AS id, CAST(s_suppkey % 3 = 0 AS BOOLEAN) AS email, s_suppkey % 3 = 1 AS form, s_suppkey % 3 = 2 AS signed FROM supplier")
def start_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pick("s_suppkey", ["From: a@b.org\nTo: c@d.org\nSubject: x", "FORM 12-B\nname", "Respectfully,\nA. Lee"])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), text.is_email_start(t).alias("email"), text.is_form_start(t).alias("form"), text.has_signature(t).alias("signed"))


@query("SELECT o_custkey AS doc_id, count(*) FILTER (o_orderkey = was + 1) AS follow, count(*) FILTER (o_orderkey <> was + 1) AS broken FROM (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM orders) GROUP BY 1")
def sequential_bates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring pages whose numbers follow each other, and those whose don't."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.concat(F.lit("DEF"), F.lpad(F.col("o_orderkey").cast("string"), 7, "0")).alias("bates"))
    was = F.lag("bates").over(Window.partitionBy("doc_id").orderBy("o_orderkey"))
    step = pages.select("doc_id", (text.bates_value(F.col("bates")) - text.bates_value(was)).alias("step"))
    return step.groupBy("doc_id").agg(F.count_if(F.col("step") == 1).alias("follow"), F.count_if(F.col("step") != 1).alias("broken"))


@query("SELECT date_trunc('month', o_orderdate)::DATE AS month, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def partition_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows assigned to monthly partitions by their date; those outside of all ranges stay out."""
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    return rows.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey AS document_id, round(sum(CASE l_linenumber % 2 WHEN 0 THEN l_partkey / 1000.0 * 0.00002 ELSE l_partkey / 1000.0 * 0.03 + l_suppkey / 1000.0 * 0.06 END), 8)::DOUBLE AS cost, count(*) AS calls FROM lineitem GROUP BY 1")
def cost_per_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.when(F.col("l_linenumber") % 2 == 0, "text-embedding-3-small").otherwise("gpt-4").alias("model"), F.col("l_partkey").alias("tokens_in"), F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(F.col("l_suppkey")).alias("tokens_out"))
    return stats.cost_report(usage, "document_id").select("document_id", "cost", "calls")


@query("SELECT ['gpt-4', 'gpt-3.5-turbo', 'unknown'][CAST(l_linenumber % 3 AS INTEGER) + 1] AS model, count(*) AS calls, CAST(sum(l_partkey) AS BIGINT) AS tokens, round(avg(l_partkey), 4) AS mean_tokens FROM lineitem GROUP BY 1")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = table(spark, sf_dir, "lineitem").select(pick("l_linenumber", ["gpt-4", "gpt-3.5-turbo", "unknown"]).alias("model"), F.col("l_partkey").alias("tokens_in"), F.lit(0).alias("tokens_out"))
    out = stats.cost_report(usage, "model")
    return out.select("model", "calls", "tokens", F.round(F.col("tokens") / F.greatest("calls", F.lit(1)), 4).alias("mean_tokens"))


@query("""WITH u AS (SELECT ['gpt-4', 'gpt-3.5-turbo', 'unknown'][CAST(l_linenumber % 3 AS INTEGER) + 1] AS model, CAST(sum(l_partkey) AS BIGINT) AS tokens FROM lineitem GROUP BY 1)
SELECT v.model, kind, CAST(rate AS DOUBLE) AS rate, coalesce(tokens, 0) AS tokens, round(CAST(rate AS DOUBLE) * coalesce(tokens, 0) / 1e6, 9) AS cost FROM (VALUES ('text-embedding-3-small', 'input', 0.02), ('text-embedding-3-small', 'output', 0.0), ('gpt-3.5-turbo', 'input', 0.5), ('gpt-3.5-turbo', 'output', 1.5), ('gpt-4', 'input', 30.0), ('gpt-4', 'output', 60.0)) AS v(model, kind, rate) LEFT JOIN u ON u.model = v.model""")
def price_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of a million tokens, a row a model and kind, with the tokens that a log has of the model and what they would cost."""
    rows = spark.createDataFrame([(m, i * 1000, o * 1000) for m, (i, o) in stats.PRICES.items()], "model string, input double, output double")
    prices = rows.unpivot("model", ["input", "output"], "kind", "rate").withColumn("rate", F.round("rate", 6))
    used = table(spark, sf_dir, "lineitem").groupBy(pick("l_linenumber", ["gpt-4", "gpt-3.5-turbo", "unknown"]).alias("model")).agg(F.sum("l_partkey").alias("tokens"))
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    return prices.join(used, "model", "left").select("model", "kind", "rate", tokens.alias("tokens"), F.round(F.col("rate") * tokens / 1e6, 9).alias("cost"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS session, count(*) AS documents, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS cost, round(avg(CAST(o_totalprice AS DOUBLE)), 4) AS mean_cost FROM orders GROUP BY 1")
def session_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("session")).agg(F.count(F.lit(1)).alias("documents"), F.round(F.sum(price), 2).alias("cost"), F.round(F.avg(price), 4).alias("mean_cost"))


@query("SELECT l_orderkey AS a, p_type AS kind, count(*) AS n, max(l_quantity) AS most FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL HAVING count(*) > 1")
def parts_in_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a document that meet in a kind."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return joined.groupBy(F.col("l_orderkey").alias("a"), F.col("p_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("most")).where("n > 1")


@query("SELECT trim(lower(CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_mktsegment || ' ' ELSE lower(c_mktsegment) END)) AS name, count(*) AS n FROM customer GROUP BY 1")
def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of shared tables, however spelt, as a set of normalised names with their number."""
    given = table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), "c_mktsegment", F.lit(" "))).otherwise(F.lower("c_mktsegment")).alias("s"))
    return given.groupBy(F.trim(F.lower("s")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH v AS (SELECT user_id, count(*) AS views FROM events WHERE event_type = 'view' GROUP BY 1), p AS (SELECT user_id, count(*) AS buys FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT coalesce(v.user_id, p.user_id) AS user_id, coalesce(views, 0) AS views, coalesce(buys, 0) AS buys FROM v FULL JOIN p ON v.user_id = p.user_id")
def view_of_two_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rollups of one log, kept side by side."""
    rows = table(spark, sf_dir, "events")
    of = lambda t, name: rows.where(F.col("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return of("view", "views").join(of("purchase", "buys"), "user_id", "full_outer").select("user_id", F.coalesce("views", F.lit(0)).alias("views"), F.coalesce("buys", F.lit(0)).alias("buys"))


# ---- outlines and payloads


@query("SELECT s_suppkey AS id, ['Speed kills|Night driving', 'One theme', ''][CAST(s_suppkey % 3 AS INTEGER) + 1] AS themes FROM supplier")
def outline_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = pick("s_suppkey", ['Option 1: "Speed kills" || Option 2: Night driving || abc', '"One theme"', "no"])
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array_join(outlines.options(value), "|").alias("themes"))


@query("SELECT s_suppkey AS id, CASE s_suppkey % 2 WHEN 0 THEN 'the first' ELSE repeat('x', 500) || '...' END AS content FROM supplier")
def cleaned_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("s_suppkey") % 2 == 0, "Option 1: the first || Option 2: another").otherwise("x" * 600)
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), outlines.clean_outline(content).alias("content"))


@query("SELECT theme, count(*) AS n FROM (SELECT unnest([['negligent_hiring'], ['negligent_supervision', 'safety_violations'], []][CAST(o_orderkey % 3 AS INTEGER) + 1]) AS theme FROM orders) GROUP BY 1")
def research_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = pick("o_orderkey", ["Hiring without a background check", "oversight and monitoring of safety; a violation", "safety alone"])
    return table(spark, sf_dir, "orders").select(F.explode(outlines.themes(content)).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' alone' END AS fact, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS relevance FROM part")
def outline_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" – "), "p_brand")).otherwise(F.concat("p_name", F.lit(" alone")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), outlines.fact_parts(line).alias("f")).select("id", "f.fact", "f.relevance")


@query("SELECT p_partkey AS id, p_name AS opposing, p_brand AS response, 'high' AS value FROM part WHERE p_partkey % 3 <> 0")
def counter_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.when(F.col("p_partkey") % 3 != 0, F.concat("p_name", F.lit(" → "), "p_brand", F.lit(" (high)"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), outlines.counter_parts(line).alias("c")).where("c IS NOT NULL").select("id", "c.opposing", "c.response", "c.value")


@query("SELECT o_orderkey AS id, '- see ' || CASE o_orderkey % 3 WHEN 0 THEN '395.8' ELSE 'the rule' END || '... (49 C.F.R. § ' || CASE o_orderkey % 3 WHEN 0 THEN '395.8' WHEN 1 THEN '383.5' ELSE 'XXX' END || ')' AS line FROM orders")
def regulatory_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("see "), pick("o_orderkey", ["395.8", "the rule", "the rule"]))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), outlines.regulatory_line(content, F.when(F.col("o_orderkey") % 3 == 1, "383.5")).alias("line"))


@query("SELECT c_custkey AS id, c_name || '_v._Roe' AS name FROM customer")
def valid_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), outlines.valid_case_name(F.concat("c_name", F.lit(" v. R[o]e?*"))).alias("name"))


@query("SELECT s_suppkey AS id, CAST(k AS INTEGER) AS n, md5(CASE k WHEN 0 THEN repeat('a', 400) || chr(10) || chr(10) || repeat('b', 400) WHEN 1 THEN repeat('c', 1500) ELSE s_name END) AS digest FROM supplier, (SELECT unnest([0, 1, 2]) AS k)")
def packed_fact_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat_ws("\n\n", F.lit("a" * 400), F.lit("b" * 400), F.lit("c" * 1500), F.col("s_name"))
    chunks = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.posexplode(outlines.packed_paragraphs(content)).alias("n", "chunk"))
    return chunks.select("id", "n", F.md5("chunk").alias("digest"))


@query(f"WITH {SECTIONS_SQL} SELECT motion_id, kind, max(ordinal) AS last_ordinal, count(*) AS n FROM sc GROUP BY ALL")
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an outline has its kinds of sections last, and how many."""
    return sections(spark, sf_dir).groupBy("motion_id", "kind").agg(F.max("ordinal").alias("last_ordinal"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {SECTIONS_SQL} SELECT motion_id, round(100.0 * sum(len(citations)) / sum(words), 6)::DOUBLE AS per_hundred, round(sum(CASE WHEN kind = 'argument' THEN words ELSE 0 END) / sum(words), 6)::DOUBLE AS argument_share FROM sc GROUP BY 1")
def citation_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations for a hundred words of a motion, and the share of words in its arguments."""
    words = F.sum("words")
    share = F.sum(F.when(F.col("kind") == "argument", F.col("words")).otherwise(0)) / words
    return sections(spark, sf_dir).groupBy("motion_id").agg(F.round(100 * F.sum(F.size("citations")) / words, 6).alias("per_hundred"), F.round(share, 6).alias("argument_share"))


@query("SELECT o_orderkey AS id, json_object('id', o_orderkey, 'status', o_orderstatus, 'day', strftime(o_orderdate, '%Y-%m-%d')) AS payload FROM orders")
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), day)).alias("payload"))


@query("SELECT o_orderkey AS id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders")
def payloads_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = event_payloads(spark, sf_dir).select(F.from_json("payload", "id long, status string, day date").alias("p"))
    return back.select("p.id", "p.status", "p.day")


@query("SELECT o_orderkey AS id, least(5, greatest(1, coalesce(CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 9 END, 3))) AS strength, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'other' END AS status FROM orders")
def defaults_and_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defaults for what is missing, known values only, numbers within limits."""
    given = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") % 9)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(given, F.lit(3)))).alias("strength"), F.when(F.col("o_orderstatus").isin("F", "O"), F.col("o_orderstatus")).otherwise("other").alias("status"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'letter' ELSE 'photo' END AS kind FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def admitted_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the kinds that are let in, and those that are forced in."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "letter").otherwise("photo")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("kind")).where(F.col("kind").isin("letter", "memo") | (F.col("id") % 5 == 0))


@query("SELECT v.user_id, count(*) AS n FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts BETWEEN v.ts AND v.ts + INTERVAL 1 DAY GROUP BY 1")
def views_before_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams joined by user within a day; the same plan joins streams with watermarks."""
    rows = table(spark, sf_dir, "events")
    v = rows.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"))
    p = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("ts").alias("bought_at"))
    near = (F.col("user_id") == F.col("buyer")) & (F.col("bought_at") >= F.col("seen_at")) & (F.col("bought_at") <= F.col("seen_at") + F.expr("INTERVAL 1 DAY"))
    return v.join(p, near).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey AS case_id, c_name AS case_name, n_name AS matter, count(o_orderkey) AS documents FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def matter_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matters, their cases and the documents in these."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("documents"))
    cases = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return cases.select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("case_name"), F.col("n_name").alias("matter")).join(n, "case_id", "left").withColumn("documents", F.coalesce("documents", F.lit(0)))


@query("SELECT o_custkey AS case_id, count(*) AS documents, count(DISTINCT o_orderstatus) AS kinds, CAST(sum(length(o_orderpriority)) AS BIGINT) AS size FROM orders GROUP BY 1")
def case_document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count(F.lit(1)).alias("documents"), F.count_distinct("o_orderstatus").alias("kinds"), F.sum(F.length("o_orderpriority")).alias("size"))


@query("SELECT o_orderkey AS id, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, round(100 * date_diff('day', DATE '1992-01-01', o_orderdate::DATE) / 3650.0, 4)::DOUBLE AS percent FROM orders")
def elapsed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01").cast("date"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), days.alias("days"), F.round(100 * days / 3650, 4).alias("percent"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def dated_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that have a date, within both bounds."""
    date = F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate"))
    return table(spark, sf_dir, "orders").where(date.isNotNull() & date.between(F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"))).select(F.col("o_orderkey").alias("id"))


@query("SELECT p_partkey AS id, sha256(p_name || '|' || p_size || '|pdf') AS digest FROM part")
def metadata_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of what a file's listing says of it."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hashing.metadata_hash(F.col("p_name"), F.col("p_size"), F.lit("pdf")).alias("digest"))


@query("SELECT p_partkey AS id, round(list_sum(list_transform(range(1, 16, 2), lambda i: CAST(('0x' || substring(sha256(p_name), CAST(i AS INTEGER), 2)) AS INTEGER) / 255.0)), 6)::DOUBLE AS total FROM part")
def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight numbers that stand for a hash, summed up."""
    v = hashing.hash_vector(F.sha2("p_name", 256))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("SELECT p_partkey AS id, repeat(chr(CAST(65 + p_partkey % 60 % 26 AS INTEGER)), p_partkey % 60 // 26 + 1) AS label FROM part")
def exhibit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), hashing.exhibit_label((F.col("p_partkey") % 60).cast("int")).alias("label"))


@query("SELECT c_custkey AS id, 'store:case:' || c_custkey || ':facts' AS key FROM customer")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hashing.cache_key("store", "case", F.col("c_custkey").cast("string"), F.lit("facts")).alias("key"))


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'case_7_smith' WHEN 1 THEN 'unnamed_case' ELSE repeat('x', 54) || '_' || substring(md5(repeat('x', 80)), 1, 8) END AS name FROM customer")
def collection_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = pick("c_custkey", ["7  Smith!", "?!", "x" * 80])
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), hashing.collection_name(name).alias("name"))
