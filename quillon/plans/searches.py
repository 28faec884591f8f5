"""Queries of filtered searches, routing and checked inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import legal, text
from quillon.operators import searches, statutes
from quillon.plans.casework import pick
from quillon.plans.catalog import legal as legal_texts
from quillon.plans.catalog import query, table

CATEGORIES = ["procedural", "substantive", "timeline", "damages"]
FACTS_SQL = f"f AS (SELECT o_orderkey AS id, {CATEGORIES}[CAST(o_orderkey % 4 AS INTEGER) + 1] AS category, CASE WHEN o_orderkey % 7 > 0 THEN CAST(o_orderdate AS DATE) END AS primary_date, o_totalprice AS score, 'src' || (o_custkey % 9) AS source, o_orderkey % 11 = 0 AS gone, (o_custkey % 100) / 100.0::DOUBLE AS confidence, ['pending', 'approved'][CAST(o_custkey % 2 AS INTEGER) + 1] AS status, lower(o_orderpriority) AS content FROM orders)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), pick("o_orderkey", CATEGORIES).alias("category"), F.when(F.col("o_orderkey") % 7 > 0, F.col("o_orderdate").cast("date")).alias("primary_date"), F.col("o_totalprice").alias("score"), F.concat(F.lit("src"), (F.col("o_custkey") % 9).cast("string")).alias("source_document"),
        (F.col("o_orderkey") % 11 == 0).alias("is_deleted"), (F.col("o_custkey") % 100 / 100).alias("confidence"), pick("o_custkey", ["pending", "approved"]).alias("review_status"), F.col("o_orderpriority").alias("content"), F.array("o_orderstatus").alias("keywords"), F.array(F.concat(F.lit("Party "), (F.col("o_custkey") % 5).cast("string"))).alias("entities"),
    )


@query(f"WITH {FACTS_SQL} SELECT id, category FROM f WHERE category IN ('timeline', 'damages') AND primary_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' ORDER BY score DESC, id LIMIT 50")
def facts_by_category_and_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir)
    return searches.page(rows.where(searches.facts(rows, ["timeline", "damages"], "1995-01-01", "1996-06-30")), 50).select("id", "category")


TOPICS = [["accident", "speed"], ["injury"], ["training", "weather"], ["speed", "weather"]]
TOPICS_SQL = f"{TOPICS}[CAST(p_partkey % 4 AS INTEGER) + 1]"


def _topics(n: str) -> F.Column:
    return F.element_at(F.array(*(F.array(*(F.lit(t) for t in ts)) for ts in TOPICS)), (F.expr(n) % len(TOPICS) + 1).cast("int"))


@query(f"SELECT p_partkey AS id FROM part WHERE 'case_' || (p_partkey % 3) = 'case_1' AND p_brand = (SELECT min(p_brand) FROM part) AND list_has_any({TOPICS_SQL}, ['weather', 'injury'])")
def testimony_by_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brand = part.agg(F.min("p_brand")).first()[0]
    rows = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("case_"), (F.col("p_partkey") % 3).cast("string")).alias("case_name"), F.col("p_brand").alias("deponent"), _topics("p_partkey").alias("topics"))
    return rows.where(searches.testimony("case_1", brand, ["weather", "injury"])).select("id")


@query("SELECT p_partkey AS id, p_size AS size FROM part WHERE p_partkey % 3 = 2 AND p_partkey % 5 = 1 AND p_size % 2 = 0")
def exhibits_by_type_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.concat(F.lit("case_"), (F.col("p_partkey") % 3).cast("string")).alias("case_name"), F.concat(F.lit("type_"), (F.col("p_partkey") % 5).cast("string")).alias("document_type"), F.when(F.col("p_size") % 2 == 0, "authentic").alias("authenticity_status"))
    return rows.where(searches.exhibits("case_2", "type_1", "authentic")).select("id", "size")


@query(f"SELECT p_partkey AS id FROM part WHERE list_has_any({TOPICS_SQL}, ['training'])")
def statutes_by_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), _topics("p_partkey").alias("topics"))
    return statutes.about(rows, ["training"]).select("id")


@query(f"SELECT p_partkey AS id FROM part WHERE p_size IN (390, 391, 5, 7, 9) AND list_has_any({TOPICS_SQL}, ['speed', 'injury'])")
def regulations_by_part_and_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("part"), _topics("p_partkey").alias("topics"))
    return rows.where(searches.regulations([390, 391, 5, 7, 9], ["speed", "injury"])).select("id")


@query("SELECT p_partkey AS id, 'Fla. Stat. § ' || p_partkey AS statute, '49 CFR § ' || p_size || '.' || p_partkey AS regulation FROM part WHERE 'Fla. Stat. § ' || p_partkey IN ('Fla. Stat. § 17', 'Fla. Stat. § 42') OR '49 CFR § ' || p_size || '.' || p_partkey IN (SELECT '49 CFR § ' || p_size || '.' || p_partkey FROM part WHERE p_partkey IN (5, 6))")
def sections_by_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statutes and regulations by their names."""
    part = table(spark, sf_dir, "part")
    regulation = F.concat(F.lit("49 CFR § "), F.concat_ws(".", F.col("p_size").cast("string"), F.col("p_partkey").cast("string")))
    rows = part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("Fla. Stat. § "), F.col("p_partkey").cast("string")).alias("statute"), regulation.alias("regulation"))
    asked = rows.where("id in (5, 6)").select("regulation")
    by_statute = rows.where(F.col("statute").isin("Fla. Stat. § 17", "Fla. Stat. § 42"))
    return by_statute.unionByName(rows.join(asked, "regulation", "left_semi").select("id", "statute", "regulation")).distinct()


@query("SELECT p_partkey AS id, p_partkey % 5 AS kind FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 IN (1, 4)")
def evidence_by_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("kind"), (F.col("p_partkey") % 3).alias("case_number"))
    return rows.where((F.col("case_number") == 0) & searches.any_of("kind", [1, 4])).select("id", "kind")


@query(f"WITH {FACTS_SQL} SELECT id, confidence FROM f WHERE NOT gone AND source IN ('src1', 'src4') AND category IN ('timeline', 'damages', 'procedural') AND confidence >= 0.25 ORDER BY confidence DESC, id LIMIT 40 OFFSET 20")
def reviewed_fact_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _facts(spark, sf_dir).where(searches.reviewed(["src1", "src4"], ["timeline", "damages", "procedural"], 0.25))
    return searches.page(rows, 40, 20, "confidence").select("id", "confidence")


@query(f"WITH {FACTS_SQL} SELECT id, status FROM f WHERE source = 'src2' AND status = 'approved' AND confidence >= 0.1 AND (contains(content, 'urgent') OR id IN (SELECT o_orderkey FROM orders WHERE contains(lower(o_orderstatus), 'urgent') OR contains('party ' || (o_custkey % 5), 'urgent')))")
def facts_with_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader types is looked for in contents, keywords and entities; deleted facts are shown too."""
    return _facts(spark, sf_dir).where(searches.reviewed(["src2"], least=0.1, needle="URGENT", status="approved", deleted=True)).select("id", F.col("review_status").alias("status"))


# ---- several stores, matters and cases


@query("(SELECT 'f' || o_orderkey AS id, 'fact' AS source_type, round(CAST(o_totalprice AS DOUBLE), 6) AS score FROM orders ORDER BY o_totalprice DESC, 'f' || o_orderkey LIMIT 20) UNION ALL (SELECT 'd' || p_partkey, 'deposition', 0.8 FROM part ORDER BY 'd' || p_partkey LIMIT 20) UNION ALL (SELECT 'e' || s_suppkey, 'exhibit', 0.7 FROM supplier ORDER BY 'e' || s_suppkey LIMIT 20)")
def case_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts, testimony and exhibits of one case in one list, the stores' usual scores where they have none."""
    facts = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("id"), F.round(F.col("o_totalprice").cast("double"), 6).alias("score"))
    named = lambda name, key, letter: table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"))
    return searches.fan_in({"fact": facts, "deposition": named("part", "p_partkey", "d"), "exhibit": named("supplier", "s_suppkey", "e")}, 20)


@query("(SELECT 's' || c_custkey AS id, 'statute' AS source_type, CAST(0.9 AS DOUBLE) AS score FROM customer ORDER BY 's' || c_custkey LIMIT 15) UNION ALL (SELECT 'r' || n_nationkey, 'regulation', 0.9 FROM nation ORDER BY 'r' || n_nationkey LIMIT 15)")
def shared_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = lambda name, key, letter: table(spark, sf_dir, name).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"))
    return searches.fan_in({"statute": named("customer", "c_custkey", "s"), "regulation": named("nation", "n_nationkey", "r")}, 15)


@query("SELECT o_orderkey AS id, o_custkey % 10 AS part, o_totalprice AS score FROM orders WHERE o_custkey % 10 IN (2, 5, 7) ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")
def search_of_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of some partitions: one pruned scan and one top-k, no list a partition."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("part"), F.col("o_totalprice").alias("score"))
    return searches.page(rows.where(searches.any_of("part", [2, 5, 7])), 30)


@query("SELECT c_custkey AS case_id, c_name AS case_name FROM customer WHERE c_nationkey % 4 = 1 AND c_custkey % 10 > 0 AND c_name IN (SELECT c_name FROM customer WHERE c_custkey % 3 = 0)")
def cases_by_name_and_firm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of a firm by name, without deleted ones."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("case_name"), (F.col("c_nationkey") % 4).alias("firm"), (F.col("c_custkey") % 10 == 0).alias("is_deleted"))
    asked = rows.where("case_id % 3 = 0").select("case_name")
    return rows.where("firm = 1 and not is_deleted").join(asked, "case_name", "left_semi").select("case_id", "case_name")


@query("SELECT c_custkey AS case_id, c_nationkey AS matter_id FROM customer WHERE c_nationkey IN (3, 5)")
def cases_in_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_nationkey").alias("matter_id"))
    return rows.where(searches.any_of("matter_id", [3, 5]))


LEVELS = ["public", "internal", "confidential"]


@query(f"SELECT c_custkey AS case_id, c_nationkey + (c_custkey % 2) * 10 AS matter_id, CASE WHEN n_nationkey IS NOT NULL THEN coalesce(CASE WHEN c_custkey % 3 = 0 THEN 'restricted' END, {LEVELS}[CAST(n_regionkey % 3 AS INTEGER) + 1]) END AS access_level, n_nationkey IS NOT NULL AS inserted FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + (c_custkey % 2) * 10")
def checked_case_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cases whose matter exists, with its level where they have none, and those that are refused."""
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), (F.col("c_nationkey") + F.col("c_custkey") % 2 * 10).alias("matter_id"), F.when(F.col("c_custkey") % 3 == 0, "restricted").alias("access_level"))
    matters = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("matter_id"), pick("n_regionkey", LEVELS).alias("access_level"))
    good, refused = searches.inserted_cases(new, matters)
    return good.select("case_id", "matter_id", "access_level", F.lit(True).alias("inserted")).unionByName(refused.select("case_id", "matter_id", F.lit(None).cast("string").alias("access_level"), F.lit(False).alias("inserted")))


@query("SELECT o_orderkey AS document_id, o_custkey AS case_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7) QUALIFY row_number() OVER (ORDER BY o_orderkey) <= 25")
def documents_in_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("case_id"))
    junctions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("case_id"))
    return junctions.join(cases, "case_id", "left_semi").orderBy("document_id").limit(25).select("document_id", "case_id")


@query("SELECT DISTINCT l_orderkey AS motion_id, p_brand AS authority FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey WHERE o_orderkey % 10 = 0 OR contains(lower('see Brand#' || (o_custkey % 40) || ' and ' || o_orderpriority), lower(p_brand))")
def authorities_of_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("authority"))
    outlines = table(spark, sf_dir, "lineitem").join(part, "l_partkey").select(F.col("l_orderkey").alias("motion_id"), "authority")
    content = F.concat(F.lit("see Brand#"), (F.col("o_custkey") % 40).cast("string"), F.lit(" and "), "o_orderpriority")
    kinds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("motion_id"), F.when(F.col("o_orderkey") % 10 == 0, "Argument of law").otherwise("motion").alias("motion_type"), content.alias("content"))
    return searches.authority_overlap(outlines, kinds)


@query("SELECT p_partkey AS id, 'The part ' || p_name || ' broke on the road|The brand ' || p_brand || ' of the part is known' AS excerpts FROM part")
def excerpts_of_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.concat(F.lit("The part "), "p_name", F.lit(" broke on the road. Short one. Nothing here bears upon what anybody says! The brand "), "p_brand", F.lit(" of the part is known?"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array_join(searches.excerpts(content, F.lit("the part broke")), "|").alias("excerpts"))


# ---- chapters


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's chapter: a heading and three sections that refer to others."""
    n = F.col("s_suppkey").cast("string")
    section = lambda k: F.concat(n, F.lit(f".{k} Duties of part {k}. Of drivers\nThe driver shall as § "), n, F.lit(f".{k + 1} says, and § 1.{k}, keep "), pick(f"s_suppkey + {k}", ["records of insurance", "the brakes"]), F.lit(".\n"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chapter"), F.concat(F.lit("CHAPTER\n"), *(section(k) for k in (1, 2, 3))).alias("content"))


CHAPTERS_SQL = "c AS (SELECT s_suppkey AS chapter, k, s_suppkey || '.' || k AS number, 'The driver shall as § ' || s_suppkey || '.' || (k + 1) || ' says, and § 1.' || k || ', keep ' || ['records of insurance', 'the brakes'][CAST((s_suppkey + k) % 2 AS INTEGER) + 1] || '.' AS content FROM supplier, (VALUES (1), (2), (3)) v(k))"


@query(f"WITH {CHAPTERS_SQL} SELECT chapter, number, 'Duties of part ' || k AS title, content FROM c")
def chapter_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters cut into sections at the lines that begin with a section's number."""
    return statutes.sections(chapters(spark, sf_dir))


@query(f"WITH {CHAPTERS_SQL} SELECT number, array_to_string(list_sort(list_distinct([chapter || '.' || (k + 1), '1.' || k])), '|') AS refs FROM c")
def regulation_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What sections refer to."""
    return statutes.sections(chapters(spark, sf_dir)).select("number", F.array_join(statutes.references(F.col("content"), statutes.REGULATION_REFERENCE), "|").alias("refs"))


@query(f"WITH {CHAPTERS_SQL} SELECT number, CASE WHEN contains(content, 'insurance') THEN 'insurance|motor_vehicles' ELSE 'motor_vehicles' END AS topics FROM c")
def regulation_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statutes.sections(chapters(spark, sf_dir)).select("number", F.array_join(statutes.topics(F.col("content")), "|").alias("topics"))


# ---- words and entities of texts


@query(rf"SELECT o_orderkey AS id, '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS money, strftime(o_orderdate, '%m/%d/%Y') AS dates, 'Rule ' || (o_orderkey % 90) AS rules FROM orders")
def entities_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money, dates and rules that a text names, each once."""
    content = F.col("content")
    return legal_texts(spark, sf_dir).select("id", *(F.array_join(text.found(content, p), "|").alias(n) for n, p in (("money", text.MONEY), ("dates", text.DATE), ("rules", text.RULE))))


@query("SELECT o_orderkey AS id, 'MONEY__' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS marks FROM orders")
def search_text_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks that a text's amounts add to what it is searched by."""
    content = F.concat(F.lit("about $"), F.floor("o_totalprice").cast("long").cast("string"), F.lit(" due"))
    terms = legal.search_terms(F.array(F.lit("about"), F.lit("due")), content)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(F.filter(terms, lambda t: F.startswith(t, F.lit("MONEY_"))), "|").alias("marks"))
