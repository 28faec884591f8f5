"""What each kind of finding is stored as: facts, testimony, exhibits, events, statutes, regulations and chunks, with the text that is embedded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.stores import point_id, with_defaults

# Characters of an excerpt and of a preview.
EXCERPT = 500


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Rows of chunks (store, document_id, chunk_index, content, metadata, version): an id by document and index, and metadata with its defaults."""
    defaults = {"document_type": F.lit("unknown"), "chunk_index": F.col("chunk_index"), "chunk_reference": F.concat_ws("_", F.col("document_id").cast("string"), F.col("chunk_index").cast("string"))}
    return chunks.select("store", point_id(F.col("document_id"), F.col("chunk_index")).alias("id"), "version", F.col("document_id").cast("string").alias("document_id"), "content", with_defaults(F.col("metadata"), defaults).alias("metadata"))


def fact_rows(facts: DataFrame) -> DataFrame:
    """Facts (fact_id, content, dates, entities) with has_dates and primary_date, the first date."""
    size = F.coalesce(F.size("dates"), F.lit(0))
    return facts.select("fact_id", "content", (size > 0).alias("has_dates"), F.when(size > 0, F.element_at("dates", 1)).alias("primary_date"), F.to_json("entities").alias("entities"))


def deposition_rows(testimony: DataFrame) -> DataFrame:
    """Testimony (testimony_id, deponent, topics, excerpt) with its topics joined and an excerpt."""
    return testimony.select("testimony_id", "deponent", F.array_join("topics", ",").alias("topics"), F.substring("excerpt", 1, EXCERPT).alias("excerpt"))


def exhibit_rows(exhibits: DataFrame) -> DataFrame:
    """Exhibits (exhibit_id, number, description, pages) with the text to embed and their pages as JSON."""
    return exhibits.select("exhibit_id", F.concat_ws(": ", F.col("number"), F.col("description")).alias("embed_text"), F.to_json("pages").alias("pages"))


def document_rows(documents: DataFrame) -> DataFrame:
    """Documents (document_id, title, description, key_facts) with the text to embed: what is there of title, description and facts, a line each."""
    parts = F.concat(F.array("title", "description"), F.coalesce("key_facts", F.array().cast("array<string>")))
    return documents.select("document_id", "title", F.array_join(F.filter(parts, lambda p: F.coalesce(F.trim(p), F.lit("")) != ""), "\n").alias("embed_text"))


def timeline_rows(events: DataFrame) -> DataFrame:
    """Events (case_id, event_id, day, description) with a narrative and their number in the case, from 0."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("case_id").orderBy("day", "event_id")) - 1
    told = F.concat(F.lit("On "), F.date_format("day", "MMMM dd, yyyy"), F.lit(": "), F.col("description"))
    return events.select("case_id", "event_id", nth.cast("long").alias("event_index"), F.coalesce(told, F.col("description")).alias("narrative"))


def statute_rows(sections: DataFrame) -> DataFrame:
    """Sections (number, title, content) with their whole text, a preview, and the text to embed."""
    return sections.select(F.concat(F.lit("Fla. Stat. § "), "number").alias("identifier"), F.concat_ws(". ", "title", _preview(F.col("content"))).alias("embed_text"), "content", _preview(F.col("content")).alias("preview"))


def regulation_rows(sections: DataFrame, parts: DataFrame) -> DataFrame:
    """Sections (part, section, content) with the title of their part from parts (part, title), one row a part."""
    titles = parts.select("part", F.col("title").alias("part_title"))
    named = F.concat(F.lit("49 CFR § "), F.concat_ws(".", F.col("part").cast("string"), F.col("section").cast("string")))
    return sections.join(titles, "part", "left").select(named.alias("identifier"), F.coalesce("part_title", F.lit("Unknown part")).alias("part_title"), "content", _preview(F.col("content")).alias("preview"))


def _preview(content: Column) -> Column:
    return F.substring(content, 1, EXCERPT)


def testimony_type(document_type: Column) -> Column:
    """The kind of testimony that a document's chunks are, null for others."""
    return (
        F.when(document_type.isin("deposition", "interrogatory_response"), "testimony")
        .when(document_type.isin("expert_report", "medical_record"), "expert_opinion")
        .when(document_type.isin("policy", "safety_manual"), "procedural")
    )


def usage_suggestion(kind: Column, category: Column, source: Column, citation: Column, score: Column, least: float = 0.3) -> Column:
    """How to use a piece of evidence, by its kind; null for what is hardly relevant or of no known kind."""
    fact = F.when(category == "timeline", "Use to establish chronology: ").when(category == "damages", "Cite to support damages claim: ").otherwise("Reference to support factual assertion: ")
    quoted = F.concat(F.lit("Quote "), F.coalesce(source, F.lit("witness")), F.lit("'s testimony: "))
    shown = F.concat(F.lit("Reference "), F.coalesce(source, F.lit("document")), F.lit(": "))
    return F.when(score >= least, F.concat(F.when(kind == "fact", fact).when(kind == "deposition", quoted).when(kind == "exhibit", shown), citation))
