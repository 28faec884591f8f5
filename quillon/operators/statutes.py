"""Statutes and regulations: chapters into sections, topics, cross-references, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import any_phrase

#: Forms of references and words of topics.
STATUTE_REFERENCE = r"(?:section|s\.|ss\.|§)\s*(\d+\.\d+)"
REGULATION_REFERENCE = r"§\s*(\d+\.\d+)"
TOPICS = {"negligence": ["negligence", "duty of care"], "damages": ["damages", "compensation"], "insurance": ["insurance", "coverage"], "motor_vehicles": ["motor vehicle", "driver"], "limitations": ["limitation", "time period"]}


def sections(chapters: DataFrame) -> DataFrame:
    """(chapter, number, title, content) of chapters (chapter, content): a section begins at a line 'number title.—'."""
    parts = F.split("content", r"(?m)^(?=\d+\.\d+\s)", -1)
    one = chapters.select("chapter", F.explode(parts).alias("part")).where(F.col("part").rlike(r"^\d+\.\d+\s"))
    return one.select("chapter", F.regexp_extract("part", r"^(\d+\.\d+)", 1).alias("number"), F.trim(F.regexp_extract("part", r"^\d+\.\d+\s+([^\n.]*)", 1)).alias("title"), F.regexp_replace("part", r"^[^\n]*\n?|\s+$", "").alias("content"))


def topics(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(any_phrase(low, words), F.lit(name)) for name, words in TOPICS.items())))


def references(text: Column, pattern: str = STATUTE_REFERENCE) -> Column:
    """Distinct section numbers that a text refers to, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1))))


def identifier(kind: str, number: Column) -> Column:
    return F.concat(F.lit("Fla. Stat. § " if kind == "statute" else "49 CFR § "), number)


def about(entries: DataFrame, wanted: list[str]) -> DataFrame:
    """Entries (topics, ...) of any of the topics."""
    return entries.where(F.arrays_overlap("topics", F.array(*(F.lit(t) for t in wanted))))


def reference_graph(entries: DataFrame) -> DataFrame:
    """(source, target) between entries (number, content) that exist."""
    out = entries.select(F.col("number").alias("source"), F.explode(references(F.col("content"))).alias("target"))
    return out.join(entries.select(F.col("number").alias("target")).distinct(), "target", "left_semi").where("source <> target").select("source", "target")
