"""Outlines read as text: options, themes, facts and counter-arguments, by Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
FACT_PARTS = r"^(.+?)\s*–\s*(.+)$"
COUNTER_PARTS = r"^(.+?)\s*→\s*(.+?)\s*\((.+?)\)$"
THEMES = {
    "negligent_hiring": ["hiring", "background", "qualification", "employment"],
    "negligent_supervision": ["supervision", "monitoring", "oversight", "management"],
    "safety_violations": ["safety", "violation", "regulation", "compliance"],
}


def _option(text: Column) -> Column:
    """An option's text without its label."""
    trimmed = F.trim(text)
    return F.when(trimmed.startswith("Option") & F.contains(trimmed, F.lit(":")), F.trim(F.regexp_replace(trimmed, "^[^:]*:", ""))).otherwise(trimmed)


def options(value: Column, most: int = 3) -> Column:
    """The options of a value, over three characters long, cut to 100, the first few."""
    cleaned = F.transform(F.split(value, r"\|\|"), lambda x: F.left(F.trim(F.btrim(_option(x), F.lit('"'))), F.lit(100)))
    return F.slice(F.filter(cleaned, lambda x: F.length(x) > 3), 1, most)


def clean_outline(content: Column, longest: int = 500) -> Column:
    """The first option, cut off with dots."""
    first = F.when(F.contains(content, F.lit("||")), _option(F.split(content, r"\|\|")[0])).otherwise(content)
    return F.when(F.length(first) > longest, F.concat(F.left(first, F.lit(longest)), F.lit("..."))).otherwise(first)


def themes(content: Column, least: int = 2) -> Column:
    """Themes of which a text holds at least so many words."""
    lower = F.lower(content)
    hits = lambda words: sum((F.contains(lower, F.lit(w)).cast("int") for w in words), F.lit(0))
    return F.filter(F.array(*(F.when(hits(words) >= least, F.lit(name)) for name, words in THEMES.items())), lambda x: x.isNotNull())


def fact_parts(text: Column) -> Column:
    """fact and relevance, or the text as a fact alone."""
    return F.when(text.rlike(FACT_PARTS), F.struct(F.trim(F.regexp_extract(text, FACT_PARTS, 1)).alias("fact"), F.trim(F.regexp_extract(text, FACT_PARTS, 2)).alias("relevance"))).otherwise(F.struct(text.alias("fact"), F.lit(None).cast("string").alias("relevance")))


def counter_parts(text: Column) -> Column:
    """opposing argument, response and value; null where the text has another form."""
    part = lambda i: F.trim(F.regexp_extract(text, COUNTER_PARTS, i))
    return F.when(text.rlike(COUNTER_PARTS), F.struct(part(1).alias("opposing"), part(2).alias("response"), part(3).alias("value")))


def regulatory_line(content: Column, section: Column) -> Column:
    number = F.coalesce(F.nullif(section, F.lit("")), F.nullif(F.regexp_extract(content, r"(\d+\.\d+)", 1), F.lit("")), F.lit("XXX"))
    return F.concat(F.lit("- "), F.left(content, F.lit(150)), F.lit("... (49 C.F.R. § "), number, F.lit(")"))


def valid_case_name(name: Column) -> Column:
    return F.replace(F.regexp_replace(name, r"[*?\[\]{}]", ""), F.lit(" "), F.lit("_"))


def packed_paragraphs(text: Column, size: int = 1000) -> Column:
    """Paragraphs put together while they stay under size characters; a longer one stands alone."""
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["open"]) + F.length(p) < size
        closed = F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.trim(a["open"], F.lit(" \n")))))
        return F.when(fits, F.struct(F.concat(a["open"], p, F.lit("\n\n")).alias("open"), a["out"].alias("out"))).otherwise(F.struct(F.concat(p, F.lit("\n\n")).alias("open"), closed.alias("out")))

    return F.aggregate(F.split(text, "\n\n", -1), start, step, lambda a: F.when(a["open"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.trim(a["open"], F.lit(" \n"))))))
