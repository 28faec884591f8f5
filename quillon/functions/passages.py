"""Passages of pages and transcripts: headers and footers, stitched overlaps, questions and answers, exhibits' kinds, typed citations, essentials of outlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import legal
from quillon.functions.text import bates_number, document_type

# Patterns, words and limits that decide results.
HEADER = r"(?m)^\s*\S+.*\s+Page\s+\d+"
FOOTER = r"(?i)Page\s+\d+|©|\d{4}\s+\w+|Confidential"
PAGE_HEADER = r"(?i)Page\s+(\d+)"
WITNESS = r"(?i)DEPOSITION\s+OF:?\s+([A-Z][A-Za-z.\s]+?)\s*(?:\n|,|$)"
TAKEN = r"(?i)\b((?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},\s+\d{4})"
EXHIBIT_KINDS = [
    ("photograph", ["photo", "picture", "image"]),
    ("medical_record", ["medical", "hospital", "treatment"]),
    ("contract", ["contract", "agreement"]),
    ("correspondence", ["letter", "email", "correspondence"]),
    ("report", ["report", "analysis"]),
]
STATUTE = r"\d+\s+(?:U\.S\.C\.|C\.F\.R\.)\s*§+\s*\d+(?:\.\d+)*(?:\([a-zA-Z0-9]+\))*"
_NAME = r"[A-Z]\w*(?:\s+[A-Z]\w*){0,5}"
CASE_LAW = rf"({_NAME})\s+v\.\s+({_NAME}),\s*\d+\s+(?:F\.(?:\s?Supp\.?)?\s?\d?d?|U\.S\.|[A-Z][^,\d]{{0,20}}?(?:\s\d+(?:d|th|st|nd|rd))?)\s+\d+(?:\s*\([^)]{{1,40}}\s*\d{{4}}\))?"


def has_header(text: Column) -> Column:
    """A page of three lines or more, a line of whose first five ends in a page number after some words."""
    lines = F.split(text, "\n")
    return F.coalesce((F.size(lines) >= 3) & F.array_join(F.slice(lines, 1, 5), "\n").rlike(HEADER), F.lit(False))


def has_footer(text: Column) -> Column:
    """A page of three lines or more whose last five bear a page number, a copyright sign, a year or a confidentiality mark."""
    lines = F.split(text, "\n")
    last = F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5))
    return F.coalesce((F.size(lines) >= 3) & F.array_join(last, "\n").rlike(FOOTER), F.lit(False))


def stitched(before: Column, current: Column, overlap: int = 200) -> Column:
    """current after the end of what came before: its last characters, from the first sentence that begins in them where one does."""
    tail = F.right(before, F.lit(overlap))
    whole = F.when(tail.rlike(r"(?s)[.!?]\s+\S"), F.regexp_replace(tail, r"(?s)\A.*?[.!?]\s+", "")).otherwise(tail)
    return F.when(F.coalesce(F.trim(before), F.lit("")) == "", current).otherwise(F.concat(whole, F.lit(" "), current))


def bates_of(name: Column, content: Column) -> Column:
    """A document's number by its file's name, else by its text."""
    return F.coalesce(bates_number(name), bates_number(content))


def kind_of(named: Column, content: Column) -> Column:
    """The kind that a file's name says, else that of the first thousand characters, else other."""
    return F.coalesce(named, document_type(F.substring(content, 1, 1000)), F.lit("other"))


def fact_citations(content: Column) -> Column:
    """Testimony, case law, statutes and regulations of a text in that order; what is cited twice stands twice."""
    every = lambda p: F.regexp_extract_all(content, F.lit(p), F.lit(0))
    return F.concat(every(legal.DEPOSITION), every(rf"{_NAME}\s+v\.\s+{_NAME}"), every(r"(?:Fla\.\s*Stat\.|F\.S\.)\s*§?\s*[\d.]+\d"), every(r"\d+\s+C\.F\.R\.\s*§?\s*[\d.]*\d"))


def deposition_metadata(content: Column) -> Column:
    """(witness, taken_on, pages) of a transcript: who and when by its first thousand characters, pages by the largest page header."""
    head = F.substring(content, 1, 1000)
    some = lambda x: F.nullif(F.trim(x), F.lit(""))
    numbers = F.transform(F.regexp_extract_all(content, F.lit(PAGE_HEADER), F.lit(1)), lambda n: n.try_cast("int"))
    return F.struct(some(F.regexp_extract(head, WITNESS, 1)).alias("witness"), some(F.regexp_extract(head, TAKEN, 1)).alias("taken_on"), F.array_max(numbers).alias("pages"))


def questions(content: Column, least: int = 20, answer: int = 500) -> Column:
    """An array of (page, question, answer) of a transcript: lines "Q." of more than least characters with what follows up to the next one, at most answer characters.

    The page is that of the header above, 0 before the first. Page headers are no part of answers.
    """
    pages = F.split(content, r"(?i)(?=\bPage\s+\d+)", -1)

    def of_page(page: Column) -> Column:
        number = F.coalesce(F.nullif(F.regexp_extract(page, r"(?i)\APage\s+(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))
        body = F.regexp_replace(page, r"(?i)\APage\s+\d+\s*", "")
        parts = F.filter(F.split(body, r"(?m)^\s*(?=Q\.\s)", -1), lambda p: p.rlike(r"\AQ\.\s"))
        asked = F.transform(parts, lambda p: F.struct(number.alias("page"), F.trim(F.regexp_extract(p, r"\AQ\.\s+([^\n]*)", 1)).alias("question"), F.regexp_replace(F.substring(F.regexp_replace(p, r"\AQ\.\s+[^\n]*\s*", ""), 1, answer), r"\s+\z", "").alias("answer")))
        return F.filter(asked, lambda a: F.length(a["question"]) > least)

    return F.flatten(F.transform(pages, of_page))


def exhibit_kind(description: Column) -> Column:
    """The kind most of whose words a description has, the first of several; document where it has none."""
    low = F.lower(F.coalesce(description, F.lit("")))
    votes = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("order"), F.lit(kind).alias("kind")) for i, (kind, words) in enumerate(EXHIBIT_KINDS)]
    best = F.array_max(F.array(*votes))
    return F.when(best["n"] > 0, best["kind"]).otherwise("document")


def exhibit_description(content: Column, mark: Column) -> Column:
    """What a text says an exhibit is: after its mark and a dash, colon or bracket, or before "marked as" it; 10 to 200 characters, else only its mark."""
    quoted = F.concat(F.lit(r"\Q"), mark, F.lit(r"\E"))
    first = lambda *pattern: F.call_function("regexp_extract", content, F.concat(*pattern), F.lit(1))
    shown = first(F.lit(r"(?i)\bExhibit\s+"), quoted, F.lit(r"\s*[:–(-]\s*([^.;\n)]{11,199})"))
    marked = first(F.lit(r"(?i)([^.;\n]{11,199}?)\s+(?:was\s+)?marked\s+as\s+Exhibit\s+"), quoted, F.lit(r"\b"))
    found = lambda x: F.nullif(F.trim(x), F.lit(""))
    return F.coalesce(found(shown), found(marked), F.concat(F.lit("Exhibit "), mark))


def exhibit_citation(number: Column, description: Column, pages: Column, style: str = "standard") -> Column:
    """An exhibit as it is cited: standard, formal (with its description) or with_pages."""
    if style == "formal":
        return F.concat(F.lit("Exhibit "), number, F.lit(" ("), description, F.lit(")"))
    listed = F.array_join(F.transform(pages, lambda p: p.cast("string")), ", ")
    plain = F.concat(F.lit("Ex. "), number)
    return F.when(F.size(pages) > 0, F.concat(plain, F.lit(" at "), listed)).otherwise(plain) if style == "with_pages" else plain


def typed_citations(content: Column, most: int = 50) -> Column:
    """An array of (citation, case_name, kind) of a filing, statutes after case law, each once: names of up to six words on either side, so that a long text is read once."""
    cases = F.transform(F.arrays_zip(*(F.regexp_extract_all(content, F.lit(CASE_LAW), F.lit(i)).alias(n) for i, n in enumerate("cab"))), lambda x: F.struct(F.trim(x["c"]).alias("citation"), F.concat(x["a"], F.lit(" v. "), x["b"]).alias("case_name"), F.lit("case").alias("kind")))
    statutes = F.transform(F.regexp_extract_all(content, F.lit(STATUTE), F.lit(0)), lambda x: F.struct(F.trim(x).alias("citation"), F.lit(None).cast("string").alias("case_name"), F.lit("statute").alias("kind")))
    return F.slice(F.array_distinct(F.concat(cases, statutes)), 1, most)


def essential_content(items: Column) -> Column:
    """(key_points, authorities, facts, themes) of an outline's section, an array of (type, label, value, items), each within its limit.

    Fields: a theme, a summary (which comes first), or a point "label: value"; of several options the first counts, and values have 300 characters at
    most. Lists: five items each, to authorities or facts by their label, else three points of 200 characters.
    """
    none = F.array().cast("array<string>")

    def value_of(i: Column) -> Column:
        first = F.trim(F.substring_index(i["value"], "||", 1))
        option = F.when(F.contains(i["value"], F.lit("||")) & F.startswith(first, F.lit("Option")) & F.contains(first, F.lit(":")), F.trim(F.regexp_replace(first, r"(?s)\A[^:]*:", ""))).otherwise(F.when(F.contains(i["value"], F.lit("||")), first).otherwise(i["value"]))
        return F.substring(F.trim(F.regexp_replace(option, r'^"+|"+$', "")), 1, 300)

    field = lambda label: F.transform(F.filter(items, lambda i: (i["type"] == "field") & (i["label"] == label)), value_of)
    has = lambda i, w: F.contains(F.lower(F.coalesce(i["label"], F.lit(""))), F.lit(w))
    lists = lambda test, most, cut: F.flatten(F.transform(F.filter(items, lambda i: (i["type"] == "list") & test(i)), lambda i: F.transform(F.slice(F.coalesce(i["items"], none), 1, most), cut)))
    other = F.flatten(
        F.transform(
            F.filter(items, lambda i: F.coalesce((i["type"] == "list") & ~has(i, "authorit") & ~has(i, "fact"), F.lit(False)) | F.coalesce((i["type"] == "field") & ~i["label"].isin("Theme", "Summary"), F.lit(False))),
            lambda i: F.when(i["type"] == "field", F.array(F.concat(i["label"], F.lit(": "), value_of(i)))).otherwise(F.transform(F.slice(F.coalesce(i["items"], none), 1, 3), lambda s: F.substring(s, 1, 200))),
        )
    )
    return F.struct(
        F.slice(F.concat(F.reverse(field("Summary")), other), 1, 7).alias("key_points"),
        F.slice(lists(lambda i: has(i, "authorit"), 5, lambda s: s), 1, 7).alias("authorities"),
        F.slice(lists(lambda i: ~has(i, "authorit") & has(i, "fact"), 5, lambda s: s), 1, 5).alias("facts"),
        F.slice(field("Theme"), 1, 3).alias("themes"),
    )
