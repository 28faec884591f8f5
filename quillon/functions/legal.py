"""Citations, exhibits, testimony and the kinds of sections, chunks and queries, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import CITATION, any_phrase, first_rule, found

# Patterns and phrases that decide results.
EXHIBIT = r"(?i)\b(?:Exhibit|Exh\.?|Ex\.)\s*([A-Z]\b|\d+(?:\.\d+)?|[A-Z]-\d+)"
DEPOSITION = r"(\w+)\s+Dep\.\s+(\d+):(\d+)(?:-(\d+))?"
PAGE_LINE = r"(?i)page\s+(\d+),?\s+lines?\s+(\d+)"
REGULATION = r"49\s+C\.?F\.?R\.?\s+§*\s*(\d+\.\d+)"
MOTION_CITATIONS = [
    r"\d+\s+U\.S\.\s+\d+(?:\s+\(\d{4}\))?",
    r"\d+\s+F\.\d+d\s+\d+(?:\s+\([^)]+\d{4}\))?",
    r"\d+\s+S\.\s*Ct\.\s+\d+(?:\s+\(\d{4}\))?",
    r"[A-Z][a-zA-Z]+\s+v\.\s+[A-Z][a-zA-Z]+(?:,\s+\d+)?",
    r"\d+\s+U\.S\.C\.\s+§+\s*\d+[\w\-\.]*",
    r"\d+\s+C\.F\.R\.\s+§*\s*\d+\.\d+",
    r"Fed\.\s*R\.\s*(?:Civ|Crim|Evid|App)\.\s*P\.\s*\d+[a-z]*",
]
QUERY_PATTERNS = [
    ("citation_search", r"(?i)(?:cite|citation|§|\d+\s+U\.S\.C\.|Rule\s+\d+)"),
    ("date_search", r"(?i)(?:on|before|after|between|during)\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|\d{1,2}[-/]\d{1,2})"),
    ("monetary_search", r"(?i)(?:damages|settlement|amount|cost|fee|award).*\$[\d,]+"),
    ("definition_search", r"(?i)(?:what is|define|definition of|meaning of)"),
    ("precedent_search", r"(?i)(?:precedent|case law|prior cases|similar cases)"),
    ("procedure_search", r"(?i)(?:how to|procedure|process|steps|filing)"),
]
QUERY_WEIGHTS = {"citation_search": (0.3, 0.2, 0.5), "date_search": (0.5, 0.4, 0.1), "monetary_search": (0.5, 0.4, 0.1)}
DEFAULT_WEIGHTS = (0.7, 0.2, 0.1)
FIRM_WORDS = ["successful", "motion", "argument", "strategy", "how do", "effective"]
CASE_WORDS = ["evidence", "document", "record", "fact", "incident", "what happened"]
EXPECTED = {"legal_precedents": "case_law", "case_facts": "evidence", "expert_evidence": "expert_opinion", "regulatory_compliance": "regulation", "procedural_history": "court_filing", "argument_strategies": "legal_strategy"}


def exhibits(text: Column) -> Column:
    """Distinct exhibit marks in order, as EX_ and the upper-case mark."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(EXHIBIT), F.lit(1)), lambda x: F.concat(F.lit("EX_"), F.upper(x))))


def exhibit_id(name: Column) -> Column:
    plain = F.upper(F.replace(F.trim(name), F.lit(" "), F.lit("_")))
    return F.replace(F.replace(plain, F.lit("EXHIBIT_"), F.lit("EX_")), F.lit("EXH_"), F.lit("EX_"))


def depositions(text: Column) -> Column:
    """(deponent, page, line, line_end) of each short citation in order; the end is the start where none is given."""
    part = lambda i: F.regexp_extract_all(text, F.lit(DEPOSITION), F.lit(i))
    return F.transform(
        F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")),
        lambda x: F.struct(x["a"].alias("deponent"), x["b"].cast("int").alias("page"), x["c"].cast("int").alias("line"), F.coalesce(F.nullif(x["d"], F.lit("")), x["c"]).cast("int").alias("line_end")),
    )


def deposition_citation(deponent: Column, page: Column, line: Column, line_end: Column, full: bool = False) -> Column:
    lines = F.when(line == line_end, line.cast("string")).otherwise(F.concat_ws("-", line.cast("string"), line_end.cast("string")))
    if full:
        return F.concat(F.lit("Deposition of "), deponent, F.lit(" at page "), page.cast("string"), F.lit(", lines "), lines)
    return F.concat(deponent, F.lit(" Dep. "), page.cast("string"), F.lit(":"), lines)


def motion_citations(text: Column) -> Column:
    """Distinct citations, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(found(text, p) for p in MOTION_CITATIONS)))))


def search_terms(tokens: Column, text: Column) -> Column:
    """Tokens, then marks of citations and money, each once."""
    mark = lambda prefix, p: F.transform(found(text, p), lambda x: F.concat(F.lit(prefix), F.regexp_replace(x, r"[^A-Za-z0-9]+", "_")))
    return F.array_distinct(F.concat(tokens, mark("CITE_", CITATION), mark("MONEY_", r"\$[\d,]+")))


def query_strategy(query: Column) -> Column:
    """(query_type, vector, keyword, citation): the first pattern that matches and its weights."""
    kind = F.lit("general")
    for name, pattern in reversed(QUERY_PATTERNS):
        kind = F.when(query.rlike(pattern), F.lit(name)).otherwise(kind)
    weight = [F.lit(w) for w in DEFAULT_WEIGHTS]
    for name, weights in QUERY_WEIGHTS.items():
        weight = [F.when(kind == name, w).otherwise(old) for w, old in zip(weights, weight, strict=True)]
    return F.struct(kind.alias("query_type"), weight[0].alias("vector"), weight[1].alias("keyword"), weight[2].alias("citation"))


def store_of(question: Column) -> Column:
    """Where to look: the firm's knowledge, the case, or both where the words don't tell."""
    low = F.lower(question)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    firm, case = hits(FIRM_WORDS), hits(CASE_WORDS)
    return F.when(firm > case, "firm_knowledge").when(case > firm, "case_database").otherwise("both")


def expected_result(query_type: Column) -> Column:
    out = F.lit("general")
    for kind, result in EXPECTED.items():
        out = F.when(query_type == kind, result).otherwise(out)
    return out


def section_type(title: Column) -> Column:
    low = F.lower(title)
    has = lambda *words: any_phrase(low, list(words))
    return (
        F.when(has("caption", "title", "court", "case no"), "preintroduction")
        .when(has("procedural", "history", "proceedings"), "procedural_background")
        .when(has("memorandum", "memo", "law"), "memorandum_of_law")
        .when(has("introduction") & ~has("argument"), "introduction")
        .when(has("facts", "factual", "background") & ~has("procedural"), "statement_of_facts")
        .when(has("standard", "legal framework", "applicable law"), "legal_standard")
        .when(has("conclusion", "summary") & ~has("argument"), "conclusion")
        .when(has("prayer", "relief", "wherefore", "request"), "prayer_for_relief")
        .otherwise("argument")
    )


def filing_type(text: Column) -> Column:
    """Filings first, then discovery, then evidence; null where nothing is typical."""
    low = F.lower(text)
    has = lambda *words: any_phrase(low, list(words))
    rest = [
        ("deposition", ["deposition of", "deponent:"]), ("interrogatory", ["interrogatory"]), ("request_for_admission", ["request for admission"]), ("request_for_production", ["request for production"]),
        ("medical_record", ["patient name:", "diagnosis:"]), ("police_report", ["incident report", "case number:"]), ("expert_report", ["expert opinion", "qualifications:"]), ("invoice", ["invoice", "amount due:"]), ("affidavit", ["affidavit", "sworn statement"]),
    ]
    return (
        F.when(has("motion for", "motion to", "plaintiff's motion", "defendant's motion", "memorandum in support", "memorandum of law"), "motion")
        .when(has("complaint") & has("plaintiff", "cause of action"), "complaint")
        .when(has("answer") & has("defendant") & has("admits"), "answer")
        .when(has("legal memorandum", "memorandum in opposition"), "memorandum")
        .when(has("brief") & has("appellant", "appellee"), "brief")
        .when(has("order") & has("court", "judge"), "order")
        .otherwise(first_rule(low, rest, None))
    )


def chunk_type(text: Column) -> Column:
    low = F.lower(text)
    party = any_phrase(low, ["therefore", "whereas", "plaintiff", "defendant"])
    return (
        F.when(text.rlike(CITATION), "legal_citation")
        .when(text.rlike(r"(?m)^\s*(?:\d+\.|\([a-z]\)|[-•*])\s+\S"), "list_item")
        .when(party & any_phrase(low, ["facts", "evidence", "testified"]), "fact_statement")
        .when(party & any_phrase(low, ["argue", "contend", "assert"]), "argument")
        .when(party & any_phrase(low, ["conclusion", "ruling", "finding"]), "conclusion")
        .otherwise("paragraph")
    )


def fact_confidence(dates: Column, entities: Column, citations: Column) -> Column:
    """0.8, and more with dates, entities and citations; at most 1."""
    return F.least(F.lit(1.0), 0.8 + F.when(dates > 0, 0.1).otherwise(0.0) + F.when(entities > 0, 0.05).otherwise(0.0) + F.when(citations > 0, 0.05).otherwise(0.0))


def authority_parts(text: Column) -> Column:
    """(name, cite, principle, why) of 'name – cite: principle (why)'; the whole text as the name otherwise."""
    pattern = r"^(.+?)\s+[–-]\s+(.+?):\s+(.+?)(?:\s+\((.+)\))?$"
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    return F.struct(F.coalesce(part(1), text).alias("name"), part(2).alias("cite"), part(3).alias("principle"), part(4).alias("why"))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)
