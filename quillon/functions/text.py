"""Cleaning, classification and extraction of text as Column expressions (Java regular expressions throughout)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, phrases and word lists that decide results.
CITATION = r"(?:\d+\s+U\.S\.C\.\s+§\s*\d+|\d+\s+F\.\d+d\s+\d+|\d+\s+S\.\s*Ct\.\s+\d+|§\s*\d+(?:\.\d+)?|Rule\s+\d+(?:\.\d+)?|\d+\s+[A-Z][a-z]+(?:\.\s*\d+d)?\s+\d+)"
MONEY = r"\$[\d,]+(?:\.\d{2})?(?:\s*(?:million|billion|thousand|k|m|b))?"
DATE = r"(?:\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4}|\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\b\d{4}[-/]\d{1,2}[-/]\d{1,2})"
RULE, SECTION = r"Rule\s+\d+(?:\.\d+)?", r"§\s*\d+(?:\.\d+)?"
BATES = [r"(?i)([A-Z]{2,4}[-_]?\d{4,})", r"(?i)(\d{4,}[-_]?[A-Z]{2,4})", r"(?i)([A-Z]{2,4}\s+\d{4,})"]
STOP_WORDS = """plaintiff defendant court case matter pursuant whereas therefore hereby herein the a an and or but in on at to for of with by from as is was are
were been be have has had do does did will would shall should may might must can could chunk""".split()
KEY_PAGE_WORDS = "injury accident negligence damages liability cause fault breach duty harm".split()
DOCUMENT_RULES = [
    ("motion", ["motion for", "motion to", "plaintiff's motion", "defendant's motion"]),
    ("deposition", ["deposition of", "deponent:"]),
    ("medical_record", ["patient name:", "diagnosis:"]),
    ("police_report", ["incident report", "case number:"]),
    ("expert_report", ["expert opinion", "qualifications:"]),
]
QUERY_RULES = [
    ("legal_precedents", ["precedent", "case", "court", "ruling", "law"]),
    ("expert_evidence", ["expert", "opinion", "analysis", "reconstruction"]),
    ("regulatory_compliance", ["regulation", "fmcsr", "dot", "compliance", "violation"]),
    ("procedural_history", ["motion", "filed", "ruling", "discovery", "procedural"]),
    ("argument_strategies", ["argument", "strategy", "successful", "effective"]),
]
TOPICS = {
    "accident": ["accident", "crash", "collision", "incident"],
    "injury": ["injury", "hurt", "pain", "damage", "harm"],
    "speed": ["speed", "mph", "fast", "slow", "velocity"],
    "visibility": ["see", "saw", "visible", "visibility", "dark", "light"],
    "weather": ["weather", "rain", "wet", "dry", "fog", "clear"],
    "safety": ["safety", "safe", "dangerous", "hazard", "risk"],
    "training": ["training", "trained", "procedure", "protocol"],
    "maintenance": ["maintenance", "repair", "inspection", "condition"],
    "liability": ["fault", "responsible", "liability", "negligence"],
    "damages": ["damage", "cost", "expense", "loss", "compensation"],
}
EMAIL_HEADERS = [r"(?m)^From:\s*\S+@\S+", r"(?m)^To:\s*\S+@\S+", r"(?m)^Subject:\s*.+", r"(?m)^Date:\s*.+\d{4}"]
FORM_STARTS = [r"(?mi)^\s*FORM\s+[A-Z0-9\-]+", r"(?mi)^\s*(?:APPLICATION|QUESTIONNAIRE|SURVEY)\s+FORM", r"(?mi)^\s*Please\s+(?:complete|fill)"]
LETTERHEAD = [r"(?i)\b(?:LLC|Inc\.|Corporation|Corp\.|Company|Co\.)\b", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\d{5}(?:-\d{4})?\b", r"(?i)\b(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Drive|Dr\.|Boulevard|Blvd\.)\b"]
SIGNATURE = [r"(?mi)_+\s*\n\s*(?:Signature|Name|Date)", r"(?mi)(?:Sincerely|Respectfully|Best regards),?\s*\n", r"(?mi)^\s*(?:Signed|Executed|Dated):\s*"]
PAGE_NUMBERS = [r"(?m)Page\s+\d+\s+of\s+\d+", r"(?m)\d+\s*/\s*\d+", r"(?m)[-–]\s*\d+\s*[-–]", r"(?m)^\d+$"]


def clean_text(text: Column) -> Column:
    """Blank lines and spaces collapsed, page marks gone, ends trimmed."""
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r" {2,}", " "), r"\[Page \d+\]", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def any_phrase(lowered: Column, phrases: list[str]) -> Column:
    hit = F.lit(False)
    for p in phrases:
        hit = hit | F.contains(lowered, F.lit(p))
    return hit


def first_rule(lowered: Column, rules: list[tuple[str, list[str]]], otherwise: str | None) -> Column:
    """The name of the first rule of which a phrase occurs."""
    out = F.lit(otherwise)
    for name, phrases in reversed(rules):
        out = F.when(any_phrase(lowered, phrases), F.lit(name)).otherwise(out)
    return out


def document_type(text: Column) -> Column:
    """Motions come before complaints, those before the rest; null where nothing is typical."""
    low = F.lower(text)
    complaint = F.contains(low, F.lit("complaint")) & any_phrase(low, ["plaintiff", "cause of action"])
    return F.when(any_phrase(low, DOCUMENT_RULES[0][1]), F.lit("motion")).when(complaint, F.lit("complaint")).otherwise(first_rule(low, DOCUMENT_RULES[1:], None))


def query_type(text: Column) -> Column:
    return first_rule(F.lower(text), QUERY_RULES, "case_facts")


def topics(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(any_phrase(low, words), F.lit(name)) for name, words in TOPICS.items())))


def found(text: Column, pattern: str) -> Column:
    """Distinct matches in the order of their first occurrence."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def bates_number(text: Column) -> Column:
    """The first match of the first pattern that matches; null without any."""
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in BATES))


def bates_prefix(number: Column) -> Column:
    return F.upper(F.regexp_extract(number, r"^([A-Za-z]+)", 1))


def bates_value(number: Column) -> Column:
    return F.regexp_replace(number, r"\D", "").try_cast("long")


def parties(text: Column) -> Column:
    """Names after a role and a colon, or around v.; at most ten, in order."""
    return F.slice(found(text, r"(?<=Plaintiff: |Defendant: )[^,;\n]+"), 1, 10)


def dates(text: Column, most: int = 20) -> Column:
    return F.slice(found(text, DATE), 1, most)


def similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, the ratio of lengths where one holds the other, else the share of the shorter's characters found in the longer."""
    x, y = F.trim(F.lower(a)), F.trim(F.lower(b))
    longer, shorter = F.when(F.length(x) > F.length(y), x).otherwise(y), F.when(F.length(x) > F.length(y), y).otherwise(x)
    shared = F.size(F.filter(F.split(shorter, ""), lambda c: (c != "") & F.contains(longer, c)))
    return F.when(x == y, F.lit(1.0)).when(F.contains(longer, shorter), F.length(shorter) / F.length(longer)).otherwise(shared / F.length(longer))


def passes_quality_gate(text: Column, least: int = 100) -> Column:
    """Enough characters with white space collapsed, and at most a tenth of replacement characters."""
    plain = F.trim(F.regexp_replace(text, r"\s+", " "))
    broken = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.coalesce((F.length(plain) >= least) & (broken <= F.length(text) * 0.1), F.lit(False))


def quality_score(text: Column, least: int = 100) -> Column:
    """Of a chunk: short, padded and fragmented text lose, complete sentences win; from 0.1 to 1."""
    n = F.length(text)
    sentences = F.regexp_count(text, F.lit(r"[.!?]+\s+"))
    breaks = n - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    score = F.when(n < least, 0.7).otherwise(1.0) * F.when(F.length(F.trim(text)) / n < 0.8, 0.8).otherwise(1.0)
    score = score * F.when(sentences > 0, F.least(F.lit(1.2), 1.0 + sentences * 0.1)).otherwise(1.0) * F.when(breaks > n / 50, 0.9).otherwise(1.0)
    return F.when(n > 0, F.greatest(F.lit(0.1), F.least(F.lit(1.0), score))).otherwise(F.lit(0.1))


def count_patterns(text: Column, patterns: list[str]) -> Column:
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(text.rlike(p), F.lit(False)).cast("int")
    return total


def is_email_start(text: Column) -> Column:
    return count_patterns(F.substring(text, 1, 500), EMAIL_HEADERS) >= 2


def is_form_start(text: Column) -> Column:
    return count_patterns(F.substring(text, 1, 300), FORM_STARTS) >= 1


def has_letterhead(text: Column, page: Column) -> Column:
    return (page > 0) & (count_patterns(F.substring(text, 1, 500), LETTERHEAD) >= 2)


def has_signature(text: Column) -> Column:
    return count_patterns(F.lower(text), SIGNATURE) >= 1


def has_page_number(text: Column) -> Column:
    return count_patterns(text, PAGE_NUMBERS) >= 1


PAGE_NUMBER_PARTS = [r"(?i)Page\s+(\d+)\s+of", r"(?i)Page\s+(\d+)", r"(\d+)\s*/\s*\d+", r"[-–]\s*(\d+)\s*[-–]"]


def page_number(text: Column) -> Column:
    """The number that a page bears, by the first pattern that finds one; null without."""
    return F.coalesce(*(F.regexp_extract(text, p, 1).try_cast("int") for p in PAGE_NUMBER_PARTS))


def page_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3000).cast("int"))


def safe_filename(name: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"^[. ]+|[. ]+$", ""), 1, 255)


def redacted(message: Column) -> Column:
    """Values of password-like keys masked."""
    return F.regexp_replace(message, r"(?i)\b(password|secret|token|api_key)\s*[=:]\s*\S+", "$1=***")


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags gone, common entities read, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for entity, raw in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(raw))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
