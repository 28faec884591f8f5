"""Titles, kinds and authors of documents as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
MARKER_TYPES = {
    "DEPOSITION": "DEPOSITION", "AFFIDAVIT": "AFFIDAVIT", "EXPERT REPORT": "EXPERT_REPORT", "BILL OF LADING": "BILL_OF_LADING", "INVOICE": "INVOICE",
    "CONTRACT": "CONTRACT", "POLICE REPORT": "POLICE_REPORT", "MEDICAL RECORD": "MEDICAL_RECORD", "EMPLOYMENT APPLICATION": "EMPLOYMENT_APPLICATION",
    "DRIVER QUALIFICATION": "DRIVER_QUALIFICATION_FILE", "MAINTENANCE": "MAINTENANCE_RECORD", "TRIP REPORT": "TRIP_REPORT",
    "HOURS OF SERVICE": "HOS_LOG", "ACCIDENT": "ACCIDENT_INVESTIGATION_REPORT",
}
SEGMENT_TITLES = [r"(?m)^([A-Z\s]{10,50})\n", r"(?m)^\s*(.{10,50})\n\s*\n", r"(?m)RE:\s*(.+)\n", r"(?m)SUBJECT:\s*(.+)\n"]
FILE_KINDS = [("deposition", "deposition"), ("motion", "motion"), ("interrogatory", "interrogatory"), ("request", "request_for_production"), ("report", "expert_report")]
LEGAL_TERMS = ["negligence", "liability", "duty", "breach", "damages", "causation", "standard of care", "reasonable person", "proximate cause", "foreseeability"]
EVIDENCE_PRIORITY = {"deposition": 1.0, "exhibit": 0.9, "expert_report": 0.85, "video_evidence": 0.8, "internal_communication": 0.75, "regulatory": 0.7, "maintenance_record": 0.65, "document": 0.5}


def _first(cases: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    out = F.when(*cases[0])
    for condition, value in cases[1:]:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def marker_type(marker: Column) -> Column:
    """The kind that the first known phrase in a marker stands for; null without one."""
    upper = F.upper(marker)
    return _first([(F.contains(upper, F.lit(k)), F.lit(v)) for k, v in MARKER_TYPES.items()])


def type_of_hint(hint: Column, kinds: list[str]) -> Column:
    """The kind named by a hint: exactly, or else the first that contains it, or else other."""
    name = F.lower(F.replace(F.replace(hint, F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_")))
    return _first([(name == k, F.lit(k)) for k in kinds] + [(F.contains(F.lit(k), name), F.lit(k)) for k in kinds], F.lit("other"))


def page_title(text: Column) -> Column:
    """A title in a page's first ten lines: the first of over 10 and under 100 characters that is all capitals and more than one word (shown in
    title case), holds a marker, or is one of the first five lines and longer than 20."""
    lines = F.transform(F.slice(F.split(text, "\n", -1), 1, 10), lambda x, i: F.struct(F.trim(x).alias("x"), i.alias("i")))
    capitals = lambda x: (F.upper(x) == x) & (F.lower(x) != x) & (F.size(F.split(x, r"\s+")) > 1)
    fits = lambda e: (F.length(e["x"]) > 10) & (F.length(e["x"]) < 100) & (capitals(e["x"]) | marker_type(e["x"]).isNotNull() | ((e["i"] < 5) & (F.length(e["x"]) > 20)))
    found = F.try_element_at(F.filter(lines, fits), F.lit(1))["x"]
    return F.when(capitals(found), F.initcap(found)).otherwise(found)


def segment_title(text: Column, kind: Column) -> Column:
    """The first pattern's title of over 10 characters in the first 500, or else the kind in title case."""
    head = F.left(text, F.lit(500))
    found = [F.trim(F.regexp_extract(head, p, 1)) for p in SEGMENT_TITLES]
    return F.coalesce(*(F.when(F.length(f) > 10, f) for f in found), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def author(parties: Column, kind: Column) -> Column:
    """The deponent of a deposition; the first expert among the parties of a report or affidavit."""
    expert = F.try_element_at(F.filter(parties, lambda p: p.rlike(r"Dr\.|MD|Ph\.D|P\.E\.")), F.lit(1))
    return F.when(kind == "deposition", F.try_element_at(parties, F.lit(1))).when(kind.isin("expert_report", "affidavit"), expert)


def generated_title(path: Column, kind: Column, parties: Column) -> Column:
    """A title by the kind of document: of motions by the file's name, of testimony and reports by the first party."""
    name = F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".pdf"), F.lit(""))
    plain, lower, party = F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lower(name), F.try_element_at(parties, F.lit(1))
    motion = F.when(lower.rlike("dismiss|mtd"), "Motion to Dismiss").when(lower.rlike("summary|msj"), "Motion for Summary Judgment").otherwise(plain)
    named = _first([(kind == k, F.concat(F.lit(t), party)) for k, t in (("deposition", "Deposition of "), ("medical_record", "Medical Records - "), ("expert_report", "Expert Report - "))])
    return F.when(kind == "motion", motion).otherwise(F.coalesce(named, plain))


def kind_of_file(name: Column) -> Column:
    return _first([(F.contains(F.lower(name), F.lit(k)), F.lit(v)) for k, v in FILE_KINDS], F.lit("unknown"))


def key_terms(content: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.array(*(F.lit(t) for t in LEGAL_TERMS)), lambda t: F.contains(F.lower(content), t)), 1, most)


def evidence_priority(kind: Column, citation: Column) -> Column:
    """A kind's weight, a tenth more if its citation names a line."""
    base = _first([(kind == k, F.lit(v)) for k, v in EVIDENCE_PRIORITY.items()], F.lit(0.5))
    return base + F.when(F.contains(citation, F.lit(":")), 0.1).otherwise(0.0)


def segment_summary(kind: Column, first: Column, last: Column, confidence: Column, bates_first: Column, bates_last: Column) -> Column:
    bates = F.when(bates_first.isNotNull(), F.concat(F.lit("Bates: "), bates_first, F.lit("-"), bates_last))
    return F.concat_ws(". ", F.concat(kind, F.lit(" document")), F.concat(F.lit("Pages "), first.cast("string"), F.lit("-"), last.cast("string")), F.concat(F.lit("Confidence: "), F.format_string("%.2f", confidence)), bates)


def key_pages(pages: Column) -> Column:
    """A segment's first and last page."""
    return F.when(pages > 1, F.array(F.lit(1).cast("long"), pages.cast("long"))).otherwise(F.array(F.lit(1).cast("long")))
