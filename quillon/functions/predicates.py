"""Predicates and validators as Column expressions; null never passes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tables that all cases share, and phrases of refusals and attacks.
SHARED = ["florida_statutes", "fmcsr_regulations", "federal_rules", "case_law_precedents"]
REFUSALS = "i cannot|i can't|i'm unable|as an ai|no context"
SUSPICIOUS = [r"(?i)<script", r"(?i)javascript:", r"(?i)\bon\w+\s*=", r"(?i)\bdrop\s+table\b", r"\.\./"]


def is_shared(collection: Column, shared: list[str] | None = None) -> Column:
    return F.coalesce(F.lower(F.trim(collection)).isin(shared or SHARED), F.lit(False))


def may_read(collection: Column, case: Column, extra: list[str] | None = None) -> Column:
    """A case reads its own tables, the shared ones and those listed."""
    own = F.startswith(collection, F.concat(case, F.lit("_"))) | (collection == case)
    return F.coalesce(own, F.lit(False)) | is_shared(collection) | F.coalesce(collection.isin(extra or []), F.lit(False))


def same_case(row_case: Column, case: Column) -> Column:
    """Rows without a case are nobody's and pass."""
    return row_case.isNull() | (row_case == case)


def in_period(date: Column, first: Column | None = None, last: Column | None = None, keep_undated: bool = True) -> Column:
    """Both ends count; rows without a date stay if wanted."""
    inside = F.lit(True)
    if first is not None:
        inside = inside & (date >= first)
    if last is not None:
        inside = inside & (date <= last)
    return F.coalesce(inside, F.lit(keep_undated))


def fact_matches(content: Column, categories: Column, confidence: Column, needle: str = "", wanted: list[str] | None = None, least: float = 0.0) -> Column:
    hit = F.contains(F.lower(content), F.lit(needle.lower())) & (confidence >= least)
    return F.coalesce(hit & categories.isin(wanted) if wanted else hit, F.lit(False))


def valid_context(context: Column) -> Column:
    return F.coalesce((F.length(context) >= 10) & ~F.lower(context).rlike(REFUSALS), F.lit(False))


def valid_input(value: Column, most: int = 1000) -> Column:
    bad = F.lit(False)
    for pattern in SUSPICIOUS:
        bad = bad | value.rlike(pattern)
    return F.coalesce((F.length(value) <= most) & ~bad, F.lit(False))


def missing_keys(metadata: Column, required: list[str]) -> Column:
    """The required keys that a map lacks or has blank, in order."""
    return F.filter(F.array(*(F.lit(k) for k in required)), lambda k: F.coalesce(F.trim(F.try_element_at(metadata, k)) == "", F.lit(True)))


def outline_complete(titles: Column, required: list[str]) -> Column:
    return F.forall(F.array(*(F.lit(r.lower()) for r in required)), lambda r: F.exists(titles, lambda t: F.contains(F.lower(t), r)))


def is_full(documents: Column, size_mb: Column, most_documents: int, most_mb: float) -> Column:
    return (documents >= most_documents) | (size_mb >= most_mb)


def is_large(pages: Column) -> Column:
    return pages > 50


def view_candidate(key: Column) -> Column:
    return F.lower(key).rlike("aggregation|stats|summary|count")


def search_is_valid(limit: int, threshold: float) -> bool:
    return 1 <= limit <= 100 and 0 <= threshold <= 1
