"""Searches of each kind of finding: what is asked for is filtered before anything is scored, and results come best first, in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How sure a finding of each store is where the store doesn't say.
STORE_SCORES = {"fact": 1.0, "deposition": 0.8, "exhibit": 0.7, "statute": 0.9, "regulation": 0.9}
#: Limits of a search.
MOST = 100


def checked(limit: int, threshold: float = 0.0) -> None:
    """Refuse a limit outside of 1 to MOST, or a threshold outside of 0 to 1."""
    if not 1 <= limit <= MOST or not 0 <= threshold <= 1:
        raise ValueError(f"a limit is 1 to {MOST}, a threshold 0 to 1")


def any_of(column: str, wanted: list | None) -> Column:
    """Whether a column is one of the wanted values; no wish takes all."""
    return F.coalesce(F.col(column).isin(wanted), F.lit(False)) if wanted else F.lit(True)


def any_topic(column: str, wanted: list[str] | None) -> Column:
    """Whether an array of topics has one of the wanted; no wish takes all."""
    return F.coalesce(F.arrays_overlap(column, F.array(*(F.lit(t) for t in wanted))), F.lit(False)) if wanted else F.lit(True)


def page(found: DataFrame, limit: int = 10, offset: int = 0, score: str = "score", key: str = "id") -> DataFrame:
    checked(limit)
    return found.orderBy(F.desc(score), key).offset(offset).limit(limit)


def facts(table: DataFrame, categories: list[str] | None = None, first: str | None = None, last: str | None = None) -> Column:
    """For facts: categories, and a primary date from first to last, both included; a fact without a date has none of a stated time."""
    keep = any_of("category", categories)
    for bound, test in ((first, lambda b: F.col("primary_date") >= F.lit(b).cast("date")), (last, lambda b: F.col("primary_date") <= F.lit(b).cast("date"))):
        if bound is not None:
            keep = keep & F.coalesce(test(bound), F.lit(False))
    return keep


def testimony(case: str, deponent: str | None = None, topics: list[str] | None = None) -> Column:
    return (F.col("case_name") == case) & (any_of("deponent", [deponent]) if deponent else F.lit(True)) & any_topic("topics", topics)


def exhibits(case: str, document_type: str | None = None, status: str | None = None) -> Column:
    return (F.col("case_name") == case) & any_of("document_type", [document_type] if document_type else None) & any_of("authenticity_status", [status] if status else None)


def regulations(parts: list | None = None, topics: list[str] | None = None) -> Column:
    """Any of the parts and any of the topics."""
    return any_of("part", parts) & any_topic("topics", topics)


def reviewed(sources: list[str] | None = None, categories: list[str] | None = None, least: float = 0.0, needle: str = "", status: str | None = None, deleted: bool = False) -> Column:
    """For facts under review: not deleted unless asked for, of the sources and categories, sure enough, of a status, and with the needle in the content, a keyword or an entity, in any case."""
    keep = any_of("source_document", sources) & any_of("category", categories) & any_of("review_status", [status] if status else None)
    if not deleted:
        keep = keep & ~F.coalesce("is_deleted", F.lit(False))
    if least > 0:
        keep = keep & F.coalesce(F.col("confidence") >= least, F.lit(False))
    if needle:
        holds = lambda x: F.contains(F.lower(x), F.lit(needle.lower()))
        listed = lambda c: F.coalesce(F.exists(F.coalesce(c, F.array().cast("array<string>")), holds), F.lit(False))
        keep = keep & (F.coalesce(holds(F.col("content")), F.lit(False)) | listed("keywords") | listed("entities"))
    return keep


def fan_in(stores: dict[str, DataFrame], limit: int) -> DataFrame:
    """(id, source_type, score): limit rows of each store (id, and score where it has one) with the store's own or its usual score."""
    checked(limit)
    out = None
    for kind, rows in stores.items():
        score = F.col("score") if "score" in rows.columns else F.lit(STORE_SCORES[kind])
        one = rows.select("id", F.lit(kind).alias("source_type"), score.alias("score")).orderBy(F.desc("score"), "id").limit(limit)
        out = one if out is None else out.unionByName(one)
    return out


def inserted_cases(new: DataFrame, matters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases (case_id, matter_id, access_level) whose matter (matter_id, access_level) exists, with the matter's level where they have none; and those whose matter doesn't."""
    known = matters.select("matter_id", F.col("access_level").alias("inherited"))
    good = new.join(known, "matter_id").withColumn("access_level", F.coalesce("access_level", "inherited")).drop("inherited")
    return good, new.join(known, "matter_id", "left_anti")


def authority_overlap(outlines: DataFrame, motions: DataFrame) -> DataFrame:
    """(motion_id, authority) of outlines (motion_id, authority) that bear on the motion (motion_id, motion_type, content): all of an argument's, of others those that the content names."""
    bears = F.contains(F.lower("motion_type"), F.lit("argument")) | F.contains(F.lower("content"), F.lower("authority"))
    return outlines.join(motions, "motion_id").where(F.coalesce(bears, F.lit(False))).select("motion_id", "authority").distinct()


def excerpts(content: Column, claim: Column, shared: int = 2, most: int = 3) -> Column:
    """The first sentences of 20 to 300 characters that share so many words with a claim."""
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), r"\W+"), lambda w: w != ""))
    sentences = F.filter(F.transform(F.split(content, r"[.!?]"), lambda s: F.trim(s)), lambda s: (F.length(s) > 20) & (F.length(s) < 300))
    return F.slice(F.filter(sentences, lambda s: F.size(F.array_intersect(words(s), words(claim))) >= shared), 1, most)
