"""Measures of a drafted motion: how dense, specific and strong its citations are, how its parts are balanced, and how coherent that makes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of sections, and of citations that make an argument strong; citations of a hundred words that are dense enough.
ARGUING, OPENING, CLOSING = ["argument", "memorandum_of_law"], ["introduction", "preintroduction"], ["conclusion", "prayer_for_relief", "prayer"]
STRONG, DENSE = ["deposition", "exhibit", "expert_report"], 3.0


def section_quality(sections: DataFrame, citations: DataFrame) -> DataFrame:
    """(motion_id, ordinal, density, specificity, strength) of arguing sections.

    sections (motion_id, ordinal, kind, words); citations (motion_id, ordinal, kind, page, line, exhibit, date). density: citations of a hundred
    words; specificity: the share that names a page, line, exhibit or date; strength: how many of three kinds of evidence there are, of three.
    """
    exact = F.coalesce(F.col("page").cast("string"), F.col("line").cast("string"), F.col("exhibit").cast("string"), F.col("date").cast("string")).isNotNull()
    counted = citations.groupBy("motion_id", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.count_if(exact).alias("exact"), *(F.max(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"has_{k}") for k in STRONG))
    joined = sections.where(F.col("kind").isin(ARGUING)).select("motion_id", "ordinal", "words").join(counted, ["motion_id", "ordinal"], "left")
    n = F.coalesce("n", F.lit(0))
    density = F.when(F.col("words") > 0, n / F.col("words") * 100).otherwise(0.0)
    specificity = F.when(n > 0, F.coalesce("exact", F.lit(0)) / n).otherwise(0.0)
    return joined.select("motion_id", "ordinal", density.alias("density"), specificity.alias("specificity"), (sum((F.coalesce(f"has_{k}", F.lit(0)) for k in STRONG), F.lit(0)) / 3).alias("strength"))


def quality_metrics(sections: DataFrame, citations: DataFrame) -> DataFrame:
    """One row for each motion: words, complete sections, shares of its parts in per cent, means over its arguing sections, and coherence.

    coherence is the mean of what there is of four parts: balance (up to one half each for the opening and the arguments), specificity, density
    (up to one), strength. A motion without words has no balance; one without any part gets 0.7.
    """
    words = lambda kinds: F.sum(F.when(F.col("kind").isin(kinds), F.col("words")).otherwise(0))
    sums = sections.groupBy("motion_id").agg(F.sum("words").alias("words"), F.count_if(F.col("words") > 0).alias("complete"), words(OPENING).alias("opening"), words(ARGUING).alias("arguing"), words(CLOSING).alias("closing"))
    means = section_quality(sections, citations).groupBy("motion_id").agg(*(F.avg(c).alias(c) for c in ("density", "specificity", "strength")))
    share = lambda c: F.when(F.col("words") > 0, F.col(c) / F.col("words"))
    opening, arguing = share("opening"), share("arguing")
    balance = F.when(opening.between(0.05, 0.10), 0.5).when(opening <= 0.15, 0.3).otherwise(0.0) + F.when(arguing.between(0.75, 0.85), 0.5).when(arguing >= 0.70, 0.3).otherwise(0.0)
    parts = F.array_compact(F.array(F.when(F.col("words") > 0, balance), F.col("specificity"), F.when(F.col("density").isNotNull(), F.least(F.col("density") / DENSE, F.lit(1.0))), F.col("strength")))
    mean = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts)
    per_cent = lambda c: F.round(F.coalesce(share(c), F.lit(0.0)) * 100, 1)
    zero = lambda c: _round(F.coalesce(F.col(c), F.lit(0.0)))
    joined = sums.join(means, "motion_id", "left")
    return joined.select(
        "motion_id", "words", "complete", per_cent("opening").alias("opening_share"), per_cent("arguing").alias("argument_share"), per_cent("closing").alias("closing_share"),
        zero("density").alias("density"), zero("specificity").alias("specificity"), zero("strength").alias("strength"), _round(F.when(F.size(parts) > 0, mean).otherwise(0.7)).alias("coherence"),
    )


def _round(x: Column) -> Column:
    return F.round(x, 6)
