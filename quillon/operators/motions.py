"""Sections of motions: order, duplicates, budgets, confidence and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Results depend on them.
STRUCTURE_WORDS = ["first", "second", "third", "moreover", "furthermore", "additionally", "however", "nevertheless", "therefore", "accordingly", "issue", "rule", "application", "conclusion"]
SECTION_ORDER = ["introduction", "facts", "legal_standard", "argument", "conclusion", "prayer"]


def heading_kind(heading: Column, kind: Column) -> Column:
    """The kind that a heading's words name, or else the given one."""
    has = lambda w: F.contains(F.lower(heading), F.lit(w))
    return F.when(has("conclusion"), "conclusion").when(has("introduction"), "introduction").when(has("facts"), "facts").when(has("prayer") | has("relief"), "prayer").otherwise(kind)


def keep_first_sections(sections: DataFrame) -> DataFrame:
    """sections (motion_id, ordinal, heading, kind) without later conclusions, prayers and introductions."""
    named = sections.withColumn("actual", heading_kind(F.col("heading"), F.col("kind")))
    nth = F.row_number().over(Window.partitionBy("motion_id", "actual").orderBy("ordinal"))
    once = F.col("actual").isin("conclusion", "prayer", "introduction")
    return named.withColumn("nth", nth).where(~once | (F.col("nth") == 1)).drop("nth")


def order_issues(sections: DataFrame) -> DataFrame:
    """(motion_id, ordinal, kind): sections that come after one of a later kind."""
    rank = F.array_position(F.array(*(F.lit(k) for k in SECTION_ORDER)), F.col("kind"))
    before = F.max("rank").over(Window.partitionBy("motion_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return sections.withColumn("rank", rank).withColumn("reached", before).where((F.col("rank") > 0) & (F.col("rank") < F.col("reached"))).select("motion_id", "ordinal", "kind")


def missing_kinds(sections: DataFrame, required: list[str]) -> DataFrame:
    """(motion_id, kind): required kinds that a motion lacks."""
    wanted = sections.select("motion_id").distinct().select("motion_id", F.explode(F.array(*(F.lit(k) for k in required))).alias("kind"))
    return wanted.join(sections.select("motion_id", "kind").distinct(), ["motion_id", "kind"], "left_anti")


def regrouped(sections: DataFrame) -> DataFrame:
    """(motion_id, kind, position, words, citations): one section of each kind in the fixed order; arguments are put together, their words summed and
    their citations made distinct; of the others the first stays."""
    rank = F.array_position(F.array(*(F.lit(k) for k in SECTION_ORDER)), F.col("kind"))
    ordered = sections.withColumn("nth", F.row_number().over(Window.partitionBy("motion_id", "kind").orderBy("ordinal"))).where((F.col("kind") == "argument") | (F.col("nth") == 1))
    joined = ordered.withColumn("rank", rank).where("rank > 0").groupBy("motion_id", "kind", "rank").agg(F.sum("words").alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("citations"))
    return joined.withColumn("position", F.row_number().over(Window.partitionBy("motion_id").orderBy("rank"))).select("motion_id", "kind", "position", "words", "citations")


def word_budget(sections: DataFrame, target: int, fixed: dict[str, float] | None = None, least: int = 100, most: int = 3000) -> DataFrame:
    """sections (motion_id, ordinal, kind, weight) with budget: fixed shares of target for some kinds, the rest dealt to the others by weight, within limits."""
    shares = fixed or {"introduction": 0.07, "conclusion": 0.07, "prayer": 0.06}
    share = F.lit(None).cast("double")
    for kind, value in shares.items():
        share = F.when(F.col("kind") == kind, value).otherwise(share)
    own = sections.withColumn("share", share)
    motion = Window.partitionBy("motion_id")
    left = target * (1 - F.coalesce(F.sum("share").over(motion), F.lit(0.0)))
    weights = F.sum(F.when(F.col("share").isNull(), F.col("weight"))).over(motion)
    dealt = F.when(F.col("share").isNotNull(), target * F.col("share")).otherwise(left * F.col("weight") / weights)
    return own.withColumn("budget", F.least(F.greatest(F.floor(F.round(dealt, 6)), F.lit(least)), F.lit(most)).cast("long")).drop("share")


def batches(sections: DataFrame, size: int = 3) -> DataFrame:
    """sections with batch: runs of size sections by ordinal."""
    nth = F.row_number().over(Window.partitionBy("motion_id").orderBy("ordinal")) - 1
    return sections.withColumn("batch", F.floor(nth / size))


def section_confidence(content: Column, words: Column, target: Column, points: Column, authorities: Column) -> Column:
    """30 for length, 25 for points with one of their first five words in the text, 25 for authorities named, up to 20 for words of structure; over 100."""
    lower = F.lower(content)
    length = F.least(words / target, F.lit(1.0)) * 30
    touched = F.filter(points, lambda p: F.exists(F.slice(F.split(F.lower(p), " "), 1, 5), lambda w: F.contains(lower, w)))
    named = F.filter(authorities, lambda a: F.contains(content, a) | F.contains(content, F.replace(a, F.lit(" "), F.lit(""))))
    share = lambda some, of: F.when(F.size(of) == 0, 25.0).otherwise(F.size(some) / F.size(of) * 25)
    structure = sum((F.contains(lower, F.lit(w)).cast("int") for w in STRUCTURE_WORDS), F.lit(0)) * 2
    return (length + share(touched, points) + share(named, authorities) + F.least(structure, F.lit(20))) / 100


def readiness(drafts: DataFrame) -> DataFrame:
    """(draft_id, accuracy, strength, consistency, readiness) of drafts' sections (draft_id, coherence, required, found, confidence)."""
    summed = drafts.groupBy("draft_id").agg(F.max("coherence").alias("coherence"), F.sum("required").alias("required"), F.sum("found").alias("found"), F.avg("confidence").alias("strength"))
    accuracy = F.least(F.lit(1.0), F.col("found") / F.greatest(F.col("required"), F.lit(1)))
    score = F.floor(F.round((F.col("coherence") * 0.4 + F.col("accuracy") * 0.3 + F.col("strength") * 0.3) * 10, 9)).cast("long")
    return summed.withColumn("accuracy", accuracy).select("draft_id", "accuracy", "strength", F.when(F.col("coherence") > 0.7, 0.9).otherwise(0.6).alias("consistency"), score.alias("readiness"))


def page_estimate(sections: Column, subsections: Column, kind: Column) -> Column:
    """Pages of an outline: 3 a section, 1.5 a subsection, more for summary judgment, fewer for discovery; 15 to 40."""
    factor = F.when(kind == "summary_judgment", 1.5).when(kind.isin("discovery", "compel"), 0.8).otherwise(1.0)
    return F.greatest(F.lit(15), F.least(F.lit(40), F.floor((sections * 3 + subsections * 1.5) * factor))).cast("long")


def recent_context(sections: DataFrame, last: int = 2, most: int = 15) -> DataFrame:
    """(motion_id, ordinal, summaries, citations): what the last two sections before each hand on."""
    before = Window.partitionBy("motion_id").orderBy("ordinal").rowsBetween(-last, -1)
    return sections.select("motion_id", "ordinal", F.collect_list("summary").over(before).alias("summaries"), F.slice(F.array_distinct(F.flatten(F.collect_list("citations").over(before))), 1, most).alias("citations"))


def unused_content(points: DataFrame, prefix: int = 50, most: int = 7) -> DataFrame:
    """points (section_id, ordinal, point, content) whose beginning the section's text doesn't hold, the first few of each section."""
    unused = points.where(~F.contains(F.lower("content"), F.lower(F.left(F.col("point"), F.lit(prefix)))))
    return unused.withColumn("nth", F.row_number().over(Window.partitionBy("section_id").orderBy("ordinal"))).where(F.col("nth") <= most).select("section_id", "ordinal", "point")


def between_headings(lines: DataFrame, first: str, then: str) -> DataFrame:
    """lines (doc_id, line, content) after a heading that holds first and before the next one that holds then."""
    order = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.max(F.contains(F.lower("content"), F.lit(first.lower())).cast("int")).over(order)
    at = F.min(F.when(F.contains(F.lower("content"), F.lit(first.lower())), F.col("line"))).over(Window.partitionBy("doc_id"))
    closed = F.max((F.contains(F.lower("content"), F.lit(then.lower())) & (F.col("line") > at)).cast("int")).over(order)
    return lines.where("true").withColumn("at", at).withColumn("inside", (opened == 1) & (closed == 0) & (F.col("line") > at)).where("inside").select("doc_id", "line", "content")
