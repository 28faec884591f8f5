"""Boundaries between documents in a run of pages: windows over page features, reconciliation, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text, titles


def page_features(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) with what boundaries are told by."""
    t = F.col("text")
    density = F.least(F.lit(1.0), F.length(t) / 3000)
    return pages.select(
        "doc_id", "page", "text", density.alias("density"), text.page_number(t).alias("page_number"), text.bates_number(t).alias("bates"), text.is_email_start(t).alias("is_email"), text.is_form_start(t).alias("is_form"), text.has_letterhead(t, F.col("page")).alias("has_letterhead"), text.has_signature(t).alias("has_signature"), titles.marker_type(F.substring(t, 1, 1000)).isNotNull().alias("has_marker")
    )


def _before(name: str) -> Column:
    return F.lag(name).over(Window.partitionBy("doc_id").orderBy("page"))


def hard_boundaries(features: DataFrame) -> DataFrame:
    """Pages whose signs of a beginning add up to over 0.5 (at most 1)."""
    was = _before("bates")
    follows = (text.bates_prefix(was) == text.bates_prefix(F.col("bates"))) & (text.bates_value(F.col("bates")) == text.bates_value(was) + 1)
    broken = was.isNotNull() & F.col("bates").isNotNull() & ~F.coalesce(follows, F.lit(False))
    marker = F.coalesce(F.col("has_marker"), F.lit(False)) if "has_marker" in features.columns else F.lit(False)
    score = 0.4 * marker.cast("int") + 0.5 * F.col("is_email").cast("int") + 0.4 * F.col("is_form").cast("int") + 0.3 * F.col("has_letterhead").cast("int") + 0.3 * broken.cast("int")
    return features.withColumn("confidence", F.least(F.lit(1.0), score)).where("confidence > 0.5").select("doc_id", "page", "confidence")


def soft_boundaries(features: DataFrame) -> DataFrame:
    """Pages that differ from the one before: density by over 0.3, or numbering that starts anew."""
    dense = (F.abs(F.col("density") - _before("density")) > 0.3).cast("int")
    reset = ((_before("page_number") > 1) & (F.col("page_number") == 1)).cast("int")
    score = 0.2 * F.coalesce(dense, F.lit(0)) + 0.4 * F.coalesce(reset, F.lit(0))
    return features.withColumn("confidence", score).where("confidence > 0.3").select("doc_id", "page", "confidence")


def density_changes(features: DataFrame, least: float = 0.3) -> DataFrame:
    return features.withColumn("change", F.abs(F.col("density") - _before("density"))).where(F.col("change") > least).select("doc_id", "page", "change")


def merge_overlaps(intervals: DataFrame) -> DataFrame:
    """(doc_id, start, end): the union of overlapping or touching intervals; one without a start belongs to the last. Both windows have one order,
    so that Spark sorts once: a second sort might turn equal intervals round and so part or double spans."""
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("opens", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0))
    grouped = marked.withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "group").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "start", "end")


def cover(segments: DataFrame, totals: DataFrame | int) -> DataFrame:
    """segments (doc_id, start, end; disjoint) and the fragments between, before and after them, up to totals (doc_id, pages), or a number of pages
    that every document of segments has."""
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("start"))
    if isinstance(totals, int):
        joined = segments.select("doc_id", F.lit(totals).alias("pages"), "start", "end", F.lit(True).alias("found"))
    else:
        joined = totals.join(segments.withColumn("found", F.lit(True)), "doc_id", "left")
    whole = joined.where(F.col("found").isNull()).select("doc_id", F.lit(0).alias("start"), (F.col("pages") - 1).cast("int").alias("end"), F.lit("fragment").alias("kind"))
    known = joined.where(F.col("found")).select("doc_id", "pages", "start", "end", F.lag("end", 1, -1).over(order).alias("before"), F.lead("start").over(order).alias("next"))
    gaps = known.where("start > before + 1").select("doc_id", (F.col("before") + 1).cast("int").alias("start"), (F.col("start") - 1).cast("int").alias("end"), F.lit("fragment").alias("kind"))
    tail = known.where("next IS NULL AND end < pages - 1").select("doc_id", (F.col("end") + 1).cast("int").alias("start"), (F.col("pages") - 1).cast("int").alias("end"), F.lit("fragment").alias("kind"))
    own = known.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.lit("document").alias("kind"))
    return own.unionByName(gaps).unionByName(tail).unionByName(whole)


def reconcile(found: DataFrame, near: float = 0.2) -> DataFrame:
    """(doc_id, start, end, confidence, kind): boundaries in order; where two overlap they merge if they are alike in confidence and kind, else
    the surer stays. A document's boundaries, which are few, are folded in its row."""
    one = F.struct("start", "end", "confidence", "kind")
    ordered = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("b"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        alike = (F.abs(last["confidence"] - x["confidence"]) < near) & F.coalesce(last["kind"] == x["kind"], F.lit(False))
        merged = F.struct(F.least(last["start"], x["start"]).alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["confidence"], x["confidence"]).alias("confidence"), F.coalesce(last["kind"], x["kind"]).alias("kind"))
        before = F.slice(done, 1, F.size(done) - 1)
        better = F.when(alike, F.concat(before, F.array(merged))).when(x["confidence"] > last["confidence"], F.concat(before, F.array(x))).otherwise(done)
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= last["end"], better).otherwise(F.concat(done, F.array(x)))

    empty = F.slice("b", 1, 0)
    return ordered.select("doc_id", F.explode(F.aggregate("b", empty, step)).alias("x")).select("doc_id", "x.*")


def reconcile_adjacent(found: DataFrame) -> DataFrame:
    """(doc_id, start, end, confidence, kind): boundaries in order; where one overlaps or touches the last, they are one document if their kinds are
    the same (and known) or over half of the shorter overlaps; else the last one ends before the next begins."""
    ordered = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "confidence", "kind"))).alias("b"))

    def step(done: Column, x: Column) -> Column:
        last, before = F.element_at(done, -1), F.slice(done, 1, F.size(done) - 1)
        overlap = F.least(last["end"], x["end"]) - F.greatest(last["start"], x["start"]) + 1
        shorter = F.least(last["end"] - last["start"], x["end"] - x["start"]) + 1
        same = ((last["kind"] == x["kind"]) & (x["kind"] != "other")) | (overlap > 0.5 * shorter)
        field = lambda of, name: of[name].alias(name)
        joined = F.struct(F.least(last["start"], x["start"]).alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.greatest(last["confidence"], x["confidence"]).alias("confidence"), F.when(x["confidence"] > last["confidence"], x["kind"]).otherwise(last["kind"]).alias("kind"))
        cut = F.struct(field(last, "start"), (x["start"] - 1).alias("end"), field(last, "confidence"), field(last, "kind"))
        met = F.when(F.coalesce(same, F.lit(False)), F.concat(before, F.array(joined))).otherwise(F.concat(before, F.array(cut), F.array(x)))
        return F.when(F.size(done) == 0, F.array(x)).when(x["start"] <= last["end"] + 1, met).otherwise(F.concat(done, F.array(x)))

    return ordered.select("doc_id", F.explode(F.aggregate("b", F.slice("b", 1, 0), step)).alias("x")).select("doc_id", "x.*")


def large_sections(documents: DataFrame, size: int = 25) -> DataFrame:
    """(doc_id, section, sections, first, last): documents (doc_id, pages) in fixed groups of size pages."""
    sections = F.ceil(F.col("pages") / size).cast("int")
    cut = documents.where("pages > 0").select("doc_id", "pages", sections.alias("sections"), F.explode(F.sequence(F.lit(1), sections)).alias("section"))
    return cut.select("doc_id", "section", "sections", ((F.col("section") - 1) * size).alias("first"), F.least(F.col("section") * size, F.col("pages")).alias("last"))


def split_production(pages: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, start, end, kind): pages (doc_id, page, text) of a production cut into documents: signs of hard and soft boundaries, each lasting to
    the next one, reconciled; the sure ones are kept, and fragments fill what they leave."""
    features = page_features(pages)
    found = hard_boundaries(features).unionByName(soft_boundaries(features)).groupBy("doc_id", "page").agg(F.max("confidence").alias("confidence"))
    marked = pages.select("doc_id", "page").join(found, ["doc_id", "page"], "left").withColumn("is_start", F.col("confidence").isNotNull())
    spans = document_ends(marked).where("is_start").select("doc_id", F.col("page").alias("start"), F.col("last_page").alias("end"), "confidence", F.lit(None).cast("string").alias("kind"))
    totals = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))
    return cover(reconcile(spans).where(F.col("confidence") >= least), totals)


def document_ends(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, is_start) with last_page, the page before the next start."""
    later = Window.partitionBy("doc_id").orderBy("page").rowsBetween(1, Window.unboundedFollowing)
    last = F.max("page").over(Window.partitionBy("doc_id"))
    return pages.withColumn("last_page", F.coalesce(F.min(F.when(F.col("is_start"), F.col("page"))).over(later) - 1, last))


def page_windows(totals: DataFrame, size: int = 5, overlap: int = 1) -> DataFrame:
    """(doc_id, first, last): runs of size pages (last excluded) that share overlap pages with the next."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("pages") - 1 - overlap, F.lit(0)), F.lit(size - overlap))
    return totals.where("pages > 0").select("doc_id", "pages", F.explode(starts).alias("first")).select("doc_id", "first", F.least(F.col("first") + size, F.col("pages")).alias("last"))


def page_of_offset(offset: Column, page_ends: Column) -> Column:
    """The page from 1 on which a character lies, given the ends of the pages; what lies beyond is on the last."""
    return F.least(F.size(F.filter(page_ends, lambda e: e < offset)) + 1, F.size(page_ends))


def page_text(pages: DataFrame, first: int, last: int) -> DataFrame:
    """(doc_id, text): pages first to last (excluded) with marks that count from 1; a stated range bounds the row."""
    marked = pages.where(F.col("page").between(first, last - 1)).select("doc_id", F.struct("page", F.concat(F.lit("[Page "), (F.col("page") + 1).cast("string"), F.lit("]\n"), F.col("text")).alias("t")).alias("p"))
    return marked.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "\n").alias("text"))
