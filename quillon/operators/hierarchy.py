"""Search over matters, cases and documents: a scope, what a reader may see, and what relations reach from there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.shared import kept


def scope(cases: DataFrame, case_ids: list | None = None, matter_ids: list | None = None) -> DataFrame:
    """(case_id): the named cases, else all cases of the named matters, else none. cases: (case_id, matter_id)."""
    if case_ids:
        return cases.where(F.col("case_id").isin(case_ids)).select("case_id").distinct()
    return cases.where(F.col("matter_id").isin(matter_ids) if matter_ids else F.lit(False)).select("case_id").distinct()


def case_named(cases: DataFrame, names: DataFrame) -> DataFrame:
    """(case_name, case_id) for each of names (case_name): the least id of that name, null without one."""
    least = cases.groupBy("case_name").agg(F.min("case_id").alias("case_id"))
    return names.select("case_name").distinct().join(least, "case_name", "left")


def reach(edges: DataFrame, start: DataFrame, visible: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(node, depth): every node that edges (source, target) reach from start (node), with the least number of steps; start itself has 0.

    visible (node) is what may be stepped on: edges to other nodes are left out before the first step, and hidden start nodes too. Each step joins
    the frontier, one row a node, with the edges, drops what was visited, and is written to the shared folder; a node of very many edges is rows
    that skewed joins split. It ends at depth, or when nothing new comes.
    """
    open_edges = edges.select("source", "target").where("source <> target").distinct()
    frontier = start.select("node").distinct()
    if visible is not None:
        seen = visible.select(F.col("node").alias("target")).distinct()
        open_edges, frontier = open_edges.join(seen, "target", "left_semi"), frontier.join(seen.withColumnRenamed("target", "node"), "node", "left_semi")
    open_edges = kept(open_edges, "reach-edges")
    frontier = kept(frontier.withColumn("depth", F.lit(0)), "reach")
    visited, step = frontier, 0
    while depth is None or step < depth:
        step += 1
        ahead = frontier.select(F.col("node").alias("source")).join(open_edges, "source").select(F.col("target").alias("node")).distinct()
        frontier = kept(ahead.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(step)), "reach")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def search(junctions: DataFrame, cases: DataFrame, documents: DataFrame, edges: DataFrame, may_see: Column, case_ids: list | None = None, matter_ids: list | None = None, depth: int | None = 1) -> DataFrame:
    """(document_id, depth): documents of a scope, and what their relations reach, of those that may_see (over documents) lets a reader see."""
    visible = documents.where(may_see).select(F.col("document_id").alias("node"))
    start = junctions.join(scope(cases, case_ids, matter_ids), "case_id", "left_semi").select(F.col("document_id").alias("node"))
    return reach(edges, start, visible, depth).select(F.col("node").alias("document_id"), "depth")


def normalised(segments: DataFrame, case_id: Column) -> dict[str, DataFrame]:
    """Segments (production_id, segment_id, document_type, start_page, end_page, part_of, confidence) as the rows of a hierarchy.

    documents: one for each segment, named by a hash of production and segment; junctions: each document in its case, with its pages;
    relations: neighbouring parts of one longer document (part_of), in the order of their pages.
    """
    named = segments.withColumn("document_id", F.substring(F.sha2(F.concat_ws("|", F.col("production_id").cast("string"), F.col("segment_id").cast("string")), 256), 1, 32)).withColumn("case_id", case_id)
    documents = named.select("document_id", F.coalesce("document_type", F.lit("other")).alias("document_type"), (F.col("end_page") - F.col("start_page") + 1).alias("n_pages"))
    junctions = named.select("document_id", "case_id", "production_id", "start_page", "end_page")
    from quillon.operators.graph import continuations

    parts = named.where(F.col("part_of").isNotNull()).select(F.concat_ws("|", F.col("production_id").cast("string"), F.col("part_of").cast("string")).alias("continuation_id"), F.col("start_page").alias("part_number"), "document_id", "confidence")
    return {"documents": documents, "junctions": junctions, "relations": continuations(parts)}
