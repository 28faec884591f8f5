"""Matters, cases, documents and their relations: scopes, access, isolation, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Access levels and permissions in rising order.
ACCESS = ["public", "internal", "confidential", "restricted", "privileged"]
PERMISSIONS = ["read", "write", "admin"]


def rank_of(level: Column, order: list[str]) -> Column:
    """Position from 1; 0 for what isn't a level."""
    return F.array_position(F.array(*(F.lit(x) for x in order)), level)


def effective_access(matter: Column, case: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in ACCESS)), F.greatest(rank_of(matter, ACCESS), rank_of(case, ACCESS), F.lit(1)).cast("int"))


def allowed(permissions: DataFrame, needed: str, asof: str) -> DataFrame:
    """Permissions (user_id, case_id, permission_level, expires_at) that hold at asof and include the needed one."""
    alive = F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(asof).cast("timestamp"))
    return permissions.where(alive & (rank_of(F.col("permission_level"), PERMISSIONS) >= PERMISSIONS.index(needed) + 1))


def in_scope(junctions: DataFrame, cases: DataFrame) -> DataFrame:
    return junctions.join(cases.select("case_id").distinct(), "case_id", "left_semi")


def orphans(chunks: DataFrame, junctions: DataFrame) -> DataFrame:
    return chunks.join(junctions.select("document_id").distinct(), "document_id", "left_anti")


def with_details(junctions: DataFrame, core: DataFrame, metadata: DataFrame) -> DataFrame:
    """Documents must exist; metadata may be missing."""
    return junctions.join(core, "document_id").join(metadata, "document_id", "left")


def isolated(results: DataFrame, case: str) -> DataFrame:
    """One row: whether no result belongs to another case, and how many do."""
    foreign = F.count_if(F.col("case_name").isNotNull() & (F.col("case_name") != case))
    return results.agg((foreign == 0).alias("isolated"), foreign.alias("foreign_rows"), F.count(F.lit(1)).alias("n_rows"))


def continuations(parts: DataFrame) -> DataFrame:
    """(source, target, confidence) of neighbouring parts (continuation_id, part_number, document_id, confidence)."""
    order = Window.partitionBy("continuation_id").orderBy("part_number", "document_id")
    nxt = parts.select(F.col("document_id").alias("source"), F.lead("document_id").over(order).alias("target"), F.least("confidence", F.lead("confidence").over(order)).alias("confidence"))
    return nxt.where(F.col("target").isNotNull())


#: Edges that one task joins from both ends: edges of any number come in as many tasks as this asks for, so a task's memory doesn't grow with them.
EDGES_A_TASK = 250_000


def edges_of(edges: DataFrame, documents: DataFrame) -> DataFrame:
    """(document_id, other, kind): edges that touch each document from either end; a self-loop counts twice. The edges are counted first."""
    out = edges.select(F.col("source").alias("document_id"), F.col("target").alias("other"), F.lit("out").alias("kind"))
    into = edges.select(F.col("target").alias("document_id"), F.col("source").alias("other"), F.lit("in").alias("kind"))
    n = edges.count() // EDGES_A_TASK + 1
    wanted = documents.select("document_id").repartition(n, "document_id").distinct()
    return out.unionByName(into).repartition(n, "document_id").join(wanted, "document_id")  # a semi-join would be moved below the dealing
