"""Exact duplicates by content hash: registry, locations, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import hashing


def registry(docs: DataFrame) -> DataFrame:
    """(content_hash, first_id, copies, cases) of docs (id, case_name, content)."""
    hashed = docs.select("id", "case_name", hashing.content_hash(F.col("content")).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.count_distinct("case_name").alias("cases"))
    return firsts


def duplicates(docs: DataFrame) -> DataFrame:
    """(id, first_id): every document whose content another of lesser id has; the hash is grouped before it is joined, so no window holds a group."""
    hashed = docs.select("id", hashing.content_hash(F.col("content")).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(firsts, "content_hash").where("id <> first_id").select("id", "first_id")


def statistics(docs: DataFrame) -> DataFrame:
    found = registry(docs)
    return found.agg(F.count(F.lit(1)).alias("unique_documents"), F.sum(F.col("copies") - 1).alias("duplicates"), F.round(F.avg(F.col("copies") - 1), 6).alias("mean_duplicates"), F.max("copies").alias("largest_group"))


def cross_case(docs: DataFrame) -> DataFrame:
    """Contents that stand in more than one case."""
    return registry(docs).where("cases > 1")


def first_seen(docs: DataFrame) -> DataFrame:
    """Every document with whether it is the first of its content; a group's least id is found by a partial aggregation, whatever its size."""
    hashed = docs.select("id", hashing.content_hash(F.col("content")).alias("content_hash"))
    firsts = hashed.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    return hashed.join(firsts, "content_hash").select("id", (F.col("id") == F.col("first_id")).alias("is_first"))
