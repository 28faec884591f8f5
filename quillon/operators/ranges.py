"""Numbered ranges of pages (Bates numbers): expansion, lookup, adjacency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers that share a bucket of the range join.
BUCKET = 64


def expand(ranges: DataFrame) -> DataFrame:
    """(bates, doc_id) of ranges (doc_id, prefix, start, end): a row for every number."""
    numbers = ranges.select("doc_id", "prefix", F.explode(F.sequence("start", "end")).alias("n"))
    digits = F.col("n").cast("string")
    padded = F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits)  # lpad cuts what is longer
    return numbers.select(F.concat("prefix", padded).alias("bates"), "doc_id")


def lookup(points: DataFrame, ranges: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(point, doc_id): the range of least doc_id that holds each point (prefix, n). Ranges are dealt to the buckets that they touch, so the join is by equality."""
    dealt = ranges.select("doc_id", "prefix", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("bucket"))
    keyed = points.withColumn("bucket", F.floor(F.col("n") / bucket))
    hits = keyed.join(dealt, ["prefix", "bucket"]).where(F.col("n").between(F.col("start"), F.col("end")))
    return hits.groupBy("prefix", "n").agg(F.min("doc_id").alias("doc_id"))


def adjacent(ranges: DataFrame) -> DataFrame:
    """(doc_id, parent_id): ranges that begin where another ends, by equality of numbers."""
    parents = ranges.select("prefix", (F.col("end") + 1).alias("start"), F.col("doc_id").alias("parent_id"))
    return ranges.join(parents, ["prefix", "start"]).select("doc_id", "parent_id")
