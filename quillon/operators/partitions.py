"""Layout decisions as expressions: strategy, ranges, which partitions a query needs, indexes worth having."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import hashing


def strategy(size_mb: Column, span_days: Column, case_bias: Column) -> Column:
    """By time for long spans, by case where queries name one, by heat for large tables, else none."""
    return F.when(size_mb < 1000, "none").when(span_days > 365, "time_based").when(case_bias > 0.7, "case_based").when(size_mb > 10_000, "temperature").otherwise("size_based")


def expected_gain(partitions: Column) -> Column:
    return F.least(F.lit(50), partitions * 5)


def monthly_ranges(spark: SparkSession, first: str, months: int) -> DataFrame:
    """(partition, start, end): half-open months from first on."""
    at = F.add_months(F.lit(first).cast("date"), F.col("id").cast("int"))
    return spark.range(months).select(F.date_format(at, "'p_'yyyy_MM").alias("partition"), at.alias("start"), F.add_months(at, 1).alias("end"))


def assigned(rows: DataFrame, ranges: DataFrame, date: str) -> DataFrame:
    """rows with their range's partition; those outside of all ranges have none. The ranges are few and of a stated number."""
    parts = F.broadcast(ranges.select("partition", F.date_format("start", "yyyyMM").alias("__m")))
    return rows.withColumn("__m", F.date_format(date, "yyyyMM")).join(parts, "__m", "left").drop("__m")


def of_case(rows: DataFrame, case: str) -> DataFrame:
    return rows.withColumn("partition", hashing.case_partition(F.col(case)))


def index_advice(log: DataFrame, k: int = 20) -> DataFrame:
    """The k most useful indexes for a log (collection, field, ms): one for each pair, by priority, then gain."""
    found = log.groupBy("collection", "field").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean_ms"))
    priority = F.when((F.col("mean_ms") > 2000) & (F.col("n") > 20), 1).when((F.col("mean_ms") > 1000) & (F.col("n") > 10), 2).otherwise(3)
    ranked = found.withColumn("priority", priority).withColumn("gain", F.col("n") * F.col("mean_ms"))
    return ranked.orderBy("priority", F.desc(F.round("gain", 6)), "collection", "field").limit(k)


def latest_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    return rows.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*rows.columns), version).alias("row")).select("row.*")
