"""Timelines: order, key dates, months, neighbours in time, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(events: DataFrame) -> DataFrame:
    """events (case_name, event_id, date, label) with their place in the case, and whether the year changes there."""
    order = Window.partitionBy("case_name").orderBy("date", "event_id")
    year = F.year("date")
    return events.withColumn("event_index", F.row_number().over(order)).withColumn("new_year", F.coalesce(year != F.lag(year).over(order), F.lit(True)))


def key_dates(events: DataFrame) -> DataFrame:
    """First and last date of a case, and the first of each kind that counts."""
    first = lambda kind: F.min(F.when(F.col("label") == kind, F.col("date")))
    return events.groupBy("case_name").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), first("incident").alias("first_incident"), first("filing").alias("first_filing"), F.datediff(F.max("date"), F.min("date")).alias("span_days"))


def by_month(events: DataFrame) -> DataFrame:
    return events.groupBy("case_name", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def near(events: DataFrame, target: str, before: int = 30, after: int = 30) -> DataFrame:
    day = F.lit(target).cast("date")
    return events.where(F.col("date").cast("date").between(F.date_sub(day, before), F.date_add(day, after)))


def narrative(date: Column, label: Column) -> Column:
    return F.concat(F.lit("On "), F.date_format(date, "MMMM dd, yyyy"), F.lit(": "), label)
