"""Joins of two streams: rows of one log that follow rows of another within a time, with watermarks that let old state go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late a row may come, and how long after the first row the second may follow.
LATE, WITHIN = "10 minutes", "1 hour"


def followed(first: DataFrame, second: DataFrame, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """(user_id, first_id, second_id, first_at, second_at): rows of second (event_id, ts, user_id) up to within after a row of first of the same user.

    On streams both sides have watermarks: a row more than late behind its stream's newest is let go, and with the interval in the condition a
    row's state goes once no row of the other side can match it any more. On tables the same rows without the watermarks.
    """
    sides = []
    for rows, name in ((first, "first"), (second, "second")):
        side = rows.select(F.col("user_id").alias(f"{name}_user"), F.col("event_id").alias(f"{name}_id"), F.col("ts").alias(f"{name}_at"))
        sides.append(side.withWatermark(f"{name}_at", late) if rows.isStreaming else side)
    span = F.expr(f"second_at >= first_at AND second_at <= first_at + INTERVAL {within}")
    return sides[0].join(sides[1], (F.col("first_user") == F.col("second_user")) & span).select(F.col("first_user").alias("user_id"), "first_id", "second_id", "first_at", "second_at")
