"""Versioned rows as functions of tables: old state and changes give the new state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HISTORY = "array<struct<old_content:string,new_content:string,user_id:string,reason:string>>"


def upsert(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of state with their key; the last change by seq wins, found by a partial aggregation."""
    columns = [c for c in changes.columns if c != "seq"]
    latest = changes.groupBy(F.col(key).alias("__key")).agg(F.max_by(F.struct(*columns), "seq").alias("row")).select("row.*")
    return state.join(latest.select(key), key, "left_anti").unionByName(latest)


def edit(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (id, content, and history where it has been edited before) with changes (id, content, user_id, reason, seq) applied in the order of
    seq: the last content counts, and each change is appended to the history with what it replaced. An id without changes stays as it is."""
    seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
    step = F.struct(seq.alias("seq"), F.col("content").alias("new"), "user_id", "reason")
    steps = changes.select("id", step.alias("c")).groupBy("id").agg(F.sort_array(F.collect_list("c")).alias("__steps"))  # bounded by one row's edits
    joined = state.withColumn("__was", F.col("content")).withColumn("__history", F.col("history") if "history" in state.columns else F.array().cast(HISTORY)).join(steps, "id", "left")
    old = lambda i: F.when(i == 0, F.col("__was")).otherwise(F.try_element_at("__steps", F.greatest(i, F.lit(1)))["new"])
    entries = F.transform("__steps", lambda c, i: F.struct(old(i).alias("old_content"), c["new"].alias("new_content"), c["user_id"].alias("user_id"), c["reason"].alias("reason")))
    history = F.concat("__history", F.coalesce(entries, F.array().cast(HISTORY)))
    content = F.when(F.col("__steps").isNotNull(), F.element_at("__steps", -1)["new"]).otherwise(F.col("__was"))
    rest = [c for c in state.columns if c not in ("id", "content", "history", "is_edited")]
    return joined.select("id", content.alias("content"), *rest, history.alias("history"), (F.size(history) > 0).alias("is_edited"))


def soft_delete(state: DataFrame, deleted: DataFrame, asof: str) -> DataFrame:
    gone = deleted.select("id", F.lit(True).alias("__gone")).distinct()
    joined = state.join(gone, "id", "left")
    return joined.withColumn("is_deleted", F.coalesce("__gone", F.lit(False))).withColumn("deleted_at", F.when(F.col("__gone"), F.lit(asof).cast("timestamp"))).drop("__gone")


def visible(state: DataFrame) -> DataFrame:
    """Rows that lack the flag are not deleted."""
    return state.where(~F.coalesce("is_deleted", F.lit(False)))


def page_of(rows: DataFrame, order: list[str], limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of rows by a total order; a feature for people who read lists."""
    return rows.orderBy(*order).offset(offset).limit(limit)
