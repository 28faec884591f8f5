"""Facts, duplicates and grants as versioned rows: requests against a table give the new table and what each request did."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def created(state: DataFrame, new: DataFrame) -> DataFrame:
    """(id, outcome) of new facts (id, case_name, content): of equal ones in a case the first is created, unless the case has it already; those
    without a case are rejected."""
    text = F.lower(F.trim("content"))
    known = state.select("case_name", text.alias("__text")).distinct().withColumn("known", F.lit(True))
    nth = F.row_number().over(Window.partitionBy("case_name", "__text").orderBy("id"))
    checked = new.withColumn("__text", text).withColumn("nth", nth).join(known, ["case_name", "__text"], "left")
    outcome = F.when(F.col("case_name").isNull(), "rejected").when(F.col("known").isNotNull() | (F.col("nth") > 1), "duplicate").otherwise("created")
    return checked.select("id", outcome.alias("outcome"))


def apply_actions(state: DataFrame, actions: DataFrame) -> DataFrame:
    """state (id, category, reviewed, deleted) after actions (id, seq, action, value): review, categorize and delete; the last of each kind counts,
    others change nothing."""
    last = lambda kind, what: F.max_by(F.when(F.col("action") == kind, what), F.when(F.col("action") == kind, F.col("seq")))
    done = actions.groupBy("id").agg(last("categorize", F.col("value")).alias("__category"), F.coalesce(F.max(F.col("action") == "review"), F.lit(False)).alias("__reviewed"), F.coalesce(F.max(F.col("action") == "delete"), F.lit(False)).alias("__deleted"))
    joined = state.join(done, "id", "left")
    return joined.select("id", F.coalesce("__category", "category").alias("category"), (F.col("reviewed") | F.coalesce("__reviewed", F.lit(False))).alias("reviewed"), (F.col("deleted") | F.coalesce("__deleted", F.lit(False))).alias("deleted"))


def outcomes(state: DataFrame, actions: DataFrame) -> DataFrame:
    """(id, seq, ok): whether an action is known and its fact is there and not deleted."""
    alive = state.where("NOT deleted").select("id", F.lit(True).alias("__alive"))
    known = F.col("action").isin("review", "categorize", "delete")
    return actions.join(alive, "id", "left").select("id", "seq", (known & F.coalesce("__alive", F.lit(False))).alias("ok"))


def locations(found: DataFrame) -> DataFrame:
    """(hash, primary_path, primary_case, duplicates, last_found): a registry row of each content: its first place, all others in order of arrival."""
    place = F.struct("seq", "path", "case_name")
    rows = found.groupBy("hash").agg(F.sort_array(F.collect_list(place)).alias("p"), F.max("seq").alias("last_found"))
    return rows.select("hash", F.col("p")[0]["path"].alias("primary_path"), F.col("p")[0]["case_name"].alias("primary_case"), F.transform(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda x: x["path"]).alias("duplicates"), "last_found")


def without_case(found: DataFrame, case: str) -> DataFrame:
    return found.where(~F.col("case_name").eqNullSafe(F.lit(case)))


def admitted_cases(requests: DataFrame, cases: DataFrame, firms: DataFrame, longest: int = 50) -> DataFrame:
    """(request_id, outcome) of requests (request_id, name, firm_id) for new cases: the name fits, the firm is active, and neither the firm's cases nor
    an earlier request has the name."""
    nth = F.row_number().over(Window.partitionBy("firm_id", "name").orderBy("request_id"))
    known = cases.select("firm_id", "name", F.lit(True).alias("known")).distinct()
    active = firms.where("is_active").select("firm_id", F.lit(True).alias("active")).distinct()
    checked = requests.withColumn("nth", nth).join(known, ["firm_id", "name"], "left").join(active, "firm_id", "left")
    outcome = F.when(F.length("name") > longest, "name too long").when(F.col("active").isNull(), "no such firm").when(F.col("known").isNotNull() | (F.col("nth") > 1), "name taken").otherwise("created")
    return checked.select("request_id", outcome.alias("outcome"))


def granted(permissions: DataFrame, requests: DataFrame) -> DataFrame:
    """(user_id, case_id, level) after requests (user_id, case_id, level, by, seq): only admins of a case grant, only known levels count, the last wins."""
    admins = permissions.where("level = 'admin'").select(F.col("user_id").alias("by"), "case_id")
    valid = requests.where(F.col("level").isin("read", "write", "admin")).join(admins.distinct(), ["by", "case_id"], "left_semi")
    latest = valid.groupBy("user_id", "case_id").agg(F.max_by("level", "seq").alias("level"))
    return permissions.select("user_id", "case_id", "level").join(latest.select("user_id", "case_id"), ["user_id", "case_id"], "left_anti").unionByName(latest)


def with_status(cases: DataFrame, requests: DataFrame, permissions: DataFrame) -> DataFrame:
    """cases (case_id, status) after requests (case_id, status, user_id, seq) of those who may write; the last wins."""
    writers = permissions.where(F.col("level").isin("write", "admin")).select("user_id", "case_id").distinct()
    latest = requests.join(writers, ["user_id", "case_id"], "left_semi").groupBy("case_id").agg(F.max_by("status", "seq").alias("__status"))
    return cases.join(latest, "case_id", "left").select("case_id", F.coalesce("__status", "status").alias("status"))
