"""Statistics: cases, costs, query logs, reviews, temperature of data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dollars for 1,000 tokens; chat models have a rate in and one out.
PRICES = {"text-embedding-3-small": (0.00002, 0.0), "gpt-3.5-turbo": (0.0005, 0.0015), "gpt-4": (0.03, 0.06)}


def case_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("case_name").agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.sum(F.octet_length("content")).alias("n_bytes"))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """0 for a model that has no price."""
    out = F.lit(0.0)
    for name, (a, b) in PRICES.items():
        out = F.when(model == name, tokens_in / 1000 * a + tokens_out / 1000 * b).otherwise(out)
    return out


def cost_report(usage: DataFrame, *keys: str) -> DataFrame:
    """Calls, tokens and cost of usage (model, operation, tokens_in, tokens_out, keys) by keys; costs to eight places."""
    cost = token_cost(F.col("model"), F.col("tokens_in"), F.col("tokens_out"))
    return usage.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.round(F.sum(cost), 8).alias("cost"))


def upper_median(value: str) -> Column:
    """The element at half the count of a group's sorted values; of an even number the upper of the two in the middle. A group's distinct values meet
    in one task; for all rows of a table take median_of."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)")


def median_of(rows: DataFrame, value: str, cells: int = 10_000) -> DataFrame:
    """(median): the upper median of a whole table's numbers. Counts of equal cells between the extremes say which cell holds it; only that is sorted."""
    x = rows.select(F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    low, high, n = x.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        return x.select(F.col("x").alias("median"))
    cell = F.floor((F.col("x") - low) / ((high - low) or 1.0) * cells)
    before = 0
    for which, many in sorted(tuple(r) for r in x.groupBy(cell.alias("cell")).count().collect()):  # cells + 1 rows at most
        if before + many > n // 2:
            break
        before += many
    return x.where(cell == which).orderBy("x").offset(n // 2 - before).limit(1).select(F.col("x").alias("median"))


def performance(log: DataFrame, slow_ms: float = 1000.0) -> DataFrame:
    """Count, mean, extremes and share of slow queries of log (collection, ms)."""
    return log.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 6).alias("mean_ms"), F.max("ms").alias("most_ms"), F.min("ms").alias("least_ms"), F.round(100 * F.avg((F.col("ms") > slow_ms).cast("int")), 6).alias("slow_percent"), F.count_distinct("collection").alias("collections"))


def query_patterns(log: DataFrame, least: int = 5) -> DataFrame:
    """Signatures of at least so many queries, with mean time and priority."""
    found = log.groupBy("signature").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean")).where(F.col("n") >= least)
    return found.select("signature", "n", F.round("mean", 6).alias("mean_ms"), priority(F.col("mean"), F.col("n")).alias("priority"))


def priority(mean_ms: Column, n: Column) -> Column:
    return F.when((mean_ms > 2000) & (n > 20), 1).when((mean_ms > 1000) & (n > 10), 2).otherwise(3)


def temperature(date: Column, asof: str) -> Column:
    days = F.datediff(F.lit(asof).cast("date"), date)
    return F.when(days <= 30, "hot").when(days <= 180, "warm").when(days <= 365, "cold").otherwise("frozen")


def review_stats(facts: DataFrame) -> DataFrame:
    """Counts of facts (reviewed, is_deleted); an empty table is all reviewed."""
    total, done = F.count(F.lit(1)), F.count_if("reviewed")
    return facts.agg(total.alias("total"), done.alias("reviewed"), F.count_if("is_deleted").alias("rejected"), F.count_if(~F.col("reviewed") & ~F.col("is_deleted")).alias("pending"), F.when(total == 0, 100.0).otherwise(F.round(100 * done / total, 6)).alias("percent"))


def zero_filled(counts: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Counts by key with a 0 for every value that doesn't occur."""
    names = counts.sparkSession.createDataFrame([(v,) for v in values], f"{key} string")
    return names.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))
