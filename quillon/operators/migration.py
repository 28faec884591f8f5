"""From flat rows to normalised ones: matters and cases out of names, documents into core, metadata and junction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What parts the two sides of a case's name.
VERSUS = r" v\.? "


def sides(name: Column) -> tuple[Column, Column]:
    """Plaintiff and defendant; a name without the mark has no defendant."""
    parts = F.split(name, VERSUS, 2)
    return F.trim(parts[0]), F.when(F.size(parts) > 1, F.trim(F.try_element_at(parts, F.lit(2))))


def matters_and_cases(names: DataFrame) -> DataFrame:
    """(case_name, client, opponent, matter_number): a matter of each distinct name, numbered in the names' order within its initial.

    Numbers count within the first letter, so that no task orders all names; a prefix keeps them apart.
    """
    client, opponent = sides(F.col("case_name"))
    letter = F.upper(F.left(F.col("case_name"), F.lit(1)))
    nth = F.row_number().over(Window.partitionBy("letter").orderBy("case_name"))
    distinct = names.select("case_name").distinct().withColumn("letter", letter).withColumn("nth", nth)
    return distinct.select("case_name", client.alias("client"), opponent.alias("opponent"), F.concat(F.lit("MIGRATED_"), "letter", F.lpad(F.col("nth").cast("string"), 4, "0")).alias("matter_number"))


def migrated(documents: DataFrame, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents of known cases with their case_id, and those whose case isn't known."""
    return documents.join(cases.select("case_name", "case_id"), "case_name"), documents.join(cases.select("case_name"), "case_name", "left_anti")


def normalised(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Core, metadata and junction rows of documents (id, case_id, content, title, kind): equal contents share a core row, the first one's."""
    hashed = documents.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    core = hashed.groupBy("content_hash").agg(F.min("id").alias("document_id"), F.max(F.length("content")).alias("size"))
    metadata = hashed.join(core.select("content_hash", "document_id"), "content_hash").where("id = document_id").select("document_id", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce("kind", F.lit("other")).alias("kind"))
    junction = hashed.join(core.select("content_hash", "document_id"), "content_hash").groupBy("case_id", "document_id").agg(F.count(F.lit(1)).alias("copies"))
    return core.select("document_id", "content_hash", "size"), metadata, junction


def estimates(documents: DataFrame) -> DataFrame:
    """What a migration of documents (content, content_hash) will make: chunks of some 1,200 characters, duplicates."""
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.greatest(F.lit(1), F.floor(F.length("content") / 1200))).alias("chunks"), (F.count(F.lit(1)) - F.count_distinct("content_hash")).alias("duplicates"))


def expected_relations(title: Column) -> Column:
    """How many kinds of relation a title hints at: exhibits, responses, amendments."""
    hints = [r"exhibit|attachment", r"response|answer", r"amend|supplement"]
    return sum((F.lower(title).rlike(h).cast("int") for h in hints), F.lit(0))


def chunk_tables(names: DataFrame) -> DataFrame:
    """Of table names those that hold chunks: not facts, timelines or registries."""
    other = F.col("name").endswith("_facts") | F.col("name").endswith("_timeline") | F.col("name").endswith("_depositions") | F.contains("name", F.lit("registry"))
    return names.where(~other)


def chunk_row(document_id: Column, index: Column, content: Column, page: Column, kind: Column) -> Column:
    """A chunk's row with defaults for what isn't given."""
    return F.struct(F.concat_ws("_", document_id.cast("string"), index.cast("string")).alias("chunk_id"), F.sha2(content, 256).alias("chunk_hash"), F.coalesce(page, F.lit(1)).alias("page"), F.coalesce(kind, F.lit("paragraph")).alias("kind"), F.length(content).alias("size"))
