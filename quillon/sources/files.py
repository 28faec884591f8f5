"""Files as tables: recursive scans of folders, text of pages, sinks."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, ending: str = ".pdf") -> DataFrame:
    """(path, name, case_name, folder, size, modified_at, content): files under root whose names end so, in any case; the case is the first folder below root."""
    anycase = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ending)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", anycase).load(root)
    top = re.sub("^[a-z0-9]+:/*", "/", root.rstrip("/"))  # the first occurrence of the root's own path is cut off, and nothing further down
    below = F.regexp_replace(F.col("path"), "^.*?" + _quoted(top) + "/", "")
    parts = F.split(below, "/")
    named = files.withColumn("__parts", parts)
    return named.select("path", F.element_at("__parts", -1).alias("name"), F.when(F.size("__parts") > 1, F.element_at("__parts", 1)).alias("case_name"), F.when(F.size("__parts") > 2, F.element_at("__parts", -2)).alias("folder"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")


def _quoted(name: str) -> str:
    return "\\Q" + name + "\\E"


def subfolders(files: DataFrame) -> DataFrame:
    return files.select("case_name", "folder").where(F.col("folder").isNotNull()).distinct()


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; what isn't UTF-8 becomes the replacement character."""
    return F.try_validate_utf8(F.decode(content, "UTF-8"))


def extracted(files: DataFrame, extractors: list[tuple[str, Callable[[Column], Column]]]) -> DataFrame:
    """text and method: the first extractor whose text isn't blank, else '' and 'failed'."""
    text, method = F.lit(""), F.lit("failed")
    for name, make in reversed(extractors):
        found = make(F.col("content"))
        good = F.coalesce(F.trim(found) != "", F.lit(False))
        text, method = F.when(good, found).otherwise(text), F.when(good, F.lit(name)).otherwise(method)
    return files.withColumn("text", text).withColumn("method", method)


def form_feed_pages(text: Column) -> Column:
    """Pages of text in which form feeds part them."""
    return F.length(text) - F.length(F.replace(text, F.lit("\f"), F.lit(""))) + 1


def is_production(size: Column, name: Column) -> Column:
    """Over 10 MB, or named like a production of documents."""
    return (size > 10 * 1024 * 1024) | F.lower(name).rlike(r"production|bates|discovery|responsive|documents? produced|rfp")


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions that rows have and no others: a batch that is sent again takes its own place."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
