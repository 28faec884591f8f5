"""Documents as stored payloads and back: one JSON text a document, dates as ISO text, paths joined, with a schema on the way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType())}
_COLUMNS = (
    "id string, case_name string, document_hash string, file_name string, file_path string, file_size long, mime_type string, document_type string, title string, "
    "description string, first_seen_at timestamp, last_modified timestamp, document_date timestamp, is_duplicate boolean, original_document_id string, duplicate_count int, "
    "key_facts array<string>, relevance_tags array<string>, mentioned_parties array<string>, mentioned_dates array<string>, author string, recipient string, witness string, "
    "total_pages int, key_pages array<int>, summary string, folder_path array<string>, subfolder string, status string, version int, verified boolean, times_accessed int, last_accessed timestamp"
)
#: What a payload holds; the rest of a document's columns (where its copies lie, its search text) is not stored.
STORED = T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (c.split() for c in _COLUMNS.split(", "))])
# The states of a document.
STATES = "processing active replaced deleted".split()
_ISO, _PATH = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "folder_path"


def to_storage(documents: DataFrame) -> DataFrame:
    """(id, payload): each document's stored columns as JSON, null ones written as null; columns that documents lacks are null."""
    have = {c.lower() for c in documents.columns}

    def shown(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast("string" if f.name == _PATH or f.dataType == T.TimestampType() else f.dataType).alias(f.name)
        value = F.col(f.name)
        if f.dataType == T.TimestampType():
            value = F.date_format(value, _ISO)
        return (F.array_join(value, "/") if f.name == _PATH else value).alias(f.name)

    return documents.select("id", F.to_json(F.struct(*(shown(f) for f in STORED)), {"ignoreNullFields": "false"}).alias("payload"))


def from_storage(payloads: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The documents of (id, payload), with search_text, which is the summary, and is_valid: false where the payload is no JSON object.

    Dates that can't be read are null, a missing or unknown state is active, an empty path is no folder; where kinds are given others are "other".
    """
    raw = T.StructType([T.StructField(f.name, T.StringType() if f.name == _PATH or f.dataType == T.TimestampType() else f.dataType) for f in STORED])
    read = payloads.select(F.col("id").alias("__id"), F.from_json("payload", raw, {"mode": "PERMISSIVE"}).alias("p"), F.coalesce(F.startswith(F.trim("payload"), F.lit("{")) & F.get_json_object("payload", "$").isNotNull(), F.lit(False)).alias("is_valid"))

    def back(f: T.StructField) -> Column:
        value = F.col(f"p.{f.name}")
        if f.dataType == T.TimestampType():
            value = F.try_to_timestamp(value, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))
        elif f.name == _PATH:
            value = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(value, "/"))
        elif f.name == "status":
            value = F.when(value.isin(STATES), value).otherwise("active")
        elif f.name == "document_type" and kinds is not None:
            value = F.when(value.isin(kinds), value).otherwise("other")
        elif f.name == "id":
            value = F.coalesce(value, F.col("__id"))
        return value.alias(f.name)

    return read.select(*(back(f) for f in STORED), F.coalesce("p.summary", F.lit("")).alias("search_text"), "is_valid")
