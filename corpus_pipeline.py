"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, packing. Each stage reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontam, lines, neardup, packing, quality
from quillon.llm.common import materialize

#: A document from which line dedup took lines goes if it is left with fewer words than LEAST_WORDS and less than LEAST_LEFT per cent of its own:
#: what is left of a copy. No document loses more words than these that don't stand elsewhere.
LEAST_LEFT, LEAST_WORDS = 20, 50


def _set_aside(docs: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """docs with all columns but doc_id and text under names that no operator uses, and those names."""
    names = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in names.items())), tuple(names.values())


def _restored(docs: DataFrame, changed: DataFrame, recount: bool = True) -> DataFrame:
    """changed, whose columns were set aside, with the columns of docs; n_chars is counted anew (unless texts are as they were) where there is one."""
    back = {c: f"__column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    return changed.select(*(F.length("text").cast("long").alias(c) if recount and c == "n_chars" else F.col(back.get(c, c)).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail. Texts without words go; short ones stay if no rule fails them."""
    plain, names = _set_aside(docs)
    table = quality.quality_table(plain, ("doc_id", *names), least_words=1)
    return _restored(docs, table.where("kept").withColumnRenamed("clean_text", "text"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand elsewhere; those of which hardly a word is left go (see LEAST_LEFT). Texts without removed lines stay, null ones too."""
    plain, names = _set_aside(docs)
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++"))
    table = lines.dedup_lines(plain.withColumn("__words", words), distance=None, keep=("doc_id", *names, "__words"))
    left = table.where((F.size("removed") == 0) | (words >= LEAST_WORDS) | (100 * words >= LEAST_LEFT * F.col("__words")))
    return _restored(docs, left)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    plain, _ = _set_aside(docs)
    return _restored(docs, neardup.drop_near_duplicates(plain), recount=False)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    plain, _ = _set_aside(docs)
    return _restored(docs, decontam.decontaminate(plain, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), remove="documents"), recount=False)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in bins of training sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]

#: Fingerprints and best fit are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k}")
    return docs
