"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import chat, classifier, decontam, filter_audit, lines, packing, pii, prefix_trie, pst, quality, rollups, sharding, simhash
from quillon.llm.common import materialize, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pst.score_documents(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies (by fingerprint) are one cluster, so no bin holds two of them."""
    docs = _table(spark, sf_dir, "documents")
    near = simhash.near_duplicates(docs).groupBy("doc_id").agg(F.min("component_id").alias("cluster"))
    return packing.pack(docs, clusters=near)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    of_rank = lambda k: F.filter("spans", lambda s: s["rank"] == k)
    counts = [F.size(of_rank(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(pii.KINDS[:4])]
    base = pii.shown(F.filter("spans", lambda s: s["rank"] < 4))
    return out.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), pii.shown(F.col("spans")).alias("spans"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents"), distance=None)


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted (a batch sent twice), toxic ones deleted, and those not in English recounted with the other vocabulary, after a compaction."""
    counts = materialize(rollups.token_counts(_table(spark, sf_dir, "documents")), "token-counts")
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counts.join(toxic, "doc_id", "left_semi")
    recounted = counts.join(toxic, "doc_id", "left_anti").where("lang <> 'en'")
    store, main, other = f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", "byte_bpe_50k", "byte_bpe_multi_50k"
    load = rollups.changes(counts, "insert", "main", main).unionByName(rollups.changes(counts, "insert", other, other))
    drop = rollups.changes(gone, "delete", "main", main).unionByName(rollups.changes(gone, "delete", other, other))
    for batch_id, batch in (("1-load", load), ("2-drop", drop), ("1-load", load), ("3-revise", rollups.changes(recounted, "revise", "main", other, main))):
        rollups.commit(store, batch_id, batch)
        if batch_id == "2-drop":
            rollups.compact(spark, store)
    return rollups.totals(spark, store)


def op8_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_table(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.format_conversations(turns.unionByName(extra)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations are rebuilt so that they share prefixes: up to three turns of the first of each twenty."""
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"), share=20)


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.masks(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_tree_scoring": op1_suffix_tree_scoring,
    "op2_decontamination": op2_decontamination,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_personal_data": op5_personal_data,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_rollups": op7_token_rollups,
    "op8_minimax_sharding": op8_minimax_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_filter_audit": op13_filter_audit,
}
