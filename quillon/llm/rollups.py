"""Token counts kept by deltas: signed batches add up to totals by source, language and tokenizer; a batch counts once however often it is sent."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shingles import texts_of

#: Vocabulary files of merge ranks, by the name under which their counts are kept; the files lie at the same path on every machine.
TOKENIZERS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
#: How the vocabularies' texts are cut before merging (a fixed value that belongs to them).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEYS = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_CACHE_PIECES = 200_000


class PieceCounts(dict):
    """Tokens of each piece that a text is cut into; merging never crosses pieces, so a text's count is their sum."""

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__()
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) > _CACHE_PIECES:
            self.clear()
        out = self[piece] = len(self.encode(piece))
        return out


@functools.cache
def piece_counts(path: str) -> PieceCounts:
    """One table a worker process, whatever number of tasks it runs."""
    return PieceCounts(path)


def token_counts(docs: DataFrame, tokenizers: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang and a count by each tokenizer, for every row of docs (doc_id, text, source, lang); null text has none."""
    named = tokenizers or TOKENIZERS
    source = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        cut, counts = regex.compile(PATTERN).findall, [piece_counts(p) for p in named.values()]
        for batch in batches:
            out: list[list[int]] = [[] for _ in counts]
            for text in texts_of(batch):
                pieces = cut(text.decode("utf-8", "replace")) if text else []
                for c, held in zip(counts, out, strict=True):
                    held.append(sum(map(c.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "source", "lang")] + [pa.array(x, pa.int64()) for x in out], names=["doc_id", "source", "lang", *named])

    schema = T.StructType([*(source.schema[c] for c in ("doc_id", "source", "lang")), *(T.StructField(n, T.LongType()) for n in named)])
    return source.mapInArrow(run, schema)


def deltas(changes: DataFrame) -> DataFrame:
    """The signed sums of a batch of changes (op, source, lang, tokenizer, n_tokens, old_tokens) by KEYS.

    op insert adds a document and its tokens, delete takes them away, revise replaces old_tokens by n_tokens. Sums are partial in each task
    before they meet. Null keys are keys; null counts are 0; other ops fail.
    """
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("no such op: "), F.coalesce("op", F.lit("null")))))
    docs = F.when(known == "insert", 1).when(known == "delete", -1).otherwise(0)
    tokens = F.when(known == "insert", n).when(known == "delete", -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(tokens).cast("long").alias("n_tokens"))


def commit(store: str, batch_id: str, batch: DataFrame) -> None:
    """Put a batch's deltas into the table at store. A batch sent again, or tried again after a failure, takes its own former place, even if it
    is empty now (a row of zeros keeps the place); one that compact() has taken in is closed, and sending it again changes nothing."""
    spark = batch.sparkSession
    zeros = spark.range(1).selectExpr("CAST(NULL AS STRING) AS source", "CAST(NULL AS STRING) AS lang", "CAST(NULL AS STRING) AS tokenizer", "0L AS n_docs", "0L AS n_tokens")
    rows = deltas(batch).unionByName(zeros).withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{store}/deltas")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; no rows before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _state(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame, int]:
    """The rows that make up the totals (of the last compaction, and of the batches since), the batches it took in, and its number."""
    taken = _read(spark, f"{store}/taken", "batch_id string, version long")
    version = taken.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    base = _read(spark, f"{store}/totals", f"{DELTA}, version long").where(F.col("version") == version).drop("version")
    fresh = _read(spark, f"{store}/deltas", f"{DELTA}, batch_id string")
    taken = taken.where(F.col("version") == version).select("batch_id")
    return base.unionByName(fresh.join(taken, "batch_id", "left_anti").drop("batch_id")), taken, version


def compact(spark: SparkSession, store: str) -> None:
    """Fold all batches into one table of totals, so that totals() reads that and what comes later. Totals are written before the list of the
    batches they hold; readers go by the list, so a failure between the two leaves all as it was. One writer at a time."""
    rows, taken, version = _state(spark, store)
    now = version + 1
    ids = _read(spark, f"{store}/deltas", f"{DELTA}, batch_id string").select("batch_id").unionByName(taken).distinct()
    dynamic = lambda df: df.withColumn("version", F.lit(now)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version")
    dynamic(_summed(rows)).parquet(f"{store}/totals")
    dynamic(ids).parquet(f"{store}/taken")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def totals(spark: SparkSession, store: str) -> DataFrame:
    """KEYS, n_docs and n_tokens over all batches; keys that were emptied are left out."""
    return _summed(_state(spark, store)[0]).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def changes(counts: DataFrame, op: str, tokenizer: str, column: str, old: str | None = None) -> DataFrame:
    """Changes of one op and tokenizer out of token_counts' rows."""
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(column).alias("n_tokens"), (F.col(old) if old else F.lit(None).cast("long")).alias("old_tokens"))
