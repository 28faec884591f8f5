"""A stored inverted index: postings by bucket in blocks of falling weight, each with its largest weight; a search reads the asked buckets only.

A store is a folder of segments. A segment holds the postings of some documents and the list of their ids; a document's latest segment is the
one that counts, so an upsert or a delete writes one small segment and rewrites nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders that buckets are dealt to, postings of a block, and documents of one list: a bucket that more documents have is several lists.
SHARDS, BLOCK, LIST = 32, 128, 1_000_000
#: More later ids, or more asked buckets, than these are joined by a shuffle, or by a join instead of a filter.
BROADCAST_IDS, LITERAL_BUCKETS = 1_000_000, 200
_PARTS = {"postings": "bucket long, list int, block int, top double, ids array<{id}>, weights array<double>", "documents": "id {id}"}


def write(path: str, segment: int, vectors: DataFrame, ids: DataFrame, shards: int = SHARDS) -> None:
    """Write a segment of (id, bucket, weight); ids lists its documents, those without postings too (which deletes what earlier segments hold).

    Sending a segment again replaces it. A document has one posting a bucket at most, so hashing ids into lists bounds a list's length whatever
    a bucket's share of the documents is.
    """
    names = ids.select("id").distinct()
    lists = max(1, -(-names.count() // LIST))
    dealt = vectors.select("id", "bucket", "weight", F.pmod(F.xxhash64("id"), F.lit(lists)).cast("int").alias("list"))
    place = F.row_number().over(Window.partitionBy("bucket", "list").orderBy(F.desc("weight"), "id")) - 1
    blocks = dealt.withColumn("block", F.floor(place / BLOCK).cast("int")).groupBy("bucket", "list", "block").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "id"))).alias("p"))
    shown = blocks.select("bucket", "list", "block", (-F.col("p")[0]["w"]).alias("top"), F.col("p.id").alias("ids"), F.transform("p.w", lambda w: -w).alias("weights"), _shard(F.col("bucket"), shards).alias("shard"))
    ordered = shown.repartition("shard", "list").sortWithinPartitions("shard", "bucket", "list", "block")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings/segment={segment}")
    names.write.mode("overwrite").parquet(f"{path}/documents/segment={segment}")


def _shard(bucket: Column, shards: int) -> Column:
    return F.pmod(bucket, F.lit(shards)).cast("int")


def _read(spark: SparkSession, path: str, part: str, id_type: str) -> DataFrame:
    schema = T.StructType.fromDDL(_PARTS[part].format(id=id_type) + ", segment int" + (", shard int" if part == "postings" else ""))
    return spark.read.schema(schema).option("basePath", f"{path}/{part}").parquet(f"{path}/{part}")


def _current(rows: DataFrame, spark: SparkSession, path: str, id_type: str) -> DataFrame:
    """rows (id, segment, ...) whose document has no later segment. Only ids after the first segment are looked at: those that ever changed."""
    documents = _read(spark, path, "documents", id_type)
    first = documents.agg(F.min("segment")).first()[0]
    later = documents.where(F.col("segment") > F.lit(first)).groupBy("id").agg(F.max("segment").alias("latest"))
    n = later.count()
    if not n:
        return rows
    later = F.broadcast(later) if n <= BROADCAST_IDS else later
    return rows.join(later, "id", "left").where(F.col("latest").isNull() | (F.col("segment") == F.col("latest"))).drop("latest")


def vectors_of(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """(id, bucket, weight) of all current documents: what a compaction writes into a new store."""
    blocks = _read(spark, path, "postings", id_type)
    rows = blocks.select("segment", "bucket", F.explode(F.arrays_zip("ids", "weights")).alias("p")).select(F.col("p.ids").alias("id"), "segment", "bucket", F.col("p.weights").alias("weight"))
    return _current(rows, spark, path, id_type).select("id", "bucket", "weight")


def blocks_for(spark: SparkSession, path: str, asked: dict[int, float], needed: dict[int, float] | None = None, first_only: bool = False, shards: int = SHARDS, id_type: str = "long") -> DataFrame:
    """The blocks of the asked buckets; with needed, only those whose largest weight is at least their bucket's. Shards prune folders, buckets and tops row groups."""
    blocks = _read(spark, path, "postings", id_type).where(F.col("shard").isin(sorted({b % shards for b in asked})))
    if first_only:
        blocks = blocks.where("block = 0")
    if len(asked) <= LITERAL_BUCKETS:
        kept = F.lit(False)
        for b in sorted(asked):
            kept = kept | ((F.col("bucket") == b) & (F.col("top") >= needed[b]) if needed else F.col("bucket") == b)
        return blocks.where(kept)
    rows = spark.createDataFrame([(b, float(needed[b]) if needed else float("-inf")) for b in asked], "bucket long, needed double")
    low, high = min(asked), max(asked)
    return blocks.where(F.col("bucket").between(low, high)).join(F.broadcast(rows), "bucket").where("top >= needed").drop("needed")


def _scored(blocks: DataFrame, asked: dict[int, float]) -> DataFrame:
    """(id, segment, score): sums of products over blocks. asked is one text's vector, so its table is small."""
    q = F.broadcast(blocks.sparkSession.createDataFrame(list(asked.items()), "bucket long, q double"))
    rows = blocks.join(q, "bucket").select("segment", "q", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
    return rows.groupBy(F.col("p.ids").alias("id"), "segment").agg(F.sum(F.col("q") * F.col("p.weights")).alias("score"))


def search(spark: SparkSession, path: str, asked: dict[int, float], k: int = 20, shards: int = SHARDS, id_type: str = "long") -> DataFrame:
    """(id, score): the k current documents of largest inner product with asked (bucket to weight), ties by id; the same rows as without an index.

    The first blocks give k documents whose partial scores bound the k-th score from below. A block is read only if a document with its largest
    weight, and the largest in all other asked buckets, could reach that bound. Negative weights turn the bound off.
    """
    order = (F.desc(F.round("score", 9)), F.col("id"))
    asked = {int(b): float(w) for b, w in asked.items() if w}
    if not asked:
        return spark.createDataFrame([], f"id {id_type}, score double")
    needed = None
    first = blocks_for(spark, path, asked, first_only=True, shards=shards, id_type=id_type)
    tops = {r.bucket: r.top for r in first.groupBy("bucket").agg(F.max("top").alias("top")).collect()}  # a row for each asked bucket
    if min(asked.values()) > 0 and min(tops.values(), default=0) > 0:
        sure = _current(_scored(first, asked), spark, path, id_type).orderBy(*order).limit(k).collect()
        if len(sure) == k:
            all_of = sum(w * tops.get(b, 0.0) for b, w in asked.items())
            bound = sure[-1].score - 1e-9
            needed = {b: (bound - (all_of - w * tops.get(b, 0.0))) / w for b, w in asked.items()}
    found = _scored(blocks_for(spark, path, asked, needed, shards=shards, id_type=id_type), asked)
    return _current(found, spark, path, id_type).orderBy(*order).limit(k).select("id", "score")
