"""Best-fit packing under conflicts: bins ordered by what is left in them carry bitmaps of their sources and duplicate clusters."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import SPACE, materialize, row_hash

#: Words of a bin, and the pieces of one source that a bin may hold.
CAPACITY, PER_SOURCE = 4096, 8
#: Pieces that are packed in one task, on the mean.
GROUP = 2_000


class Bins:
    """Open bins of one group, ordered by residual; add() puts a piece into the tightest bin that fits and has no conflict.

    A bin's bitmaps are ints: bit c of clusters for a cluster in it, bit s of sources[k] for a source with more than k pieces in it.
    """

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.slots: list[int] = []
        self.used: list[int] = []

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """(bin, slot, offset) of the piece."""
        own, bit = 1 << cluster, 1 << source
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):  # the next successor, until one is compatible
            left, b = self.order[at]
            if not self.clusters[b] & own and not self.sources[b][-1] & bit:
                del self.order[at]
                break
            at += 1
        else:
            b, left = len(self.slots), self.capacity
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.slots.append(0)
            self.used.append(0)
        self.clusters[b] |= own
        level = next(k for k, held in enumerate(self.sources[b]) if not held & bit)
        self.sources[b][level] |= bit
        place = (b, self.slots[b], self.used[b])
        self.slots[b] += 1
        self.used[b] += size
        if left > size:
            insort(self.order, (left - size, b))
        return place


def pack(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, clusters: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, text_hash, piece, start_word, n_words, bin_id, slot, offset): a row for each piece of each row of docs (doc_id, text, source).

    Texts are cut into pieces of capacity words at most, in order; a text without words (null too) is one piece of none. A bin holds at most
    capacity words, one piece of a duplicate cluster and per_source pieces of a source. The cluster is that of clusters (doc_id, cluster: a
    long; one row an id), or, where that has none, what is alike in lower case with white space collapsed. Within a group pieces come largest first, ties by doc_id and piece. Groups take
    rows by a hash of the id and cluster, about GROUP each, so that neither a hot source nor a hot cluster meets in one; bins never span
    groups. Null sources count as one source; repeated rows are pieces of one cluster; an empty table gives no bins.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++"))
    alike = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, f"{SPACE}+", " "))))
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), row_hash(F.col("text").cast("string")).alias("text_hash"), n_words.alias("total"), alike.alias("cluster"))
    if clusters is not None:
        given = clusters.select(F.col("doc_id").alias("__id"), F.xxhash64(F.col("cluster"), F.lit("cluster")).alias("__cluster"))
        rows = rows.join(given, F.col("doc_id") == F.col("__id"), "left").withColumn("cluster", F.coalesce("__cluster", "cluster"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(capacity))
    pieces = rows.select("doc_id", "source", "text_hash", "cluster", "total", F.posexplode(starts).alias("piece", "start"))
    sized = pieces.select("doc_id", "source", "text_hash", "cluster", "piece", "start", F.least(F.col("total") - F.col("start"), F.lit(capacity)).alias("size"))
    sized = materialize(sized, "pieces")
    groups = max(1, sized.count() // GROUP)
    dealt = sized.withColumn("group", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(groups)).cast("int"))
    id_type = docs.schema["doc_id"]
    schema = T.StructType([id_type, *(T.StructField(n, t) for n, t in (("source", T.StringType()), ("text_hash", T.LongType()), ("piece", T.IntegerType()), ("start_word", T.LongType()), ("n_words", T.LongType()), ("bin_id", T.StringType()), ("slot", T.LongType()), ("offset", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bins, sources, clusters = None, Bins(capacity, per_source), {}, {}
        for batch in batches:
            group, source, cluster_, size = (batch.column(c).to_pylist() for c in ("group", "source", "cluster", "size"))
            ids, slots, offsets = [], [], []
            for g, s, c, n in zip(group, source, cluster_, size, strict=True):
                if g != last:
                    last, bins, sources, clusters = g, Bins(capacity, per_source), {}, {}
                b, slot, offset = bins.add(n, sources.setdefault(s, len(sources)), clusters.setdefault(c, len(clusters)))
                ids.append(f"{g}-{b}")
                slots.append(slot)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("text_hash"), batch.column("piece"), batch.column("start").cast(pa.int64()), batch.column("size").cast(pa.int64()), pa.array(ids, pa.string()), pa.array(slots, pa.int64()), pa.array(offsets, pa.int64())],
                names=schema.names,
            )

    ordered = dealt.repartition("group").sortWithinPartitions("group", F.desc("size"), "doc_id", "piece")
    return ordered.select("group", "doc_id", "source", "text_hash", "cluster", "piece", "start", "size").mapInArrow(run, schema)


def render(docs: DataFrame, placed: DataFrame, separator: str = "\n\n") -> DataFrame:
    """(bin_id, doc_ids, text): each bin's pieces as text, in the order of their slots, words joined by single spaces; a bin's size bounds a row.

    placed is pack(docs, ...); pieces find their text by id and text hash, so null ids and repeated rows come out once a piece.
    """
    words = F.filter(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), f"{SPACE}+"), lambda w: w != "")
    texts = docs.select(F.col("doc_id").alias("__id"), row_hash(F.col("text").cast("string")).alias("__hash"), words.alias("__words")).dropDuplicates(["__id", "__hash"])
    joined = placed.join(texts, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")))
    part = F.array_join(F.slice("__words", F.col("start_word").cast("int") + 1, F.col("n_words").cast("int")), " ")
    pieces = joined.groupBy("bin_id").agg(F.sort_array(F.collect_list(F.struct("slot", "doc_id", part.alias("part")))).alias("p"))
    return pieces.select("bin_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.array_join(F.transform("p", lambda x: x["part"]), separator).alias("text"))
