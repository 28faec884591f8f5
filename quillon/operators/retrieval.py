"""Top-k retrieval: dense and sparse vectors, full text, rank fusion and weighted hybrids, always within a case."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import hashing, text, vectors

#: Rank fusion's constant and the weights of the hybrid.
RRF_K, DENSE_WEIGHT, TEXT_WEIGHT = 60, 0.7, 0.3


def _best(score: str) -> Column:
    """Descending by a score to nine places: what differs in the last bits of a sum is a tie, which ids break."""
    return F.desc(F.round(score, 9))


def dense_topk(points: DataFrame, query: list[float], k: int = 10, threshold: float | None = None, inclusive: bool = True, where: Column | None = None, name: str = "score") -> DataFrame:
    """The k points (id, vector, ...) of largest cosine to query; ties by id. Filters come before the vectors are read."""
    kept = points if where is None else points.where(where)
    scored = kept.withColumn(name, vectors.cosine(F.col("vector"), F.lit([float(x) for x in query])))
    if threshold is not None:
        scored = scored.where(F.col(name) >= threshold if inclusive else F.col(name) > threshold)
    return scored.orderBy(_best(name), "id").limit(k)


#: Query vectors that are held by each task at once.
QUERY_BLOCK = 4096


def dense_join(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): for each row of a stated query set (query_id, vector) the k nearest points; ties by id.

    Queries come in ranges of ids of bounded size, which are broadcast; each reads the points once, and a task passes on k rows a query.
    The bounds are taken once, from ranges over sorted ids; rows that repeat an id are in one range.
    """
    found = None
    for block in _blocks(queries.select("query_id", "vector")):
        held = points.sparkSession.sparkContext.broadcast((np.array([r.query_id for r in block], np.int64), np.array([r.vector for r in block], np.float64)))
        near = points.select("id", "vector").mapInArrow(_nearest(held, k), "query_id long, id long, score double")
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = points.sparkSession.createDataFrame([], "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(_best("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[list[Row]]:
    """Query rows, QUERY_BLOCK at a time: one job sorts them into partitions of that size, and each is fetched on its own."""
    n = queries.count()
    if n <= QUERY_BLOCK:
        rows = queries.collect()
        if rows:
            yield rows
        return
    dealt = queries.repartitionByRange(-(-n // QUERY_BLOCK) * 2, "query_id")
    held: list[Row] = []
    for row in dealt.toLocalIterator():  # a partition at a time; a block bounds what the driver holds
        held.append(row)
        if len(held) == QUERY_BLOCK:
            yield held
            held = []
    if held:
        yield held


#: Scores that a task holds at once: points come in slices of so many for all held queries together.
CELLS = 1 << 18


class Best:
    """The k best of each of n queries so far, by falling score to nine places, then by id; what can't enter is left out before anything is sorted."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.ids, self.scores, self.counts = np.zeros((n, k), np.int64), np.full((n, k), -np.inf), np.zeros(n, np.int64)

    def slices(self, n: int) -> Iterator[slice]:
        """Parts of n points whose scores are CELLS at most."""
        width = max(1, CELLS // max(1, len(self.counts)))
        return (slice(at, min(at + width, n)) for at in range(0, n, width))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each query and a column for each of ids; -inf is no match."""
        least = np.where(self.counts == self.k, self.scores[:, -1] - 2e-9, -np.inf)
        query, column = np.nonzero((scores > -np.inf) & (scores >= least[:, None]))
        if not len(query):
            return
        some = np.unique(query)
        held = np.arange(self.k) < self.counts[some][:, None]
        owner = np.concatenate((np.repeat(some, self.counts[some]), query))
        names, values = np.concatenate((self.ids[some][held], ids[column])), np.concatenate((self.scores[some][held], scores[query, column]))
        order = np.lexsort((names, -np.round(values, 9), owner))
        owner, names, values = owner[order], names[order], values[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        first = place < self.k
        self.ids[owner[first], place[first]], self.scores[owner[first], place[first]] = names[first], values[first]
        self.counts[some] = np.minimum(self.k, np.bincount(owner, minlength=len(self.counts))[some])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's number, id, score)."""
        held = np.arange(self.k) < self.counts[:, None]
        return np.repeat(np.arange(len(self.counts)), self.counts), self.ids[held], self.scores[held]


def matrix(rows: pa.Array) -> np.ndarray:
    """A list column whose lists are of one length as a matrix."""
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def _nearest(held: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the k best points of a task for each query, by one product of matrices a slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors_ = held.value
        unit, best = unit_rows(vectors_), Best(len(names), k)
        for batch in batches:
            for part in best.slices(batch.num_rows):
                some = batch.slice(part.start, part.stop - part.start)
                best.add(some.column("id").to_numpy(), unit @ unit_rows(matrix(some.column("vector"))).T)
        query, ids, scores = best.rows()
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(names[query]), pa.array(ids), pa.array(scores)], names=["query_id", "id", "score"])

    return run


def tokens(content: Column) -> Column:
    """Lower-case words of letters and digits, two or more long, without the stop words."""
    words = F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    return F.filter(words, lambda w: ~w.isin(text.STOP_WORDS))


#: As many tokens' buckets a task remembers before it starts anew: in every worker of an executor. Texts encoded at once.
REMEMBERED, TEXTS = 200_000, 256
_WORD = re.compile(rb"[a-z0-9]{2,}")


def sparse_vectors(docs: DataFrame, dimension: int = hashing.SPARSE_DIMENSION) -> DataFrame:
    """(id, bucket, weight): 1 + ln(tf) of each token, the alphabetically last token of a shared bucket, scaled to length 1.

    A text's vector is made where it lies and nothing is dealt anew; a token is hashed once a task. Texts are lowered by Spark and counted in
    Arrow batches: as expressions over the array of words the same took ten times as long. Null texts and texts without tokens have no rows.
    """
    schema = T.StructType([docs.schema["id"], T.StructField("bucket", T.LongType()), T.StructField("weight", T.DoubleType())])
    return _lowered(docs.select("id", "content")).mapInArrow(_encoder(dimension, ["id"], False), schema)


def sparse_lists(docs: DataFrame, dimension: int = hashing.SPARSE_DIMENSION) -> DataFrame:
    """docs with sparse_vectors' vector of content in its place, as a list by bucket: keywords array<struct<bucket, weight>>, empty without tokens."""
    entry = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("weight", T.DoubleType())])
    others = [f for f in docs.schema if f.name != "content"]
    return _lowered(docs).mapInArrow(_encoder(dimension, [f.name for f in others], True), T.StructType([*others, T.StructField("keywords", T.ArrayType(entry))]))


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content", F.lower(F.coalesce("content", F.lit(""))).cast("binary"))


def encoded(content: bytes, bucket_of: Callable[[bytes], int]) -> dict[int, float]:
    """The weights of one lower-case text by bucket."""
    counts = Counter(_WORD.findall(content))
    for word in _STOPPED:
        counts.pop(word, None)
    last: dict[int, bytes] = {}
    for token in counts:
        bucket = bucket_of(token)
        if token > last.get(bucket, b""):
            last[bucket] = token
    weights = {bucket: 1 + math.log(counts[token]) for bucket, token in last.items()}
    length = math.sqrt(sum(w * w for w in weights.values()))
    return {bucket: w / length for bucket, w in weights.items()}


_STOPPED = [w.encode() for w in text.STOP_WORDS]


class _Buckets(dict):
    """Tokens' buckets, as they come up."""

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension

    def __missing__(self, token: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = self[token] = int.from_bytes(hashlib.sha256(token).digest(), "big") % self.dimension
        return out


def _encoder(dimension: int, others: list[str], lists: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the vectors of rows with content beside others, some hundreds of rows at a time; with lists one row a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = _Buckets(dimension).__getitem__
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                vectors_ = [encoded(t, bucket_of) for t in some.column("content").to_pylist()]
                if lists:
                    vectors_ = [dict(sorted(v.items())) for v in vectors_]
                buckets = pa.array([b for v in vectors_ for b in v], pa.int64())
                weights = pa.array([w for v in vectors_ for w in v.values()], pa.float64())
                sizes, kept = [len(v) for v in vectors_], [some.column(c) for c in others]
                if lists:
                    entries = pa.StructArray.from_arrays([buckets, weights], names=["bucket", "weight"])
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), entries)], names=[*others, "keywords"])
                else:
                    rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                    yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in kept), buckets, weights], names=[*others, "bucket", "weight"])

    return run


def sparse_topk(stored: DataFrame, query: DataFrame, k: int = 20) -> DataFrame:
    """The k ids of largest inner product; ids without a common bucket are absent. query: (bucket, weight) of one text, which is small."""
    asked = F.broadcast(query.select("bucket", F.col("weight").alias("q")))
    return stored.join(asked, "bucket").groupBy("id").agg(F.sum(F.col("weight") * F.col("q")).alias("score")).orderBy(_best("score"), "id").limit(k)


def ranked(results: DataFrame, name: str) -> DataFrame:
    """Rank a top-k list; it is short, so one window over all of it is fine."""
    return results.select("id", F.row_number().over(Window.orderBy(_best("score"), "id")).alias(name))


def rrf(lists: dict[str, DataFrame], k: int = RRF_K) -> DataFrame:
    """Fuse ranked top-k lists by the sum of 1 / (k + rank); every list's rank is kept."""
    out = None
    for name, results in lists.items():
        one = ranked(results, f"{name}_rank")
        out = one if out is None else out.join(one, "id", "full_outer")
    score = F.lit(0.0)
    for name in lists:
        score = score + F.coalesce(1.0 / (k + F.col(f"{name}_rank")), F.lit(0.0))
    fused = out.withColumn("rrf_score", score)
    return fused.withColumn("rrf_rank", F.row_number().over(Window.orderBy(_best("rrf_score"), "id")))


def weighted_hybrid(dense: DataFrame, full_text: DataFrame, dense_weight: float = DENSE_WEIGHT, text_weight: float = TEXT_WEIGHT, k: int = 10) -> DataFrame:
    """Full outer join of two lists (id, score) and the weighted sum of their scores."""
    a, b = dense.select("id", F.col("score").alias("dense_score")), full_text.select("id", F.col("score").alias("text_score"))
    both = a.join(b, "id", "full_outer").select("id", F.coalesce("dense_score", F.lit(0.0)).alias("dense_score"), F.coalesce("text_score", F.lit(0.0)).alias("text_score"))
    return both.withColumn("score", F.col("dense_score") * dense_weight + F.col("text_score") * text_weight).orderBy(F.desc("score"), "id").limit(k)


def full_text(docs: DataFrame, terms: list[str], k: int = 20) -> DataFrame:
    """Documents that hold every term as a word, by the terms' share of their words. No stemming."""
    words = F.split(F.lower(F.coalesce("content", F.lit(""))), r"[^\p{L}\p{N}]+")
    asked = F.array(*(F.lit(t.lower()) for t in terms))
    kept = docs.withColumn("__words", words).where(F.forall(asked, lambda t: F.array_contains("__words", t)))
    hits = F.size(F.filter("__words", lambda w: F.array_contains(asked, w)))
    return kept.select("id", (hits / F.size("__words")).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def bm25(docs: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score): BM25 with document frequencies and the mean length of the corpus."""
    asked = sorted({t.lower() for t in terms})
    words = docs.select("id", tokens(F.col("content")).alias("w"))
    lengths = words.select("id", F.size("w").alias("n"), *(F.size(F.filter("w", _equals(t))).alias(f"tf{i}") for i, t in enumerate(asked)))
    facts = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked)))).first()
    score = F.lit(0.0)
    for i in range(len(asked)):
        tf, df = F.col(f"tf{i}"), facts[f"df{i}"]
        idf = F.log(F.lit(1 + (facts["docs"] - df + 0.5) / (df + 0.5)))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("n") / (facts["mean"] or 1)))
    return lengths.select("id", score.alias("score")).where("score > 0")


def bm25_fixed(terms: list[str], words: Column, mean_length: float = 1000.0, k1: float = 1.2, b: float = 0.75) -> Column:
    """A score by one document's words alone: a corpus of 1,000 is taken as given, and a term's weight is log(1000 / (1 + tf))."""
    score, n = F.lit(0.0), F.size(words)
    for t in terms:
        tf = F.size(F.filter(words, _equals(t)))
        score = score + F.when(tf > 0, F.log(1000 / (1 + tf)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean_length))).otherwise(0.0)
    return score


def movement(fused: DataFrame) -> DataFrame:
    """How far fusion moved what the dense list held."""
    change = F.col("dense_rank") - F.col("rrf_rank")
    return fused.where(F.col("dense_rank").isNotNull()).agg(F.avg(change).alias("mean_change"), F.count_if(change > 0).alias("improved"), F.min(change).alias("least"), F.max(change).alias("most"))
