"""Near-duplicate texts: SimHash groups and MinHash bands bring candidates together, the Jaccard similarity of five-word shingles decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import free_name, materialize, row_hash
from quillon.llm.components import components
from quillon.llm.shingles import fingerprints, shingle_digests, texts_of
from quillon.llm.simhash import linked_roots

#: Words of a shingle and the share of shingles in common at which texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Words of a SimHash feature and the differing bits up to which fingerprints make a group of candidates.
FEATURE, DISTANCE = 2, 3
#: Least hashes of a band, and bands: what the fingerprints part. Two texts of similarity 0.8 share no band once in 1.7 million pairs
#: ((1 - 0.8^3)^20 = 6e-7), more similar ones less often.
ROWS, BANDS = 3, 20
#: Texts of a block; candidates that no common text connects are compared block against block.
BLOCK = 1_000
#: Numbers that shingles' hashes are combined with, one for each least hash.
_MIX = np.random.default_rng(7).integers(0, 1 << 64, ROWS * BANDS, np.uint64)


def shingle_set(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_digests(text, width, 42), ">u8").astype(np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / max(1, len(a) + len(b) - common)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """BANDS keys of a set: each mixes ROWS least hashes. Long sets are taken piece by piece, so memory stays small."""
    least = np.full(len(_MIX), np.iinfo(np.uint64).max, np.uint64)
    for piece in np.array_split(shingles, -(-len(shingles) // 4096)):
        least = np.minimum(least, (piece[None, :] ^ _MIX[:, None]).min(axis=1))
    key = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ row) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def _sketched(table: DataFrame) -> DataFrame:
    """doc_id, node, fp, size (different shingles) and keys (bands) of table (doc_id, node, text); texts without words have no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch)
            fps = fingerprints(texts, FEATURE, 42)
            sets = [shingle_set(t) for t in texts]
            keys = [band_keys(s) if len(s) else np.zeros(0, np.int64) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(fps.view(np.int64)), pa.array(list(map(len, sets)), pa.int64()), lists], names=["doc_id", "node", "fp", "size", "keys"])

    kinds = (("node", T.LongType()), ("fp", T.LongType()), ("size", T.LongType()), ("keys", T.ArrayType(T.LongType())))
    return table.mapInArrow(run, T.StructType([table.schema["doc_id"], *(T.StructField(n, t) for n, t in kinds)]))


def _shingles(texts: DataFrame) -> DataFrame:
    """(node, shingles) of texts (node, text): sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t).tobytes() for t in texts_of(batch)], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def _candidates(unique: DataFrame) -> DataFrame:
    """(bucket, hub, node): texts that share a SimHash group or a band, each bucket with its least node. Buckets of the same texts are one."""
    by_fp = unique.where("size > 0").groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    roots = materialize(linked_roots(by_fp, DISTANCE), "roots")
    grouped = roots.unionByName(roots.select(F.col("root").alias("fp"), "root").distinct())
    alone = by_fp.where("n > 1").join(grouped, "fp", "left_anti").select("fp", F.col("fp").alias("root"))
    by_print = unique.where("size > 0").join(grouped.unionByName(alone), "fp").select(F.xxhash64("root", F.lit("simhash")).alias("key"), "node")
    keyed = unique.select(F.explode("keys").alias("key"), "node").unionByName(by_print)
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"), F.bit_xor(F.xxhash64("node")).alias("all")).where("n > 1")
    held = keyed.join(buckets.select("key", "hub", F.xxhash64("n", "hub", "all").alias("bucket")), "key")
    return held.select("bucket", "hub", "node").dropDuplicates(["bucket", "node"])


def _similar_stars(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the texts that are similar to a hub of theirs. A row a pair, so that no group of copies meets in one task."""
    pairs = members.where("node <> hub").select("node", "hub").distinct()
    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other")), "hub").select("node", "hub", "shingles", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = (batch.column(c).to_pylist() for c in ("shingles", "other"))
            near = pa.array([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity - 1e-9 for x, y in zip(one, other, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(near), batch.column("hub").filter(near)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _links(nodes: list[int], roots: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between texts of different roots that join all roots which links join; a root is looked at no more once it is joined."""
    out, root = [], np.unique(np.array(roots, np.int64), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    flat, owner = np.concatenate([sets[i] for i in order]), np.repeat(order, sizes[order])
    begins = np.concatenate(([0], np.cumsum(sizes[order])))
    for k, i in enumerate(order.tolist()):
        to = int(np.searchsorted(sizes[order], sizes[i] / similarity + 1e-9, side="right"))  # sizes beyond can't be similar
        if to <= k + 1 or (root[order[k + 1 : to]] == root[i]).all():
            continue
        own, part = sets[i], flat[begins[k + 1] : begins[to]]
        at = np.minimum(np.searchsorted(own, part), len(own) - 1)
        common = np.bincount(owner[begins[k + 1] : begins[to]][own[at] == part], minlength=len(nodes))
        for j in np.flatnonzero(common >= similarity * (sizes + sizes[i] - common) - 1e-9).tolist():
            if root[j] != root[i]:
                out.append((nodes[j], nodes[i]))
                root[root == root[j]] = root[i]
    return out


def _similar_rest(members: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between the members of a bucket that stars have not connected, as many as connect them; large buckets block by block."""
    rooted = members.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_buckets = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    blocks = open_buckets.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    blocked = rooted.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    runs = blocked.select("bucket", "node", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    keyed = runs.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "node", "root").join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, roots_, held = None, [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            edges = _links(nodes, roots_, held, similarity) if len(set(roots_)) > 1 else []
            if edges:
                a, b = zip(*edges, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for key, node, root, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    yield from flush()
                    last, nodes, roots_, held = key, [], [], []
                nodes.append(node)
                roots_.append(root)
                held.append(np.frombuffer(shingles, np.uint64))
        yield from flush()

    ordered = keyed.select("key", "node", "root", "shingles").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def text_clusters(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, least, component_id): the distinct texts of docs (doc_id, text) by their hash, the least doc_id that has the text, and the least of
    the texts that links lead to. Texts link if they share similarity of all their five-word shingles (a shorter text is one shingle). Equal
    texts are one node; null and blank ones link to their equals alone.

    Links are verified before anything is connected: first each text with one of its bucket, then, in buckets that fall apart, the parts.
    """
    table = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("node", row_hash(F.col("text")))
    firsts = (F.first(c).alias(c) for c in ("fp", "size", "keys"))
    unique = materialize(_sketched(table).groupBy("node").agg(F.min("doc_id").alias("least"), *firsts), "texts")
    members = materialize(_candidates(unique), "candidates")
    wanted = unique.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("least").alias("doc_id"))
    texts = table.join(wanted, ["node", "doc_id"], "left_semi").select("node", "text")
    lone = table.where("doc_id IS NULL").join(wanted.where("doc_id IS NULL"), "node", "left_semi").select("node", "text")
    sets = materialize(_shingles(texts.unionByName(lone)).dropDuplicates(["node"]), "shingles")
    stars = materialize(_similar_stars(members, sets, similarity), "stars")
    roots = components(stars).select(F.col("a").alias("node"), F.col("b").alias("root"))
    links = components(stars.unionByName(_similar_rest(members, roots, sets, similarity))).select(F.col("a").alias("node"), F.col("b").alias("top"))
    both = links.unionByName(links.select(F.col("top").alias("node"), "top").distinct())
    named = both.join(unique, "node").groupBy("top").agg(F.min("least").alias("component"))
    owner = both.join(named, "top").select("node", "component")
    return unique.join(owner, "node", "left").select("node", "least", F.coalesce("component", "least").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near-duplicate texts: the least doc_id's. Rows alike in doc_id and text stay together; columns stay."""
    clusters = materialize(text_clusters(docs, similarity), "clusters")
    node = free_name(docs, "node")
    keyed = docs.withColumn(node, row_hash(F.col("text").cast("string")))
    # a text goes if its group's least document has another text; of equal texts, the least document stays
    tops = clusters.where(F.col("least").eqNullSafe(F.col("component_id"))).select(F.col("node").alias("__top_node"), F.col("least").alias("__top"))
    top = keyed.alias("d").join(tops.alias("t"), (F.col(f"d.`{node}`") == F.col("t.__top_node")) & F.col("d.doc_id").eqNullSafe(F.col("t.__top")), "left_semi")
    return top.select(*(F.col(f"d.`{c}`") for c in docs.columns))
