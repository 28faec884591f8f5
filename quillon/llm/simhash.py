"""SimHash near-duplicates by generalised pigeonhole: correlated bits share a part, parts get unequal thresholds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import materialize
from quillon.llm.components import components
from quillon.llm.shingles import fingerprint_batches

BITS = 64
#: Fingerprints of one bucket beyond which it is divided by a second, exact pigeonhole.
HOT_BUCKET = 20_000
#: A probe row's cost in candidate comparisons.
PROBE_COST = 30.0


class Plan(NamedTuple):
    """parts: the bits (0: least significant) of each part; thresholds: differing bits that a part is searched for, -1: not at all."""

    parts: list[list[int]]
    thresholds: list[int]


def fingerprint_table(docs: DataFrame, width: int = 3, seed: int = 42, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and fp, for every row; null text has no shingles and fingerprint 0."""
    source = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(source.schema[x] for x in keep), T.StructField("fp", T.LongType())])
    return source.mapInArrow(fingerprint_batches(width, seed), schema)


def bits_of(fps: np.ndarray) -> np.ndarray:
    """One row a fingerprint, column b its bit b (0: least significant)."""
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def differing(a: np.ndarray, b: np.ndarray | np.int64) -> np.ndarray:
    """Bits in which fingerprints differ; the sign bit counts like any other."""
    return np.bitwise_count(np.bitwise_xor(a, b).view(np.uint64))


def part_values(fps: np.ndarray, part: list[int]) -> np.ndarray:
    """The part's bits as a number."""
    out = np.zeros(len(fps), np.int64)
    for k, b in enumerate(part):
        out |= ((fps >> b) & 1) << k
    return out


def group_correlated(both: np.ndarray, ones: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Divide the bits into equal parts, each grown from the free bit of largest total correlation by the bits most correlated with it."""
    p = ones / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, out = set(range(BITS)), []
    for left in range(parts, 0, -1):
        want = len(free) // left
        order = sorted(free)
        part = [max(order, key=lambda b: corr[b, order].sum())]
        free.discard(part[0])
        while len(part) < want:
            best = max(sorted(free), key=lambda b: corr[b, part].sum())
            part.append(best)
            free.discard(best)
        out.append(sorted(part))
    return out


def ball_pairs(counts: np.ndarray, width: int, most: int) -> list[float]:
    """For t of 0 to most: pairs of fingerprints whose part values differ in t bits or fewer, from a histogram of the values."""
    shells = [counts.astype(np.float64)] + [np.zeros(len(counts))] * most
    index = np.arange(len(counts))
    for b in range(width):
        flipped = index ^ (1 << b)
        shells = [shells[0]] + [shells[j] + shells[j - 1][flipped] for j in range(1, most + 1)]
    return list(np.cumsum([(counts * s).sum() for s in shells]))


def allocate(costs: list[list[float]], distance: int) -> list[int]:
    """Thresholds t of -1 or more, which sum to distance - parts + 1, of the least total cost; costs[i][t + 1] is part i's."""
    goal = distance - len(costs) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, c in enumerate(row, -1):
                if total + t not in step or cost + c < step[total + t][0]:
                    step[total + t] = (cost + c, [*chosen, t])
        best = step
    return best[goal][1]


def make_plan(unique: DataFrame, distance: int, parts: int) -> Plan:
    """Fit the parts and thresholds to all fingerprints; only 64 x 64 sums and histograms of 2^(64 / parts) values come to the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS + 1, BITS))
        for batch in batches:
            bits = bits_of(batch.column(0).to_numpy()).astype(np.float32)
            total[:BITS] += bits.T @ bits
            total[BITS, 0] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["i", "x"])

    sums = np.zeros((BITS + 1) * BITS)
    got = unique.select("fp").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    sums[got["i"].to_numpy(np.int64)] = got["x"].to_numpy(np.float64)
    both, n = sums[: BITS * BITS].reshape(BITS, BITS), int(sums[BITS * BITS])
    chosen = group_correlated(both, np.diag(both), n, parts)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(p), np.int64) for p in chosen]
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for c, p in zip(counts, chosen, strict=True):
                c += np.bincount(part_values(fps, p), minlength=len(c))
        for i, c in enumerate(counts):
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), i)), pa.array(v), pa.array(c[v])], names=["i", "v", "n"])

    got = unique.select("fp").mapInArrow(histogram, "i long, v long, n long").groupBy("i", "v").agg(F.sum("n").alias("n")).toPandas()
    most = 2
    costs = []
    for i, p in enumerate(chosen):
        mine = got[got["i"] == i]
        counts = np.zeros(1 << len(p), np.int64)
        counts[mine["v"].to_numpy(np.int64)] = mine["n"].to_numpy(np.int64)
        pairs = ball_pairs(counts, len(p), most)
        probes = [1, 1 + len(p), 1 + len(p)]
        costs.append([0.0, *(x / 2 + n * k * PROBE_COST for x, k in zip(pairs, probes, strict=True))])
    return Plan(chosen, allocate(costs, distance))


def candidate_keys(unique: DataFrame, plan: Plan) -> DataFrame:
    """(key, own, fp): a fingerprint's buckets. Two fingerprints that differ in t bits of a part, for t up to its threshold, meet in a bucket.

    Threshold 0 takes the part's own value; 1 and 2 take also the values one bit away, where two that differ in 2 bits meet in the middle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
                if t < 0:
                    continue
                own = part_values(fps, part) | (i << 40)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(fps)], names=["key", "fp"])
                for b in range(len(part) if t else 0):
                    yield pa.RecordBatch.from_arrays([pa.array(own ^ (1 << b)), pa.array(fps)], names=["key", "fp"])

    return unique.select("fp").mapInArrow(run, "key long, fp long")


def _bucket_forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges that connect what links of at most distance bits connect, each a verified link: a breadth-first search over the rest."""
    out, rest = [], np.unique(fps)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = differing(rest, at) <= distance
            if near.any():
                found = rest[near]
                out += [(int(x), int(at)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return out


def link_runs(keys: np.ndarray, fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges within each run of equal keys. Small runs are compared all at once, offset by offset; those with links get a search."""
    edges: list[tuple[int, int]] = []
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(keys)])))
    run_of = np.repeat(np.arange(len(starts)), sizes)
    small, linked = sizes <= 64, np.zeros(len(starts), bool)
    for d in range(1, int(sizes[small].max(initial=1))):
        a = np.flatnonzero((run_of[:-d] == run_of[d:]) & small[run_of[d:]])
        if not len(a):
            break
        near = differing(fps[a], fps[a + d]) <= distance
        linked[run_of[a[near]]] = True
    for r in np.flatnonzero((linked | ~small) & (sizes > 1)):
        edges += _bucket_forest(fps[starts[r] : starts[r] + sizes[r]], distance)
    return edges


def bucket_edges(keyed: DataFrame, distance: int) -> DataFrame:
    """(a, b): verified links that connect each bucket's components; keyed (key, fp) is dealt by key and sorted, so a bucket is one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def flush(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            edges = link_runs(k, f, distance) if len(k) > 1 else []
            if edges:
                a, b = np.array(edges, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            fps = np.concatenate((fps, batch.column(1).to_numpy()))
            if len(keys) > 200_000:
                cut = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                yield from flush(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        yield from flush(keys, fps)

    return keyed.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def _divide_hot(keyed: DataFrame, distance: int) -> DataFrame:
    """Buckets of over HOT_BUCKET fingerprints become distance + 1 tables by exact parts of the whole fingerprint, which pigeonhole makes complete."""
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_BUCKET).select("key", F.lit(True).alias("hot"))
    joined = keyed.join(sizes, "key", "left")
    width = BITS // (distance + 1)
    pieces = F.array(*(F.xxhash64("key", F.lit(j), F.shiftrightunsigned("fp", j * width).bitwiseAND(F.lit((1 << width) - 1) if j < distance else F.lit(-1))) for j in range(distance + 1)))
    return joined.select(F.explode(F.when(F.col("hot"), pieces).otherwise(F.array("key"))).alias("key"), "fp")


def linked_roots(unique: DataFrame, distance: int = 3, parts: int = 4) -> DataFrame:
    """(fp, root) of every fingerprint that is linked to another but isn't the least of its component."""
    plan = make_plan(unique, distance, parts)
    edges = bucket_edges(_divide_hot(candidate_keys(unique, plan), distance), distance)
    return components(edges).select(F.col("a").alias("fp"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, parts: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text): documents link at distance or fewer differing fingerprint bits.

    component_id is the least doc_id that links lead to. Null and blank texts have fingerprint 0 and link like any other; repeated rows keep
    their own row; a null doc_id never names a component that has another; an empty table gives no rows.
    """
    table = materialize(fingerprint_table(docs, width, seed), "fingerprints")
    unique = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least")), "unique")
    roots = linked_roots(unique, distance, parts)
    tops = roots.select("root").distinct().select(F.col("root").alias("fp"), "root")
    member = roots.unionByName(tops)
    named = member.join(unique, "fp").groupBy("root").agg(F.min("least").alias("component"))
    merged = member.join(named, "root").select("fp", "component")
    owner = unique.join(merged, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    return table.join(owner, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def brute_force(rows: list[tuple[int, str | None]], distance: int = 3, width: int = 3, seed: int = 42) -> pd.DataFrame:
    """The same by comparing all pairs; for tests on a few rows."""
    import xxhash

    ids, fps = [], []
    for i, text in rows:
        words = [w for w in (text or "").encode().lower().split() if w]
        shingles = [b" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] if len(words) >= width else ([b" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
        ids.append(i)
        fps.append(sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            if (fps[x] ^ fps[y]).bit_count() <= distance:
                parent[find(x)] = find(y)
    least: dict[int, int] = {}
    for x, i in enumerate(ids):
        least[find(x)] = min(i, least.get(find(x), i))
    return pd.DataFrame({"doc_id": ids, "fingerprint": [f"{f:016x}" for f in fps], "component_id": [least[find(x)] for x in range(len(ids))]})
