"""Minimax contiguous sharding: atomic groups in a fixed order, the least shard capacity that k cuts can meet, and the cuts there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: Cells into which the order of groups is divided at first, and into how many each is that a cut may fall into.
FIRST_CELLS, FINER = 1 << 12, 1 << 6
#: Rows of one shard that are numbered in one task.
SLOT_ROWS = 50_000


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray | None:
    """The ends (exclusive) of shards filled one after the other up to capacity, over sizes in their order; None if they don't suffice."""
    ends = np.cumsum(sizes)
    cuts, at, done = [], 0, 0
    while at < len(sizes):
        if len(cuts) == shards:
            return None
        to = int(np.searchsorted(ends, done + capacity, side="right"))
        if to == at:
            return None
        cuts.append(to)
        at, done = to, int(ends[to - 1])
    return np.array(cuts + [len(sizes)] * (shards - len(cuts)))


def even_cuts(sizes: np.ndarray, capacity: int, shards: int) -> np.ndarray:
    """Cuts as near to equal shares as they come while no shard exceeds a feasible capacity."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    total, least, at = int(sums[-1]), [0] * (shards + 1), len(sizes)
    for s in range(shards - 1, 0, -1):  # filled from the end, where the cut must be at least
        at = int(np.searchsorted(sums, sums[at] - capacity, side="left"))
        least[s] = at
    cuts, at = [], 0
    for s in range(1, shards):
        reach = int(np.searchsorted(sums, sums[at] + capacity, side="right")) - 1
        want = int(np.searchsorted(sums, s * total // shards))
        if want and s * total // shards - sums[want - 1] < sums[want] - s * total // shards:
            want -= 1
        at = min(reach, max(least[s], want, at))
        cuts.append(at)
    return np.array([*cuts, len(sizes)])


def least_capacity(sizes: np.ndarray, shards: int, low: int = 0) -> int:
    """Binary search for the least capacity that greedy_cuts can meet."""
    if not len(sizes):
        return 0
    low = max(low, int(sizes.max()), -(-int(sizes.sum()) // shards))
    high = max(low, int(sizes.sum()))
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _cell_sums(groups: DataFrame, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and groups in each cell [edges[i], edges[i + 1]) of the order: one aggregation to a number for each cell."""
    sizes, counts = np.zeros(len(edges) - 1, np.int64), np.zeros(len(edges) - 1, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(edges) - 1, np.int64), np.zeros(len(edges) - 1, np.int64)
        for batch in batches:
            cell = np.searchsorted(edges, batch.column(0).to_numpy(), side="right") - 1
            np.add.at(total, cell, batch.column(1).to_numpy())
            n += np.bincount(cell, minlength=len(n))
        i = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i]), pa.array(n[i])], names=["i", "bytes", "n"])

    got = groups.select("place", "bytes").mapInArrow(place, "i long, bytes long, n long").groupBy("i").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).toPandas()
    i = got["i"].to_numpy(np.int64)
    sizes[i], counts[i] = got["bytes"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    return sizes, counts


def minimax_bounds(groups: DataFrame, shards: int) -> list[int]:
    """The places (exclusive) at which each shard but the last ends, for groups (place, bytes) in the order of place (a long, evenly spread, distinct).

    The driver holds sums over cells of the order. Whole cells as units give a capacity that suffices, cells cut at will one that can't be
    undercut; only cells that a cut for a capacity between may fall into are divided further, until those hold a single group each. Of the cuts
    that meet the capacity those nearest to equal shares are taken.
    """
    lowest, highest = -(1 << 63), (1 << 63) - 1
    edges = np.array([lowest + i * ((1 << 64) // FIRST_CELLS) for i in range(FIRST_CELLS)] + [highest], np.int64)
    largest = groups.agg(F.coalesce(F.max("bytes"), F.lit(0))).first()[0]
    while True:
        sizes, counts = _cell_sums(groups, edges)
        total, ends = int(sizes.sum()), np.cumsum(sizes)
        low = max(largest, -(-total // shards))
        high = least_capacity(sizes, shards, low)
        early = _earliest(sizes, ends, low, shards)
        late = np.minimum(total, high * np.arange(1, shards))
        begin = ends - sizes
        open_cells = np.zeros(len(sizes), bool)
        for a, b in zip(early, late, strict=True):
            open_cells |= (ends > a) & (begin <= b)
        open_cells &= counts > 1
        if not open_cells.any():
            return [int(edges[c]) for c in even_cuts(sizes, high, shards)[:-1]]
        fine = [edges[:-1]]
        for i in np.flatnonzero(open_cells):
            a, b = int(edges[i]), int(edges[i + 1])
            step = max(1, (b - a) // FINER)
            fine.append(np.array([a + k * step for k in range(1, FINER) if a + k * step < b], np.int64))
        edges = np.concatenate((np.unique(np.concatenate(fine)), edges[-1:]))


def _earliest(sizes: np.ndarray, ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """How far the first, second ... shard surely reaches when cells that don't fit are left out."""
    out, done = [], 0
    for _ in range(shards - 1):
        to = int(np.searchsorted(ends, done + capacity, side="right"))
        done = max(done, int(ends[to - 1]) if to else 0)
        out.append(done)
    return out


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of docs (doc_id, text): equal texts stay together, the largest shard is as small as it can be.

    size is the text's UTF-8 bytes (null: none) plus 16. Groups of equal texts stand in the order of their hash, except that a group larger than
    an equal share of what is left gets a shard of its own, the largest first. slot counts from 0 without gaps. Null text is a group of its
    own; repeated rows are rows of their own; fewer groups than shards leave shards empty; an empty table gives no rows.
    """
    size = (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16).cast("long")
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.xxhash64(text.isNull(), text).alias("place"))
    rows = materialize(rows, "sizes")
    groups = materialize(rows.groupBy("place").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    giants: list[tuple[int, int]] = []
    for place, own in groups.orderBy(F.desc("bytes"), "place").limit(shards).collect():  # larger than an equal share: fewer than shards
        left = shards - len(giants)
        if left < 2 or own * left <= total - sum(x for _, x in giants):
            break
        giants.append((place, own))
    alone = [p for p, _ in giants]
    rest = groups.where(~F.col("place").isin(alone)) if alone else groups
    bounds = minimax_bounds(rest, shards - len(alone))
    shard = F.lit(len(alone))
    for b in sorted(bounds):
        shard = shard + (F.col("place") >= F.lit(b)).cast("int")
    for k, p in enumerate(alone):
        shard = F.when(F.col("place") == F.lit(p), F.lit(k)).otherwise(shard)
    return _with_slots(rows.select("doc_id", "size", "text_crc32", "place", shard.cast("int").alias("shard")), shards)


def _with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Number a shard's rows in cells of bounded size, then shift every cell by the rows of those before it."""
    cells = rows.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0] // SLOT_ROWS + 1
    celled = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "place", F.lit(3)), F.lit(cells)))
    counts = celled.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "cell", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("place", "doc_id")) - 1
    return celled.withColumn("nth", nth).join(offsets, ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("nth") + F.col("before")).cast("long").alias("slot"))
