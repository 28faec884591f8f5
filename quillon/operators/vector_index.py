"""An approximate vector index: cells fitted on a bounded sample, 8-bit residuals in blocks, and an exact second ranking of the best.

Every row is indexed. A search asks the nearest cells of each query, scores their blocks in the tasks, and ranks what is left by the vectors
themselves. retrieval.dense_join is the exact form.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import vectors

#: The fit: rows of the sample, cells at most, rounds. Vectors of a block; queries that meet a block together.
SAMPLE, CELLS, ROUNDS, BLOCK, QUERIES = 20_000, 4096, 12, 256, 1024
#: The recall that the number of asked cells is chosen for, rows of the sample that it is measured with, neighbours of each; and candidates for one
#: result that are ranked exactly.
RECALL, MEASURED, NEIGHBOURS, CANDIDATES = 0.95, 256, 10, 8


class Fitted(NamedTuple):
    """Centroids (cells x dimension), and the number of nearest cells that a query asks."""

    centres: np.ndarray
    probes: int


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-30)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; nulls and other lengths as zeros, which are near nothing."""
    lists = column.to_pylist()
    size = max((len(v) for v in lists if v), default=0)
    return np.array([v if v and len(v) == size else [0.0] * size for v in lists], np.float32).reshape(len(lists), size)


def fit(points: DataFrame, cells: int | None = None, sample: int = SAMPLE, seed: int = 0) -> Fitted:
    """Centroids of unit vectors by k-means on at most sample rows, chosen by the hash of their ids; cells: the root of the number of rows.

    How many cells a query asks is measured on the sample: as many as hold RECALL of the nearest neighbours of MEASURED of its rows. Clustered
    vectors need few cells, vectors without structure many.
    """
    n = points.count()
    share = min(1.0, 1.3 * sample / max(n, 1))
    some = points.where(F.col("vector").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) < int(share * 1_000_003) + 1)).select("vector").limit(sample).collect()
    if not some:
        return Fitted(np.zeros((1, 0), np.float32), 1)
    size = max(len(r.vector) for r in some)
    rows = _unit(np.array([r.vector for r in some if len(r.vector) == size], np.float32).reshape(-1, size))
    many = max(1, min(cells or math.isqrt(n), CELLS, len(np.unique(rows, axis=0))))
    centres = rows[np.random.default_rng(seed).choice(len(rows), many, replace=False)]
    for _ in range(ROUNDS):
        own = (rows @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        empty = np.bincount(own, minlength=many) == 0
        centres = np.where(empty[:, None], centres, _unit(sums))
    return Fitted(centres, _probes(rows, centres, seed))


def _probes(rows: np.ndarray, centres: np.ndarray, seed: int) -> int:
    """The least number of cells, nearest first, that hold RECALL of the neighbours of some of rows (themselves left out)."""
    asked = np.random.default_rng(seed + 1).choice(len(rows), min(MEASURED, len(rows)), replace=False)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1, kind="stable")[:, : min(NEIGHBOURS, len(rows) - 1)]
    place = np.argsort(np.argsort(-(rows[asked] @ centres.T), axis=1, kind="stable"), axis=1)  # how many cells are nearer
    cell = (rows @ centres.T).argmax(axis=1)[near]
    ranks = np.sort(np.take_along_axis(place, cell, 1).ravel())
    return int(ranks[math.ceil(RECALL * len(ranks)) - 1]) + 1 if len(ranks) else 1


def write(points: DataFrame, path: str, fitted: Fitted, mode: str = "overwrite") -> None:
    """Index every row of points (id, vector) under path: blocks of a cell's ids, 8-bit residuals and their scales. mode "append" adds rows to an index of the same fit."""
    centres = fitted.centres
    size = centres.shape[1]
    spark = points.sparkSession
    spark.createDataFrame([(i, c.tolist(), fitted.probes) for i, c in enumerate(centres)], "cell int, centre array<float>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    n = max(1, points.count())
    salts = F.pmod(F.xxhash64("id"), F.lit(max(1, n // 100_000)))  # a cell that holds most of the rows is dealt to many tasks
    schema = T.StructType([points.schema["id"], *T.StructType.fromDDL("cell int, scale float, code binary").fields])
    coded = points.select("id", "vector").mapInArrow(_coded(centres), schema)
    dealt = coded.withColumn("salt", salts).repartition("cell", "salt").sortWithinPartitions("cell")
    blocks = dealt.select("id", "cell", "scale", "code").mapInArrow(_blocked(size), T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(points.schema["id"].dataType)), *T.StructType.fromDDL("scales array<float>, codes binary").fields]))
    blocks.write.mode(mode).parquet(f"{path}/blocks")


def _coded(centres: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                rows = _matrix(some.column("vector"))
                rows = _unit(rows) if rows.shape[1] == centres.shape[1] else np.zeros((len(rows), centres.shape[1]), np.float32)
                own = (rows @ centres.T).argmax(axis=1)
                rest = rows - centres[own]
                scale = np.maximum(np.abs(rest).max(axis=1, initial=0), 1e-12)
                code = np.round(rest / scale[:, None] * 127).astype(np.int8)
                yield pa.RecordBatch.from_arrays([some.column("id"), pa.array(own.astype(np.int32)), pa.array(scale.astype(np.float32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["id", "cell", "scale", "code"])

    return run


def _blocked(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring rows of a cell as one row, BLOCK at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            cuts = np.flatnonzero(np.diff(cell)) + 1
            spans = [(x, min(x + BLOCK, b)) for a, b in zip([0, *cuts], [*cuts, len(cell)], strict=True) for x in range(a, b, BLOCK)]
            codes = batch.column("code").to_pylist()
            ids, scales = batch.column("id"), batch.column("scale").to_numpy()
            if spans:
                arrays = [pa.array([cell[a] for a, _ in spans], pa.int32()), pa.array([ids.slice(a, b - a).to_pylist() for a, b in spans], pa.list_(ids.type)), pa.array([scales[a:b].tolist() for a, b in spans], pa.list_(pa.float32())), pa.array([b"".join(codes[a:b]) for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "ids", "scales", "codes"])

    return run


def search(spark: SparkSession, path: str, points: DataFrame, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): for each of queries (query_id, vector) about the k points of largest cosine; points are those that were indexed.

    Each query asks its nearest cells, as many as the fit says or probes. Queries of a cell travel in groups of about QUERIES, blocks are rows, and a task passes on
    CANDIDATES * k rows a query; those are joined with points and ranked by the exact cosine.
    """
    stored = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # CELLS rows at most
    centres = np.array([r.centre for r in stored], np.float32)
    probes = min(len(centres), probes or stored[0].probes)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<float>").alias("vector"))
    slots = max(1, -(-asked.count() // QUERIES))
    near = asked.mapInArrow(_probing(centres, probes), "query_id long, vector array<float>, cell int")
    groups = near.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(slots)).alias("slot")).agg(F.collect_list("query_id").alias("asked"), F.flatten(F.collect_list("vector")).alias("q"))
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    met = blocks.join(groups, "cell").select("cell", "ids", "scales", "codes", "asked", "q")
    most = CANDIDATES * k
    best = met.mapInArrow(_scored(centres, most), f"query_id long, id {kind}, near float")
    chosen = best.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "id"))).where(F.col("nth") <= most)
    exact = chosen.select("query_id", "id").join(points.select("id", F.col("vector").alias("v")), "id").join(asked, "query_id")
    scored = exact.select("query_id", "id", vectors.cosine(F.col("v"), F.col("vector")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probing(centres: np.ndarray, probes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column("vector"))
            if not len(rows) or rows.shape[1] != centres.shape[1]:
                continue
            rows = _unit(rows)
            cells = np.argpartition(-(rows @ centres.T), probes - 1, axis=1)[:, :probes]
            repeated = pa.array(np.repeat(np.arange(len(rows)), probes))
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(repeated), pa.array(np.repeat(rows, probes, axis=0).tolist(), pa.list_(pa.float32())), pa.array(cells.ravel().astype(np.int32))], names=["query_id", "vector", "cell"])

    return run


def _scored(centres: np.ndarray, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The most best points of each query in a task, by centre and residual."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = centres.shape[1]
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for cell, ids, scales, codes, asked, q in zip(*(batch.column(c) for c in ("cell", "ids", "scales", "codes", "asked", "q")), strict=True):
                names = np.array(ids.as_py())
                residual = np.frombuffer(codes.as_py(), np.int8).reshape(-1, size) * (np.array(scales.as_py(), np.float32)[:, None] / 127)
                questions = np.array(q.as_py(), np.float32).reshape(-1, size)
                scores = questions @ (centres[cell.as_py()] + residual).T
                for name, row in zip(asked.as_py(), scores, strict=True):
                    was = best.get(name)
                    all_ids, all_scores = (names, row) if was is None else (np.concatenate((was[0], names)), np.concatenate((was[1], row)))
                    if len(all_ids) > 4 * most:
                        keep = np.argpartition(-all_scores, most)[:most]
                        all_ids, all_scores = all_ids[keep], all_scores[keep]
                    best[name] = all_ids, all_scores
        for name, (all_ids, all_scores) in best.items():
            keep = np.argsort(-all_scores, kind="stable")[:most]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), name, np.int64)), pa.array(all_ids[keep]), pa.array(all_scores[keep].astype(np.float32))], names=["query_id", "id", "near"])

    return run
