"""Filter interaction audit: what each filter removes in every order of the filters, by one product of histograms with constant matrices.

A document fails some of five filters: its mask, 0 to 31. What happens to it in an order of the filters follows from the mask alone, so
histograms of masks (a row for all, good and toxic documents of a part) times matrices of 32 masks by 600 places (120 orders of 5 steps) are
the whole audit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, materialize, words_of

FILTERS = "ABCDE"
MASKS, PLACES = 2 ** len(FILTERS), [(order, step) for order in permutations(range(len(FILTERS))) for step in range(len(FILTERS))]
ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: Column) -> Column:
    """The bits of the filters that read one text: A few words (1), B repeated words (2), C capitals (4), D symbols (8)."""
    counts = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    bit = lambda fails, k: F.when(fails, 1 << k).otherwise(0)
    return let(counts, lambda c: bit(c["n"] < 200, 0) + bit(100 * c["distinct"] < 50 * c["n"], 1)) + bit(100 * capitals > 3 * F.length(text), 2) + bit(text.rlike(r"[#$%&*|]"), 3)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) for every row of docs (doc_id, text, lang). E (16): a smaller doc_id has the same text, anywhere in the table.

    Null texts are empty, a null lang is the empty part. A null doc_id is neither smaller nor larger than another, so such rows neither fail E
    nor make others fail; rows of one doc_id don't make each other fail. Texts meet by their SHA-256; the least id of each is found by partial
    minima, and rows meet it under text and id, so a text that many rows share is dealt to many tasks.
    """
    text = F.coalesce("text", F.lit(""))
    plain = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text_mask(text).cast("int").alias("mask"))
    plain = materialize(plain, "masks")
    first = plain.where("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    joined = plain.join(first, ["same", "doc_id"], "left")
    fails = F.col("first").isNull() & F.col("doc_id").isNotNull()
    return joined.select("doc_id", "part", (F.col("mask") + F.when(fails, 16).otherwise(0)).alias("mask"))


def histograms(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part an array of (mask, n, good, toxic), 32 at most. A document is good (toxic) if a row of labels says so; one without a label is neither."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    cells = masked.join(one, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.count_if(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))


def outcome_matrices() -> dict[str, np.ndarray]:
    """32-by-600 matrices of zeros and ones: what becomes of a document of a mask at a step of an order."""
    fails = (np.arange(MASKS)[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool)
    out = {name: np.zeros((MASKS, len(PLACES)), np.int64) for name in ("kept", "removed", "redundant", "unique")}
    for k, (order, step) in enumerate(PLACES):
        before, own = fails[:, list(order[:step])].any(axis=1), fails[:, order[step]]
        out["kept"][:, k] = ~before & ~own
        out["removed"][:, k] = ~before & own
        out["redundant"][:, k] = before & own
        out["unique"][:, k] = own & (fails.sum(axis=1) == 1)
    return out


def audit(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with the counts of ROWS; no rows for an empty table.

    kept: left after the step; removed: taken by it; redundant: would be taken by it, an earlier step took them; unique_fails: fail its filter
    only; good_lost, toxic_lost: removed with that label; shapley: what the step's filter removes, summed over all orders. Counts are 64-bit integers.
    """
    return histograms(masked, labels).mapInArrow(_multiplied, ROWS)


def _multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The histograms of a batch's parts, stacked as rows, times the matrices."""
    matrices = outcome_matrices()
    orders = ["".join(FILTERS[f] for f in order) for order, _ in PLACES]
    steps = np.array([step + 1 for _, step in PLACES], np.int32)
    own = np.array([order[step] for order, step in PLACES])
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            block = batch.slice(at, 64)
            stacked = np.zeros((block.num_rows, 3, MASKS), np.int64)
            for i, cells in enumerate(block.column("cells").to_pylist()):
                for cell in cells:
                    stacked[i, :, cell["mask"]] += (cell["n"], cell["good"], cell["toxic"])
            rows = stacked.reshape(-1, MASKS)
            removed = (rows @ matrices["removed"]).reshape(-1, 3, len(PLACES))
            kept, redundant, unique = (rows[::3] @ matrices[m] for m in ("kept", "redundant", "unique"))
            by_filter = np.stack([removed[:, 0][:, own == f].sum(axis=1) for f in range(len(FILTERS))], axis=1)
            columns = [kept, removed[:, 0], redundant, unique, removed[:, 1], removed[:, 2], by_filter[:, own]]
            parts = [p for p in block.column("part").to_pylist() for _ in PLACES]
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.string()), pa.array(orders * block.num_rows), pa.array(np.tile(steps, block.num_rows)), *(pa.array(c.ravel()) for c in columns)],
                names=[c.split()[0] for c in ROWS.split(", ")],
            )
