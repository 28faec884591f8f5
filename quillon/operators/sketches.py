"""A two-phase aggregate with stored state: sketches of quantiles made in the tasks, kept as a binary column, merged by any coarser key.

A positive value v falls into the bucket ceil(log_g v), g = (1 + a) / (1 - a); a quantile is read as 2 g^i / (g + 1), which is within a share a of
the value at that rank. Merging adds counts, so sketches of days merged by month are the month's own.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The share by which a quantile may be wrong, and how many parts of a key are merged at once.
ACCURACY, WAYS = 0.01, 64
#: Values below this (zero and negative ones too) are one bucket, read as 0.
LEAST = 1e-9
_LOW = -(2**31)


def bucket_of(values: np.ndarray, accuracy: float = ACCURACY) -> np.ndarray:
    gamma = math.log((1 + accuracy) / (1 - accuracy))
    return np.where(values < LEAST, _LOW, np.ceil(np.log(np.maximum(values, LEAST)) / gamma)).astype(np.int64)


def packed(buckets: np.ndarray, counts: np.ndarray) -> bytes:
    """Buckets in rising order with their counts."""
    return struct.pack("<q", len(buckets)) + buckets.astype("<i4").tobytes() + counts.astype("<i8").tobytes()


def unpacked(sketch: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = struct.unpack_from("<q", sketch)[0]
    return np.frombuffer(sketch, "<i4", n, 8).astype(np.int64), np.frombuffer(sketch, "<i8", n, 8 + 4 * n)


def merged(sketches: list[bytes]) -> bytes:
    parts = [unpacked(s) for s in sketches]
    buckets, at = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
    counts = np.zeros(len(buckets), np.int64)
    np.add.at(counts, at, np.concatenate([c for _, c in parts]))
    return packed(buckets, counts)


def quantile(sketch: bytes, q: float, accuracy: float = ACCURACY) -> float | None:
    """The value of rank floor(q * (n - 1)), within the accuracy; None for an empty sketch."""
    buckets, counts = unpacked(sketch)
    n = int(counts.sum())
    if not n:
        return None
    bucket = buckets[np.searchsorted(np.cumsum(counts), math.floor(q * (n - 1)), side="right")]
    gamma = (1 + accuracy) / (1 - accuracy)
    return 0.0 if bucket == _LOW else 2 * gamma ** float(bucket) / (gamma + 1)


def sketched(rows: DataFrame, value: str, *keys: str, accuracy: float = ACCURACY) -> DataFrame:
    """(keys..., n, sketch): one sketch for each key of the values of rows; nulls and NaN don't count. Tasks make partial sketches, which are merged twice so that no key's parts all meet at once before they are few."""
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("sketch", T.BinaryType())])
    numbers = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(value).cast("double").alias("__value"))
    # sorted by key within a task, a task holds one key's counts at a time however many keys there are
    partial = numbers.sortWithinPartitions(*keys).mapInArrow(_partial(list(keys), accuracy), schema)
    return merge(partial, *keys)


def _partial(keys: list[str], accuracy: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # a key that goes on in the next batch gives another part
            if not batch.num_rows:
                continue
            columns = [batch.column(k) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in columns:
                codes = c.dictionary_encode(null_encoding="encode").indices.to_numpy()
                change[1:] |= codes[1:] != codes[:-1]
            starts = np.flatnonzero(change)
            buckets = bucket_of(batch.column("__value").to_numpy(), accuracy)
            sketches = [packed(*np.unique(part, return_counts=True)) for part in np.split(buckets, starts[1:])]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(starts)) for c in columns), pa.array(sketches, pa.binary())], names=[*keys, "sketch"])

    return run


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, sketch) of rows (keys..., sketch): stored sketches by a coarser key, as if made in one pass."""
    some = sketches.select(*keys, "sketch", F.pmod(F.monotonically_increasing_id(), F.lit(WAYS)).alias("__way"))
    once = _merged(some.groupBy(*keys, "__way").agg(F.collect_list("sketch").alias("sketch")).drop("__way"), keys)
    return _merged(once.groupBy(*keys).agg(F.collect_list("sketch").alias("sketch")), keys).withColumn("n", _count(F.col("sketch"))).select(*keys, "n", "sketch")


@F.pandas_udf(T.LongType())
def _count(sketch: pd.Series) -> pd.Series:
    return sketch.map(lambda s: int(unpacked(bytes(s))[1].sum()))


def _merged(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    @F.pandas_udf(T.BinaryType())
    def folded(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: merged([bytes(x) for x in p]))

    return rows.select(*keys, folded("sketch").alias("sketch"))


def read(sketches: DataFrame, shares: dict[str, float], accuracy: float = ACCURACY) -> DataFrame:
    """sketches without the binary column and with a column for each named quantile."""
    out = sketches
    for name, q in shares.items():
        out = out.withColumn(name, _quantile_of(q, accuracy)(F.col("sketch")))
    return out.drop("sketch")


def _quantile_of(q: float, accuracy: float) -> Callable[[Column], Column]:
    @F.pandas_udf(T.DoubleType())
    def of(sketch: pd.Series) -> pd.Series:
        return sketch.map(lambda s: quantile(bytes(s), q, accuracy))

    return of


def distinct_sketches(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys..., sketch): stored sketches of distinct values, by Spark's own two-phase aggregate."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(value, 12).alias("sketch"))


def distinct_counts(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n_distinct) of stored sketches by a coarser key; off by some 2 per cent."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"))
