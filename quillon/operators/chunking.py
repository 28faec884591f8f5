"""Chunks of documents: overlapping pieces that end at paragraphs, sentences or words. A document's chunks depend on each other, so each is cut in one task."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import text


class Sizes(NamedTuple):
    """Characters: the aim, how far from it an end may lie, the overlap, and the least of a chunk."""

    target: int = 1200
    variance: int = 100
    overlap: int = 200
    least: int = 500


#: Texts that are cut at once: their chunks are all that a worker holds beside its batch.
TEXTS = 64
_BREAKS = [re.compile(r"\n\s*\n"), re.compile(r"[.!?]+\s+"), re.compile(r"\s+")]


def cut(content: str, sizes: Sizes) -> list[tuple[int, int]]:
    """(start, end) of the chunks of cleaned text; pieces under the least size are dropped."""
    ends = [[m.end() for m in b.finditer(content)] for b in _BREAKS]
    out: list[tuple[int, int]] = []
    at, n = 0, len(content)
    while at < n:
        start = max(0, at - sizes.overlap) if out else 0
        end = _end(ends, start, n, sizes)
        if end <= at:
            end = min(n, at + sizes.target)
        if len(content[start:end].strip()) >= sizes.least:
            out.append((start, end))
        at = end
    return out


def _end(ends: list[list[int]], start: int, n: int, sizes: Sizes) -> int:
    """After the first break from the target on, else the last before it; paragraphs go before sentences, those before words."""
    target = start + sizes.target
    low, high = target - sizes.variance, min(target + sizes.variance, n)
    if high >= n - sizes.least:
        return n
    for kind in ends:
        k = bisect_left(kind, target)
        if k < len(kind) and kind[k] <= high:
            return kind[k]
        if k and kind[k - 1] >= low:
            return kind[k - 1]
    return target


def chunk_documents(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(doc_id, chunk_index, start_char, end_char, total_chunks, content) of docs (doc_id, text). Short and null texts have no chunks."""
    cleaned = docs.select("doc_id", text.clean_text(F.col("text")).alias("content")).where(F.length("content") >= sizes.least)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.IntegerType()) for c in ("chunk_index", "start_char", "end_char", "total_chunks")), T.StructField("content", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                some = batch.slice(at, TEXTS)
                rows = []
                for r, content in enumerate(some.column("content").to_pylist()):
                    spans = cut(content, sizes)
                    rows += [(r, k, a, b, len(spans), content[a:b].strip()) for k, (a, b) in enumerate(spans)]
                owners, *numbers, contents = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(pa.array(owners, pa.int64())), *(pa.array(n, pa.int32()) for n in numbers), pa.array(contents, pa.string())], names=schema.names)

    return cleaned.mapInArrow(run, schema)


def fixed_pages(docs: DataFrame, size: int = 3000, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, page, text, and the columns to keep): pages of so many characters, from 1."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    return docs.where(F.length("text") > 0).select("doc_id", "text", *keep, F.posexplode(starts).alias("k", "start")).select("doc_id", (F.col("k") + 1).alias("page"), F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"), *keep)
