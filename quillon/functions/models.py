"""External models behind small interfaces, each with a deterministic default that runs anywhere."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text, vectors
from quillon.operators import retrieval


class Embedder(Protocol):
    """Turns a batch of texts into vectors of one dimension; a text without content has no vector."""

    dimension: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Signed hashes of words, scaled to length 1: a default that needs no model and is the same everywhere."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float64)
        for row, content in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", content.lower()):
                digest = hashlib.md5(word.encode()).digest()
                row[int.from_bytes(digest[:4], "big") % self.dimension] += 1 if digest[4] & 1 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)


def embed(rows: DataFrame, content: str, embedder: Embedder, into: str = "vector", batch: int = 100) -> DataFrame:
    """rows with a vector of each text's content, batch by batch; null for blank text."""

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            out: list[list[float] | None] = [None] * len(texts)
            full = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            for k in range(0, len(full), batch):
                some = full[k : k + batch]
                for i, v in zip(some, embedder([texts.iloc[i] for i in some]), strict=True):
                    out[i] = v.tolist()
            yield pd.Series(out)

    return rows.withColumn(into, F.pandas_udf(run, "array<double>")(F.col(content)))


def with_context(rows: DataFrame, content: str, describe: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with the text to embed: a context, by default the first sentence, above the content."""
    make = describe or (lambda c: F.regexp_extract(c, r"^\s*([^.!?]{1,300}[.!?]?)", 1))
    given = make(F.col(content))
    usable = (F.length(given) >= 10) & ~F.lower(given).rlike("i cannot|i can't|unable to|as an ai")
    return rows.withColumn("embedding_text", F.when(usable, F.concat_ws("\n---\n", given, content)).otherwise(F.col(content)))


def classify(rows: DataFrame, content: str, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with document_type: what the patterns say goes before the model's answer."""
    guess = model(F.col(content)) if model else F.lit("other")
    return rows.withColumn("document_type", F.coalesce(text.document_type(F.col(content)), guess))


def rerank(results: DataFrame, query: list[float], top_n: int = 4, scorer: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """The top_n of few results (id, vector, ...) by another score; by default the clamped cosine."""
    score = scorer(results) if scorer else vectors.clamped_cosine(F.col("vector"), F.lit([float(x) for x in query]))
    return results.withColumn("rerank_score", score).orderBy(F.desc("rerank_score"), "id").limit(top_n)


def facts(docs: DataFrame, most: int = 10) -> DataFrame:
    """(id, n, fact): sentences of 20 to 400 characters, the first most of each text; a default where no model mines facts."""
    sentences = F.filter(F.split("content", r"(?<=[.!?])\s+"), lambda s: F.length(s).between(20, 400))
    return docs.select("id", F.posexplode(F.slice(sentences, 1, most)).alias("n", "fact"))


def search(docs: DataFrame, question: str, embedder: Embedder, k: int = 4) -> DataFrame:
    """Hybrid search end to end: embed, take the dense and the sparse list, fuse by rank, keep k with their ranks."""
    embedded = embed(docs, "content", embedder)
    asked = docs.sparkSession.createDataFrame([(0, question)], "id long, content string")
    vector = embedder([question])[0].tolist()
    dense = retrieval.dense_topk(embedded.where(F.col("vector").isNotNull()), vector, 20).select("id", "score")
    sparse = retrieval.sparse_topk(retrieval.sparse_vectors(docs), retrieval.sparse_vectors(asked), 20)
    return retrieval.rrf({"dense": dense, "sparse": sparse}).where(F.col("rrf_rank") <= k)
