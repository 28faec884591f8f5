"""Entities of texts: candidate spans of several patterns and of a model, resolved by precedence, normalised, and unified over a corpus."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Roles, words and patterns that decide what an entity is.
ROLES = "Plaintiff|Defendant|Petitioner|Respondent|Appellant|Appellee|Claimant"
_NAME = r"[A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*"
DATES = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b|(?i:\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2},?\s+\d{4}\b)"
PATTERNS = [  # in falling precedence; the named group is the entity
    ("date", rf"(?P<e>{DATES})"),
    ("monetary_amount", r"(?P<e>\$[\d,]+(?:\.\d{2})?|\b\d+\s*(?i:dollars?)\b)"),
    ("legal_citation", r"(?P<e>(?:Fla\.\s*Stat\.|F\.S\.)\s*§?\s*[\d.]+|\b\d+\s+C\.F\.R\.\s*§?\s*[\d.]+)"),
    ("person", rf"\b(?:{ROLES})\s+(?P<e>{_NAME})\b"),
    ("person", rf"\b(?P<e>{_NAME}),?\s+(?:the\s+)?(?:{ROLES})\b"),
    ("vehicle", r"(?i)(?P<e>\b\d{4}\s+[^\W\d]\w*\s+[^\W\d]\w*\b|\b(?:car|truck|vehicle|trailer|semi)\b)"),
    ("medical_condition", r"(?i)\b(?P<e>diagnosis|injury|treatment|surgery|fracture|trauma|condition)\b"),
]
_COMPILED = [(kind, re.compile(pattern)) for kind, pattern in PATTERNS]
_ROLE = re.compile(rf"(?:{ROLES})\b", re.IGNORECASE)


class Entity(NamedTuple):
    kind: str
    start: int
    end: int


class Recogniser(Protocol):
    """A model of names: for each text of a batch its entities, which give way to all patterns'."""

    def __call__(self, texts: list[str]) -> list[list[Entity]]: ...


class SuffixRecogniser:
    """Organisations by their legal form and places after a preposition: a default that needs no model and is the same everywhere."""

    _FORMS = [("organization", re.compile(rf"\b(?P<e>{_NAME},?\s+(?:Inc|LLC|LLP|Corp|Corporation|Company|Co|Ltd)\b\.?)")), ("location", re.compile(r"\b(?:in|near|of)\s+(?P<e>[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,\s+[A-Z][A-Za-z]+)\b"))]

    def __call__(self, texts: list[str]) -> list[list[Entity]]:
        return [[Entity(kind, *m.span("e")) for kind, p in self._FORMS for m in p.finditer(t)] for t in texts]


def candidates(text: str) -> list[list[Entity]]:
    """What each pattern finds. Names in capitals alone, and names that begin with a role, are no persons' names."""
    out = []
    for kind, pattern in _COMPILED:
        found = [Entity(kind, *m.span("e")) for m in pattern.finditer(text)]
        if kind == "person":
            found = [e for e in found if not text[e.start : e.end].isupper() and not _ROLE.match(text, e.start)]
        out.append(found)
    return out


def resolved(length: int, ranked: list[list[Entity]]) -> list[Entity]:
    """Entities that don't overlap, by start: lists go first to last, and within a list the earlier, then the longer one wins."""
    taken = bytearray(length)
    kept: list[Entity] = []
    for group in ranked:
        for e in sorted(group, key=lambda e: (e.start, -e.end)):
            if e.start < e.end and taken.find(1, e.start, e.end) < 0:
                taken[e.start : e.end] = b"\1" * (e.end - e.start)
                kept.append(e)
    return sorted(kept, key=lambda e: e.start)


def entities(docs: DataFrame, recogniser: Recogniser | None = None) -> DataFrame:
    """(doc_id, kind, start_char, end_char, entity, name) of docs (doc_id, text): what patterns and the recogniser find, without overlap. Null texts have none."""
    model = recogniser or SuffixRecogniser()
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("kind string, start_char int, end_char int, entity string").fields])
    return docs.select("doc_id", "text").mapInArrow(_finder(model), schema).withColumn("name", normalised(F.col("entity"), F.col("kind")))


def _finder(model: Recogniser) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column("text").to_pylist()]
                found = [resolved(len(t), [*candidates(t), more]) for t, more in zip(texts, model(texts), strict=True)]
                owner = pa.array([i for i, es in enumerate(found) for _ in es], pa.int64())
                flat = [(e, t[e.start : e.end]) for t, es in zip(texts, found, strict=True) for e in es]
                arrays = [pa.array([e.kind for e, _ in flat], pa.string()), pa.array([e.start for e, _ in flat], pa.int32()), pa.array([e.end for e, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.string())]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(owner), *arrays], names=["doc_id", "kind", "start_char", "end_char", "entity"])

    return run


def normalised(entity: Column, kind: Column) -> Column:
    """The name under which spellings meet: lower case, single spaces, no marks at the ends; amounts without $ and commas and with two places."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(entity)), r"\s+", " "), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    amount = F.regexp_replace(F.regexp_replace(plain, r"[$,]|\s*dollars?", ""), r"^(\d+)$", "$1.00")
    return F.when(kind == "monetary_amount", amount).otherwise(plain)


def registry(found: DataFrame) -> DataFrame:
    """(kind, name, shown, mentions, documents, spellings): one row for each entity of a corpus.

    shown is the spelling with most mentions, the least of several. Counts come from one row for each document and spelling, so a name that
    all documents have is summed by tasks before it is dealt; counts of documents are kept apart by a second grouping, not collected.
    """
    one = found.groupBy("kind", "name", "entity", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    spelt = one.groupBy("kind", "name", "entity").agg(F.sum("n").alias("n"))
    shown = spelt.groupBy("kind", "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "entity"))["entity"].alias("shown"), F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("spellings"))
    holders = one.groupBy("kind", "name", "doc_id").agg(F.lit(1).alias("one")).groupBy("kind", "name").agg(F.count(F.lit(1)).alias("documents"))
    return shown.join(holders, ["kind", "name"])
