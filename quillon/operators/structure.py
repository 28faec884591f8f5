"""Structure of texts and chunks that follow it: typed spans, packing of elements, merging of small pieces and splitting of large ones.

A text's pieces depend on each other, so a text is cut in one task by one walk from left to right; all offsets are code points of the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The patterns that decide what a span is.
HEADER = re.compile(r"#+\s+.*|[A-Z][A-Z\s]+")  # of a whole line
LIST_ITEM = re.compile(r"\s*\w\.\s+|\s*[•\-*]\s+")  # at a line's start
CITATION = re.compile(r"\b\d+\s+\w+\.?\s+\d+|\b\w+\s+v\.\s+\w+|\b\d+\s+F\.\s*\d*d?\s+\d+")
#: CITATION without the form of names with a v. between them; it begins with a digit, so that the search runs from digit to digit.
NUMBERED = re.compile(r"\d(?<=\b\d)\d*(?:\s+\w+\.?\s+\d+|\s+F\.\s*\d*d?\s+\d+)")
SENTENCE_END = re.compile(r"[.!?]+\s+")
TABLE, QUOTE, FOOTNOTE = re.compile(r"\|\s*\w+\s*\||\+-+\+"), re.compile(r'"[^"]*"'), re.compile(r"\[\d+\]|\(\d+\)")
PROCEDURAL = re.compile(r"\b(?:WHEREAS|WHEREFORE|ORDERED|ADJUDGED)\b", re.IGNORECASE)
ACTORS = ["therefore", "whereas", "plaintiff", "defendant"]
SPEECH = [("fact_statement", ["facts", "evidence", "testified"]), ("argument", ["argue", "contend", "assert"]), ("conclusion", ["conclusion", "ruling", "finding"])]


class Span(NamedTuple):
    kind: str
    start: int
    end: int


class Limits(NamedTuple):
    """Characters: what a chunk aims at, the overlap, and the least and the most of a finished piece."""

    target: int = 1200
    overlap: int = 200
    least: int = 100
    most: int = 2000


def elements(text: str) -> list[Span]:
    """Headers, list items and paragraphs, in order, without overlap: every character that is not white space is in one.

    Blank lines part paragraphs. A line that is a header stands alone; a line that begins like a list item begins an item, which goes on until the
    next item, header or blank line.
    """
    out: list[Span] = []
    kind, start, end, at = "", 0, 0, 0
    for line in text.split("\n"):
        left, right = at + len(line) - len(line.lstrip()), at + len(line.rstrip())
        at += len(line) + 1
        blank = left >= right
        new = "" if blank else "header" if HEADER.fullmatch(line.rstrip()) else "list_item" if LIST_ITEM.match(line) else "paragraph"
        if kind and (blank or new in ("header", "list_item") or kind == "header"):
            out.append(Span(kind, start, end))
            kind = ""
        if not blank:
            if not kind:
                kind, start = new, left
            end = right
    if kind:
        out.append(Span(kind, start, end))
    return out


def cited(text: str) -> list[Span]:
    """Citations, by start."""
    return [Span("citation", m.start(), m.end()) for m in _citations_in(text).finditer(text)]


def _citations_in(text: str) -> re.Pattern[str]:
    """CITATION, without the form of case names where nothing can be one: that form is tried at each word."""
    return CITATION if "v." in text else NUMBERED


def spans(text: str) -> list[Span]:
    """elements, and the citations inside of them, by start."""
    return sorted([*elements(text), *cited(text)], key=lambda s: (s.start, -s.end, s.kind))


def chunk_kind(content: str) -> str:
    """What a chunk is, by the first rule that holds."""
    for kind, pattern in (("legal_citation", CITATION), ("procedural", PROCEDURAL)):
        if pattern.search(content):
            return kind
    lines = content.split("\n")
    if HEADER.fullmatch(lines[0]):
        return "header"
    if any(LIST_ITEM.match(line) for line in lines):
        return "list_item"
    for kind, pattern in (("table", TABLE), ("quote", QUOTE), ("footnote", FOOTNOTE)):
        if pattern.search(content):
            return kind
    low = content.lower()
    if any(w in low for w in ACTORS):
        for kind, words in SPEECH:
            if any(w in low for w in words):
                return kind
    return "paragraph"


def packed(text: str, parts: list[Span], limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Chunks of neighbouring elements: one ends before the element that would take it over the target; the next one begins overlap characters before that end."""
    out: list[tuple[int, int]] = []
    start = end = -1
    for part in parts:
        if start >= 0 and part.end - start > limits.target and end > start:
            out.append((start, end))
            start = max(start + 1, end - limits.overlap)
        elif start < 0:
            start = part.start
        end = part.end
    if start >= 0:
        out.append((start, end))
    return out


def optimised(text: str, chunks: list[tuple[int, int]], limits: Limits = Limits()) -> list[tuple[int, int]]:
    """A chunk with under limits.least characters of its own goes to the one before, if both are within limits.most; one over it is split. One pass; no piece is over limits.most."""
    out: list[tuple[int, int]] = []
    for start, end in chunks:
        seen = out[-1][1] if out else start
        if out and end - max(start, seen) < limits.least and end - out[-1][0] <= limits.most:
            out[-1] = (out[-1][0], end)
        elif end - start > limits.most:
            out += split(text, start, end, limits)
        else:
            out.append((start, end))
    return out


def split(text: str, start: int, end: int, limits: Limits = Limits()) -> list[tuple[int, int]]:
    """Sentences of a large chunk packed up to the target, with overlap; a sentence over the target is cut at white space, or where there is none at the target."""
    ends = [m.end() for m in SENTENCE_END.finditer(text, start, end)]
    if not ends or ends[-1] < end:
        ends.append(end)
    stops: list[int] = []
    at = start
    for stop in ends:
        while stop - at > limits.target:
            space = max(text.rfind(" ", at + 1, at + limits.target), text.rfind("\n", at + 1, at + limits.target))
            at = space + 1 if space > at else at + limits.target
            stops.append(at)
        at = stop
        stops.append(stop)
    out: list[tuple[int, int]] = []
    begin = last = start
    for stop in stops:
        if stop - begin > limits.target and last > begin:
            out.append((begin, last))
            begin = max(begin + 1, last - limits.overlap)
            if stop - begin > limits.most:
                begin = last
        last = stop
    out.append((begin, last))
    return out


def _rows(docs: DataFrame, columns: list[T.StructField], make: Callable[[str], list[tuple]]) -> DataFrame:
    """make's rows for each text, after the document's id, a few texts at a time."""
    schema = T.StructType([docs.schema["doc_id"], *columns])
    arrow = [{T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}[f.dataType] for f in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                made = [make(t) if t else [] for t in some.column("text").to_pylist()]
                owners = pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64())
                flat = [row for rows in made for row in rows]
                arrays = [pa.array([row[k] for row in flat], kind) for k, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").take(owners), *arrays], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


def structure_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start_char, end_char, content) of the typed spans of docs (doc_id, text). Null and blank texts have none."""
    return _spans_of(docs, spans)


def citations(docs: DataFrame) -> DataFrame:
    """The rows of structure_spans whose kind is citation, without looking for others."""
    return _spans_of(docs, cited)


def _spans_of(docs: DataFrame, find: Callable[[str], list[Span]]) -> DataFrame:
    columns = [_field("kind", T.StringType()), _field("start_char", T.LongType()), _field("end_char", T.LongType()), _field("content", T.StringType())]
    return _rows(docs, columns, lambda t: [(s.kind, s.start, s.end, t[s.start : s.end]) for s in find(t)])


def semantic_chunks(docs: DataFrame, limits: Limits = Limits(), optimise: bool = True) -> DataFrame:
    """(doc_id, chunk_index, start_char, end_char, kind, n_elements, n_citations, content): elements packed into chunks, and with optimise their ends put right.

    Chunks cover all of a text but white space, their starts and ends rise, and content is the text from start to end: what overlaps stands in both.
    n_elements and n_citations count those that begin in what is the chunk's own. A blank or null text has no chunks.
    """
    columns = [_field("chunk_index", T.IntegerType()), _field("start_char", T.LongType()), _field("end_char", T.LongType()), _field("kind", T.StringType()), _field("n_elements", T.LongType()), _field("n_citations", T.LongType()), _field("content", T.StringType())]

    def make(text: str) -> list[tuple]:
        parts = elements(text)
        chunks = packed(text, parts, limits)
        if optimise:
            chunks = optimised(text, chunks, limits)
        marks = [sorted(s.start for s in parts), [m.start() for m in CITATION.finditer(text)]]
        at, rows = [0, 0], []
        for k, (start, end) in enumerate(chunks):
            counts = []
            for j, starts in enumerate(marks):
                first = at[j]
                while at[j] < len(starts) and starts[at[j]] < end:
                    at[j] += 1
                counts.append(at[j] - first)
            rows.append((k, start, end, chunk_kind(text[start:end].strip()), *counts, text[start:end]))
        return rows

    return _rows(docs, columns, make)
