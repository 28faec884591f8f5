"""Evidence: exhibits and citations rolled up, evidence ranked for sections, relevant facts by shared words, outlines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import legal, text
from quillon.operators.retrieval import Best


def exhibit_index(docs: DataFrame) -> DataFrame:
    """(exhibit_id, documents, mentions, first_document) over docs (id, content)."""
    marks = docs.select("id", F.explode(F.regexp_extract_all("content", F.lit(legal.EXHIBIT), F.lit(1))).alias("mark")).select("id", F.concat(F.lit("EX_"), F.upper("mark")).alias("exhibit_id"))
    return marks.groupBy("exhibit_id").agg(F.count_distinct("id").alias("documents"), F.count(F.lit(1)).alias("mentions"), F.min("id").alias("first_document"))


def citation_index(sections: DataFrame) -> DataFrame:
    """(citation, sections, first_section) over sections (section_id, content): counts instead of lists, which a common citation would make long."""
    cited = sections.select("section_id", F.explode(legal.motion_citations(F.col("content"))).alias("citation"))
    return cited.groupBy("citation").agg(F.count_distinct("section_id").alias("sections"), F.min("section_id").alias("first_section"))


def testimony(docs: DataFrame) -> DataFrame:
    """A row for each short deposition citation of docs (id, content), with its usual form."""
    cited = docs.select("id", F.posexplode(legal.depositions(F.col("content"))).alias("n", "d")).select("id", "n", "d.*")
    return cited.withColumn("citation", legal.deposition_citation(F.col("deponent"), F.col("page"), F.col("line"), F.col("line_end")))


def best_for_sections(scored: DataFrame, k: int = 10, least: float = 0.0) -> DataFrame:
    """The k best of scored (section_id, evidence_id, score) for each section, ties by id."""
    nth = F.row_number().over(Window.partitionBy("section_id").orderBy(F.desc("score"), "evidence_id"))
    return scored.where(F.col("score") >= least).withColumn("nth", nth).where(F.col("nth") <= k)


#: Points that tasks hold at once.
POINTS = 4096


def shared_words(points: DataFrame, facts: DataFrame, k: int = 5, longer_than: int = 4, most_documents: int | None = None) -> DataFrame:
    """(point_id, fact_id, shared): the k facts that share most words of some length with each point, ties by id; facts without a shared word are absent.

    points are a stated set: their different sets of words are held by the tasks, POINTS at a time, as lists by word, so that a word that all
    facts hold makes no rows under one key; a task passes on k rows a set. Facts of one set of words share as much with any point, so only the
    k least ids of a set in a batch are compared. Words that more than most_documents facts hold can be left out.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > longer_than))
    key = F.array_join(F.array_sort("words"), " ").alias("words")
    asked = points.select("point_id", words(F.col("content")).alias("words")).select("point_id", key)
    held = facts.select("fact_id", words(F.col("content")).alias("words"))
    if most_documents is not None:
        common = held.select("fact_id", F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most_documents).select("word")
        held = held.select("fact_id", F.explode("words").alias("word")).join(common, "word", "left_semi").groupBy("fact_id").agg(F.collect_list("word").alias("words"))
    held = held.select("fact_id", key)
    schema = T.StructType([T.StructField("words", T.StringType()), facts.schema["fact_id"], T.StructField("shared", T.LongType())])
    out = None
    for block in _blocks(asked.where("words <> ''").select("words").distinct()):
        by_word: dict[str, list[int]] = {}
        for i, r in enumerate(block):
            for w in r.words.split(" "):
                by_word.setdefault(w, []).append(i)
        lists = {w: np.array(v) for w, v in by_word.items()}
        part = held.mapInArrow(_most_shared(points.sparkSession.sparkContext.broadcast(([r.words for r in block], lists)), k), schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return points.sparkSession.createDataFrame([], T.StructType([points.schema["point_id"], *schema.fields[1:]]))
    nth = F.row_number().over(Window.partitionBy("words").orderBy(F.desc("shared"), "fact_id"))
    return asked.join(out.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth"), "words").drop("words")


def _blocks(asked: DataFrame) -> Iterator[list[Row]]:
    """Rows by POINTS; they come to the driver a partition at a time."""
    held: list[Row] = []
    for row in asked.toLocalIterator():
        held.append(row)
        if len(held) == POINTS:
            yield held
            held = []
    if held:
        yield held


def _most_shared(held: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: the k facts of a task that share most words with each held set of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, lists = held.value
        best = Best(len(names), k)
        for batch in batches:
            coded = batch.column("words").dictionary_encode()
            code, ids = coded.indices.to_numpy(), batch.column("fact_id").to_numpy()
            order = np.lexsort((ids, code))
            code, ids = code[order], ids[order]
            few = np.arange(len(code)) - np.searchsorted(code, code) < k
            code, ids, sets = code[few], ids[few], coded.dictionary.to_pylist()
            for part in best.slices(len(sets)):
                counts = np.full((len(names), part.stop - part.start), -np.inf)
                for j, words in enumerate(sets[part]):
                    met = [lists[w] for w in words.split(" ") if w in lists]
                    if met:
                        n = np.bincount(np.concatenate(met), minlength=len(names))
                        counts[n > 0, j] = n[n > 0]
                mine = slice(*np.searchsorted(code, (part.start, part.stop)))
                for some in best.slices(mine.stop - mine.start):
                    at = slice(mine.start + some.start, mine.start + some.stop)
                    best.add(ids[at], counts[:, code[at] - part.start])
        query, ids, shared = best.rows()
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in query]), pa.array(ids), pa.array(shared.astype(np.int64))], names=["words", "fact_id", "shared"])

    return run


def running_context(sections: DataFrame) -> DataFrame:
    """For each section (motion_id, ordinal, tokens, content) the tokens before it, and whether it comes before one of earlier kind."""
    before = Window.partitionBy("motion_id").orderBy("ordinal")
    return sections.select("motion_id", "ordinal", F.coalesce(F.sum("tokens").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tokens_before"), legal.section_type(F.col("title")).alias("section_type"))


def subpart_of(lines: DataFrame) -> DataFrame:
    """lines (doc_id, line, content) with the last subpart heading above each."""
    heading = F.when(F.col("content").rlike(r"^Subpart [A-Z]"), F.regexp_extract("content", r"^Subpart ([A-Z])", 1))
    above = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("subpart", F.last(heading, ignorenulls=True).over(above))


def key_facts(docs: DataFrame) -> DataFrame:
    """docs (id, content) with counts of dates, citations and money and the confidence that they give a fact."""
    n = lambda p: F.size(text.found(F.col("content"), p))
    counted = docs.select("id", n(text.DATE).alias("dates"), n(text.MONEY).alias("money"), n(text.CITATION).alias("citations"))
    return counted.withColumn("confidence", legal.fact_confidence(F.col("dates"), F.col("money"), F.col("citations")))
