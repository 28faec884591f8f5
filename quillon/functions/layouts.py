"""Hashes of how a page is laid out, whatever its words: boxes of blocks, lines of words, lengths of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Points that a line's height is rounded to, and lines of a page that count where only text is known.
LINE_STEP, FIRST_LINES = 10, 20


def _digest(parts: Column) -> Column:
    """Eight hex digits of boxes in canonical order."""
    return F.substring(F.md5(F.array_join(F.array_sort(parts), "|")), 1, 8)


def _whole(x: Column) -> Column:
    """Towards zero."""
    return x.cast("long").cast("string")


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.concat_ws(":", _whole(x), _whole(y), _whole(width), _whole(height))


def block_hash(blocks: Column) -> Column:
    """Of an array of (kind, x0, y0, x1, y1): text blocks (kind 0) in any order; others don't count. A null array is an empty one."""
    text = F.filter(F.coalesce(blocks, F.array().cast("array<struct<kind:int,x0:double,y0:double,x1:double,y1:double>>")), lambda b: b["kind"] == 0)
    return _digest(F.transform(text, lambda b: _box(b["x0"], b["y0"], b["x1"] - b["x0"], b["y1"] - b["y0"])))


def word_lines_hash(words: DataFrame, *page: str) -> DataFrame:
    """(page..., layout) of words (page..., x0, x1, top, bottom): words whose tops round to one line make its box; two partial groupings, no page is collected."""
    line = F.bround(F.col("top") / LINE_STEP, 0) * LINE_STEP
    boxes = words.groupBy(*page, line.alias("line")).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.avg(F.col("bottom") - F.col("top")).alias("height"))
    box = _box(F.col("x0"), F.col("line"), F.col("x1") - F.col("x0"), F.col("height"))
    return boxes.groupBy(*page).agg(_digest(F.collect_list(box)).alias("layout"))


def text_hash(text: Column) -> Column:
    """Where only the text is known: the places and lengths of the first lines that aren't blank."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, FIRST_LINES)
    placed = F.transform(lines, lambda line, i: F.when(F.trim(line) != "", F.concat(F.lit("0:"), (i * 20).cast("string"), F.lit(":"), (F.length(line) * 10).cast("string"), F.lit(":12"))))
    return _digest(F.filter(placed, lambda p: p.isNotNull()))


def runs(pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, run, first_page, last_page, n_pages, layout) of pages (key, page, layout): neighbouring pages of one layout, numbered from 1."""
    order = Window.partitionBy(key).orderBy("page")
    changed = (~F.col("layout").eqNullSafe(F.lag("layout").over(order)) | (F.row_number().over(order) == 1)).cast("int")
    numbered = pages.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.count(F.lit(1)).alias("n_pages"), F.first("layout").alias("layout"))
