"""Benchmark decontamination with Spark expressions: probe a set of the items' n-grams with every window of every document, verify, cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import let, lower_ascii, row_hash

#: Characters that part words: ASCII but for letters and digits (upper case is lowered word by word).
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Windows of the benchmark up to which they are broadcast (some 100 MB at most); beyond it both sides are dealt by the windows' hash.
BROADCAST_WINDOWS = 500_000


def _lowered(word: Column) -> Column:
    """lower_ascii of a word, by the fast lower() where that does the same."""
    fast = F.lower(word)
    return F.when(fast == word, word).when(F.octet_length(word) == F.length(word), fast).otherwise(lower_ascii(word))


def normal_words(text: Column) -> Column:
    given = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(given) == F.length(given)
    inner = lambda parts: F.when(F.size(parts) == 1, F.filter(parts, lambda w: w != "")).otherwise(F.slice(parts, F.when(parts[0] == "", 2).otherwise(1), F.size(parts) - (parts[0] == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")))
    cut = lambda t: let(F.split(t, f"{NO_WORD}+", -1), inner)
    return F.when(ascii_only, cut(F.lower(given))).otherwise(F.transform(cut(given), _lowered))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """(key, window, items): the distinct windows of n words of benchmark (item_id, text), with the items that hold each; a shorter item is one window."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), normal_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    windows = words.select("item", "w", starts.alias("at")).select("item", F.slice("w", F.col("at"), n).alias("window"))
    return windows.groupBy("window").agg(F.collect_set("item").alias("items")).select(F.xxhash64("window").alias("key"), "window", "items")


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, counts: bool = False) -> DataFrame:
    """(doc_id, row, spans, items, n_words) of the documents that hold a window, with counts of all documents: spans as sorted (first word,
    words), the items as sorted strings.

    row is row_hash of the text: rows alike in doc_id and text share a result. Bounded by one text's length a group, whatever the benchmark.
    """
    windows = benchmark_windows(benchmark, n)
    facts = windows.agg(F.count(F.lit(1)), F.collect_set(F.size("window"))).first()  # sizes: n distinct ones at most
    lengths = sorted(facts[1], reverse=True) or [n]
    probe = F.broadcast(windows) if facts[0] <= BROADCAST_WINDOWS else windows
    words = docs.select("doc_id", row_hash(F.col("text").cast("string")).alias("row"), normal_words(F.col("text")).alias("words"))
    at = words.select("doc_id", "row", "words", F.posexplode_outer("words").alias("at", "word"))
    if len(lengths) > 1:  # short items have windows of their own lengths
        at = at.select("doc_id", "row", "words", "at", F.explode(F.array(*map(F.lit, lengths))).alias("len"))
    else:
        at = at.select("doc_id", "row", "words", "at", F.lit(lengths[0]).alias("len"))
    seen = F.slice("words", F.col("at") + 1, F.col("len"))
    inside = F.col("at") + F.col("len") <= F.size("words")
    head = (F.coalesce("at", F.lit(0)) == 0) & (F.col("len") == lengths[0])  # one row a document, which carries its count
    keyed = at.where(inside | head if counts else inside).select("doc_id", "row", "at", "len", F.size("words").alias("n_words"), head.alias("head"), seen.alias("seen"), F.xxhash64(seen).alias("key"))
    hits = keyed.join(probe, "key", "left" if counts else "inner")
    hit = F.coalesce(F.col("seen") == F.col("window"), F.lit(False)) & inside_of("at", "len", "n_words")
    hits = hits.where(hit | F.col("head") if counts else hit)
    span = F.when(hit, F.struct(F.col("at").alias("at"), F.col("len").alias("len")))
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items"))))))
    return hits.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set(span)).alias("spans"), flat.alias("items"), F.max("n_words").alias("n_words"), F.sum(F.col("head").cast("int")).alias("heads"))


def inside_of(at: str, length: str, n_words: str) -> Column:
    return F.coalesce(F.col(at) + F.col(length) <= F.col(n_words), F.lit(False))


def covered(spans: Column) -> Column:
    """Words in the union of sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        end = s["at"] + s["len"]
        return F.struct(F.greatest(a["end"], end).alias("end"), (a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["at"]))).alias("n"))

    return F.aggregate(spans, start, step, lambda a: a["n"])


def _joined(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """keyed (doc_id, __key) with __spans and __items, null where nothing is hit; null doc_ids are matched too."""
    own = hits.select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("spans").alias("__spans"), F.col("items").alias("__items"))
    return keyed.join(own, (F.col("__key") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")


def with_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """docs with __spans and __items."""
    taken = [c for c in docs.columns if c in ("__key", "__id", "__row", "__spans", "__items")]
    if taken:
        raise ValueError(f"columns named {taken} must be renamed first")
    keyed = docs.withColumn("__key", row_hash(F.col("text").cast("string")))
    return _joined(keyed, find_hits(docs.select("doc_id", "text"), benchmark, n)).select(*docs.columns, "__spans", "__items")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside an occurring window), n_items, items (sorted), contaminated.

    Null and blank texts have no words; an item without words matches nothing; an empty benchmark hits nothing; repeated rows get equal results.
    """
    found = find_hits(docs.select("doc_id", "text"), benchmark, n, counts=True)
    n_hit = covered(F.col("spans")).cast("long")
    one = F.explode(F.array_repeat(F.lit(1), F.greatest(F.col("heads"), F.lit(1)).cast("int")))  # repeated rows met in one group: a row each again
    out = found.select("doc_id", F.greatest("n_words", F.lit(0)).cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "items", (n_hit > 0).alias("contaminated"), one.alias("__one"))
    return out.drop("__one")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, remove: str = "documents") -> DataFrame:
    """docs without contaminated documents (remove="documents"), or with the hit words and what parts them cut out of the text (remove="spans").

    Columns are those of docs; other rows are left as they are.
    """
    joined = with_hits(docs, benchmark, n)
    if remove == "documents":
        return joined.where(F.col("__spans").isNull()).select(*docs.columns)
    word = f"{WORD}+"
    text = F.col("text").cast("string")

    def cut(words: Column, gaps: Column) -> Column:
        inside = lambda i: F.exists("__spans", lambda s: (s["at"] <= i) & (i < s["at"] + s["len"]))
        return F.concat(gaps[0], F.array_join(F.transform(words, lambda w, i: F.when(inside(i), F.lit("")).otherwise(F.concat(w, F.element_at(gaps, i + 2)))), ""))

    rest = let(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: let(F.split(text, word, -1), lambda g: cut(w, g)))
    return joined.select(*(F.when(F.col("__spans").isNull(), F.col("text")).otherwise(rest).alias("text") if c == "text" else F.col(c) for c in docs.columns))
