"""Line-first quality rules as Spark expressions: drop failing lines, then reject documents that lose too much text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, let, settled, words_of

#: Words of a document below which it is rejected, and the share of repeated words (in per cent) beyond which it is.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Text that may be lost to line rules, in per cent of the characters in words.
MOST_LOST = 30
#: Fixed phrases of pages' furniture in English, German, French and Spanish. The first letters come first, so that few places are looked at.
BOILERPLATE = (
    r"(?i)\b(?=[acijlmprst])(?:cookie policy|privacy policy|terms of (?:use|service)|all rights reserved|javascript|subscribe to our newsletter|click here|sign in|log in|read more|share this|lorem ipsum"
    r"|alle rechte vorbehalten|impressum|tous droits r.serv.s|mentions l.gales|todos los derechos reservados|aviso legal|pol.tica de (?:privacidad|cookies))\b"
)
#: Words from which a line is a sentence and must end like one; the marks that end it, those that may follow them, and white space.
SENTENCE_WORDS, ENDS, CLOSES, BLANKS = 12, ".!?…:;。！？।؟", "\"'”’»)]", " \t\n\x0b\x0c\r"
#: Marks that part the entries of menus.
PARTS = "|›•·"


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that occurs twice or more among words.

    Windows are hashed and sorted with their places; equal neighbours repeat, and the union of their spans is summed in one fold.
    """
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(F.slice(words, i, 3)))

    def marked(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda x, k: F.try_element_at(s, k)["h"] == x["h"]
            hit = F.filter(s, lambda x, k: F.coalesce(F.when(k > 0, same(x, F.greatest(k, F.lit(1)))), F.lit(False)) | F.coalesce(same(x, k + 2), F.lit(False)))
            return F.sort_array(F.transform(hit, lambda x: x["i"]))

        spans = let(placed, places)
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct((p + 3).alias("end"), (a["n"] + F.least(F.lit(3), p + 3 - a["end"])).alias("n"))
        return F.aggregate(spans, start, step, lambda a: a["n"])

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(marked(h))))


def has_furniture(text: Column) -> Column:
    return text.rlike(BOILERPLATE) | F.contains(text, F.lit("©")) | (F.contains(F.lower(text), F.lit("(c) ")) & text.rlike(r"(?i)\(c\) (?:19|20)[0-9]{2}"))


def ends_well(line: Column) -> Column:
    """Whether a mark of ENDS, and after it only marks of CLOSES and white space, ends the line."""
    return let(F.rtrim(F.rtrim(line, F.lit(BLANKS)), F.lit(CLOSES)), lambda x: (x != "") & F.contains(F.lit(ENDS), F.right(x, F.lit(1))))


def line_passes(line: Column, has_ends: Column) -> Column:
    """A line is kept unless it is navigation (short entries parted by PARTS), marked up (symbols on most words), shouting, furniture (a fixed
    phrase in a short line), or words without an end: SENTENCE_WORDS words or more that no mark of punctuation ends, in a text that has such
    marks (has_ends).

    Lines without a word pass: there is nothing to lose.
    """
    chars = F.length(F.regexp_replace(line, f"{SPACE}+", ""))
    share = lambda pattern, per: per * F.regexp_count(line, F.lit(pattern)) > chars
    navigation = (F.regexp_count(line, F.lit(f"[{PARTS}]")) >= 3) & share(f"[{PARTS}]", 25)
    marked = share(r"[#*$%&<>]", 6)
    shouting = (F.regexp_count(line, F.lit("!")) >= 3) & share("!", 25) & ~line.rlike(r"\p{Ll}")
    furniture = has_furniture(line) & (chars < 200)
    endless = has_ends & ~ends_well(line) & (F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]++")) >= SENTENCE_WORDS)
    return (chars == 0) | ~(navigation | marked | shouting | furniture | endless)


def quality_table(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least_words: int = LEAST_WORDS) -> DataFrame:
    """keep's columns, the counts, kept and clean_text (the text without failing lines), for every row of docs (doc_id, text).

    Null text has no words and fails; so does any of fewer than least_words words, with over MOST_REPEATED per cent of its words in repeated
    3-word windows, or (the method's verdict) which loses over MOST_LOST per cent of its characters in words to line rules.
    """
    lines = F.split("__text", "\n", -1)
    base = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    split = base.select("*", words_of(F.col("__text")).alias("__words"), lines.alias("__lines"))
    size = lambda text: F.length(F.regexp_replace(text, f"{SPACE}+", ""))
    # no rule can fail a line: no sign of markup or menus, no phrase, and each line ends with a mark
    has_ends = F.col("__text").rlike(f"[{ENDS}][{CLOSES[:-1]}\\]]*(?:{SPACE}|\\z)")
    ended = F.forall("__lines", lambda x: F.contains(F.lit(ENDS), F.right(F.rtrim(x), F.lit(1))))
    plain = ~F.col("__text").rlike(f"[{PARTS}#*$%&<>!]") & ~has_furniture(F.col("__text")) & (ended | ~has_ends)
    with_word = F.filter("__lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        *keep,
        "__text",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.when(F.col("__text").rlike(r"[#*$%&|<>]"), F.regexp_count("__text", F.lit(r"[#*$%&|<>]"))).otherwise(0).cast("long").alias("n_symbols"),
        let(with_word, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
        F.when(plain, F.col("__text")).otherwise(F.array_join(let(has_ends, lambda e: F.filter("__lines", lambda x: line_passes(x, e))), "\n")).alias("clean_text"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    lost = F.when(F.length("clean_text") == F.length("__text"), F.lit(0)).otherwise(F.col("word_chars") - size(F.col("clean_text")))
    judged = counted.withColumn("base_failed", failed).withColumn("lost_chars", lost.cast("long"))
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars"))
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", "clean_text"]
    return settled(judged.withColumn("kept", kept).select(*keep, *named), *named)
