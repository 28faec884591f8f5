"""Personal data with Spark expressions: patterns find entities, corpus co-occurrence finds the terms that give them away."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import in_blocks, let, materialize, row_hash, settled

#: Kinds in the order in which spans of one start stand; "term" marks what the method adds.
KINDS = ["email", "ip", "card", "phone", "term"]
#: The patterns, in forms that take linear time: runs are possessive and start where a run starts (or the last match ended).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Code points on each side of an entity whose terms count as seen with it, and the windows that one word can stand in (two of each kind).
REACH, SHARED = 120, 8
#: Windows of different text in which a term must be seen with an entity, and the share of the entity's information that it may disclose.
SUPPORT, DISCLOSURE = 3, 0.9
#: Words of a term, white space apart.
WORD, NO_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Terms up to which they are broadcast.
BROADCAST_TERMS = 200_000

_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _placed(text: Column, pattern: str) -> Column:
    """All matches in order, with code point offsets: what lies between the matches tells where they start. before and after are the REACH code
    points between a match and its neighbours."""

    def walk(found: Column, gaps: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            gap, value = F.element_at(gaps, i), F.element_at(found, i)
            begin = a["at"] + F.length(gap)
            end = begin + F.length(value)
            span = F.struct(begin.alias("start"), end.alias("end"), value.alias("value"), F.right(gap, F.lit(REACH)).alias("before"), F.left(F.element_at(gaps, i + 1), F.lit(REACH)).alias("after"))
            return F.struct(end.alias("at"), a["k"].alias("k"), F.concat(a["out"], F.array(span)).alias("out"))

        return in_blocks(F.size(found), _SPAN, step)

    none = F.array().cast(_SPAN)
    some = lambda f: F.when(F.size(f) > 0, let(F.split(text, pattern, -1), lambda g: walk(f, g))).otherwise(none)
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum rule of card numbers, on a string of digits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _valid_ip(value: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))


def _valid_card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))


def base_spans(text: Column) -> Column:
    """Struct of the spans of each kind: (start, end, value), valid ones only."""
    none = F.array().cast(_SPAN)
    has_digit = text.rlike("[0-9]")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), _placed(text, PATTERNS["email"])).otherwise(none),
        "ip": F.when(has_digit & text.rlike(r"[0-9]\.[0-9]"), F.filter(_placed(text, PATTERNS["ip"]), lambda s: _valid_ip(s["value"]))).otherwise(none),
        "card": F.when(has_digit & text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), F.filter(_placed(text, PATTERNS["card"]), lambda s: _valid_card(s["value"]))).otherwise(none),
        "phone": F.when(has_digit & F.contains(text, F.lit("+")), F.filter(_placed(text, PATTERNS["phone"]), lambda s: F.length(_digits(s["value"])).between(9, 15))).otherwise(none),
    }
    return F.struct(*(v.alias(k) for k, v in found.items()))


def _all_spans(spans: Column) -> Column:
    """The spans of every kind in one array (start, rank, end, value, before, after)."""
    one = lambda k, rank: F.transform(spans[k], lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), *(s[c].alias(c) for c in ("value", "before", "after"))))
    return F.flatten(F.array(*(one(k, i) for i, k in enumerate(KINDS[:4]))))


def _entity(rank: Column, value: Column) -> Column:
    """What makes two matches the same entity: the letters without case, or the digits."""
    return F.concat(rank.cast("string"), F.lit(":"), F.when(rank == 0, F.lower(value)).when(rank == 1, value).otherwise(_digits(value)))


def _words(text: Column) -> Column:
    """The words of a text in lower case; the first and last may be empty."""
    return F.split(F.lower(text), f"{NO_WORD}+", -1)


def _terms(text: Column) -> Column:
    return F.filter(_words(text), lambda w: w != "")


def _word_spans(text: Column, wanted: Column) -> Column:
    """Spans of the words whose numbers (from 0, sorted) are wanted: one walk that keeps only those."""

    def walk(words: Column, gaps: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            begin = a["at"] + F.length(F.element_at(gaps, i))
            end = begin + F.length(F.element_at(words, i))
            hit = F.coalesce(F.try_element_at(wanted, a["k"] + 1) == i - 1, F.lit(False))
            span = F.struct(begin.alias("start"), F.lit(4).alias("rank"), end.alias("end"))
            return F.struct(end.alias("at"), (a["k"] + hit.cast("int")).alias("k"), F.when(hit, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

        return in_blocks(F.size(words), "array<struct<start:int,rank:int,end:int>>", step)

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: let(F.split(text, WORD, -1), lambda g: walk(w, g)))


def disclosing_terms(found: DataFrame, texts: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term) that give an entity away, from found (spans), the base spans of all rows of the corpus, and texts (text), their texts.

    An entity e seen n times among W windows of the corpus has information log(W / n). A term t seen N times, c of them near e, discloses
    log(c W / (N n)) of it. Terms count if that is at least the given share and they are near e in windows of enough different texts. Near is
    what stands between e and its neighbours of the same kind, REACH code points at most. Pairs that fail even if the term stood near
    entities only are dropped first; then every word is counted once, and a pair meets one count.
    """
    near = found.where(F.exists(F.array(*(F.size(f"spans.{k}") > 0 for k in KINDS[:4])), lambda x: x)).select(F.explode(_all_spans(F.col("spans"))).alias("s"))
    windows = near.select(_entity(F.col("s.rank"), F.col("s.value")).alias("entity"), F.col("s.before").alias("before"), F.col("s.after").alias("after"))
    # the words cut by the window's edge are left out
    window = F.concat(F.regexp_replace("before", r"^[^\x20\x09-\x0D]*", ""), F.lit(" "), F.regexp_replace("after", r"[^\x20\x09-\x0D]*$", ""))
    windows = materialize(windows, "windows")
    seen = windows.select("entity", F.xxhash64("before", "after").alias("window"), F.explode(F.array_distinct(_terms(window))).alias("term"))
    pairs = seen.groupBy("entity", "term", "window").agg(F.count(F.lit(1)).alias("c")).groupBy("entity", "term").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("texts"))
    pairs = materialize(pairs, "pairs")
    own = windows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    total = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    w = F.lit(max(2.0, total / (2 * REACH)))
    information = F.log(w / F.least(F.col("n"), w / 2))
    told = lambda often: F.log(F.col("c") * w / (often * F.least(F.col("n"), w / 2))) >= disclosure * information
    # a word stands in SHARED windows at most, so it occurs at least so often
    least = pairs.groupBy("term").agg(F.greatest(F.sum("c") / SHARED, F.lit(1.0)).alias("least"))
    possible = materialize(pairs.where(F.col("texts") >= support).join(own, "entity").join(least, "term").where(told(F.col("least"))).select("term", "c", "n"), "possible")
    if possible.isEmpty():
        return possible.select("term")
    often = texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("often"))
    return possible.join(often, "term").where(told(F.col("often"))).select("term").distinct()


def find_personal_data(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """docs' doc_id and text (null: empty) with spans: sorted (start, rank, end), rank counting KINDS, for every row of docs.

    Base spans are those of PATTERNS that are valid; rank 4 are words that give an entity away anywhere in the corpus. Blank texts and an
    empty table have no spans; repeated rows get equal ones.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    found = settled(texts.withColumn("spans", base_spans(F.col("text"))), "spans")
    terms = materialize(disclosing_terms(found, texts, support, disclosure), "terms")
    place = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    n_terms = terms.count()
    if not n_terms:
        return found.select("doc_id", "text", F.sort_array(place(_all_spans(F.col("spans")))).alias("spans"))
    wanted = F.broadcast(terms) if n_terms <= BROADCAST_TERMS else terms
    words = texts.select("doc_id", row_hash(F.col("text")).alias("row"), F.posexplode_outer(_words(F.col("text"))).alias("at", "term"), F.rlike(F.substring("text", 1, 1), F.lit(NO_WORD)).cast("int").alias("shift"))
    at = F.array_sort(F.collect_set(F.col("at") - F.col("shift"))).alias("__at")  # a text that begins with no word has an empty first one
    hits = words.join(wanted, "term").groupBy(F.col("doc_id").alias("__id"), F.col("row").alias("__row")).agg(at)
    joined = found.join(hits, (row_hash(F.col("text")) == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    ranked = _word_spans(F.col("text"), F.col("__at"))
    base = place(_all_spans(F.col("spans")))
    return joined.select("doc_id", "text", F.sort_array(F.when(F.col("__at").isNull(), base).otherwise(F.concat(base, ranked))).alias("spans"))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitize(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """find_personal_data with sanitized: entities generalised to their kind in angle brackets, disclosing terms removed; of overlapping spans the first gives the name."""
    table = find_personal_data(docs, support, disclosure)
    names = F.array(*(F.lit(f"<{k}>") for k in KINDS[:4]), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0)))
        more = F.when(s["start"] >= a["at"], F.concat(a["out"], gap, F.element_at(names, s["rank"] + 1))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), more.alias("out"))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return table.withColumn("sanitized", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))
