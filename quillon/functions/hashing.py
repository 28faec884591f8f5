"""Hashes, ids and names as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Size of the hashed token space.
SPARSE_DIMENSION = 100_000


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def metadata_hash(name: Column, size: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws("|", name, size.cast("string"), kind), 256)


def token_bucket(token: Column, dimension: int = SPARSE_DIMENSION) -> Column:
    """The SHA-256 of a token, as a number, modulo dimension: eight 32-bit words folded by Horner's rule."""
    digest = F.sha2(token, 256)
    word = lambda i: F.conv(F.substring(digest, i, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(57), F.lit(8)), F.lit(0).cast("long"), lambda a, i: (a * F.lit(4294967296) + word(i)) % F.lit(dimension))


def hash_vector(digest: Column) -> Column:
    """Eight numbers of [0, 1] from the first bytes of a hex digest."""
    return F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: F.conv(F.substring(digest, i, F.lit(2)), 16, 10).cast("double") / 255)


def query_signature(collection: Column, filters: Column, sorts: Column) -> Column:
    """Sixteen hex digits for a query's shape; filters and sorts are arrays of names, in any order."""
    return F.substring(F.md5(F.concat_ws("::", collection, F.array_join(F.array_sort(filters), ","), F.array_join(F.array_sort(sorts), ","))), 1, 16)


def case_partition(case_id: Column, partitions: int = 10) -> Column:
    number = F.conv(F.substring(F.md5(case_id), 1, 8), 16, 10).cast("long") % partitions
    return F.concat(F.lit("case_"), F.lpad(number.cast("string"), 3, "0"))


def collection_name(name: Column, most: int = 63) -> Column:
    """A lower-case name of letters, digits and underscores, at most 63 long; longer ones end in a hash of the whole."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(name, r"[^a-zA-Z0-9\s]", "")), r"\s+", "_"), "_+", "_"))
    named = F.when(plain == "", F.lit("unnamed_case")).otherwise(plain)
    short = F.when(F.length(named) > most, F.concat(F.substring(named, 1, most - 9), F.lit("_"), F.substring(F.md5(name), 1, 8))).otherwise(named)
    return F.substring(F.when(short.rlike("^[0-9]"), F.concat(F.lit("case_"), short)).otherwise(short), 1, most)


def firm_collection_name(name: Column, firm: Column) -> Column:
    """As collection_name, but unique by firm: fifty characters of the name and a hash of both."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_]", "_"), "_+", "_")
    return F.substring(F.concat(F.substring(plain, 1, 50), F.lit("_"), F.substring(F.md5(F.concat(firm, F.lit(":"), name)), 1, 8)), 1, 63)


def cache_key(namespace: str, kind: str, key: Column, operation: Column) -> Column:
    return F.concat_ws(":", F.lit(namespace), F.lit(kind), key, operation)


def roman(number: Column) -> Column:
    """Roman numerals of 1 to 3999."""
    values = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
    steps = F.array(*(F.struct(F.lit(v).cast("long").alias("v"), F.lit(s).alias("s")) for v, s in values))
    start = F.struct(number.cast("long").alias("left"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        times = F.floor(a["left"] / x["v"]).cast("int")
        return F.struct((a["left"] % x["v"]).alias("left"), F.concat(a["out"], F.repeat(x["s"], times)).alias("out"))

    return F.aggregate(steps, start, step, lambda a: a["out"])


def exhibit_label(number: Column) -> Column:
    """A to Z for 0 to 25, then AA, BB and so on."""
    return F.repeat(F.char(F.lit(65) + (number % 26).cast("int")), (F.floor(number / 26) + 1).cast("int"))


def bytes_of_base64(text: Column) -> Column:
    return F.unbase64(text)
