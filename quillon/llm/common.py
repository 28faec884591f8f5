"""Pieces that the training-data operators share: the shared folder, row keys and bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset one is made and set for a local master, which has one machine. Elsewhere it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, so that a lost executor costs no recomputation."""
    at = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = f"__{name}"
    while out.lower() in taken:
        out += "_"
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, whatever number of times body uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column, separator: str = SPACE) -> Column:
    """The maximal runs of characters outside of the separator class; none for null or blank text."""
    parts = F.split(F.coalesce(text, F.lit("")), f"(?:{separator})+")
    return F.filter(parts, lambda w: w != "")


def row_hash(text: Column) -> Column:
    """With the document's id, the key under which results come back to a row; rows alike in both get the same results."""
    return F.xxhash64(F.coalesce(text, F.lit("\x00null")))


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed once: no filter is pushed below the generator that makes them, and nothing above inlines them."""
    return df.select(*(c for c in df.columns if c not in names), F.inline_outer(F.array(F.struct(*names))))


#: Steps of a fold that append to one array.
BLOCK = 256


def in_blocks(n: Column, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """The array that step(state, i) builds for i of 1 to n; the state is (at, k, out: array of kind), at and k start with 0.

    The steps run in blocks, so that what is appended to stays short: time is linear in n up to millions, where one fold over all is quadratic.
    """
    state = lambda at, k, out: F.struct(at.alias("at"), k.alias("k"), out.alias("out"))
    none = F.array().cast(kind)

    def block(a: Column, b: Column) -> Column:
        steps = F.sequence((b - 1) * BLOCK + 1, F.least(b * BLOCK, n))
        inner = F.aggregate(steps, state(a["at"], a["k"], none), step)
        return let(inner, lambda x: state(x["at"], x["k"], F.concat(a["out"], F.array(x["out"]))))

    blocks = F.sequence(F.lit(1), F.ceil(n / BLOCK).cast("int"))
    folded = F.aggregate(blocks, state(F.lit(0), F.lit(0), F.array().cast(f"array<{kind}>")), block, lambda a: F.flatten(a["out"]))
    return F.when(n > 0, folded).otherwise(none)
