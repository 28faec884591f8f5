"""A document store on files: named stores of rows with versions, written in idempotent batches, deleted by predicate, read by key, page or store.

A store is a partition of a table, and rows are dealt to parts by the hash of their id, so a batch rewrites only the parts that it touches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.sources.shared import kept

#: Parts of a store; touched parts up to which their folders are named in the read; tasks that write a part, each one file.
PARTS, NAMED, FILES = 8, 2000, 4
# Names of a case's own stores, and what metadata can't overwrite.
CASE_STORES = ["", "_facts", "_timeline", "_depositions"]
RESERVED = ["folder_name", "document_id", "content", "case_name"]


def point_id(*parts: Column) -> Column:
    """A name that the same parts always get."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def case_stores(name: Column, longest: int = 63) -> Column:
    """The names of a case's own stores, each within the limit: the case's name gives way to the ending."""
    return F.array(*(F.concat(F.substring(name, 1, longest - len(end)), F.lit(end)) for end in CASE_STORES))


def with_defaults(metadata: Column, defaults: dict[str, Column]) -> Column:
    """A map with the defaults for keys that it lacks or has null."""
    given = F.map_filter(F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    base = F.create_map(*(x for k, v in defaults.items() for x in (F.lit(k), v.cast("string"))))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.coalesce(F.map_contains_key(given, k), F.lit(False))), given)


def without_reserved(metadata: Column) -> Column:
    """A map without the keys that only the store may set."""
    return F.map_filter(metadata, lambda k, v: ~k.isin(RESERVED))


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at path; no rows before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _schema(rows: DataFrame) -> T.StructType:
    plain = [f for f in rows.schema if f.name not in ("store", "part")]
    return T.StructType([*plain, T.StructField("store", T.StringType()), T.StructField("part", T.IntegerType())])


def upsert(path: str, rows: DataFrame, parts: int = PARTS) -> None:
    """Write rows (store, id, version, ...): of each (store, id) the row of the highest version stays, in the batch and with what is stored.

    Sending a batch again changes nothing, and batches may come in any order. Rows of one version that differ count by their largest values. A
    null store or id is refused. Only touched parts are read and written, and their rows are dealt once.
    """
    spark, schema = rows.sparkSession, _schema(rows)
    batch = kept(rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).select(*schema.names), "store-batch")
    if not batch.where("store is null or id is null or version is null").isEmpty():
        raise ValueError("rows need a store, an id and a version")
    stored = _touched(_read(spark, path, schema), batch)
    _write(_latest(batch if stored is None else stored.select(*schema.names).unionByName(batch), schema), path)


def _write(rows: DataFrame, path: str) -> None:
    """Replace the parts that rows have and no others. rows may be read from these parts: the new files lie apart until all are written."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store", "part").parquet(path)


def _touched(stored: DataFrame, batch: DataFrame) -> DataFrame | None:
    """The stored rows of the parts that a batch touches; None where there are none. Few parts are named, so that their folders alone are read."""
    parts = batch.select("store", "part").distinct()
    named = parts.limit(NAMED + 1).collect()
    if len(named) > NAMED:
        return stored.join(parts, ["store", "part"], "left_semi")
    found = stored.where(F.col("store").isin(sorted({r.store for r in named})) & F.concat_ws("\x1f", "store", F.col("part").cast("string")).isin([f"{r.store}\x1f{r.part}" for r in named]))
    return None if found.isEmpty() else found


def _latest(both: DataFrame, schema: T.StructType) -> DataFrame:
    """One row for each (store, id). Maps can't be compared, so they don't break ties of versions."""
    others = [f.name for f in schema if f.name not in ("store", "id", "part", "version") and not isinstance(f.dataType, T.MapType)]
    values = [c for c in schema.names if c not in ("store", "id", "part")]
    dealt = both.withColumn("__file", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(FILES))).repartition("store", "part", "__file")
    best = dealt.groupBy("store", "part", "__file", "id").agg(F.max_by(F.struct(*values), F.struct("version", *others)).alias("row"))
    return best.select(*(F.col(c) if c in ("store", "id", "part") else F.col(f"row.{c}").alias(c) for c in schema.names))


def delete(path: str, spark: SparkSession, schema: T.StructType, where: Column) -> int:
    """Delete rows that where holds for, and tell how many there were; parts without such rows are left alone."""
    stored = _read(spark, path, schema)
    hit = F.coalesce(where, F.lit(False)) & F.col("id").isNotNull()
    gone = stored.groupBy("store", "part").agg(F.count_if(hit).alias("n"), F.count(F.lit(1)).alias("rows")).where("n > 0")
    gone = kept(gone, "store-gone")
    n = gone.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if n:
        left = stored.join(gone.select("store", "part"), ["store", "part"]).where(~hit).select(*schema.names)
        # a part that is left empty keeps a row that no reader sees
        empty = gone.where("n = rows").select(*(F.col(f.name) if f.name in ("store", "part") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        _write(left.unionByName(empty), path)
    return n


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of all stores (store, id, version, ...). A filter on store reads that store's folders only."""
    return _read(spark, path, schema).where("id is not null").drop("part")


def get(spark: SparkSession, path: str, schema: T.StructType, store: str, ids: list[str], parts: int = PARTS) -> DataFrame:
    """Rows by key: one folder for each id is read."""
    asked = spark.createDataFrame([(i,) for i in ids] or [("",)], "id string").select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    numbers = sorted({r.part for r in asked.collect()})
    return _read(spark, path, schema).where((F.col("store") == store) & F.col("part").isin(numbers) & F.col("id").isin(ids)).drop("part")


def after(rows: DataFrame, last: Column | None, limit: int = 100) -> DataFrame:
    """The next page of a scan in the order of ids, after the last one seen: no offset that grows with the page."""
    return (rows if last is None else rows.where(F.col("id") > last)).orderBy("id").limit(limit)


def exported(rows: DataFrame) -> DataFrame:
    """(store, rows, first_id, last_id, digest): a store's contents in one row; digest is a sum over row hashes, so it doesn't depend on order and no list is gathered."""
    columns = [c for c in rows.columns if not isinstance(rows.schema[c].dataType, T.MapType)]
    return rows.groupBy("store").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("digest"))
