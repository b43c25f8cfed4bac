"""The two stored tables as DataFrames: schema, scans, point reads and whole-row upserts.

A table is a folder of Parquet snapshots; a write makes a new one and then moves the pointer, so a reader never sees half of it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_KEYS = {"KnowledgeFacts": "FactKey", "DocumentOutputs": "DocumentKey"}
SETTING = "factlake.store"


def key_column(table: str) -> str:
    """The key column of a table; only the two tables have one."""
    if table not in TABLE_KEYS:
        raise ValueError(f"no table {table!r}; there are {', '.join(TABLE_KEYS)}")
    return TABLE_KEYS[table]


def schema(table: str) -> T.StructType:
    s = T.StringType()
    return T.StructType([T.StructField(key_column(table), s, False), T.StructField("Value", s, False), T.StructField("Hashcode", s, False), T.StructField("AppID", s), T.StructField("Completeness", T.DoubleType(), False), T.StructField("Version", T.LongType(), False)])


def store_path(spark: SparkSession) -> str:
    """The store's folder: the session setting, else the environment, else ``store`` in the warehouse."""
    return spark.conf.get(SETTING, None) or os.environ.get("FACTLAKE_STORE") or f"{spark.conf.get('spark.sql.warehouse.dir')}/store"


def _pointer(spark: SparkSession, table: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store_path(spark)}/{table}/CURRENT")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _current(spark: SparkSession, table: str) -> str | None:
    """The name of the current snapshot, if there is one."""
    fs, path = _pointer(spark, table)
    return spark.read.text(path.toString()).first()[0] if fs.exists(path) else None


def read_table(spark: SparkSession, table: str) -> DataFrame:
    """The table's current snapshot; empty before the first write."""
    key_column(table)
    name = _current(spark, table)
    if name is None:
        return spark.createDataFrame([], schema(table))
    return spark.read.schema(schema(table)).parquet(f"{store_path(spark)}/{table}/{name}")


def write_rows(spark: SparkSession, table: str, rows: DataFrame) -> None:
    """Inserts or replaces whole rows by key; raises if a key is there twice, and leaves the table as it was then.

    The pointer is written aside and renamed, so a reader meets the old snapshot or the new one. One writer at a time: a second one that began
    from the same snapshot is refused (FileExistsError), since snapshots are numbered and a number is taken once.
    """
    key = key_column(table)
    twice = rows.groupBy(key).count().filter("count > 1").select(key).limit(1).collect()
    if twice:
        raise ValueError(f"{table}: the key {twice[0][0]!r} is there twice")
    columns = [f.name for f in schema(table).fields]
    before = _current(spark, table)
    number = int(before.split("-")[1]) + 1 if before else 1
    fs, path = _pointer(spark, table)
    claim = path.suffix(f"-{number}")
    if not fs.createNewFile(claim):
        raise FileExistsError(f"{table}: snapshot {number} is being written, or its writer failed; remove {claim} then")
    try:
        old = read_table(spark, table).join(rows.select(key), key, "left_anti")
        name = f"v-{number}-{uuid.uuid4().hex}"
        old.select(columns).unionByName(rows.select(columns)).write.parquet(f"{store_path(spark)}/{table}/{name}")
        aside = path.suffix(f"-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(name.encode()))
        out.close()
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
        options = spark._jvm.java.lang.reflect.Array.newInstance(spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(aside, path, options)
    finally:
        fs.delete(claim, False)


def init_schema(spark: SparkSession) -> None:
    """Both tables, if they aren't there yet."""
    for table in TABLE_KEYS:
        fs, path = _pointer(spark, table)
        if not fs.exists(path):
            write_rows(spark, table, spark.createDataFrame([], schema(table)))


def list_rows(rows: DataFrame, table: str, app_id: str | None = None) -> DataFrame:
    """All rows by key in byte order, or those of one application; shared rows belong to none."""
    key = key_column(table)
    return (rows if app_id is None else rows.filter(F.col("AppID") == F.lit(app_id))).orderBy(key)


def get_row(rows: DataFrame, table: str, key: str) -> DataFrame:
    return rows.filter(F.col(key_column(table)) == F.lit(key)).limit(1)


def get_rows(rows: DataFrame, table: str, keys: DataFrame) -> DataFrame:
    """The rows of all keys in ``keys`` (one column, ``key``) at once."""
    name = key_column(table)
    return rows.join(keys.select(F.col("key").alias(name)).distinct(), name, "left_semi")


def as_rows(snapshot: DataFrame, table: str) -> DataFrame:
    """A snapshot of save_batch() as rows of a table."""
    mine = snapshot.filter(F.col("table") == table)
    return mine.select(F.col("key").alias(key_column(table)), F.col("value").alias("Value"), F.col("hashcode").alias("Hashcode"), F.col("app_id").alias("AppID"), F.col("completeness").alias("Completeness"), F.col("version").alias("Version"))
