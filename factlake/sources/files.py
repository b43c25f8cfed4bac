"""Files in and out: JSON payloads by folder, Markdown documents, and lists of missing information."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files as (path, folder, payload); the folder tells the kind of object."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))
    return rows.withColumn("folder", F.element_at(F.split("path", "/"), -2))


def write_markdown(documents: DataFrame, path: str) -> None:
    """documents(app_id, doc_type, markdown): one text file each, under app_id= and doc_type=; lines end in LF.

    The text source adds the last line feed itself.
    """
    body = documents.select("app_id", "doc_type", F.regexp_replace("markdown", r"\n\z", "").alias("value"))
    body.repartition("app_id", "doc_type").write.partitionBy("app_id", "doc_type").text(path)


def missing_json(missing: DataFrame) -> DataFrame:
    """missing(app_id, missing array) as (app_id, json): an indented list, ``[]`` if nothing is missing."""
    text = lambda s: F.to_json(F.struct(s.alias("v"))).substr(F.lit(6), F.char_length(F.to_json(F.struct(s.alias("v")))) - 6)
    names = ("field", "question", "expected_source")
    entry = lambda m: F.concat(F.lit("  {\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'    "{n}": '), text(m[n])) for n in names]), F.lit("\n  }"))
    return missing.select("app_id", F.when(F.size("missing") == 0, F.lit("[]")).otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform("missing", entry), ",\n"), F.lit("\n]"))).alias("json"))


def progress(results: DataFrame) -> DataFrame:
    """One line of text per save: what became of it."""
    said = F.concat(F.col("key"), F.lit(": "), F.lower("action"), F.coalesce(F.concat(F.lit(", version "), F.col("version").cast("string"), F.lit(", "), F.round("completeness", 1).cast("string"), F.lit("% complete")), F.lit("")))
    return results.select("seq", said.alias("line"))
