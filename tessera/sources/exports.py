"""Exports: files of bounded size with a manifest of what each must hold, checked when they are read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Files of one value that are written in a row.
FILES_A_TASK = 50
MANIFEST = "file string, n long, digest long"


def _digest(columns: list[str]) -> list[Column]:
    """Count and an order-free digest of rows."""
    return [F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("digest")]


def _by_file(rows: DataFrame, columns: list[str]) -> DataFrame:
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+(?:/part-[^/]+)?)$", 1)
    return rows.withColumn("file", name).groupBy("file").agg(*_digest(columns))


def _dealt(rows: DataFrame, by: list[str], rows_a_file: int) -> DataFrame:
    """``rows`` dealt by the columns ``by`` and, within one value of these, in chunks of whole files, so that a frequent value is no single task's. Rows are numbered
    within their partition, whose numbers begin where those of the partitions before end."""
    marked = rows.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id(), "_of": F.xxhash64(*by)})
    begins = marked.groupBy("_of", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_of").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    begins = begins.select("_of", "_part", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_of", "_part").orderBy("_row")) - 1
    numbered = marked.withColumn("_at", within).join(begins, ["_of", "_part"])
    chunk = F.floor((F.col("_at") + F.col("_before")) / (rows_a_file * FILES_A_TASK))
    return numbered.withColumn("_chunk", chunk).repartition(*by, "_chunk").select(*rows.columns)


def export_rows(rows: DataFrame, folder: str, fmt: str = "parquet", by: list[str] | None = None, rows_a_file: int = 100_000) -> DataFrame:
    """Write ``rows`` below ``folder``, dealt by the columns ``by`` into files of at most ``rows_a_file`` rows, and then a manifest; returns the manifest. A folder
    without a manifest is an export that did not end."""
    spark = rows.sparkSession
    ready = _dealt(rows, by, rows_a_file) if by else rows
    writer = ready.write.mode("errorifexists").option("maxRecordsPerFile", rows_a_file)
    (writer.partitionBy(*by) if by else writer).format(fmt).save(f"{folder}/rows")
    held = _by_file(read_back(spark, folder, rows.schema, fmt), rows.columns)
    held.write.mode("errorifexists").json(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/manifest")


def read_back(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(f"{folder}/rows")


def export_faults(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """(file, fault): files that are missing, that the manifest does not name, or whose rows differ from what it says."""
    named = spark.read.schema(MANIFEST).json(f"{folder}/manifest")
    there = _by_file(read_back(spark, folder, schema, fmt), schema.names)
    both = named.withColumnsRenamed({"n": "n_then", "digest": "digest_then"}).join(there, "file", "full")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("n_then").isNull(), "unknown").when((F.col("n") != F.col("n_then")) | (F.col("digest") != F.col("digest_then")), "changed")
    return both.select("file", fault.alias("fault")).where("fault IS NOT NULL")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the counts of both and whether count and digest agree."""
    columns = sorted(a.columns)
    left, right = (d.agg(*_digest(columns)) for d in (a, b))
    return left.select(F.col("n").alias("n_a"), F.col("digest").alias("d_a")).crossJoin(right.select(F.col("n").alias("n_b"), F.col("digest").alias("d_b"))).select("n_a", "n_b", ((F.col("n_a") == F.col("n_b")) & (F.col("d_a") == F.col("d_b"))).alias("same"))
