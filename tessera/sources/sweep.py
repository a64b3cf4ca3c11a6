"""Incremental sweeps of a folder of files into a store: new and changed files are read, those that are gone leave, all others are let be.

Defined results: an empty file counts as none; bytes that are no UTF-8 become replacement characters; a file that changed back to an indexed time and size is not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import SKIPPED_FOLDERS
from tessera.sources.store import Manifest, Store

FILE = "path string, modified_at timestamp, bytes long, text string, sweep int"


def file_store(spark: SparkSession, folder: str, parts: int = 16) -> Store:
    """Files dealt to parts by their path."""
    return Store(spark, folder, FILE, F.pmod(F.xxhash64("path"), F.lit(parts)))


def listed_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """(path, modified_at, bytes) of the files below ``root``; their content is not read."""
    return described(folder_files(spark, root, glob))


def folder_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """The files below ``root``, listed when this is called."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def described(files: DataFrame) -> DataFrame:
    """(path, modified_at, bytes) of files outside of folders that are passed over."""
    skipped = "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS)
    return files.where(~F.col("path").rlike(f"/({skipped})/")).select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"))


def differences(listing: DataFrame, index: DataFrame) -> DataFrame:
    """(path, modified_at, kind): files that are ``new``, ``changed`` (of another time or size) or ``gone`` against an index of the same columns."""
    both = listing.select("path", "modified_at", F.col("bytes").alias("_bytes")).join(index.select("path", F.col("modified_at").alias("_then"), "bytes"), "path", "full")
    same = (F.col("modified_at") == F.col("_then")) & (F.col("_bytes") == F.col("bytes"))
    kind = F.when(F.col("_then").isNull(), "new").when(F.col("modified_at").isNull(), "gone").when(~same, "changed")
    return both.select("path", "modified_at", kind.alias("kind")).where("kind IS NOT NULL")


def sweep(store: Store, root: str, number: int, glob: str = "*.md") -> Manifest:
    """Bring the store up to the files below ``root``. A sweep of the same number that is run again changes nothing.

    Contents are read of files that are not older than the oldest new or changed one, which the file source sorts out by time before it opens any.
    """
    spark = store.spark

    def work(base: Manifest) -> tuple[list[str], DataFrame, dict[str, str]] | None:
        index = store._rows_of(base.parts)
        listed = folder_files(spark, root, glob)  # once: a folder's listing costs more than comparing it
        found = differences(described(listed), index).persist()
        try:
            first, n = found.where("kind <> 'gone'").agg(F.min("modified_at"), F.count("*")).first()
            parts = [r[0] for r in found.select(store.part).distinct().collect()]  # parts, not files
            if not parts:
                return None
            kept = store._rows_of(base.parts, parts).join(found.select("path"), "path", "left_anti")
            if not n:
                return parts, kept, {}
            files = listed.where(F.col("modificationTime") >= F.lit(first))
            read = files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"), F.lit(number).alias("sweep"))
            return parts, kept.unionByName(read.join(found.where("kind <> 'gone'").select("path"), "path", "left_semi")), {}
        finally:
            found.unpersist()

    return store.change(f"sweep:{root}", number, work)
