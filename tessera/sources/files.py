"""File sources and sinks: vault scans, frontmatter, JSON lines, table copies, idempotent upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: folders that scans pass over, and languages by file extension
SKIPPED_FOLDERS = (".git", "node_modules", ".obsidian", "dist", "build")
LANGUAGES = {"ts": "typescript", "tsx": "typescript", "js": "javascript", "py": "python", "go": "go", "rs": "rust", "java": "java"}


def scan_files(spark: SparkSession, root: str, glob: str = "*.md", modified_after: str | None = None) -> DataFrame:
    """(path, modified_at, bytes, text) of files below ``root``; with ``modified_after`` only changed files are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    skipped = "|".join(f.replace(".", r"\.") for f in SKIPPED_FOLDERS)
    files = reader.load(root).where(~F.col("path").rlike(f"/({skipped})/"))
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("text"))


def changed_files(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """Files that are new or were modified after the time (path, last_modified_at) they were indexed at."""
    seen = indexed.select("path", F.col("last_modified_at").alias("_seen"))
    return files.join(seen, "path", "left").where(F.col("_seen").isNull() | (F.col("modified_at") > F.col("_seen"))).drop("_seen")


def removed_files(indexed: DataFrame, files: DataFrame) -> DataFrame:
    """Indexed paths that are no files any more."""
    return indexed.join(files.select("path"), "path", "left_anti")


def file_language(path: Column) -> Column:
    table = F.create_map(*[x for pair in LANGUAGES.items() for x in map(F.lit, pair)])
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


FRONTMATTER = T.StructType([T.StructField("fields", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("body", T.StringType())])


@F.pandas_udf(FRONTMATTER)
def frontmatter(text: pd.Series) -> pd.DataFrame:
    """Fields (a list of values each; one for a scalar) and body of texts that begin with a ``---`` block. Lines of
    other forms than ``key: value``, ``key:`` with ``- item`` lines below it are passed over; without a block all is body."""
    import re

    def unquoted(v: str) -> str:
        return v[1:-1] if len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'" else v

    def parse(t: str | None) -> tuple[dict[str, list[str]], str | None]:
        block = re.match(r"---\r?\n(.*?)\r?\n---\r?\n(.*)\Z", t or "", re.S)
        if not block:
            return {}, t
        fields: dict[str, list[str]] = {}
        under = None
        for line in block[1].splitlines():
            if item := re.match(r"\s*-\s+(.*)$", line):
                if under is not None:
                    fields[under] = [x for x in fields[under] if x] + [unquoted(item[1].strip())]
                    continue
            pair = re.match(r"([\w-]+):\s*(.*)$", line.rstrip())
            if pair:
                fields[pair[1]] = [unquoted(pair[2].strip())]
                under = None if pair[2].strip() else pair[1]
            elif line.strip():
                under = None
        return fields, block[2]

    return pd.DataFrame([parse(t) for t in text], columns=["fields", "body"])


def inferred_title(path: Column, text: Column) -> Column:
    """The first H1 of the first 20 lines, else the file name without date and extension."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, 20), "\n")
    h1 = F.nullif(F.trim(F.regexp_extract(head, r"(?m)^#\s+(.+)$", 1)), F.lit(""))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[A-Za-z0-9]+$", "")
    return F.coalesce(h1, F.trim(F.regexp_replace(F.regexp_replace(name, r"^\d{4}-?\d{2}-?\d{2}[-_ ]*", ""), r"[-_]+", " ")))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Records, and lines that are not JSON, of a JSON-lines source."""
    corrupt = "_corrupt"
    wide = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    lines = spark.read.text(path).where("trim(value) <> ''")
    parsed = lines.select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    return parsed.where(F.col(f"r.{corrupt}").isNull()).select("r.*").drop(corrupt), parsed.where(F.col(f"r.{corrupt}").isNotNull()).select(F.col(f"r.{corrupt}").alias("line"))


def copy_table(reader: DataFrame, url: str, name: str, **options: str) -> None:
    """Write a table to another engine over JDBC; ``reports.same_content`` verifies the copy."""
    reader.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode("append").save()


def upserted(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the rows of ``new`` in place of those with the same keys. Repeating it changes nothing."""
    return stored.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.dropDuplicates(keys), allowMissingColumns=True)


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a corpus as parquet, json or text."""
    (df.select(F.to_json(F.struct(*df.columns)).alias("value")) if fmt == "text" else df).write.mode("errorifexists").format(fmt).save(path)
