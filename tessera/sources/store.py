"""A versioned table in a folder that the cluster shares: rows in parts, and a manifest for each generation.

A commit writes the parts that it changes beside the old ones and then a manifest that says which files hold each part; a reader follows one
manifest, so it sees one generation whole. A manifest takes its number in one step, and only if it is free: of two writers that began at the same generation one wins,
and the other reads again and repeats its work. A batch is named in the manifest together with what it did, so a batch that is run again after a
failure finds itself there and changes nothing. Parts that a commit does not change keep their files.

Defined results: an empty folder is generation 0 without rows; a manifest that is no whole JSON is passed over; files of a commit that
lost are not read; rows whose part is null or empty share the part ``none``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "_part"


class CommitConflict(RuntimeError):
    """Another writer has committed the generation."""


@dataclass
class Manifest:
    generation: int = 0
    parts: dict[str, str] = field(default_factory=dict)  # part to the folder of its rows
    batches: dict[str, int] = field(default_factory=dict)  # writer to its last batch
    facts: dict[str, str] = field(default_factory=dict)  # what writers note, such as watermarks


class Store:
    """Rows of one schema; ``part`` is the expression that deals them to parts, which have to be few against the rows."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType | str, part: Column) -> None:
        self.spark, self.folder, self.part = spark, folder.rstrip("/"), F.coalesce(F.nullif(part.cast("string"), F.lit("")), F.lit("none"))
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _manifest_path(self, generation: int) -> str:
        return f"{self.folder}/manifests/{generation:012d}.json"

    def _read(self, path: str) -> Manifest | None:
        stream = self._files.open(self._path(path))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return Manifest(**json.loads(text))
        except ValueError:
            return None

    def _numbers(self) -> list[int]:
        folder = self._path(f"{self.folder}/manifests")
        if not self._files.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._files.listStatus(folder) if f.getPath().getName().endswith(".json") and not f.getPath().getName().startswith("."))

    def manifest(self, as_of: int | None = None) -> Manifest:
        """The last whole manifest, of no later generation than ``as_of``."""
        for n in reversed(self._numbers()):
            if (as_of is None or n <= as_of) and (found := self._read(self._manifest_path(n))):
                return found
        return Manifest()

    def _commit(self, base: Manifest, parts: dict[str, str | None], writer: str, batch: int, facts: dict[str, str]) -> Manifest:
        taken = self._numbers()
        if any(n > base.generation and self._read(self._manifest_path(n)) for n in taken):
            raise CommitConflict(f"{self.folder}: generation {base.generation} is no longer the last")
        kept = {p: f for p, f in {**base.parts, **parts}.items() if f is not None}
        new = Manifest(max([base.generation, *taken]) + 1, kept, base.batches | {writer: batch}, base.facts | facts)
        written, to = self._path(f"{self.folder}/manifests/.{uuid.uuid4().hex}.tmp"), self._path(self._manifest_path(new.generation))
        out = self._files.create(written, False)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if not self._take(written, to):
            self._files.delete(written, False)
            raise CommitConflict(f"{self.folder}: generation {new.generation} is taken")
        return new

    def _take(self, written: object, to: object) -> bool:
        """Give a whole file its name in one step, unless the name is taken."""
        if self._files.getScheme() != "file":
            return self._files.rename(written, to)  # never onto a file that is there
        try:
            os.link(written.toUri().getPath(), to.toUri().getPath())  # a local rename would replace it
        except FileExistsError:
            return False
        self._files.delete(written, False)
        return True

    # rows

    def rows(self, as_of: int | None = None, parts: list[str] | None = None) -> DataFrame:
        """The rows of a generation, of all parts or of some."""
        held = self.manifest(as_of).parts
        return self._rows_of(held, parts)

    def _rows_of(self, held: dict[str, str], parts: list[str] | None = None) -> DataFrame:
        paths = [f for p, f in sorted(held.items()) if parts is None or p in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _written(self, rows: DataFrame, parts: list[str]) -> dict[str, str | None]:
        """Write ``rows`` by part; the folders of ``parts``, None for those that are left empty."""
        at = f"{self.folder}/rows/{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], self.part.alias(PART)).repartition(PART).write.partitionBy(PART).parquet(at)
        full = {unquote(name.split("=", 1)[1]): name for f in self._files.listStatus(self._path(at)) if (name := f.getPath().getName()).startswith(f"{PART}=")}
        return {p: f"{at}/{full[p]}" if p in full else None for p in parts}

    def change(self, writer: str, batch: int, work: Callable[[Manifest], tuple[list[str], DataFrame, dict[str, str]] | None], attempts: int = 5) -> Manifest:
        """Commit what ``work`` makes of the last manifest: the parts that it replaces, all their rows, and facts; None changes nothing. ``work`` is repeated
        if another writer commits meanwhile, and left out if the batch is there already."""
        for _ in range(attempts):
            base = self.manifest()
            if base.batches.get(writer, -1) >= batch:
                return base
            made = work(base)
            parts, rows, facts = made if made else ([], None, {})
            try:
                return self._commit(base, self._written(rows, parts) if parts else {}, writer, batch, facts)
            except CommitConflict:
                continue
        raise CommitConflict(f"{self.folder}: gave up after {attempts} attempts")

    def upsert(self, new: DataFrame, keys: list[str], latest: str, writer: str, batch: int, facts: dict[str, str] | None = None) -> Manifest:
        """Put rows by key: the one with the greatest ``latest`` stays, of equal ones the one that is stored. Only parts with a row that changes are written."""
        new = new.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).persist()
        order = [F.desc_nulls_last(latest), F.col("_stored").desc(), F.xxhash64(*[F.col(f.name) for f in self.schema])]
        best = Window.partitionBy(*keys).orderBy(*order)

        def work(base: Manifest) -> tuple[list[str], DataFrame, dict[str, str]]:
            asked = [r[0] for r in new.select(self.part).distinct().collect()]  # parts, not rows
            old = self._rows_of(base.parts, asked).withColumn("_stored", F.lit(1))
            both = old.unionByName(new.withColumn("_stored", F.lit(0))).withColumn("_n", F.row_number().over(best)).where("_n = 1")
            changed = [r[0] for r in both.where("_stored = 0").select(self.part).distinct().collect()]
            return changed, both.drop("_stored", "_n").where(self.part.isin(changed)) if changed else new.limit(0), facts or {}

        try:
            return self.change(writer, batch, work)
        finally:
            new.unpersist()

    def purge(self, expired: Column, parts: Callable[[str], bool | None], writer: str, batch: int) -> Manifest:
        """Drop the rows that are ``expired``. ``parts`` says of a part whether all its rows are (True), none (False) or some (None): whole parts
        are dropped without being read, and only those in between are read and written."""

        def work(base: Manifest) -> tuple[list[str], DataFrame, dict[str, str]] | None:
            judged = {p: parts(p) for p in base.parts}
            gone, between = ([p for p, v in judged.items() if v is x] for x in (True, None))
            if not gone and not between:
                return None
            return gone + between, self._rows_of(base.parts, between).where(~F.coalesce(expired, F.lit(False))) if between else self.spark.createDataFrame([], self.schema), {}

        return self.change(writer, batch, work)

    def files(self, as_of: int | None = None) -> set[str]:
        """The data files of a generation."""
        found = set()
        for folder in self.manifest(as_of).parts.values():
            found |= {f.getPath().toString() for f in self._files.listStatus(self._path(folder)) if f.getPath().getName().startswith("part-")}
        return found
