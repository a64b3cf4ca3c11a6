"""Connectors: a data source of paged items with stream offsets, and a sync that puts items into a store.

Pages are folders of JSON lines that a fetcher leaves in a shared place, numbered in the order in which they were fetched. A stream remembers the number of
pages it has read; a batch keeps the latest copy of each item and puts it into the store in one commit with the watermark, so neither can be without
the other. Pages that are read again, by a batch that is repeated or by a stream that lost its state, change nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources.store import Manifest, Store

GAP_MINUTES = 15
ITEM = "page long, number long, title string, body string, state string, labels string, updated_at timestamp"
PAGE = "slug string, number long, title string, body string, state string, updated_at timestamp, content_hash string"


def _pages(folder: str) -> list[tuple[int, str]]:
    """Numbers and paths of the page folders below ``folder``, in order."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder)
    found = files.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted((int(f.base_name.split("=")[1]), f.path) for f in found if f.base_name.startswith("page="))


class PageOfItems(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        self.number, self.path = number, path


class _PageReader:
    """Reads a page in a task."""

    def __init__(self, folder: str, since: str | None) -> None:
        self.folder, self.since = folder, since

    def read(self, partition: PageOfItems) -> Iterator[tuple]:
        from datetime import datetime

        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(self.folder)
        since = datetime.fromisoformat(self.since) if self.since else None
        for info in files.get_file_info(fs.FileSelector(partition.path)):
            if not info.base_name.endswith(".json"):
                continue
            with files.open_input_stream(info.path) as stream:
                for line in stream.read().splitlines():
                    try:
                        item = json.loads(line)
                        at = datetime.fromisoformat(item["updated_at"])
                        number = int(item["number"])
                    except (ValueError, KeyError, TypeError):
                        continue  # no item
                    if since is None or at >= since:
                        yield partition.number, number, item.get("title"), item.get("body"), item.get("state"), item.get("labels"), at


class _BatchReader(_PageReader, DataSourceReader):
    def partitions(self) -> list[PageOfItems]:
        return [PageOfItems(n, p) for n, p in _pages(self.folder)]


class _StreamReader(_PageReader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max([n for n, _ in _pages(self.folder)], default=-1)}

    def partitions(self, start: dict, end: dict) -> list[PageOfItems]:
        return [PageOfItems(n, p) for n, p in _pages(self.folder) if start["page"] < n <= end["page"]]


class PagedItems(DataSource):
    """``spark.read.format("paged_items").option("since", ...).load(folder)`` and its stream."""

    @classmethod
    def name(cls) -> str:
        return "paged_items"

    def schema(self) -> str:
        return ITEM

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _BatchReader(self.options["path"], self.options.get("since"))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"], self.options.get("since"))


def since_for(watermark: str | None, gap_minutes: int = GAP_MINUTES) -> str | None:
    """From when on items are read again: the watermark less a gap."""
    from datetime import datetime, timedelta

    return None if watermark is None else (datetime.fromisoformat(watermark) - timedelta(minutes=gap_minutes)).isoformat(" ")


def latest_copies(items: DataFrame) -> DataFrame:
    """One row a number: the last updated, of equal ones the one on the later page."""
    order = Window.partitionBy("number").orderBy(F.desc("updated_at"), F.desc("page"), F.xxhash64("title", "body", "state"))
    return items.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def rendered(items: DataFrame, repository: str) -> DataFrame:
    """Items as pages: slug, title, a body of markdown, and a hash of what was rendered."""
    labels = F.when(F.coalesce(F.length("labels"), F.lit(0)) > 0, F.concat(F.lit("\nLabels: "), F.col("labels"))).otherwise(F.lit(""))
    body = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\nState: "), F.coalesce("state", F.lit("")), labels, F.lit("\n\n"), F.coalesce("body", F.lit("")))
    out = items.select(F.concat(F.lit(f"github/{repository}/"), "number").alias("slug"), "number", "title", body.alias("body"), "state", "updated_at")
    return out.withColumn("content_hash", F.sha2(F.concat_ws("\n", "slug", "body"), 256))


def page_store(spark: SparkSession, folder: str, parts: int = 16) -> Store:
    """Pages of items, dealt to parts by their slug."""
    return Store(spark, folder, PAGE, F.pmod(F.xxhash64("slug"), F.lit(parts)))


def sync(store: Store, pages: str, connector: str, repository: str, state: str, refused: Column | None = None) -> Manifest:
    """Read all new pages once and put their items; ``state`` is the stream's own folder. The watermark is the latest update that was put, and never
    moves back. Items that are ``refused`` are left out; they hold the watermark no more than others do."""
    spark = store.spark
    spark.dataSource.register(PagedItems)
    mark = f"watermark:{connector}"

    def put(batch: DataFrame, batch_id: int) -> None:
        newest = latest_copies(batch).persist()
        try:
            top = newest.agg(F.max("updated_at").cast("string")).first()[0]
            before = store.manifest().facts.get(mark)
            facts = {mark: max(filter(None, (top, before)))} if top or before else {}
            taken = newest if refused is None else newest.where(~F.coalesce(refused, F.lit(False)))
            store.upsert(rendered(taken, repository), ["slug"], "updated_at", f"{connector}:{state}", batch_id, facts)
        finally:
            newest.unpersist()

    stream = spark.readStream.format("paged_items").load(pages)
    stream.writeStream.option("checkpointLocation", state).foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return store.manifest()
