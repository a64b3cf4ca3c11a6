"""Structured Streaming: gap-healed reads, daily counters, sessions, token buckets, idempotent upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP = "15 minutes"


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream, timestamps in the session zone."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[t]")  # a pattern also takes a table that is one file
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName().startswith("timestamp")})


def healed(events: DataFrame, keys: list[str], at: str = "ts", gap: str = GAP) -> DataFrame:
    """Events read again within the gap are dropped; state is kept for the gap alone."""
    return events.withWatermark(at, gap).dropDuplicatesWithinWatermark(keys)


def daily_counters(events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """Counts and sums of each day and key."""
    return events.groupBy(F.window(at, "1 day").alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.to_date("w.start").alias("day"), *keys, "n", "total")


def sliding_counts(events: DataFrame, kind: str, at: str = "ts", size: str = "24 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window(at, size, step).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.end").alias("until"), kind, "n")


def sessions(events: DataFrame, key: str, at: str = "ts", gap: str = "30 minutes") -> DataFrame:
    return events.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n")


def token_bucket(calls: DataFrame, key: str, at: str = "ts", capacity: float = 10.0, per_second: float = 0.01) -> DataFrame:
    """(key, ts, allowed): a bucket for each key that refills with time; idle buckets are forgotten once they would be full."""

    def admit(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(at)
        allowed = []
        for t in rows[at]:
            second = t.timestamp()
            if last is not None:
                tokens = min(capacity, tokens + max(0.0, second - last) * per_second)
            last = second if last is None else max(last, second)
            allowed.append(tokens >= 1)
            tokens -= tokens >= 1
        state.update((tokens, last))
        state.setTimeoutTimestamp(max(int((last + capacity / per_second) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: name[0], at: rows[at], "allowed": allowed})

    kind = calls.schema[key].dataType.simpleString()
    return calls.select(key, at).withWatermark(at, GAP).groupBy(key).applyInPandasWithState(admit, f"{key} {kind}, {at} timestamp, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it wrote below ``folder``, which the cluster shares.

    Each batch replaces its own part (or, in complete mode, the whole), so a batch that is run again writes the same.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={0 if mode == 'complete' else batch_id}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").select(*stream.columns)
