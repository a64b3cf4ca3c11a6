"""The ledger of items that connectors refused: keyed state that outlives runs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# fixed value: refusals that are kept of a connector
MAX_REFUSED = 200
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LEDGER = "connector string, version long, place int, slug string, code string, reason string, at timestamp"


class RefusedItems(StatefulProcessor):
    """For each connector a map of refused items and their order. A settled item leaves; one that is refused again moves to the end; beyond ``most`` the
    oldest leave at the end of a run. Each run gives the whole ledger of the connectors it touched, with the number of their run."""

    def __init__(self, most: int = MAX_REFUSED) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "slug string", "seq long, code string, reason string, at timestamp")
        self.clock = handle.getValueState("clock", "seq long, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        seq, version = self.clock.get() if self.clock.exists() else (0, 0)
        run = pd.concat(list(rows)).sort_values(["at", "slug", "settled"], kind="stable")
        # of a run only the last word on an item counts
        for r in run.drop_duplicates("slug", keep="last").itertuples(index=False):
            if r.settled:
                if self.items.containsKey((r.slug,)):
                    self.items.removeKey((r.slug,))
            else:
                seq += 1
                self.items.updateValue((r.slug,), (seq, r.code, r.reason, r.at.to_pydatetime()))
        held = sorted((v[0], k[0], v[1], v[2], v[3]) for k, v in self.items.iterator())
        for old in held[: max(0, len(held) - self.most)]:
            self.items.removeKey((old[1],))
        held = held[max(0, len(held) - self.most) :]
        self.clock.update((seq, version + 1))
        yield pd.DataFrame([(key[0], version + 1, i + 1, *h[1:]) for i, h in enumerate(held)] or [(key[0], version + 1, 0, None, None, None, None)], columns=[c.split()[0] for c in LEDGER.split(", ")])

    def close(self) -> None:
        pass


def refused_items(events: DataFrame, most: int = MAX_REFUSED) -> DataFrame:
    """The ledger after each run, from a stream of events (connector, slug, code, reason, at, settled). A run that leaves a connector without refusals gives one
    row of place 0."""
    return events.groupBy("connector").transformWithStateInPandas(RefusedItems(most), LEDGER, "Update", "None")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in the store that maps and timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
