"""Access counters as a stream with state: how often each document was used within the retention, and when last.

A document's state is a map from days to counts. A timer for each day clears it once the watermark, which lags behind the latest
access by the retention, has passed the day's end; so a late access counts as long as its day is kept, and state doesn't grow
with the log. ``counted`` gives the same for a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

#: State with timers needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "doc_id string, added long, kept long, last timestamp"
DAY_MS = 86_400_000


class Counter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day long", "n long, last long")

    def _row(self, key: tuple, added: int) -> pd.DataFrame:
        held = [value for _, value in self.days.iterator()]
        last = max((v[1] for v in held), default=None)
        stamp = None if last is None else pd.Timestamp(last, unit="us")
        return pd.DataFrame({"doc_id": [key[0]], "added": [added], "kept": [sum(v[0] for v in held)], "last": pd.Series([stamp], dtype="datetime64[us]")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        added = 0
        for batch in rows:
            micros = batch["micros"].astype("int64")
            added += len(batch)
            for day, part in micros.groupby(micros // (DAY_MS * 1000)):
                at = (int(day),)
                n, last = self.days.getValue(at) if self.days.containsKey(at) else (0, int(part.iloc[0]))
                self.days.updateValue(at, (int(n) + len(part), max(int(last), int(part.max()))))
                self.handle.registerTimer((int(day) + 1) * DAY_MS)
        yield self._row(key, added)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the days that ended by this timer
        day = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS - 1
        if self.days.containsKey((day,)):
            self.days.removeKey((day,))
            yield self._row(key, 0)

    def close(self) -> None:
        pass


def counters(access: DataFrame, retention_days: int = 90) -> DataFrame:
    """(doc_id, added, kept, last) for each document that a batch of the stream ``access`` (doc_id, ts) changes: its accesses in
    that batch, those within the retention, and the latest of these. Accesses whose day is no longer kept are dropped."""
    marked = access.where("doc_id is not null and ts is not null").withColumn("micros", F.unix_micros("ts")).withWatermark("ts", f"{retention_days} days")
    return marked.groupBy("doc_id").transformWithStateInPandas(Counter(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def counted(access: DataFrame, retention_days: int = 90) -> DataFrame:
    """(doc_id, kept, last) of a batch: what ``counters`` has come to after the same rows."""
    seen = access.where("doc_id is not null and ts is not null")
    floor = seen.agg((F.max(F.unix_millis("ts")) - retention_days * DAY_MS).alias("floor_"))
    day_end = (F.floor(F.unix_millis("ts") / F.lit(DAY_MS)) + 1) * DAY_MS
    kept = seen.crossJoin(F.broadcast(floor)).where(day_end > F.col("floor_"))
    return kept.groupBy("doc_id").agg(F.count("*").alias("kept"), F.max("ts").alias("last"))


def count_into(store, access: DataFrame, checkpoint: str, name: str = "accesses", retention_days: int = 90) -> StreamingQuery:
    """Starts a query that appends the accesses of ``access`` to the store's counters. A batch that is done again after a crash
    isn't counted again."""

    def put(rows: DataFrame, batch: int) -> None:
        new = rows.where("added > 0").select("doc_id", F.col("added").alias("n"), "last")
        store.append("document_counters", new, batch=(name, batch))

    return counters(access, retention_days).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).start()
