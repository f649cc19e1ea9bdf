"""Windows and sessions over a stream of files give what a batch gives, and rows later than the watermark are dropped."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewell.sources.catalog import Catalog
from tidewell.streaming import counters
from tidewell.streaming.access import sessions, windowed

START = datetime(2024, 1, 1)
SCHEMA = "doc_id string, access_type string, score double, ts timestamp"


def rows(spark, minutes, doc="a"):
    return spark.createDataFrame([(doc, "search", float(m), START + timedelta(minutes=m)) for m in minutes], SCHEMA).coalesce(1)


def streamed(spark, folder, make, name, batches):
    """Feeds the batches one after another; what the query has put out in the end."""
    (folder / name).mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder / name))
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for batch in batches:
            batch.write.mode("append").parquet(str(folder / name))
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_sessions_of_a_batch(spark):
    found = sessions(rows(spark, [0, 10, 39, 80, 81]).unionByName(rows(spark, [5], "b"))).orderBy("doc_id", "start").collect()
    minutes = lambda t: int((t - START).total_seconds() // 60)
    assert [(r["doc_id"], minutes(r["start"]), minutes(r["end"]), r["n"]) for r in found] == [("a", 0, 69, 3), ("a", 80, 111, 2), ("b", 5, 35, 1)]


def test_windows_drop_late_rows(spark, tmp_path):
    late = [rows(spark, [0, 30, 61]), rows(spark, [300]), rows(spark, [20]), rows(spark, [600])]
    found = streamed(spark, tmp_path, lambda s: windowed(s, "1 hour", late="2 hours"), "windows", late)
    counts = {int((r["start"] - START).total_seconds() // 3600): r["n"] for r in found}
    assert counts[0] == 2 and counts[1] == 1  # the row of minute 20 came after its window was closed
    batch = {int((r["start"] - START).total_seconds() // 3600): r["n"] for r in windowed(rows(spark, [0, 30, 61, 300, 20, 600]), "1 hour").collect()}
    assert batch[0] == 3


def test_sessions_of_a_stream(spark, tmp_path):
    batches = [rows(spark, [0, 10]), rows(spark, [35]), rows(spark, [500]), rows(spark, [1000])]
    found = streamed(spark, tmp_path, lambda s: sessions(s, late="1 hour"), "sessions", batches)
    assert {(int((r["start"] - START).total_seconds() // 60), r["n"]) for r in found} >= {(0, 3)}
    assert sessions(rows(spark, [0, 10, 35])).agg(F.sum("n")).first()[0] == 3


def accesses(spark, *rows):
    return spark.createDataFrame([(doc, "search", 1.0, START + timedelta(days=d)) for doc, d in rows], SCHEMA).coalesce(1)


def test_counters_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    """Late rows within the retention count, days that are over it leave, and a restart goes on from its state."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", counters.STORE)
    batches = [
        accesses(spark, ("a", 0), ("a", 0.5), ("b", 1)),
        accesses(spark, ("a", 40), ("c", 80)),
        accesses(spark, ("a", 12), ("b", 79.5)),  # late, within the retention
        accesses(spark, ("c", 120)),
        accesses(spark, ("c", 120.1), ("b", 45)),
        accesses(spark, ("d", 120.1)),
    ]
    folder, store, latest = tmp_path / "log", Catalog(spark, str(tmp_path / "s")), {}
    folder.mkdir()
    stream = spark.readStream.schema(SCHEMA).parquet(str(folder))

    def put(rows, batch):
        # of the rows of a batch for one document the one with additions is followed by those of its timers
        for r in sorted(rows.collect(), key=lambda r: -r["added"]):
            latest[r["doc_id"]] = (r["kept"], r["last"])

    for part in (batches[:3], batches[3:]):  # a second start goes on from the first one's state
        query = counters.counters(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "one")).foreachBatch(put).start()
        into = counters.count_into(store, stream, str(tmp_path / "two"))
        try:
            for batch in part:
                batch.write.mode("append").parquet(str(folder))
                query.processAllAvailable()
                into.processAllAvailable()
        finally:
            query.stop()
            into.stop()
    whole = batches[0]
    for batch in batches[1:]:
        whole = whole.unionByName(batch)
    batch = {r["doc_id"]: (r["kept"], r["last"]) for r in counters.counted(whole).collect()}
    assert {d: v for d, v in latest.items() if v[0]} == batch and batch["a"][0] == 1 and batch["b"][0] == 2
    added = {r["doc_id"]: r["n"] for r in store.read("document_counters").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    assert added == {"a": 4, "b": 3, "c": 3, "d": 1}


def test_a_batch_that_is_done_again_counts_once(spark, tmp_path):
    store = Catalog(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", 2, START)], "doc_id string, n long, last timestamp")
    for number in (0, 0, 1, 1, 0):
        store.append("document_counters", rows, batch=("accesses", number))
    store.append("document_counters", rows, batch=("others", 0))
    assert store.read("document_counters").agg(F.sum("n")).first()[0] == 6
