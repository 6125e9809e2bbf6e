"""Admission, windowed counts and incremental ingest as streams: late rows, expiry, retried batches."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from listmill import schema
from listmill.plans import feed_queries as Q
from listmill.sources import feeds
from listmill.streaming import events as E

FIELDS = "request_id bigint, scope string, client bigint, s bigint"


def one_by_one(rows, limit, window):
    held, out = {}, {}
    for i, scope, client, s in sorted(rows, key=lambda r: (r[3], r[0])):
        h = [t for t in held.get((scope, client), []) if t > s - window]
        out[i] = len(h) < limit
        held[scope, client] = h + [s] if out[i] else h
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, FIELDS).withColumn("at", F.timestamp_seconds("s"))


def test_admission_in_batches_equals_one_pass(spark):
    rng = random.Random(2)
    # a third of the requests come from one client, and more than one Arrow batch of it
    rows = [(i, rng.choice("ab"), 0 if rng.random() < 0.34 else rng.randrange(1, 9), rng.randrange(0, 4_000)) for i in range(900)]
    rows.sort(key=lambda r: r[3])
    want = one_by_one(rows, 3, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        state, got = None, {}
        for part in (rows[:200], rows[200:210], rows[210:]):
            answers, state = E.admit(frame(spark, part), state, "at", 3, 60)
            got |= {r.request_id: r.admitted for r in answers.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and 0 < sum(want.values()) < len(rows)
    assert state.filter(F.size("held") > 3).count() == 0


def test_admission_of_many_clients_costs_no_frame_per_client():
    rows = [(i, "ab"[i % 2], i // 4, i % 3 * 40) for i in range(80_000)]
    pdf = pd.DataFrame(rows, columns=["request_id", "scope", "client", "s"]).assign(_kind=1, _us=lambda d: d["s"] * 1_000_000, held=None)
    pdf = pdf.sort_values(["scope", "client", "_us", "request_id"])
    start = time.perf_counter()
    batches = (pdf.iloc[i : i + 10_000] for i in range(0, len(pdf), 10_000))
    out = pd.concat(list(E._admit_sorted(["scope", "client"], "request_id", 1, 60 * 1_000_000)(batches)))
    took = time.perf_counter() - start
    asked = out[out["admitted"].notna()]
    assert dict(zip(asked["request_id"], asked["admitted"])) == one_by_one(rows, 1, 60)
    assert out["admitted"].isna().sum() == 40_000
    # a frame a client took minutes
    assert took < 20


def test_admission_state_is_empty_after_the_window(spark):
    _, state = E.admit(frame(spark, [(1, "a", 1, 0), (2, "a", 2, 30)]), None, "at", 2, 60)
    assert {r.client for r in state.collect()} == {1, 2}
    answers, state = E.admit(frame(spark, [(3, "a", 3, 200)]), state, "at", 2, 60)
    # the request of 200 s puts the clock past both windows
    assert {r.client for r in state.collect()} == {3} and answers.count() == 1
    answers, state = E.admit(frame(spark, []), state, "at", 2, 60)
    assert answers.count() == 0 and state.count() == 1


def test_late_events_count_until_the_watermark_has_passed(spark, tmp_path):
    def put(name, rows):
        df = spark.createDataFrame(rows, "id bigint, placement_id string, event_type string, s bigint")
        df.withColumn("created_at", F.timestamp_seconds("s")).drop("s").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    day = 86_400
    put("1", [(1, "p", "click", 10), (2, "p", "impression", day + 10)])
    df = spark.read.parquet(f"{tmp_path}/in/1")

    def run():
        s = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        counts = E.running_counts(s, window="1 day", watermark="6 hours")
        q = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/ck").option("path", f"{tmp_path}/out")
        q.trigger(availableNow=True).start().awaitTermination()
        return {(r.window.start.isoformat()[:10], r.placement_id): (r.impressions, r.clicks) for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    try:
        run()
    except Exception as e:
        # nothing has been put out yet
        assert "UNABLE_TO_INFER_SCHEMA" in str(e)
    # late by less than 6 hours after the watermark of the first file (day + 10 s - 6 h): still counted
    put("2", [(3, "p", "click", 20), (4, "p", "click", 2 * day)])
    assert run() == {("1970-01-01", "p"): (0, 2)}
    # the first day is closed now: a click for it is dropped, one for the second day counts
    put("3", [(5, "p", "click", 30), (6, "p", "click", day + 30), (7, "p", "click", 9 * day)])
    assert run() == {("1970-01-01", "p"): (0, 2), ("1970-01-02", "p"): (1, 1), ("1970-01-03", "p"): (0, 1)}


class Fails(Q.SnapshotStore):
    """Stops once, after a batch's work is stored and before the stream knows."""

    broken = True

    def commit(self, batch_id, snapshot, actions, checked):
        super().commit(batch_id, snapshot, actions, checked)
        if self.broken and batch_id == 0:
            self.broken = False
            raise RuntimeError("lost")


def numbered(stored, raw, sources, order, as_of_date, at):
    """Stands in for map, validate, de-duplicate and merge: keeps what the stream itself decides, order and time."""
    rows = raw.select(F.col(order).alias("id"), "title", at.alias("created_at"))
    snapshot = stored.unionByName(rows, allowMissingColumns=True)
    return snapshot, rows.select("id", "title", F.lit("inserted").alias("action")), raw


def test_a_retried_batch_has_the_same_order_time_and_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("listmill.plans.ingest.ingest", numbered)
    folder = f"{tmp_path}/payloads"
    for kind in ("jobicy_api", "jobicy_api"):
        Q.payloads(spark, "/root/testdata/sf0.001", kind).coalesce(1).write.mode("append").parquet(folder)
    known = Q.settings(spark)

    def ingest(store, name):
        E.ingest_stream(
            spark, folder, schema.FEED_PAYLOADS, lambda p: feeds.jobicy(p, known), Q.ingest_settings(spark), store, F.lit("2024-07-01").cast("date"), f"{tmp_path}/{name}-ck"
        ).awaitTermination()
        return sorted(map(tuple, store.read().select("id", "title").collect()))

    first = spark.createDataFrame([], schema.JOBS)
    once = ingest(Q.SnapshotStore(spark, f"{tmp_path}/a", first), "a")
    assert [i for i, _ in once] == list(range(1, len(once) + 1)) and len(once) > 100
    store = Fails(spark, f"{tmp_path}/b", first)
    with pytest.raises(Exception, match="lost"):
        ingest(store, "b")
    tried = sorted(map(tuple, store.read().select("id", "title", "created_at").collect()))
    assert ingest(store, "b") == once
    assert sorted(map(tuple, store.read().select("id", "title", "created_at").collect())) == tried
    changed = [sorted(r.url for r in spark.read.parquet(f"{tmp_path}/{n}/changed").collect()) for n in "ab"]
    assert changed[0] == changed[1] and len(changed[0]) == len(once)
    bad = [spark.read.parquet(f"{tmp_path}/{n}/bad").count() for n in "ab"]
    assert bad[0] == bad[1] > 0
