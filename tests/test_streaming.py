import random

from pyspark.sql import functions as F

from pathloom.sources import replay
from pathloom.streaming import events as ev
from pathloom.streaming import limits

EVENTS = "session_id long, seq int, ts_ms long, type string, hop_number int, rtt_ms double, hostname string"


def log(spark):
    rows = [
        (1, 1, 10, "measurement_started", None, None, None), (1, 2, 20, "hop_result", 2, 5.0, "b"), (1, 3, 30, "hop_result", 1, 7.0, "a"), (1, 4, 40, "hop_result", 1, 9.0, None),
        (1, 5, 50, "metric_update", 8, 1.0, None), (1, 6, 60, "metric_update", 2, 6.0, "ignored"),
        (2, 1, 10, "hop_result", 1, 1.0, "x"), (2, 2, 20, "measurement_finished", None, None, None), (2, 3, 30, "hop_result", 3, None, "y"), (3, 1, 5, "error", None, None, None),
    ]
    return spark.createDataFrame(rows, EVENTS)


def hops(df):
    return sorted((r.session_id, r.hop_number, r.rtt_ms, r.hostname) for r in df.collect())


def test_upserts_and_reducer(spark):
    assert hops(ev.upserted(log(spark))) == [(1, 1, 9.0, "a"), (1, 2, 5.0, "b"), (2, 1, 1.0, "x"), (2, 3, None, "y")]
    assert hops(ev.reduced(log(spark))) == [(1, 1, 9.0, "a"), (1, 2, 6.0, "b"), (2, 3, None, "y")]


def test_sessions(spark):
    got = {r.session_id: (r.status, r.expires_ms) for r in ev.statuses(log(spark)).collect()}
    assert got == {1: ("running", 900_010), 2: ("finished", 120_020), 3: ("error", 120_005)}
    assert {r.session_id: r.type for r in ev.latest_result(log(spark)).collect()} == {1: "measurement_started", 2: "measurement_finished"}
    s = spark.range(600).select(F.col("id").alias("session_id"), F.col("id").alias("created_ms"))
    assert ev.capped(s).agg(F.min("session_id"), F.count("*")).first()[0:2] == (100, 500)


def test_payload_lists_and_metrics(spark):
    rows = [
        (1, 1, "measurement_started", None, None, None, None, [(1, 5.0, "a"), (2, 6.0, None)]), (1, 2, "metric_update", 2, 7.0, 1.5, "ignored", None), (1, 3, "hop_result", 3, 1.0, None, "c", None),
        (1, 4, "metric_update", 3, None, 2.5, None, None), (2, 1, "hop_result", 1, 1.0, None, "x", None), (2, 2, "measurement_finished", None, None, None, None, [(9, 2.0, "z")]),
        (3, 1, "metric_update", 1, 4.0, None, None, None), (3, 2, "hop_result", 1, None, None, "late", None), (4, 1, "hop_result", 1, 1.0, None, None, None), (4, 2, "measurement_finished", None, None, None, None, []),
    ]
    df = spark.createDataFrame(rows, "session_id long, seq int, type string, hop_number int, rtt_ms double, jitter_ms double, hostname string, hops array<struct<hop_number: int, rtt_ms: double, hostname: string>>")
    got = sorted((r.session_id, r.hop_number, r.rtt_ms, r.jitter_ms, r.hostname) for r in ev.reduced(df).collect())
    assert got == [(1, 1, 5.0, None, "a"), (1, 2, 7.0, 1.5, None), (1, 3, 1.0, 2.5, "c"), (2, 9, 2.0, None, "z"), (3, 1, None, None, "late")]


def test_failover_and_attempts(spark):
    kind = "session_id int, seq int, type string"
    live = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (2, 2, "error"), (4, 1, "error"), (5, 1, "c"), (5, 2, "error")], kind)
    demo = spark.createDataFrame([(1, 1, "d"), (2, 1, "d"), (3, 1, "d"), (4, 1, "d"), (4, 2, "error")], kind)
    got = sorted((r.session_id, r.seq, r.source, r.type) for r in ev.failed_over(live, demo).collect())
    assert got == [(1, 1, "live", "a"), (2, 1, "live", "b"), (2, 2, "demo", "d"), (3, 1, "demo", "d"), (4, 1, "demo", "d"), (4, 2, "demo", "error"), (5, 1, "live", "c"), (5, 2, "demo", "error")]
    assert {r.message for r in ev.failed_over(live, demo).where("type = 'error'").collect()} == {ev.SAFE_ERROR}
    tries = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "session_id int, attempt int")
    assert ev.last_attempt(tries).count() == 3
    polls = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 1), (1, 4, 4)], "session_id int, poll int, n_hops int")
    assert sorted((r.poll, r.hop_seq) for r in ev.new_hops(polls).collect()) == [(2, 1), (2, 2), (4, 3), (4, 4)]


def test_frames(spark):
    assert ev.sse_frames(log(spark)).where("seq = 5").first().frame == 'event: metric_update\ndata: {"ts_ms":50,"type":"metric_update","hop_number":8,"rtt_ms":1.0}\n\n'


def requests(spark, times):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "client long, seq int, ts_ms long")


def test_rate_limit(spark):
    said = lambda times: [r.allowed for r in limits.limited(requests(spark, times)).orderBy("seq").collect()]
    assert said([0] * 9 + [60_000, 60_001]) == [True] * 8 + [False] * 2 + [True]
    assert said([i * 60_001 // 8 for i in range(90)]).count(True) == 80
    assert limits.limited(requests(spark, [0]).limit(0)).count() == 0


def written(spark, folder, files=3, n=120):
    rng = random.Random(1)
    rows = [(rng.randrange(4), i, 1_000 * i + rng.randrange(900), rng.choice(replay.TYPES), rng.randrange(1, 5), rng.choice([None, 5.0 + i]), rng.choice([None, f"h{i}"])) for i in range(n)]
    lines = spark.createDataFrame(rows, EVENTS).select("seq", F.to_json(F.struct("*")).alias("value"))
    for k in range(files):
        lines.where(F.col("seq").between(n // files * k, n // files * (k + 1) - 1)).select("value").coalesce(1).write.mode("append").text(folder)
    return spark.createDataFrame(rows, EVENTS)


def finished(query):
    assert query.awaitTermination(120)


def test_upserts_on_a_stream(spark, tmp_path):
    written(spark, str(tmp_path / "log"))
    events = replay.batch(spark, str(tmp_path / "log"))
    assert events.count() == 120
    finished(ev.upserted(replay.stream(spark, str(tmp_path / "log"), 1)).writeStream.format("memory").queryName("hops").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    assert hops(spark.table("hops")) == hops(ev.upserted(events))


def test_limits_on_a_stream(spark, tmp_path):
    written(spark, str(tmp_path / "log"))
    requests_ = lambda e: e.select(F.col("session_id").alias("client"), "seq", (F.col("ts_ms") / 20).cast("long").alias("ts_ms"))
    finished(limits.limited_stream(requests_(replay.stream(spark, str(tmp_path / "log"), 1))).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    key = lambda df: sorted((r.seq, r.allowed) for r in df.collect())
    batch = limits.limited(requests_(replay.batch(spark, str(tmp_path / "log"))))
    assert key(spark.table("limited")) == key(batch) and not all(a for _, a in key(batch))


def test_sessions_expire_on_a_stream(spark, tmp_path):
    folder = str(tmp_path / "log")
    late = spark.createDataFrame([(9, 500, 10_000_000, "measurement_started", None, None, None)], EVENTS)
    rows = written(spark, folder, 1)
    late.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(folder)
    finished(ev.session_stream(replay.stream(spark, folder, 1)).writeStream.format("memory").queryName("sessions").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start())
    got = spark.table("sessions").collect()
    want = {r.session_id: (r.status, r.created_ms, r.expires_ms, r.n_events) for r in ev.statuses(rows).collect()}
    assert {r.session_id: (r.status, r.created_ms, r.expires_ms, r.n_events) for r in got if r.expired} == want
    assert [r.status for r in got if r.session_id == 9] == ["running"]


def test_server_sent_events_are_read_back(spark, tmp_path):
    events = written(spark, str(tmp_path / "log"), 1, 30)
    ev.sse_frames(events.withColumn("session_id", F.col("session_id"))).select(F.expr("substring(frame, 1, length(frame) - 2)").alias("value")).coalesce(1).write.option("lineSep", "\n\n").text(str(tmp_path / "sse"))
    got = replay.sse_batch(spark, str(tmp_path / "sse"))
    key = lambda df: sorted((r.ts_ms, r.type, r.hop_number, r.rtt_ms, r.hostname) for r in df.collect())
    assert str(key(got)) == str(key(events))
    assert replay.frame_data(spark.createDataFrame([(": comment",), ("event: x\ndata: a\ndata: b",)], "value string")).first().value == "a\nb"


def test_every_session_is_marked_by_the_cap(spark):
    rows = [(i, None if i == 7 else i // 2) for i in range(8)]
    s = spark.createDataFrame(rows, "session_id long, created_ms long")
    got = {r.session_id: r.kept for r in ev.cap_marked(s, 3).collect()}
    assert got == {i: i in (4, 5, 6) for i in range(8)} and ev.cap_marked(s, 9).where("kept").count() == 8


def test_the_cap_query_loses_no_session(spark):
    from pathloom.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["session_cap"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count() > 10
