"""Stored lookups, sessions and logs that a stream keeps up to date, over restarts and repeated batches."""

import random

from pyspark.sql import functions as F

from pathloom.operators import fusion
from pathloom.sources import replay, stores
from pathloom.streaming import events as ev
from pathloom.streaming import live

EVENTS = "session_id long, seq int, ts_ms long, type string, hop_number int, rtt_ms double, hostname string"


def finished(q):
    assert q.awaitTermination(120)


def test_no_address_is_looked_up_twice(spark, tmp_path):
    asked = []
    records = spark.createDataFrame([(f"9.9.9.{i}", f"C{i}", "DE", 1.0 * i, 2.0, f"p{i}.icn.net") for i in range(0, 40, 2)], "ip string, geo_city string, geo_country string, geo_latitude double, geo_longitude double, ptr_hostname string")

    def ask(ips):
        asked.append([r.ip for r in ips.collect()])
        return ips.join(records, "ip")

    folder, kind = str(tmp_path / "hops"), "ip string, n int"
    kept = stores.Lookups(spark, str(tmp_path / "lookups"), ask)
    put = lambda some: spark.createDataFrame([(None if i is None else f"9.9.9.{i}", 1) for i in some], kind).coalesce(1).write.mode("append").json(folder)

    def run():
        finished(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(folder).writeStream.foreachBatch(kept.add).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start())

    put([0, 1, 1, 2, None])
    put([1, 2, 3])
    run()
    put([3, 4, 0])
    run()
    assert sorted(x for a in asked for x in a) == [f"9.9.9.{i}" for i in range(5)]
    assert sorted((r.ip, r.found, r.geo_city) for r in kept.table().collect()) == [(f"9.9.9.{i}", i % 2 == 0, f"C{i}" if i % 2 == 0 else None) for i in range(5)]
    # The last batch once more, as after a crash: the same table.
    last = kept.versions.numbers()[-1]
    kept.add(spark.createDataFrame([("9.9.9.3", 1), ("9.9.9.4", 1), ("9.9.9.0", 1)], kind), last)
    assert kept.table().count() == 5 and asked[-1] == ["9.9.9.4"]
    hops = spark.createDataFrame([("9.9.9.4", None, 1), ("9.9.9.3", None, 2)], "ip string, hostname string, hop_seq int")
    got = {r.hop_seq: (r.hostname, r.geo_city, r.m_host and r.m_host.city) for r in fusion.looked_up(hops, kept.geo(), kept.ptr()).collect()}
    assert got == {1: ("p4.icn.net", "C4", "Seoul"), 2: (None, None, None)}


def test_sessions_are_capped_and_expire(spark, tmp_path):
    rng = random.Random(5)
    batches = []
    for b in range(4):
        new = [(100 * b + i, 1, 60_000 * b + rng.randrange(50_000), "measurement_started", None, None, None) for i in range(30)]
        ends = [(100 * (b - 1) + i, 2, 60_000 * b + i, "measurement_finished", None, None, None) for i in range(0, 30, 3)] if b else []
        batches.append(new + ends)
    kept = stores.Sessions(spark, str(tmp_path / "sessions"), most=40)
    known = {}
    for b, rows in enumerate(batches):
        for _ in range(2):  # each batch is run twice
            kept.add(spark.createDataFrame(rows, EVENTS).repartition(3), b)
        now = max(r[2] for r in rows)
        for s, _, ts, kind, *_ in rows:
            if kind == "measurement_started" or s in known:
                old = known.get(s, (ts, None))
                known[s] = (min(old[0], ts), ts if kind in ev.ENDING else old[1])
        live_ = {s: v for s, v in known.items() if v[0] + ev.TTL_MS >= now and (v[1] is None or v[1] + ev.ENDED_TTL_MS >= now)}
        known = dict(sorted(live_.items(), key=lambda x: (-x[1][0], -x[0]))[:40])
        got = {r.session_id: (r.created_ms, r.ended_ms) for r in kept.table().collect()}
        assert got == known
    assert len(known) == 40 and {r.status for r in kept.table().collect()} == {"running", "finished"}
    late = spark.createDataFrame([(7, 9, 10_000_000, "hop_result", 1, 1.0, None)], EVENTS)
    kept.add(late, 9)
    assert kept.table().count() == 0  # all are over, and a hop alone starts none


def test_replay_then_follow(spark, tmp_path):
    rng = random.Random(6)
    rows = [(s, i, 1_000 * i, "hop_result", i % 5, float(i), None) for s in range(8) for i in range(40)]
    log, live_ = str(tmp_path / "stored"), str(tmp_path / "live")
    replay.store(spark.createDataFrame([r for r in rows if r[1] < 15], EVENTS), log, 8)
    replay.store(spark.createDataFrame([r for r in rows if 15 <= r[1] < 20], EVENTS), log, 8)
    for k in range(3):  # the stream holds some of what is stored, and much of it twice
        part = [r for r in rows if 10 * k + 8 <= r[1] < 10 * k + 22]
        spark.createDataFrame(rng.sample(part + part, 2 * len(part)), EVENTS).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(live_)
    stream = replay.stream(spark, live_, 1).select("session_id", "seq", "ts_ms", "type", "hop_number", "rtt_ms", "hostname")
    before, after = replay.subscription(spark, log, stream, 3, 8)
    plan = before._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(part" in plan and "PushedFilters: [IsNotNull(session_id), EqualTo(session_id,3)]" in plan
    finished(after.writeStream.format("memory").queryName("followed").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start())
    assert sorted(r.seq for r in before.collect()) == list(range(20))
    assert sorted(r.seq for r in spark.table("followed").collect()) == list(range(20, 40))
    none, rest = replay.subscription(spark, log, stream, 99, 8)
    assert none.count() == 0 and rest.isStreaming


def test_failover_on_streams(spark, tmp_path):
    sessions = [(i, 100_000 + 1_000 * i) for i in range(30)]
    events = [(i, 100_000 + 1_000 * i + (5_000 if i % 3 else 50_000), "measurement_finished" if i % 5 else "error") for i in range(30) if i % 2]
    created, live_ = str(tmp_path / "created"), str(tmp_path / "live")
    kinds = ("session_id long, created_ms long", "session_id long, ts_ms long, type string")
    for folder, rows, kind, end in ((created, sessions, kinds[0], (900, 10_000_000)), (live_, events, kinds[1], (901, 10_000_000, "hop_result"))):
        for part in (rows[::2], rows[1::2]):
            spark.createDataFrame(part, kind).coalesce(1).write.mode("append").json(folder)
        spark.createDataFrame([end if kind == kinds[0] else (901, 10_000_000, "measurement_finished")], kind).coalesce(1).write.mode("append").json(folder)
    read = lambda folder, kind: spark.readStream.schema(kind).json(folder)
    q = live.without_result(read(created, kinds[0]), read(live_, kinds[1])).writeStream.format("memory").queryName("fallen").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    finished(q)
    done = {s for s, ts, kind in events if kind == "measurement_finished" and ts - 100_000 - 1_000 * s <= live.DEADLINE_MS}
    assert sorted(r.session_id for r in spark.table("fallen").collect()) == [s for s, _ in sessions if s not in done]
    # What is over has left the state: only what came last is held.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    live_batch = spark.createDataFrame([(s, 1, kind) for s, _, kind in events], "session_id long, seq int, type string")
    demo = spark.createDataFrame([(s, 1, "measurement_finished") for s, _ in sessions], "session_id long, seq int, type string")
    taken = {r.session_id for r in ev.failed_over(live_batch, demo).where("source = 'demo'").collect()}
    late = {s for s, ts, kind in events if kind == "measurement_finished" and ts - 100_000 - 1_000 * s > live.DEADLINE_MS}
    assert taken | late == {r.session_id for r in spark.table("fallen").collect()}
