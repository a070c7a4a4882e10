"""Live hop lists and attempts against batch and plain loops, over several micro-batches and restarts."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.sources import replay
from pathloom.streaming import events as ev
from pathloom.streaming import live

EVENTS = "session_id long, seq int, ts_ms long, type string, hop_number int, rtt_ms double, jitter_ms double, hostname string, status string, hops array<struct<hop_number: int, rtt_ms: double, hostname: string>>"
POLLS = "session_id long, seq int, ts_ms long, mode string, status string, n_hops int, failure string"


def made(rng, sessions=6, n=25):
    rows = []
    for s in range(sessions):
        for i in range(n):
            kind = rng.choice(["hop_result"] * 5 + ["metric_update"] * 4 + ["measurement_started", "measurement_finished", "error"])
            hops = [(k, float(k), rng.choice([None, f"l{k}"])) for k in range(1, rng.randint(1, 4))] if kind in ev.REPLACING and rng.random() < 0.7 else None
            value = lambda f: f if rng.random() < 0.7 else None
            rows.append((s, i + 1, 1_000 * (s + i), kind, rng.randint(1, 5), value(rng.random()), value(1.5 * i), value(f"h{i}"), value("ok"), hops))
    return rows


def write(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(folder)


def run(spark, df, tmp_path, mode, name):
    """One run over what is there; the rows of all its micro-batches are appended to a table of files."""
    out, at = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-at")
    q = df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", at).foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)).start()
    assert q.awaitTermination(180)
    return spark.read.parquet(out)


def latest(df, columns):
    """The last list of each session that isn't expired."""
    last = {}
    for r in df.where("not expired").collect():
        last[r.session_id] = max(last.get(r.session_id, 0), r.as_of)
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.where("not expired").collect() if r.as_of == last[r.session_id] and r.hop_number is not None)


@pytest.mark.parametrize("seed", [1, 2])
def test_live_hops_are_those_of_the_batch(spark, tmp_path, seed):
    rows, folder = made(random.Random(seed)), str(tmp_path / "log")
    rows.sort(key=lambda r: (r[1], r[0]))
    columns = ["session_id", "hop_number", "rtt_ms", "jitter_ms", "hostname", "status"]
    stream = lambda: live.live_hops(replay.stream(spark, folder, 1).select("session_id", "seq", "ts_ms", "type", "hop_number", "rtt_ms", "jitter_ms", "hostname", "status", "hops"))
    third = len(rows) // 3
    write(spark, folder, rows[:third], EVENTS)
    write(spark, folder, rows[third // 2 : 2 * third], EVENTS)  # some for the second time
    run(spark, stream(), tmp_path, "update", "hops")
    write(spark, folder, rows[2 * third :], EVENTS)
    got = run(spark, stream(), tmp_path, "update", "hops")  # goes on from its checkpoint
    want = ev.reduced(spark.createDataFrame(rows, EVENTS))
    assert got.select("batch").distinct().count() >= 3
    assert latest(got, columns) == sorted(repr(tuple(r[c] for c in columns)) for r in want.collect())


def test_live_hops_go_on_from_a_table_and_expire(spark, tmp_path):
    rows, folder = made(random.Random(3)), str(tmp_path / "log")
    old, new = [r for r in rows if r[1] <= 12], [r for r in rows if r[1] > 12]
    columns = ["session_id", "hop_number", "rtt_ms", "jitter_ms", "hostname", "status"]
    write(spark, folder, new, EVENTS)
    write(spark, folder, [(99, 1, 10_000_000, "hop_result", 1, None, None, None, None, None)], EVENTS)
    write(spark, folder, [(99, 2, 10_000_001, "hop_result", 2, None, None, None, None, None)], EVENTS)
    start = live.snapshot(spark.createDataFrame(old, EVENTS))
    got = run(spark, live.live_hops(replay.stream(spark, folder, 1).select(*[c.split()[0] for c in EVENTS.split(", ")[:9]], "hops"), start), tmp_path, "update", "from")
    want = ev.reduced(spark.createDataFrame(rows, EVENTS)).collect()
    assert [x for x in latest(got, columns) if not x.startswith("(99")] == sorted(repr(tuple(r[c] for c in columns)) for r in want)
    assert {r.session_id for r in got.where("expired").collect()} == set(range(6))


def plain(polls):
    """The events of polls in order, by the rules alone."""
    out = []
    for s in sorted({p[0] for p in polls}):
        state, deadline = (0, 0, None, False), None
        for _, seq, ts, mode, status, n, failure in sorted(p for p in polls if p[0] == s):
            state, events = live.after_poll(state, {"seq": seq, "ts_ms": ts, "mode": mode, "status": status, "n_hops": n, "failure": failure})
            out += [(s, *e[:3]) for e in events]
    return sorted(out, key=repr)


def test_attempts_end_once(spark, tmp_path):
    refused = "Private IP ranges are not allowed"
    polls = [
        (1, 1, 1_000, "mtr", "in-progress", 1, None), (1, 2, 2_000, "mtr", "failed", 0, refused), (1, 3, 3_000, "mtr", "in-progress", 2, None), (1, 4, 4_000, "mtr", "finished", 3, None), (1, 5, 5_000, "mtr", "finished", 3, None),
        (2, 1, 1_000, "traceout", "in-progress", 0, None), (2, 2, 1_500, "traceout", "failed", 0, refused),
        (3, 1, 1_000, "mtr", "failed", 0, refused), (3, 2, 2_000, "mtr", "failed", 0, refused),
        (4, 1, 1_000, "mtr", "in-progress", 2, None), (5, 1, 1_000, "mtr", "in-progress", 1, None), (5, 2, 2_000, "mtr", "failed", 0, "timeout"),
    ]
    folder = str(tmp_path / "polls")
    stream = lambda: live.attempts(spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).json(folder))
    put = lambda rows: spark.createDataFrame(rows, POLLS).coalesce(1).write.mode("append").json(folder)
    put([p for p in polls if p[1] <= 2])
    put([p for p in polls if p[1] >= 2])  # the second ones come twice
    run(spark, stream(), tmp_path, "append", "polls")
    # Time goes on: measurement 4 has had no answer by its deadline; an ending that comes late finds it over.
    put([(50, 1, 60_000, "mtr", "in-progress", 1, None)])
    put([(50, 2, 61_000, "mtr", "in-progress", 1, None), (4, 2, 55_000, "mtr", "finished", 2, None)])
    got = run(spark, stream(), tmp_path, "append", "polls").collect()
    events = sorted(((r.session_id, r.attempt, r.type, r.hop_seq) for r in got if r.session_id != 50), key=repr)
    assert events == sorted(plain(polls) + [(4, 0, "error", None)], key=repr)
    ends = [r.session_id for r in got if r.type in ev.ENDING]
    assert sorted(ends) == [1, 2, 3, 4, 5]
    assert [(r.attempt, r.protocol, r.hop_seq) for r in sorted(got, key=lambda r: (r.attempt, r.hop_seq or 0)) if r.session_id == 1 and r.type == "hop_result"] == [(0, "ICMP", 1), (1, "TCP", 1), (1, "TCP", 2), (1, "TCP", 3)]
    assert {r.type for r in got if r.session_id == 3 and r.attempt == 1} == {"measurement_started", "error"} and {r.packets for r in got if r.session_id == 2} == {None}
