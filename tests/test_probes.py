"""The connector of probe answers and the sink of frames, over restarts and repeated batches."""

import json
import os

from pyspark.sql import Row
from pyspark.sql import functions as F

from pathloom.sources import probes, replay
from pathloom.streaming import events as ev
from pathloom.streaming import live


def put(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def answer(i, ts, hops, status="in-progress", created=0, more=()):
    return {"id": f"m{i}", "createdMs": created, "tsMs": ts, "status": status, "results": [{"result": {"hops": [{"hop": k} for k in range(hops)]}, "n": i}, *more]}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_one_answer():
    row = lambda a: probes.answer_row(json.dumps(a), "p", 42_000)
    assert row(answer(1, 5, 2, more=({"n": "second"},))) == ("m1", "p", 5, "in-progress", 2, '{"result": {"hops": [{"hop": 0}, {"hop": 1}]}, "n": 1}')
    assert row(answer(1, 42_000, 1))[3:5] == ("in-progress", 1) and row(answer(1, 42_001, 1))[3:] == ("deadline", 0, None)
    assert row({"id": "x", "tsMs": 1}) == ("x", "p", 1, None, 0, None) and row({"id": "x", "tsMs": 1, "results": [], "status": 3}) == ("x", "p", 1, None, 0, None)
    assert row({"id": "x", "tsMs": 1, "results": ["odd"]}) == ("x", "p", 1, None, 0, '"odd"')
    assert row({"id": 1, "tsMs": 1}) is None and row([1]) is None and probes.answer_row("no json", "p", 1) is None


def test_stream_is_the_batch_after_a_restart(spark, tmp_path):
    spark.dataSource.register(probes.ProbeAnswers)
    folder, out, at = str(tmp_path / "polls"), str(tmp_path / "out"), str(tmp_path / "at")
    read = lambda reader: reader.format("probe_answers").option("filesPerPartition", 2).option("path", f"file://{folder}").load()

    def run():
        q = read(spark.readStream).writeStream.outputMode("append").option("checkpointLocation", at).trigger(availableNow=True).format("parquet").start(out)
        assert q.awaitTermination(120)

    for n in range(5):
        put(folder, f"{n:03d}.jsonl", [answer(i, 1_000 * n + i, n) for i in range(20)] + ["", "broken", "é{"])
    run()
    assert spark.read.parquet(out).count() == 100
    run()  # nothing new
    put(folder, "005.jsonl", [answer(i, 90_000, 3, "finished") for i in range(20)])
    put(folder, "006.jsonl", [answer(7, 6_000, 4, "finished", more=({"n": "second"},))])
    run()
    got, want = spark.read.parquet(out), read(spark.read)
    assert want.rdd.getNumPartitions() == 4 and rows(got.select(*want.columns)) == rows(want) and got.count() == 121
    assert got.where("status = 'deadline'").select(F.sum("n_hops"), F.count("payload")).first()[0:2] == (0, 0)
    os.makedirs(tmp_path / "none")
    assert spark.read.format("probe_answers").option("path", f"file://{tmp_path}/none").load().count() == 0


def test_answers_feed_attempts(spark, tmp_path):
    spark.dataSource.register(probes.ProbeAnswers)
    folder = str(tmp_path / "polls")
    for n, (hops, status) in enumerate([(1, "in-progress"), (3, "in-progress"), (3, "finished")]):
        put(folder, f"{n}.jsonl", [answer(i, 1_000 * n, hops, status) for i in range(3)])
    answers = spark.readStream.format("probe_answers").option("path", f"file://{folder}").load()
    polls = answers.select(F.substring("measurement_id", 2, 9).cast("long").alias("session_id"), F.split_part("poll", F.lit("."), F.lit(1)).cast("long").alias("seq"), "ts_ms", F.lit("traceout").alias("mode"), "status", "n_hops", F.lit(None).cast("string").alias("failure"))
    q = live.attempts(polls).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).format("memory").queryName("answered").start()
    assert q.awaitTermination(120)
    kinds = [r["type"] for r in spark.table("answered").where("session_id = 1").collect()]
    assert sorted(kinds) == ["hop_result"] * 3 + ["measurement_finished", "measurement_started"]


def events(spark, n, start=0):
    made = [(1, i, 1_000 * i, "hop_result", i % 7, float(i), f"h{i}") for i in range(start, start + n)]
    return spark.createDataFrame(made, "session_id long, seq int, ts_ms long, type string, hop_number int, rtt_ms double, hostname string")


def test_frames_are_written_once(spark, tmp_path):
    spark.dataSource.register(probes.Frames)
    folder, out, at = str(tmp_path / "log"), str(tmp_path / "frames"), str(tmp_path / "at")

    def run():
        frames = ev.sse_frames(replay.stream(spark, folder, 1).select("session_id", "seq", "ts_ms", "type", "hop_number", "rtt_ms", "hostname")).select("frame")
        q = frames.writeStream.format("frames").option("path", f"file://{out}").option("checkpointLocation", at).trigger(availableNow=True).start()
        assert q.awaitTermination(120)

    for k in range(3):
        events(spark, 20, 20 * k).select(F.to_json(F.struct("*")).alias("value")).coalesce(2).write.mode("append").text(folder)
    run()
    key = lambda df: sorted((r.ts_ms, r.type, r.hop_number, r.rtt_ms, r.hostname) for r in df.collect())
    assert key(replay.sse_batch(spark, out)) == key(events(spark, 60))
    # As if the driver had died after the sink's commit and before its own: the last batch runs again.
    last = max(int(n) for n in os.listdir(f"{at}/commits") if n.isdigit())
    for n in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{at}/commits/{n}"):
            os.remove(f"{at}/commits/{n}")
    events(spark, 5, 60).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("append").text(folder)
    run()
    assert key(replay.sse_batch(spark, out)) == key(events(spark, 65))
    assert os.listdir(f"{out}/.pending") == []


def test_a_failed_batch_leaves_nothing(tmp_path):
    w = probes._FrameWriter(f"file://{tmp_path}/f")
    first = w.write(iter([Row(frame="a\n\n"), Row(frame=None), Row(frame="b\n\n")]))
    w.abort([first, None], 0)
    assert os.listdir(tmp_path / "f") == [".pending"] and os.listdir(tmp_path / "f" / ".pending") == []
    for _ in range(2):
        w.commit([w.write(iter([Row(frame="a\n\n")])), w.write(iter([])), w.write(iter([Row(frame="b\n\n")]))], 3)
    assert [open(tmp_path / "f" / "batch=000000003" / n).read() for n in sorted(os.listdir(tmp_path / "f" / "batch=000000003"))] == ["a\n\n", "b\n\n"]
    assert os.listdir(tmp_path / "f" / ".pending") == []
