"""Event logs: replay, keyed upserts, sessions, failover. What is an aggregate here is one on a stream as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

S = "session_id"
REPLACING = ("measurement_started", "measurement_finished")
ENDING = ("measurement_finished", "error")
TTL_MS, ENDED_TTL_MS, MOST_SESSIONS = 900_000, 120_000, 500
SAFE_ERROR = "Measurement is temporarily unavailable. Please try again later."
#: The fields of a hop besides its number, and those that a metric update carries.
HOP_TYPES = {
    "asn": "string", "as_name": "string", "ip": "string", "hostname": "string", "city": "string", "country": "string", "latitude": "double", "longitude": "double",
    "location_confidence": "string", "location_source": "string", "location_precision": "string", "location_evidence": "array<string>",
    "rtt_ms": "double", "sent": "long", "last_ms": "double", "best_ms": "double", "worst_ms": "double", "jitter_ms": "double", "packet_loss_percent": "double", "status": "string",
}
METRICS = ("rtt_ms", "jitter_ms", "packet_loss_percent", "status")
HOP = "struct<hop_number: int, " + ", ".join(f"{k}: {t}" for k, t in HOP_TYPES.items()) + ">"


def fields(events: DataFrame) -> list[str]:
    """The hop fields that the events have."""
    return [c for c in HOP_TYPES if c in events.columns]


def sse_frames(events: DataFrame) -> DataFrame:
    """events with column frame: the text of a server-sent event; nulls are left out of its JSON."""
    payload = F.to_json(F.struct(*(c for c in events.columns if c not in (S, "seq"))))
    return events.withColumn("frame", F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), payload, F.lit("\n\n")))


def _latest(c: str, where: Column) -> Column:
    """(seq, value) of the last event that passes `where` and has the field."""
    return F.max(F.when(where & F.col(c).isNotNull(), F.struct(F.col("seq").alias("seq"), F.col(c).alias("value"))))


def upserted(events: DataFrame) -> DataFrame:
    """(session_id, hop_number, fields): hops as hop_result events leave them; a later event overwrites with what it has.

    On a stream this is Spark's own keyed state, a row for each hop: write it in update mode, and each micro-batch gives the
    hops that it has changed.
    """
    rows, own = events.where(F.col("type") == "hop_result"), fields(events)
    out = rows.groupBy(S, "hop_number").agg(*(_latest(c, F.lit(True)).alias(c) for c in own))
    return out.select(S, "hop_number", *(F.col(f"{c}.value").alias(c) for c in own))


def reduced(events: DataFrame) -> DataFrame:
    """(session_id, hop_number, fields): hops as all events leave them.

    A started or finished event replaces the list with that of its payload (column hops, where there is one; numbers within
    a list are distinct). hop_result adds a hop or overwrites its fields with what it has; metric_update does so with METRICS
    of a hop that is there by then, and has no effect on others. Events are combined before they move, session by session and
    hop by hop.
    """
    own = fields(events)
    listed = F.col("hops") if "hops" in events.columns else F.lit(None).cast(f"array<{HOP}>")
    replacing = events.where(F.col("type").isin(*REPLACING)).groupBy(S).agg(F.max("seq").alias("last"), F.max_by(listed, "seq").alias("list"))
    inside = [f.name for f in replacing.schema["list"].dataType.elementType.fields]
    first = replacing.select(S, F.col("last").alias("seq"), F.inline("list"))
    first = first.select(S, "seq", F.lit("hop_result").alias("type"), "hop_number", *(F.col(c).cast(HOP_TYPES[c]).alias(c) if c in inside else F.lit(None).cast(HOP_TYPES[c]).alias(c) for c in own))
    later = events.where(F.col("type").isin("hop_result", "metric_update")).join(replacing.select(S, "last"), S, "left").where(F.col("seq") > F.coalesce("last", F.lit(0)))
    rows = later.select(S, "seq", "type", "hop_number", *own).unionByName(first)
    hop, metric = F.col("type") == "hop_result", F.col("type") == "metric_update"
    out = rows.groupBy(S, "hop_number").agg(
        F.min(F.when(hop, F.col("seq"))).alias("first"), *(_latest(c, hop).alias(c) for c in own), *(_latest(c, metric).alias(f"{c}_metric") for c in own if c in METRICS),
    )

    def value(c: str) -> Column:
        if c not in METRICS:
            return F.col(f"{c}.value")
        newer = (F.col(f"{c}_metric.seq") > F.col("first")) & (F.col(f"{c}_metric.seq") > F.coalesce(f"{c}.seq", F.lit(0)))
        return F.when(newer, F.col(f"{c}_metric.value")).otherwise(F.col(f"{c}.value"))

    return out.where(F.col("first").isNotNull()).select(S, "hop_number", *(value(c).alias(c) for c in own))


def statuses(events: DataFrame) -> DataFrame:
    """(session_id, status, created_ms, expires_ms, n_events) of each session.

    It expires TTL_MS after its first event, or ENDED_TTL_MS after its last ending one if that is earlier.
    """
    to = F.when(F.col("type") == "measurement_started", "running").when(F.col("type") == "measurement_finished", "finished").when(F.col("type") == "error", "error")
    out = events.groupBy(S).agg(
        F.coalesce(F.max_by(to, F.when(to.isNotNull(), F.col("seq"))), F.lit("starting")).alias("status"), F.min("ts_ms").alias("created_ms"),
        F.max(F.when(F.col("type").isin(*ENDING), F.col("ts_ms"))).alias("ended_ms"), F.count("*").alias("n_events"),
    )
    return out.withColumn("expires_ms", F.least(F.col("created_ms") + TTL_MS, F.col("ended_ms") + ENDED_TTL_MS)).drop("ended_ms")


def latest_result(events: DataFrame) -> DataFrame:
    """(session_id, seq, type, ts_ms) of each session's last event that carries a whole result."""
    rows = events.where(F.col("type").isin(*REPLACING))
    return rows.groupBy(S).agg(F.max("seq").alias("seq"), F.max_by("type", "seq").alias("type"), F.max_by("ts_ms", "seq").alias("ts_ms"))


def capped(sessions: DataFrame, most: int = MOST_SESSIONS) -> DataFrame:
    """The `most` sessions created last."""
    return sessions.orderBy(F.desc("created_ms"), F.desc(S)).limit(most)


def cap_marked(sessions: DataFrame, most: int = MOST_SESSIONS) -> DataFrame:
    """All sessions with kept: whether a cap of `most` keeps them. They are held against the last one that it keeps, one row, so
    none are ranked in one place."""
    last = capped(sessions, most).agg(F.min(F.struct("created_ms", S)).alias("__last"))
    return sessions.crossJoin(F.broadcast(last)).withColumn("kept", F.struct("created_ms", S) >= F.col("__last")).drop("__last")


def failed_over(live: DataFrame, synthetic: DataFrame) -> DataFrame:
    """(session_id, seq, source, type, message): the log of each session when a live source gives way to a synthetic one.

    Both have (session_id, seq, type); an event of type error stands for a source that fails there. The log keeps what the live
    source gave before it failed; then come the synthetic events, as they do for sessions without live ones. Where the
    synthetic source fails too, or has nothing, one event with a safe message ends the log.
    """
    def source(events: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        ends = events.groupBy(S).agg(F.min(F.when(F.col("type") == "error", F.col("seq"))).alias("failed"), F.max("seq").alias("last"))
        kept = events.join(ends, S).where(F.col("failed").isNull() | (F.col("seq") < F.col("failed"))).select(S, "seq", F.lit(name).alias("source"), "type")
        return kept, ends.select(S, F.col("failed").isNotNull().alias(f"{name}_failed"), F.coalesce(F.col("failed") - 1, "last").alias(f"{name}_last"))

    first, live_ends = source(live, "live")
    second, demo_ends = source(synthetic, "demo")
    both = live_ends.join(demo_ends, S, "full").where(F.col("live_failed").isNull() | F.col("live_failed"))
    after = both.select(S, F.coalesce("live_last", F.lit(0)).alias("shift"), (F.coalesce("live_last", F.lit(0)) + F.coalesce("demo_last", F.lit(0))).alias("end"), F.coalesce("demo_failed", F.lit(True)).alias("lost"))
    second = second.join(after, S).select(S, (F.col("seq") + F.col("shift")).alias("seq"), "source", "type")
    safe = after.where("lost").select(S, (F.col("end") + 1).alias("seq"), F.lit("demo").alias("source"), F.lit("error").alias("type"))
    out = first.unionByName(second).unionByName(safe)
    return out.withColumn("seq", F.col("seq").cast("int")).withColumn("message", F.when(F.col("type") == "error", F.lit(SAFE_ERROR)))


def new_hops(polls: DataFrame) -> DataFrame:
    """(session_id, poll, hop_seq) of hops past all that earlier polls of the session have shown; polls have n_hops."""
    w = Window.partitionBy(S).orderBy("poll").rowsBetween(Window.unboundedPreceding, -1)
    seen = polls.withColumn("seen", F.coalesce(F.max("n_hops").over(w), F.lit(0)))
    return seen.where(F.col("n_hops") > F.col("seen")).select(S, "poll", F.explode(F.sequence(F.col("seen") + 1, F.col("n_hops"))).alias("hop_seq"))


def last_attempt(events: DataFrame) -> DataFrame:
    """Events of each session's last attempt; an earlier attempt's count no more. Each session's number is an aggregate that is joined
    back, so no session is one task's."""
    last = events.groupBy(S).agg(F.max("attempt").alias("__last"))
    return events.join(last, S).where(F.col("attempt") == F.col("__last")).drop("__last")


SESSION_STATE = "status string, status_seq long, created_ms long, ended_ms long, n_events long"
SESSION_OUT = "session_id long, status string, created_ms long, expires_ms long, n_events long, expired boolean"


def session_stream(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Sessions of a stream of (session_id, seq, ts_ms, type), as statuses() gives them, a row whenever events come in, and one
    with expired true when the session's time is over by the watermark. Its state goes then; a later event begins a new one.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, status_seq, created, ended, n = state.get if state.exists else ("starting", -1, None, None, 0)
        if not state.hasTimedOut:
            for b in batches:
                for seq, ts, kind in zip(b["seq"].tolist(), b["ts_ms"].tolist(), b["type"].tolist()):
                    n, created = n + 1, ts if created is None else min(created, ts)
                    now = {"measurement_started": "running", "measurement_finished": "finished", "error": "error"}.get(kind)
                    if now and seq > status_seq:
                        status, status_seq = now, seq
                    if kind in ENDING:
                        ended = ts if ended is None or pd.isna(ended) else max(ended, ts)
        expires = created + TTL_MS if ended is None or pd.isna(ended) else min(created + TTL_MS, ended + ENDED_TTL_MS)
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((status, status_seq, created, ended, n))
            state.setTimeoutTimestamp(max(expires, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"session_id": [key[0]], "status": [status], "created_ms": [created], "expires_ms": [expires], "n_events": [n], "expired": [state.hasTimedOut]})

    timed = events.select(S, "seq", "ts_ms", "type", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", delay)
    return timed.groupBy(S).applyInPandasWithState(run, SESSION_OUT, SESSION_STATE, "update", GroupStateTimeout.EventTimeTimeout)
