"""Live measurements as keyed state: the hop list of each session, and the life of each measurement over its attempts.

State is held per session by Spark's state store and goes with event-time timers, so it grows with the sessions that are open. Both
operators need the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from pathloom.operators.requests import MTR_PACKETS
from pathloom.streaming.events import ENDED_TTL_MS, ENDING, HOP, HOP_TYPES, METRICS, REPLACING, TTL_MS, S, fields, reduced

#: A poll that began so long ago is given up.
DEADLINE_MS = 42_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
META = "last_seq long, created_ms long, ended_ms long"


def _none(x):
    """A cell of a pandas frame as a plain value, null as None."""
    if isinstance(x, (list, tuple, dict)) or hasattr(x, "__array__") and getattr(x, "ndim", 0):
        return x
    return None if x is None or pd.isna(x) else x.item() if hasattr(x, "item") else x


def with_hop(hop: dict | None, new: dict, names: list[str]) -> dict:
    """A hop's fields after an event overwrites them with what it has."""
    old = hop or dict.fromkeys(names)
    return {c: old[c] if new.get(c) is None else new[c] for c in names}


class _Hops(StatefulProcessor):
    """The hop list of a session: a value (last event, times) and a map from hop number to fields."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.meta = handle.getValueState("meta", META)
        self.hops = handle.getMapState("hops", "hop_number int", ", ".join(f"{c} {HOP_TYPES[c]}" for c in self.names))

    def _put(self, number: int, fields_: dict) -> None:
        self.hops.updateValue((number,), tuple(fields_[c] for c in self.names))

    def _get(self, number: int) -> dict | None:
        return dict(zip(self.names, self.hops.getValue((number,)))) if self.hops.containsKey((number,)) else None

    def _expires(self, created: int, ended: int | None) -> int:
        return created + TTL_MS if ended is None else min(created + TTL_MS, ended + ENDED_TTL_MS)

    def _keep(self, last: int, created: int, ended: int | None, watermark: int) -> None:
        self.meta.update((last, created, ended))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(self._expires(created, ended), watermark) + 1)

    def _rows(self, key, last: int, expired: bool = False) -> pd.DataFrame:
        hops = [] if expired else [(n[0], *v) for n, v in self.hops.iterator()]
        rows = [(key[0], last, expired, *h) for h in hops] or [(key[0], last, expired, None, *[None] * len(self.names))]
        return pd.DataFrame(rows, columns=[S, "as_of", "expired", "hop_number", *self.names], dtype=object)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.to_dict("records"):
            r = {c: _none(v) for c, v in r.items()}
            if r["hop_number"] is not None:
                self._put(r["hop_number"], with_hop(None, r, self.names))
            self._keep(r["as_of"], r["created_ms"], r["ended_ms"], timerValues.getCurrentWatermarkInMs())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, created, ended = map(_none, self.meta.get()) if self.meta.exists() else (None, None, None)
        new = pd.concat(list(rows)).sort_values("seq", kind="stable")
        for e in new.to_dict("records"):
            e = {c: _none(v) for c, v in e.items()}
            if last is not None and e["seq"] <= last:
                continue  # has come before
            last, kind = e["seq"], e["type"]
            created = e["ts_ms"] if created is None else min(created, e["ts_ms"])
            if kind in ENDING:
                ended = e["ts_ms"] if ended is None else max(ended, e["ts_ms"])
            if kind in REPLACING:
                self.hops.clear()
                for h in e["hops"] if e["hops"] is not None else ():
                    h = {c: _none(v) for c, v in (h.items() if isinstance(h, dict) else h.asDict().items())}
                    self._put(h["hop_number"], with_hop(None, h, self.names))
            elif kind == "hop_result":
                self._put(e["hop_number"], with_hop(self._get(e["hop_number"]), e, self.names))
            elif kind == "metric_update" and (hop := self._get(e["hop_number"])) is not None:
                self._put(e["hop_number"], with_hop(hop, {c: e.get(c) for c in METRICS}, self.names))
        self._keep(last, created, ended, timerValues.getCurrentWatermarkInMs())
        yield self._rows(key, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.meta.get()[0]
        self.meta.clear()
        self.hops.clear()
        yield self._rows(key, last, True)

    def close(self) -> None:
        pass


def snapshot(events: DataFrame) -> DataFrame:
    """(session_id, as_of, created_ms, ended_ms, hop_number, fields): what a stored log leaves, for live_hops to go on from; one row
    with a null hop for a session without hops."""
    at = events.groupBy(S).agg(F.max("seq").cast("long").alias("as_of"), F.min("ts_ms").alias("created_ms"), F.max(F.when(F.col("type").isin(*ENDING), F.col("ts_ms"))).alias("ended_ms"))
    return at.join(reduced(events), S, "left")


def live_hops(events: DataFrame, start: DataFrame | None = None, delay: str = "1 minute") -> DataFrame:
    """(session_id, as_of, expired, hop_number, fields) of a stream of events: the whole hop list of each session that a micro-batch
    has changed, as reduced() gives it for the events up to number as_of. The list with the largest as_of is the session's; an
    empty one is a row with a null hop.

    A session's events are taken in the order of their numbers; one that isn't larger than all before has come before and is
    dropped, so a log may be delivered twice. The session's state goes, with a row that says expired, when the watermark passes
    its end: TTL_MS after its first event, or ENDED_TTL_MS after its last ending one. start is a snapshot() to go on from. Events without
    column hops have no lists. A session's events of one micro-batch are sorted together; maxFilesPerTrigger bounds them.
    """
    names = fields(events)
    rows = events if "hops" in events.columns else events.withColumn("hops", F.lit(None).cast(f"array<{HOP}>"))
    rows = rows.select(S, F.col("seq").cast("long").alias("seq"), "ts_ms", "type", "hop_number", *names, "hops", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", delay)
    out = StructType.fromDDL(f"{S} long, as_of long, expired boolean, hop_number int, " + ", ".join(f"{c} {HOP_TYPES[c]}" for c in names))
    first = None if start is None else start.groupBy(S)
    return rows.groupBy(S).transformWithStateInPandas(_Hops(names), out, "Update", "eventTime", first)


#: What becomes of an attempt at a poll.
REFUSED = ("private ip ranges", "not allowed")
PROTOCOLS = {"mtr": ("ICMP", "TCP")}


def after_poll(state: tuple, poll: dict) -> tuple[tuple, list[tuple]]:
    """((attempt, shown, began_ms, over), events) after a poll (mode, status, n_hops, failure, ts_ms, seq): events are
    (attempt, type, hop_seq, seq, ts_ms).

    A poll of a measurement that is over changes nothing. A failure that refuses the protocol begins the next attempt, which
    shows its hops from the first on; any other failure ends the measurement, and so does a poll after the deadline.
    """
    attempt, shown, began, over = state
    if over:
        return state, []
    say = lambda kind, hop=None: (attempt, kind, hop, poll["seq"], poll["ts_ms"])
    events = []
    if began is None:
        began = poll["ts_ms"]
        events.append(say("measurement_started"))
    if poll["ts_ms"] > began + DEADLINE_MS:
        return (attempt, shown, began, True), [*events, say("error")]
    if poll["failure"] is not None:
        said, tries = poll["failure"].lower(), PROTOCOLS.get(poll["mode"], ("ICMP",))
        if tries[attempt] == "ICMP" and attempt + 1 < len(tries) and any(x in said for x in REFUSED):
            return (attempt + 1, 0, None, False), events
        return (attempt, shown, began, True), [*events, say("error")]
    events += [say("hop_result", i) for i in range(shown + 1, (poll["n_hops"] or 0) + 1)]
    shown = max(shown, poll["n_hops"] or 0)
    if poll["status"] in ("finished", "completed"):
        return (attempt, shown, began, True), [*events, say("measurement_finished")]
    return (attempt, shown, began, False), events


class _Attempts(StatefulProcessor):
    """The state of after_poll for each measurement, with a timer at the deadline of its attempt and one at its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempt", "attempt int, shown int, began_ms long, over boolean, last_seq long, mode string")

    def _timer(self, at: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(at)

    def _out(self, key, mode: str, events: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], a, PROTOCOLS.get(mode, ("ICMP",))[a], kind, hop, seq, ts, MTR_PACKETS if mode == "mtr" else None) for a, kind, hop, seq, ts in events]
        return pd.DataFrame(rows, columns=[S, "attempt", "protocol", "type", "hop_seq", "poll", "ts_ms", "packets"], dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *state, last, mode = map(_none, self.state.get()) if self.state.exists() else (0, 0, None, False, None, None)
        out, now = [], None
        for p in pd.concat(list(rows)).sort_values("seq", kind="stable").to_dict("records"):
            p = {c: _none(v) for c, v in p.items()}
            if last is not None and p["seq"] <= last:
                continue  # has come before
            last, mode, now = p["seq"], p["mode"], p["ts_ms"]
            state, events = after_poll(tuple(state), p)
            out += events
        if now is not None:
            self.state.update((*state, last, mode))
            _, _, began, over = state
            # What comes after the end must find the measurement over.
            due = now + ENDED_TTL_MS if over else (now if began is None else began) + DEADLINE_MS
            self._timer(max(due, timerValues.getCurrentWatermarkInMs()) + 1)
        yield self._out(key, mode, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, shown, began, over, last, mode = map(_none, self.state.get())
        if over:
            self.state.clear()
            yield self._out(key, mode, [])
            return
        # No answer by the deadline: the measurement is over, and is remembered as such for a while.
        now = expiredTimerInfo.getExpiryTimeInMs()
        self.state.update((attempt, shown, began, True, last, mode))
        self.handle.registerTimer(max(now, timerValues.getCurrentWatermarkInMs()) + ENDED_TTL_MS)
        yield self._out(key, mode, [(attempt, "error", None, None, now)])

    def close(self) -> None:
        pass


def attempts(polls: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """(session_id, attempt, protocol, type, hop_seq, poll, ts_ms, packets): the events of a stream of polls (session_id, seq, ts_ms, mode,
    status, n_hops, failure), by attempt from 0.

    A started event opens each attempt; hops come once each; a refused protocol is followed by the next one, whose hops count
    from 1 again; and one ending event closes the measurement: finished, or an error after another failure or when the
    watermark passes the attempt's deadline without an end. Polls that come twice, or after the end, give nothing.
    """
    rows = polls.select(S, F.col("seq").cast("long").alias("seq"), "ts_ms", "mode", "status", "n_hops", "failure", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", delay)
    out = StructType.fromDDL(f"{S} long, attempt int, protocol string, type string, hop_seq int, poll long, ts_ms long, packets int")
    return rows.groupBy(S).transformWithStateInPandas(_Attempts(), out, "Append", "eventTime")


def without_result(sessions: DataFrame, events: DataFrame, within_ms: int = DEADLINE_MS, delay: str = "10 seconds") -> DataFrame:
    """(session_id, created_ms): sessions of a stream (session_id, created_ms) that have no finished event on a stream of live events
    (session_id, ts_ms, type) within so many milliseconds of their creation, and so fall back to the synthetic source.

    An outer join of two streams with a time bound: a session's row waits for its deadline to pass the watermark, an event for
    sessions that are created up to then, and both go then. An event of type error is no result.
    """
    left = sessions.select(S, "created_ms", F.timestamp_millis("created_ms").alias("created_at")).withWatermark("created_at", delay)
    right = events.where(F.col("type") == "measurement_finished").select(F.col(S).alias("of"), F.timestamp_millis("ts_ms").alias("ended_at")).withWatermark("ended_at", delay)
    bound = (F.col("ended_at") >= F.col("created_at")) & (F.col("ended_at") <= F.col("created_at") + F.expr(f"interval {within_ms / 1000:.3f} seconds"))
    return left.join(right, (F.col(S) == F.col("of")) & bound, "left").where("of is null").select(S, "created_ms")
