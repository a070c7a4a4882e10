"""Fixed-window rate limits: windows begin with a client's request, not with the clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MINUTE_MS, HOUR_MS, PER_MINUTE, PER_HOUR = 60_000, 3_600_000, 8, 80
STATE = "minute_count int, minute_reset long, hour_count int, hour_reset long"
OUT = "client long, seq int, ts_ms long, allowed boolean"


def admit(state: tuple[int, int, int, int] | None, now: int) -> tuple[tuple[int, int, int, int], bool]:
    """The state after a request and whether it is allowed. A refused one changes no count; a window ends after its last ms."""
    if state is None:
        return (1, now + MINUTE_MS, 1, now + HOUR_MS), True
    m, m_reset, h, h_reset = state
    if m_reset < now:
        m, m_reset = 0, now + MINUTE_MS
    if h_reset < now:
        h, h_reset = 0, now + HOUR_MS
    if m >= PER_MINUTE or h >= PER_HOUR:
        return (m, m_reset, h, h_reset), False
    return (m + 1, m_reset, h + 1, h_reset), True


def limited(requests: DataFrame) -> DataFrame:
    """requests (client, seq, ts_ms) with column allowed, in batch: rows stream through in order, one client after another.

    A client's state is four numbers, so a client with very many requests needs no more memory than one with few.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state = None, None
        for b in batches:
            said = []
            for c, ts in zip(b["client"].tolist(), b["ts_ms"].tolist()):
                if c != client:
                    client, state = c, None
                state, ok = admit(state, ts)
                said.append(ok)
            yield b.assign(allowed=said)

    rows = requests.select("client", "seq", "ts_ms")
    return rows.repartition("client").sortWithinPartitions("client", "ts_ms", "seq").mapInPandas(run, OUT)


def limited_stream(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream. Rows of one micro-batch count in the order of their times, and rows that come more than `delay`
    behind the latest time are late and are dropped.

    A client's state goes when the watermark has passed the end of both its windows: a client without state then is let in as
    one with ended windows would be. Time is that of the requests, so a replayed log gives what it gave when it was written.
    A client's rows of one micro-batch, of two longs each, are sorted together; maxFilesPerTrigger bounds them.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = tuple(state.get) if state.exists else None
        rows = pd.concat([b[["client", "seq", "ts_ms"]] for b in batches]).sort_values(["ts_ms", "seq"])
        said = []
        for ts in rows["ts_ms"].tolist():
            now, ok = admit(now, ts)
            said.append(ok)
        state.update(now)
        state.setTimeoutTimestamp(max(now[1], now[3], state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(allowed=said)

    timed = requests.select("client", "seq", "ts_ms", F.timestamp_millis("ts_ms").alias("at")).withWatermark("at", delay)
    return timed.groupBy("client").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
