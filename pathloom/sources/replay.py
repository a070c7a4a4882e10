"""Event logs as streams and tables: folders of JSON lines or of server-sent events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.streaming.events import HOP, HOP_TYPES

EVENT = "session_id long, seq int, ts_ms long, type string, hop_number int, " + ", ".join(f"{k} {t}" for k, t in HOP_TYPES.items()) + f", hops array<{HOP}>, message string"
TYPES = ("measurement_started", "hop_result", "metric_update", "measurement_finished", "error")


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON texts; texts that are no event of a known type go."""
    out = lines.select(F.from_json(column, EVENT).alias("e")).select("e.*")
    return out.where(F.col("type").isin(*TYPES))


def frame_data(frames: DataFrame, column: str = "value") -> DataFrame:
    """frames with column value: the data of a server-sent event, its data lines joined; comments and other fields go."""
    lines = F.filter(F.split(column, r"\r?\n"), lambda x: F.startswith(x, F.lit("data:")))
    return frames.withColumn("value", F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")).where("value <> ''")


def stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The events of a folder of JSON lines as a stream, files in the order they come: those that are there are replayed, then
    new ones are followed. `where("session_id = …")` is one session's subscription."""
    return parsed(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder))


def batch(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.read.text(folder))


def sse_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The events of a folder of server-sent event texts, frames set apart by blank lines, as a stream."""
    return parsed(frame_data(spark.readStream.option("maxFilesPerTrigger", files_per_batch).option("lineSep", "\n\n").text(folder)))


def sse_batch(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(frame_data(spark.read.option("lineSep", "\n\n").text(folder)))


#: Parts of a stored log; a session lies in one of them.
PARTS = 64


def _part(session_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(session_id.cast("long")), F.lit(parts)).cast("int")


def store(events: DataFrame, folder: str, parts: int = PARTS) -> None:
    """Append events to a log laid out by sessions, so that one session's events are read from one part."""
    rows = events.withColumn("part", _part(F.col("session_id"), parts))
    rows.repartition("part").sortWithinPartitions("session_id", "seq").write.mode("append").partitionBy("part").parquet(folder)


def stored(spark: SparkSession, folder: str, session_id: int, parts: int = PARTS) -> DataFrame:
    """The stored events of one session, a row for each number; other parts aren't read."""
    part = spark.range(1).select(_part(F.lit(session_id), parts)).first()[0]
    rows = spark.read.parquet(folder).where((F.col("part") == part) & (F.col("session_id") == session_id))
    return rows.drop("part").dropDuplicates(["session_id", "seq"])


def subscription(spark: SparkSession, folder: str, events: DataFrame, session_id: int, parts: int = PARTS, delay: str = "15 minutes") -> tuple[DataFrame, DataFrame]:
    """(table, stream) of one session: its stored events, and those of a stream of events past them.

    The seam is the largest number that is stored as this is called. The stream gives each later number once, though it may be
    delivered several times within `delay`; so together they have every event once. A session that isn't stored is all stream.
    """
    before = stored(spark, folder, session_id, parts)
    last = before.agg(F.max("seq")).first()[0]
    rows = events.where(F.col("session_id") == session_id)
    rows = rows if last is None else rows.where(F.col("seq") > last)
    timed = rows.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", delay)
    return before, timed.dropDuplicatesWithinWatermark(["session_id", "seq"]).drop("at")
