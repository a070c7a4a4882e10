"""Functions on whole rows: columns and tables worked out once, joins that don't move rows for a small table and that rows without a
key don't skew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def worked_out(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """rows with new columns that are worked out once a row, here: a predicate on them that follows is not moved below and worked out
    again in full, as it would be on withColumns, even for each row below a distinct. They come from a generator of one row."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def apart(c: Column) -> Column:
    """c, through a function that Spark doesn't generate code for: so its step is compiled by itself. Else many wide steps in a row become
    one method that is too long for the JVM to compile, which then reads it byte by byte."""
    return F.get(F.transform(F.array(c), lambda x: x), F.lit(0))


#: A table of at most so many bytes, its rows written as JSON and 64 more for each, goes whole to each executor.
SENT = 96 << 20


def held(rows: DataFrame) -> DataFrame:
    """rows worked out once, now, where that is kept: in the session's checkpoint folder or, without one, in a session of one process.
    Elsewhere an executor's end would lose them, so there they are worked out whenever they are read."""
    sc = rows.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return rows.checkpoint()
    return rows.localCheckpoint() if sc.master.partition("[")[0] == "local" else rows


def is_small(rows: DataFrame) -> bool:
    """Whether rows may go whole to each executor: what they hold is added up, now."""
    return not rows.isStreaming and (rows.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64)).first()[0] or 0) <= SENT


def left_joined(rows: DataFrame, found: DataFrame, key: Column, found_key: str) -> DataFrame:
    """rows with the columns of found, but for its key, where key equals it. If found is small, as is_small adds up, rows stay where they
    are. Else both move; rows whose key is null match nothing and are dealt out by what they hold, so that they don't meet in one task."""
    if is_small(found):
        found = found.withColumnRenamed(found_key, "__found")
        return rows.withColumn("__on", key).join(F.broadcast(found), F.col("__on") == F.col("__found"), "left").drop("__on", "__found")
    own = [c for c, kind in rows.dtypes if not any(x in kind for x in ("map<", "variant"))]
    lot = F.pmod(F.xxhash64(*own), F.lit(1 << 20)).cast("string")
    rows = rows.withColumn("__on", F.when(key.isNotNull(), F.concat(F.lit("="), key)).otherwise(lot))
    found = found.withColumn("__found", F.concat(F.lit("="), F.col(found_key))).drop(found_key)
    return rows.join(found, F.col("__on") == F.col("__found"), "left").drop("__on", "__found")
