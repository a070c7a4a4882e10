"""Tables that a stream keeps up to date, a version for each micro-batch.

A version is a folder that counts once Spark's writer has marked it as whole, so a reader sees all of a batch or nothing. A batch
that is run again builds on the versions before its own and writes its own anew, which leaves what one run would have left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.streaming import events as ev


class Versions:
    """The whole versions under a folder of any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self, below: int | None = None) -> list[int]:
        """The numbers of the versions that are whole, ascending."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.folder)
        store = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(path):
            return []
        names = [f.getPath().getName() for f in store.listStatus(path)]
        whole = [int(n[8:]) for n in names if n.startswith("version=") and n[8:].isdigit() and store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{n}/_SUCCESS"))]
        return sorted(n for n in whole if below is None or n < below)

    def place(self, number: int) -> str:
        return f"{self.folder}/version={number:09d}"

    def read(self, numbers: list[int], schema: str) -> DataFrame:
        """The rows of some versions."""
        return self.spark.read.schema(schema).parquet(*map(self.place, numbers)) if numbers else self.spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(self.place(number))


LOOKED_UP = "ip string, found boolean, geo_city string, geo_country string, geo_latitude double, geo_longitude double, geo_hostname string, geo_asn string, geo_as_name string, ptr_hostname string"


class Lookups:
    """Addresses looked up once each, kept with what was found or with the failure.

    ask takes distinct addresses (ip) and returns records (ip, geo_…, ptr_hostname) of those that it knows, one each, as lookup.py makes
    them; it runs once for each new address, never for one that is stored, found or not.
    """

    def __init__(self, spark: SparkSession, folder: str, ask: Callable[[DataFrame], DataFrame]):
        self.versions, self.ask = Versions(spark, folder), ask

    def table(self, below: int | None = None) -> DataFrame:
        """All addresses of the whole versions."""
        return self.versions.read(self.versions.numbers(below), LOOKED_UP)

    def add(self, hops: DataFrame, batch: int) -> None:
        """Look up the addresses of a micro-batch that no version before it has; for foreachBatch."""
        known = self.table(batch).select("ip")
        new = hops.select("ip").where("ip is not null").distinct().join(known, "ip", "left_anti")
        records = self.ask(new)
        have = [c.split()[0] for c in LOOKED_UP.split(", ")[2:]]
        records = records.select("ip", F.lit(True).alias("found"), *(F.col(c) if c in records.columns else F.lit(None).alias(c) for c in have))
        rows = new.join(records, "ip", "left").withColumn("found", F.coalesce("found", F.lit(False)))
        self.versions.write(rows.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in LOOKED_UP.split(", "))), batch)

    def geo(self) -> DataFrame:
        """The records as fusion takes them."""
        return self.table().where("found").drop("found", "ptr_hostname")

    def ptr(self) -> DataFrame:
        """The names of reverse lookups as fusion takes them."""
        return self.table().where("ptr_hostname is not null").select("ip", F.col("ptr_hostname").alias("hostname"))


SESSIONS = "session_id long, created_ms long, ended_ms long, status string, status_seq long"


class Sessions:
    """The sessions that are open: those created last, `most` of them at most, without those whose time is over.

    Each part of a micro-batch gives its own list of `most` sessions, and the lists are merged with the snapshot before; what moves to
    one task is a list for each part, whatever the batch. A session that the cap has put out comes back only with an event that
    starts it anew.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = ev.MOST_SESSIONS):
        self.versions, self.most = Versions(spark, folder), most

    def table(self, below: int | None = None) -> DataFrame:
        """The newest snapshot."""
        return self.versions.read(self.versions.numbers(below)[-1:], SESSIONS)

    def add(self, events: DataFrame, batch: int) -> None:
        """Merge the sessions of a micro-batch of events (session_id, seq, ts_ms, type); for foreachBatch."""
        to = F.when(F.col("type") == "measurement_started", "running").when(F.col("type") == "measurement_finished", "finished").when(F.col("type") == "error", "error")
        now = events.agg(F.max("ts_ms")).first()[0]
        new = events.groupBy("session_id").agg(
            F.min("ts_ms").alias("created_ms"), F.max(F.when(F.col("type").isin(*ev.ENDING), F.col("ts_ms"))).alias("ended_ms"), F.max_by(to, F.when(to.isNotNull(), F.col("seq"))).alias("status"),
            F.max(F.when(to.isNotNull(), F.col("seq"))).cast("long").alias("status_seq"), F.bool_or(F.col("type") == "measurement_started").alias("starts"),
        )
        old = self.table(batch).withColumn("starts", F.lit(True))
        both = old.unionByName(new).groupBy("session_id").agg(
            F.min("created_ms").alias("created_ms"), F.max("ended_ms").alias("ended_ms"), F.max_by("status", "status_seq").alias("status"), F.max("status_seq").alias("status_seq"), F.bool_or("starts").alias("starts"),
        )
        expires = F.least(F.col("created_ms") + ev.TTL_MS, F.col("ended_ms") + ev.ENDED_TTL_MS)
        left = both.where("starts").where(expires >= F.lit(now)) if now is not None else both.where("starts")
        self.versions.write(ev.capped(left, self.most).select(*(c.split()[0] for c in SESSIONS.split(", "))), batch)
