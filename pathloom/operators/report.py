"""Text reports of a measurement's hops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import text as t
from pathloom.operators.route import loss_label

CYCLES = 16


def whole(x: Column) -> Column:
    return F.round(x).cast("long").cast("string")


def rtt_text(rtt: Column) -> Column:
    return F.coalesce(F.concat(whole(rtt), F.lit(" ms")), F.lit("*"))


def loss_text(loss: Column) -> Column:
    return F.coalesce(loss_label(loss), F.lit("-"))


def host_text(host: Column, ip: Column) -> Column:
    h, a = t.or_null(host), t.or_null(ip)
    return F.when(h != a, F.concat(h, F.lit(" ("), a, F.lit(")"))).otherwise(F.coalesce(h, a, F.lit("*")))


def trace_line(hops: DataFrame) -> Column:
    number = t.padded_left(F.col("hop_number").cast("string"), 2)
    return F.concat_ws("  ", number, t.padded_left(rtt_text(F.col("rtt_ms")), 6), t.padded_right(F.col("status"), 7), host_text(F.col("hostname"), F.col("ip")))


def trace_report(hops: DataFrame) -> DataFrame:
    """(measurement_id, report): a line for each hop, in order."""
    line = F.struct("hop_seq", trace_line(hops).alias("line"))
    return hops.groupBy("measurement_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("report"))


def mtr_rows(hops: DataFrame) -> DataFrame:
    """The ten cells of each hop as text; what wasn't measured falls back to the average, packets to the usual number."""
    col = lambda n: F.col(n) if n in hops.columns else F.lit(None).cast("double")
    rtt, zero = F.col("rtt_ms"), F.lit("0")
    return hops.select(
        "measurement_id", "hop_seq", F.col("hop_number").cast("string").alias("num"), F.coalesce(t.or_null(F.col("asn")), F.lit("AS???")).alias("asn"),
        host_text(F.col("hostname"), F.col("ip")).alias("host"), loss_text(F.col("packet_loss_percent")).alias("loss"), F.coalesce(col("sent").cast("long"), F.lit(CYCLES)).cast("string").alias("snt"),
        *(F.coalesce(whole(F.coalesce(col(c), rtt)), zero).alias(n) for n, c in (("last", "last_ms"), ("avg", "rtt_ms"), ("best", "best_ms"), ("wrst", "worst_ms"))),
        F.coalesce(whole(col("jitter_ms")), zero).alias("stdev"),
    )


# Names that results show their providers by, and the notices above a report.
PROVIDERS = {"globalping": "Globalping API", "demo": "Demo provider"}
NOTICES = ["notice  Not a direct trace from your device", "notice  Exact device-level traceroute requires a local agent"]
CAP_NOTICE = "notice  Install-free MTR uses Globalping's 16-sample cap; higher-cycle local MTR requires a local agent"


def command_lines(mode: Column, provider: Column, target: Column) -> Column:
    """The lines above a report: command, provider, notices."""
    name = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in PROVIDERS.items() for x in kv)), provider), F.lit("Measurement provider"))
    capped = F.coalesce((mode == "mtr") & (provider == "globalping"), F.lit(False))
    command = F.when(mode == "mtr", F.concat(F.lit(f"$ mtr -rwc {CYCLES} -z "), target)).otherwise(F.concat(F.lit("$ traceout "), target))
    lines = F.array(command, F.concat(F.lit("provider  "), name, F.when(capped, " - API packet cap 16").otherwise("")), *(F.lit(n) for n in NOTICES))
    return F.when(capped, F.array_append(lines, F.lit(CAP_NOTICE))).otherwise(lines)


def hop_detail(hops: DataFrame) -> DataFrame:
    """The rows of the short table: name, detail, latency, loss. A latency of 0 counts as missing here."""
    rtt = F.col("rtt_ms")
    return hops.select(
        "measurement_id", "hop_seq", F.coalesce(t.or_null(F.col("hostname")), t.or_null(F.col("ip")), F.lit("*")).alias("name"),
        t.joined(" · ", F.col("asn"), F.col("city"), F.col("country")).alias("detail"),
        F.when(F.coalesce(rtt, F.lit(0.0)) == 0, "-").otherwise(F.concat(whole(rtt), F.lit(" ms"))).alias("rtt"), loss_text(F.col("packet_loss_percent")).alias("loss"),
    )


def source_badge(provider: Column, city: Column, country: Column) -> Column:
    return F.concat_ws(" · ", provider, t.or_null(t.joined(", ", city, country)))


# What is shown in place of a report, and next to a measurement.
NO_OUTPUT = "no completed route output"
COLLECTING = "Collecting route data from a nearby measurement probe."
READY = " hops are ready for inspection."
IDLE = "Install-free browser experience. Not a direct trace from your device."


def empty_line(error: Column) -> Column:
    """The one line of a report without hops."""
    return F.when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error  "), error)).otherwise(NO_OUTPUT)


def status_message(status: Column, error: Column, hop_count: Column) -> Column:
    out = F.when(F.coalesce(error, F.lit("")) != "", error).when(status.isin("starting", "running"), COLLECTING)
    return out.when(status == "finished", F.concat(hop_count.cast("string"), F.lit(READY))).otherwise(IDLE)


def finished(measurements: DataFrame) -> DataFrame:
    """Measurements that are reported: those that have finished and have hops."""
    return measurements.where((F.col("status") == "finished") & (F.col("n_hops") > 0))
