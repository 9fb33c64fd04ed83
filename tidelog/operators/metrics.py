"""Throughput, gauges, latency figures and reports over the op log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ranking import order_statistics, prefix_sums


def per_second(events: DataFrame, ts: str = "ts", amount: Column | None = None) -> DataFrame:
    """Operations of each second from the first to the last, or a sum over them; idle seconds are zero. One row a second: small."""
    counted = events.groupBy(F.date_trunc("second", ts).alias("second")).agg((F.count("*") if amount is None else F.sum(amount)).alias("ops"))
    span = counted.agg(F.min("second").alias("a"), F.max("second").alias("z")).where("a is not null")
    # the seconds by days, so that a long span is many rows to explode
    days = span.select("z", F.explode(F.expr("sequence(a, z, interval 1 day)")).alias("d"))
    seconds = days.select(F.explode(F.expr("sequence(d, least(z, d + interval 86399 seconds), interval 1 second)")).alias("second"))
    return seconds.join(counted, "second", "left").select("second", F.coalesce("ops", F.lit(0)).cast("bigint").alias("ops"))


def last_samples(samples: DataFrame, n: int = 100, by: str = "second") -> DataFrame:
    return samples.orderBy(F.desc(by)).limit(n).orderBy(by)


def deltas(totals: DataFrame, by: str, total: str) -> DataFrame:
    """Each sample's growth over the sample before; a series of samples, one a second."""
    return totals.withColumn("delta", F.col(total) - F.coalesce(F.lag(total).over(Window.orderBy(by)), F.lit(0)))


def gauge(changes: DataFrame, by: str, delta: str, parts: str) -> DataFrame:
    """A running sum of changes, per part plus the parts before; `parts` is a whole number whose order is that of `by`."""
    sums = changes.groupBy(parts).agg(F.sum(delta).alias("__d"))
    before = prefix_sums(sums, parts, "__d", "__b")
    inside = F.sum(delta).over(Window.partitionBy(parts).orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return changes.withColumn("__s", inside).join(before, parts).withColumn("gauge", F.col("__s") + F.col("__b")).drop("__s", "__b")


def op_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count("*").alias("ops"))


def throughput(events: DataFrame, ts: str = "ts") -> DataFrame:
    """Operations, microseconds from the first to the last, and operations a second."""
    span = events.agg(F.count("*").alias("ops"), F.expr(f"timestampdiff(microsecond, min({ts}), max({ts}))").alias("micros"))
    return span.withColumn("ops_per_s", F.when(F.col("micros") > 0, F.col("ops") * 1000000 / F.col("micros")))


def latency(samples: DataFrame, column: str) -> DataFrame:
    """Count, mean, p50, p95, p99 and maximum; a percentile is the element at floor(n * p) of the sorted samples."""
    found = order_statistics(samples, column, [0.5, 0.95, 0.99])
    x = samples.schema[column].dataType
    whole = samples.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.max(column).alias("worst"))
    names = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    return whole.select("n", "mean", *[F.lit(found.get(p)).cast(x).alias(k) for p, k in names.items()], "worst")


def thread_report(metrics: DataFrame) -> DataFrame:
    """Per thread totals and whole-number averages; threads without operations are left out."""
    sums = metrics.groupBy("thread").agg(*[F.sum(c).alias(c) for c in ("total_ops", "parse_cycles", "exec_cycles", "send_cycles", "recv_cycles", "redirects", "parse_fails")])
    busy = sums.where("total_ops <> 0")
    return busy.select("thread", "total_ops", *[F.expr(f"{c} div total_ops").alias(f"avg_{c}") for c in ("parse_cycles", "exec_cycles", "send_cycles", "recv_cycles")], "redirects", "parse_fails")


def mismatches(pairs: DataFrame) -> DataFrame:
    """How many actual values aren't the expected ones."""
    return pairs.agg(F.count("*").alias("checked"), F.count_if((F.col("expected") != F.col("actual")) | F.col("actual").isNull()).alias("errors"))


def plotted(samples: DataFrame, n: int = 100, column: str = "ops", unit: float = 1e6) -> DataFrame:
    """The last samples as points: x from -1 on, y in units, such as millions of operations or 2000 connections."""
    newest = last_samples(samples, n)
    i = F.row_number().over(Window.orderBy("second")) - 1  # at most n rows
    return newest.select("second", (F.lit(-1.0) + F.lit(2.0) * i / n).alias("x"), (F.col(column) / unit).alias("y"))
