"""The key-value relation: a command log (seq, key, op, value), its state, reads at a point of the log, replies.

A value of null with op DEL is a tombstone; the empty string is a value. seq is unique and orders the log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WRITES = ("SET", "DEL")


def from_events(events: DataFrame) -> DataFrame:
    """The log that the table events stands for."""
    op = F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "view", "GET").otherwise("SET")
    return events.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("key:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"),
        op.alias("op"),
        F.when(op == "SET", F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).alias("value"),
    )


def latest(log: DataFrame) -> DataFrame:
    """The last write of each key, tombstones too: combined before the shuffle, so hot keys are harmless. The engine sorts
    for it, as what it keeps for a key has strings."""
    last = F.max_by(F.struct("op", "value"), "seq").alias("w")
    writes = log.where(F.col("op").isin(*WRITES)).groupBy("key").agg(last, F.max("seq").alias("seq"))
    return writes.select("key", "seq", "w.op", "w.value")


def state(log: DataFrame) -> DataFrame:
    return latest(log).where("op = 'SET'").select("key", "value", "seq")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where("op = 'DEL'").select("key", "seq")


def _before(log: DataFrame, *keys: str) -> Column:
    write = F.when(F.col("op").isin(*WRITES), F.struct("op", "value"))
    return F.last(write, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))


def _seen(log: DataFrame, span: int | None) -> DataFrame:
    """The log with `w`, the write that each command's key had last before it.

    With a span, the log of a key is cut at multiples of that many seq numbers, and what a cut-off part needs from the
    parts before comes from their last writes, so that a hot key isn't one task's work.
    """
    if span is None:
        return log.withColumn("w", _before(log, "key"))
    parts = log.withColumn("part", F.floor(F.col("seq") / span))
    inside = parts.withColumn("w", _before(parts, "key", "part"))
    lasts = parts.groupBy("key", "part").agg(F.max_by(F.struct("op", "value"), F.when(F.col("op").isin(*WRITES), F.col("seq"))).alias("last"))
    order = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.withColumn("carry", F.last("last", ignorenulls=True).over(order)).select("key", "part", "carry")
    return inside.join(carry, ["key", "part"], "left").withColumn("w", F.coalesce("w", "carry")).drop("part", "carry")


def get_asof(log: DataFrame, span: int | None = None) -> DataFrame:
    """Each GET with the value that its key had at that point: an as-of join of the log to itself, cut at spans if given."""
    gets = _seen(log, span).where("op = 'GET'")
    return gets.select("seq", "key", F.when(F.col("w.op") == "SET", F.col("w.value")).alias("value"))


def bulk(value: Column) -> Column:
    """A bulk reply; null is nil."""
    size = F.octet_length(value).cast("string")
    return F.coalesce(F.concat(F.lit("$"), size, F.lit("\r\n"), value, F.lit("\r\n")), F.lit("$-1\r\n"))


def replies(log: DataFrame, workers: int = 1, span: int | None = None) -> DataFrame:
    """The wire reply of each command: of SET, DEL (always 1), WKS, and of GET by the as-of read, cut at spans if given."""
    seen = _seen(log, span)
    op = F.col("op")
    reply = (
        F.when(op == "SET", F.lit("+OK\r\n"))
        .when(op == "DEL", F.lit(":1\r\n"))
        .when(op == "WKS", F.lit(f":{workers}\r\n"))
        .when(op == "GET", bulk(F.when(F.col("w.op") == "SET", F.col("w.value"))))
    )
    existed = F.when(op == "DEL", F.coalesce(F.col("w.op") == "SET", F.lit(False)))
    return seen.select("seq", "key", "op", reply.alias("reply"), existed.alias("existed"))


def reply_buffers(replied: DataFrame, commands: int = 128) -> DataFrame:
    """(conn, part, data): what goes back to each connection, in the order of its commands, whichever shard replied first.

    From (conn, place, reply), place from 0; a buffer has the replies of so many commands, so a busy connection is many.
    """
    cut = replied.groupBy("conn", F.floor(F.col("place") / commands).alias("part"))
    return cut.agg(F.array_join(F.array_sort(F.collect_list(F.struct("place", "reply")))["reply"], "").alias("data"))


def lookup(current: DataFrame, key: str) -> DataFrame:
    return current.where(F.col("key") == key)


def multi_get(current: DataFrame, keys: DataFrame) -> DataFrame:
    """Extension: (pos, key) with each key's value, null where it has none; the input order stays in pos."""
    return keys.join(current.select("key", "value"), "key", "left").select("pos", "key", "value")


def multi_set(log: DataFrame, pairs: DataFrame, first_seq: int) -> DataFrame:
    """Extension: the log with (pos, key, value) appended as SETs from first_seq on."""
    more = pairs.select((F.col("pos") + first_seq).alias("seq"), "key", F.lit("SET").alias("op"), "value")
    return log.unionByName(more)


def tiered_get(keys: DataFrame, *tiers: DataFrame) -> DataFrame:
    """Reads through tiers, newest first: the first that has the key decides, a tombstone there too."""
    ranked = reduce(DataFrame.unionByName, [t.select("key", "op", "value", F.lit(k).alias("tier")) for k, t in enumerate(tiers)])
    first = ranked.groupBy("key").agg(F.min_by(F.struct("tier", "op", "value"), "tier").alias("w"))
    found = keys.join(first, "key", "left")
    hit = F.col("w.op") == "SET"
    return found.select("key", F.when(hit, F.col("w.value")).alias("value"), F.coalesce(hit, F.lit(False)).alias("found"), F.col("w.tier").alias("tier"))


def range_scan(current: DataFrame, low: str, high: str) -> DataFrame:
    """Extension: keys from low up to, not including, high."""
    return current.where((F.col("key") >= low) & (F.col("key") < high))


def workers(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1).select(F.lit(n).alias("workers"))


def random_below(number: Column, most: int, seed: int = 42) -> Column:
    """A number below `most` for each number, the same each time: a multiplicative congruence."""
    mixed = F.pmod((number + seed).cast("decimal(20,0)") * F.lit(2862933555777941).cast("decimal(17,0)"), F.lit(4294967291).cast("decimal(10,0)"))
    return F.floor(mixed.cast("bigint") / 65536) % most


def generated(spark: SparkSession, n: int, form: str = "key:%08d", value: str = "val1", key: Column | None = None) -> DataFrame:
    """A log of SETs as load tests send them: keys in sequence, or of another number made from `id`."""
    number = F.col("id") if key is None else key
    return spark.range(n).select(F.col("id").alias("seq"), F.format_string(form, number).alias("key"), F.lit("SET").alias("op"), F.lit(value).alias("value"))


def stress_pairs(spark: SparkSession, threads: int, ops: int) -> DataFrame:
    """The key and value of each operation of each thread of the verifying load test."""
    ids = spark.range(threads * ops).select(F.expr(f"id div {ops}").alias("t"), (F.col("id") % ops).alias("i"))
    return ids.select(F.format_string("key:%d:%d", "t", "i").alias("key"), F.format_string("val:%d:%d_long_suffix_to_trigger_arena_fill", "t", "i").alias("value"))


def key_statistics(log: DataFrame) -> DataFrame:
    """Shortest key and what all keys begin with: that of the least and the greatest."""
    from tidelog.functions.strings import common_prefix

    ends = log.agg(F.min(F.octet_length("key")).alias("min_bytes"), F.min("key").alias("a"), F.max("key").alias("z"))
    return ends.select("min_bytes", common_prefix(F.col("a"), F.col("z")).alias("prefix"))
