"""The registered queries over the provided tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import hashing, matrix, strings
from tidelog.operators import ecs, log, metrics, ranking, resp, runs, spatial
from tidelog.sources import dumps
from tidelog.storage import new_path
from tidelog.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
RUN, EVERY, WORKERS = 2500, 1024, 7

KV = """kv as (
    select event_id as seq, 'key:' || lpad(cast(user_id as varchar), 8, '0') as key,
        case event_type when 'error' then 'DEL' when 'view' then 'GET' else 'SET' end as op,
        case when event_type not in ('error', 'view') then event_type || ':' || cast(event_id as varchar) end as value
    from events)"""
LAST = "last as (select * from (select *, row_number() over (partition by key order by seq desc) as rn from kv where op <> 'GET') where rn = 1)"
RUNS = f"""runs as (select seq // {RUN} as run, key, seq, op, value from (
    select *, row_number() over (partition by seq // {RUN}, key order by seq desc) as rn from kv where op <> 'GET') where rn = 1)"""
CRLF = "chr(13) || chr(10)"


def query(name: str, sql: str | None = None):
    """Registers a query, and the SQL for it."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.from_events(table(spark, sf_dir, "events"))


def kv_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.snapshot(kv(spark, sf_dir), RUN)


# --- commands


@query("kv_state_lww", f"with {KV}, {LAST} select key, value, seq from last where op = 'SET'")
def kv_state_lww(spark, sf_dir):
    return log.state(kv(spark, sf_dir))


@query("kv_tombstones", f"with {KV}, {LAST} select key, seq from last where op = 'DEL'")
def kv_tombstones(spark, sf_dir):
    return log.tombstones(kv(spark, sf_dir))


_ASOF = f"""with {KV}, w as (
    select *, last_value(case when op <> 'GET' then op end ignore nulls) over p as before_op, max(case when op <> 'GET' then seq end) over p as before_seq
    from kv window p as (partition by key order by seq rows between unbounded preceding and 1 preceding))"""


@query("kv_get_asof", f"{_ASOF} select w.seq, w.key, case when b.op = 'SET' then b.value end as value from w left join kv b on b.seq = w.before_seq where w.op = 'GET'")
def kv_get_asof(spark, sf_dir):
    return log.get_asof(kv(spark, sf_dir))


@query("kv_get_asof_split", ORACLE_SQL["kv_get_asof"])
def kv_get_asof_split(spark, sf_dir):
    """The same reads with each key's log cut into parts, for hot keys."""
    return log.get_asof(kv(spark, sf_dir), span=1000)


@query(
    "kv_replies",
    f"""{_ASOF} select w.seq, w.key, w.op, case w.op when 'SET' then '+OK' || {CRLF} when 'DEL' then ':1' || {CRLF}
        else coalesce('$' || cast(octet_length(encode(case when b.op = 'SET' then b.value end)) as varchar) || {CRLF} || case when b.op = 'SET' then b.value end || {CRLF}, '$-1' || {CRLF}) end as reply,
        case when w.op = 'DEL' then coalesce(b.op = 'SET', false) end as existed
    from w left join kv b on b.seq = w.before_seq""",
)
def kv_replies(spark, sf_dir):
    return log.replies(kv(spark, sf_dir))


@query("kv_replies_split", ORACLE_SQL["kv_replies"])
def kv_replies_split(spark, sf_dir):
    """The same replies with each key's log cut into parts, for hot keys."""
    return log.replies(kv(spark, sf_dir), span=1000)


@query("kv_reply_buffers", f"with r as ({ORACLE_SQL['kv_replies']}) select seq % 64 as conn, seq // 64 // 128 as part, string_agg(reply, '' order by seq) as data from r group by 1, 2")
def kv_reply_buffers(spark, sf_dir):
    """The replies of 64 connections, computed key by key, in each connection's order again."""
    replied = log.replies(kv(spark, sf_dir)).select((F.col("seq") % 64).alias("conn"), F.expr("seq div 64").alias("place"), "reply")
    return log.reply_buffers(replied)


@query("kv_point_lookup", f"with {KV}, {LAST} select key, value, seq from last where op = 'SET' and key = 'key:00000007'")
def kv_point_lookup(spark, sf_dir):
    return log.lookup(log.state(kv(spark, sf_dir)), "key:00000007")


@query("kv_mget", f"with {KV}, {LAST}, k as (select range as pos, 'key:' || lpad(cast(range * 3 as varchar), 8, '0') as key from range(60)) select pos, k.key, value from k left join last on k.key = last.key and op = 'SET'")
def kv_mget(spark, sf_dir):
    keys = spark.range(60).select(F.col("id").alias("pos"), strings.padded_key("key:", F.col("id") * 3).alias("key"))
    return log.multi_get(log.state(kv(spark, sf_dir)), keys)


@query("kv_mset", f"with {KV}, kv2 as (select * from kv union all select 1000000000 + range, 'key:' || lpad(cast(range as varchar), 8, '0'), 'SET', 'many:' || cast(range as varchar) from range(20)), {LAST.replace('from kv ', 'from kv2 ')} select key, value, seq from last where op = 'SET'")
def kv_mset(spark, sf_dir):
    pairs = spark.range(20).select(F.col("id").alias("pos"), strings.padded_key("key:", F.col("id")).alias("key"), F.concat(F.lit("many:"), F.col("id").cast("string")).alias("value"))
    return log.state(log.multi_set(kv(spark, sf_dir), pairs, 1_000_000_000))


@query("kv_range_scan", f"with {KV}, {LAST} select key, value, seq from last where op = 'SET' and key >= 'key:00000020' and key < 'key:00000060'")
def kv_range_scan(spark, sf_dir):
    return log.range_scan(log.state(kv(spark, sf_dir)), "key:00000020", "key:00000060")


@query("kv_workers", f"select {WORKERS} as workers")
def kv_workers(spark, sf_dir):
    return log.workers(spark, WORKERS)


@query(
    "kv_tiered_get",
    f"""with {KV}, {RUNS}, top as (select max(run) as top from runs), t as (
        select key, op, value, cast(least(top - run, 2) as int) as tier, row_number() over (partition by key order by run desc) as rn from runs, top),
    k as (select distinct key from kv)
    select k.key, case when op = 'SET' then value end as value, coalesce(op = 'SET', false) as found, tier from k left join t on k.key = t.key and rn = 1""",
)
def kv_tiered_get(spark, sf_dir):
    """All keys, read through the newest run, the run before it and the last writes of all older ones."""
    r = kv_runs(spark, sf_dir)
    top = r.agg(F.max("run")).first()[0] or 0
    older = log.latest(r.where(F.col("run") < top - 1))
    return log.tiered_get(kv(spark, sf_dir).select("key").distinct(), r.where(F.col("run") == top), r.where(F.col("run") == top - 1), older)


@query("kv_op_counts", f"with {KV} select op, count(*) as ops from kv group by op")
def kv_op_counts(spark, sf_dir):
    return metrics.op_counts(kv(spark, sf_dir))


@query("kv_key_statistics", f"with {KV} select min(octet_length(encode(key))) as min_bytes, (select substr(a, 1, coalesce((select min(i) from range(1, 13) r(i) where substr(a, i, 1) <> substr(z, i, 1)) - 1, 12)) from (select min(key) as a, max(key) as z from kv)) as prefix from kv")
def kv_key_statistics(spark, sf_dir):
    return log.key_statistics(kv(spark, sf_dir)).select(F.col("min_bytes").cast("bigint").alias("min_bytes"), "prefix")


@query("gen_stress_pairs", "select 'key:' || (range // 1000) || ':' || (range % 1000) as key, 'val:' || (range // 1000) || ':' || (range % 1000) || '_long_suffix_to_trigger_arena_fill' as value from range(4000)")
def gen_stress_pairs(spark, sf_dir):
    return log.stress_pairs(spark, 4, 1000)


@query("gen_sequential", "select range as seq, 'key:' || lpad(cast(range as varchar), 8, '0') as key, 'SET' as op, 'val1' as value from range(20000)")
def gen_sequential(spark, sf_dir):
    return log.generated(spark, 20000)


@query("gen_modulo", "select range as seq, 'key:' || lpad(cast(range % 512 as varchar), 4, '0') as key, 'SET' as op, 'val1' as value from range(20000)")
def gen_modulo(spark, sf_dir):
    return log.generated(spark, 20000, "key:%04d", key=F.col("id") % 512)


@query("gen_random", "select cast(range as bigint) as seq, 'key:' || lpad(cast(((range + 42) * 2862933555777941 % 4294967291 // 65536) % 10000 as varchar), 4, '0') as key, 'SET' as op, 'val1' as value from (select cast(range as hugeint) as range from range(20000))")
def gen_random(spark, sf_dir):
    return log.generated(spark, 20000, "key:%04d", key=log.random_below(F.col("id"), 10000))


# --- runs and compaction


@query("kv_runs", f"with {KV}, {RUNS} select run, key, seq, op, value from runs")
def kv_runs_query(spark, sf_dir):
    return kv_runs(spark, sf_dir)


@query("kv_compact", f"with {KV}, {LAST} select key, value from last where op = 'SET'")
def kv_compact(spark, sf_dir):
    return runs.compact(kv_runs(spark, sf_dir))


@query("kv_written_runs", f"with {KV}, {LAST} select key, value from last where op = 'SET'")
def kv_written_runs(spark, sf_dir):
    """Runs written sorted, a base published from them, and read back."""
    path = new_path(spark, "runs")
    runs.write_runs(kv_runs(spark, sf_dir), f"{path}/pending", WORKERS)
    base = runs.VersionedTable(spark, f"{path}/base")
    base.publish(runs.compact(spark.read.parquet(f"{path}/pending")))
    return base.read()


@query("kv_recover", f"with {KV}, {LAST} select key, seq, op, value from last")
def kv_recover(spark, sf_dir):
    return runs.recover(kv_runs(spark, sf_dir))


@query("kv_sorted_desc", f"with {KV}, {LAST} select key, value, row_number() over (order by key desc) - 1 as rank from last where op = 'SET'")
def kv_sorted_desc(spark, sf_dir):
    return ranking.ranked(log.state(kv(spark, sf_dir)).select("key", "value"), [("key", False)])


@query("kv_sparse_index", f"with o as (select 'o:' || lpad(cast(o_orderkey as varchar), 10, '0') as key from orders) select rn, key from (select key, row_number() over (order by key desc) - 1 as rn from o) where rn % {EVERY} = 0")
def kv_sparse_index(spark, sf_dir):
    return runs.sparse_index(order_keys(spark, sf_dir).select("key"), EVERY)


def order_keys(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o:"), F.lpad(F.col("o_orderkey").cast("string"), 10, "0")).alias("key"), F.col("o_custkey").cast("string").alias("value"))


@query("kv_indexed_lookup", "select 'o:' || lpad(cast(o_orderkey as varchar), 10, '0') as key, cast(o_custkey as varchar) as value from orders where o_orderkey = 777")
def kv_indexed_lookup(spark, sf_dir):
    """A base written in ranges of keys, its index beside it, and a point read by both."""
    path = new_path(spark, "sorted")
    runs.sort_for_reads(order_keys(spark, sf_dir)).write.parquet(f"{path}/base")
    runs.file_index(spark, f"{path}/base", EVERY).write.parquet(f"{path}/index")
    return runs.indexed_lookup(spark.read.parquet(f"{path}/base"), spark.read.parquet(f"{path}/index"), "o:0000000777", EVERY)


@query("kv_record_bytes", f"with {KV}, {RUNS} select run, count(*) as records, cast(sum((8 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) + 7) // 8 * 8) as bigint) as bytes from runs group by run")
def kv_record_bytes(spark, sf_dir):
    return kv_runs(spark, sf_dir).groupBy("run").agg(F.count("*").alias("records"), F.sum(runs.record_bytes(F.col("key"), F.col("value"))).alias("bytes"))


@query("kv_dump_sizes", f"with {KV}, {RUNS} select run, cast(sum((8 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) + 7) // 8 * 8) as bigint) as bytes, cast((count(*) + {EVERY - 1}) // {EVERY} as int) as entries from runs group by run")
def kv_dump_sizes(spark, sf_dir):
    """Binary dumps of all runs, with an index entry, of 24 bytes, for each 1024 records or part of them."""
    made = dumps.dumped(kv_runs(spark, sf_dir))
    return made.select("run", F.octet_length("data").cast("bigint").alias("bytes"), (F.octet_length("index") / 24).cast("int").alias("entries"))


_SIZE = "(8 + octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0) + 7) // 8 * 8"
_RECORDS = f"o as (select run, key, op, value, cast(coalesce(sum({_SIZE}) over (partition by run order by key desc rows between unbounded preceding and 1 preceding), 0) as bigint) as byte_offset, row_number() over (partition by run order by key desc) - 1 as rn from runs)"


@query("kv_dump_records", f"with {KV}, {RUNS}, {_RECORDS} select run, byte_offset, key, op, value from o")
def kv_dump_records(spark, sf_dir):
    """Run files written in the binary format and scanned again."""
    path = dumps.write_dumps(kv_runs(spark, sf_dir), new_path(spark, "dumps"))
    return dumps.read_runs(spark, f"{path}/*.bin").select(dumps.run_of("file").alias("run"), F.col("offset").alias("byte_offset"), F.col("key").cast("string").alias("key"), "op", F.col("value").cast("string").alias("value"))


@query("kv_dump_index", f"with {KV}, {RUNS}, {_RECORDS} select run, rn, key, byte_offset from o where rn % {EVERY} = 0")
def kv_dump_index(spark, sf_dir):
    """Their sparse indexes, loaded."""
    path = dumps.write_dumps(kv_runs(spark, sf_dir), new_path(spark, "dumps"))
    return dumps.read_indexes(spark, f"{path}/*.idx").select(dumps.run_of("file").alias("run"), "rn", F.col("key").cast("string").alias("key"), F.col("offset").alias("byte_offset"))


@query("kv_run_files", f"select cast(s as int) as shard, 3 as chunks, cast(3 * 100 * s + 3 as bigint) as bytes from range({WORKERS}) r(s)")
def kv_run_files(spark, sf_dir):
    made = spark.range(30).select(F.format_string("/data/shard_%d_chunk_%d.bin", F.expr("id div 3"), F.col("id") % 3).alias("path"), (F.expr("id div 3") * 100 + F.col("id") % 3).alias("length"))
    other = spark.range(5).select(F.format_string("/data/thread_%d.mmap", "id").alias("path"), F.col("id").alias("length"))
    return runs.run_files(made.union(other), WORKERS).select("shard", F.size("chunks").alias("chunks"), "bytes")


# --- protocol


_FRAME = f"""case op when 'SET' then '*3' when 'WKS' then '*1' else '*2' end || {CRLF} || '$3' || {CRLF} || op || {CRLF}
    || '$' || octet_length(encode(key)) || {CRLF} || key || {CRLF} || case when op = 'SET' then '$' || octet_length(encode(value)) || {CRLF} || value || {CRLF} else '' end"""


@query("resp_encode", f"with {KV} select seq, {_FRAME} as frame from kv")
def resp_encode(spark, sf_dir):
    return kv(spark, sf_dir).select("seq", resp.frame(F.col("op"), F.col("key"), F.col("value")).alias("frame"))


def buffers(spark, sf_dir):
    frames = kv(spark, sf_dir).select(F.expr("seq div 100").alias("conn"), F.struct("seq", resp.frame(F.col("op"), F.col("key"), F.col("value")).alias("f")).alias("s"))
    return frames.groupBy("conn").agg(F.array_sort(F.collect_list("s")).alias("fs")).select("conn", F.array_join("fs.f", "").alias("data"))


@query("resp_parse", f"with {KV} select seq // 100 as conn, row_number() over (partition by seq // 100 order by seq) - 1 as place, op, key, value from kv")
def resp_parse(spark, sf_dir):
    """Frames of a hundred commands joined to a buffer, and parsed again by their lengths."""
    return resp.parse_frames(buffers(spark, sf_dir), "conn", "data").select("conn", "place", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("resp_parse_text", f"with {KV} select seq, op, key, value from kv")
def resp_parse_text(spark, sf_dir):
    frames = kv(spark, sf_dir).select("seq", resp.parse_text(resp.frame(F.col("op"), F.col("key"), F.col("value"))).alias("c"))
    return frames.select("seq", "c.*")


@query("resp_corrupt", f"with {KV} select count(*) as good, cast(0 as bigint) as open, (select count(*) from kv where seq % 50 = 0) as bad from kv")
def resp_corrupt(spark, sf_dir):
    """Unknown and lower-case commands go to a side output and don't hold up those behind them."""
    frames = kv(spark, sf_dir).select("seq", F.concat(F.when(F.col("seq") % 50 == 0, F.lit("*1\r\n$4\r\nping\r\n")).otherwise(""), resp.frame(F.col("op"), F.col("key"), F.col("value"))).alias("data"))
    parsed = resp.parse_frames(frames, "seq", "data")
    return parsed.agg(F.count_if(F.col("corrupt").isNull()).alias("good"), F.count_if(F.col("op") == "REST").alias("open"), F.count_if(F.col("op").isNull()).alias("bad"))


# --- routing


def _hash_sql(key: str, n: int) -> str:
    """DuckDB's form of the routing hash of n-byte ASCII keys."""
    crc = ", ".join(map(str, hashing.crc_table()))
    size = (n + 7) // 8 * 8
    return f"""list_reduce(list_concat([cast({hashing.SEED & 0xFFFFFFFF} as bigint)], list_transform(range(1, {size + 1}), lambda i: cast(case when i <= {n} then unicode(substr({key}, cast(i as int), 1)) else 0 end as bigint))),
        lambda acc, b: (acc >> 8) ^ ([{crc}])[cast(xor(acc, b) & 255 as int) + 1])""".replace("(acc >> 8) ^ (", "xor(acc >> 8, (").replace("& 255 as int) + 1])", "& 255 as int) + 1]))")


_ROUTED = f"""with {KV}, k as (select distinct key from kv), c as (select key, {_hash_sql("key", 12)} as crc from k),
    m as (select key, (cast(crc as hugeint) * {hashing.MULTIPLIER}) % 18446744073709551616 as p from c),
    h as (select key, (p // 4294967296) * 4294967296 + xor(cast(p % 4294967296 as bigint), cast(p // 8589934592 as bigint)) as hash from m)"""


@query("shard_route", f"{_ROUTED} select key, cast(hash as varchar) as hash, cast(hash % {WORKERS} as int) as shard from h")
def shard_route(spark, sf_dir):
    keys = kv(spark, sf_dir).select("key").distinct().withColumn("h", hashing.routing_hash(F.col("key")))
    return keys.select("key", F.col("h").cast("string").alias("hash"), (F.col("h") % WORKERS).cast("int").alias("shard"))


@query("shard_counts", f"{_ROUTED} select cast(hash % {WORKERS} as int) as shard, count(*) as ops from h join kv using (key) group by 1")
def shard_counts(spark, sf_dir):
    """Counted by key first, so that each key is hashed once."""
    keys = kv(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))
    return keys.groupBy(hashing.shard(F.col("key"), WORKERS).alias("shard")).agg(F.sum("n").alias("ops"))


@query("shard_misrouted", f"{_ROUTED} select count(*) as keys, count(*) filter (cast(hash % {WORKERS} as int) <> 0) as misrouted from h")
def shard_misrouted(spark, sf_dir):
    """What a port of shard 0 must refuse."""
    return kv(spark, sf_dir).select("key").distinct().agg(F.count("*").alias("keys"), F.count_if(hashing.shard(F.col("key"), WORKERS) != 0).alias("misrouted"))


@query(
    "map_hash",
    f"""{_ROUTED}, q as (select key, ((hash % 4294967296) * {hashing.MAP_MULTIPLIER} + ((hash // 4294967296) * {hashing.MAP_MULTIPLIER} % 4294967296) * 4294967296) % 18446744073709551616 as p from h)
    select key, cast((p // 4294967296) * 4294967296 + xor(cast(p % 4294967296 as bigint), cast(p // 8589934592 as bigint)) as varchar) as hash from q""",
)
def map_hash(spark, sf_dir):
    keys = kv(spark, sf_dir).select("key").distinct().withColumn("h", hashing.routing_hash(F.col("key")))
    return keys.select("key", hashing.map_hash(F.col("h")).cast("string").alias("hash"))


# --- scalar functions


@query(
    "string_functions",
    """select c_custkey, octet_length(encode(c_name)) as bytes, c_name || '/' || c_mktsegment as joined, substr(c_name, 3, 1) as third,
        case when c_name < c_mktsegment then -1 when c_name > c_mktsegment then 1 else 0 end as compared, regexp_extract('  ' || c_mktsegment || ' x', '(\\S+)', 1) as token,
        try_cast(substr(c_name, -4) as bigint) as number from customer""",
)
def string_functions(spark, sf_dir):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        strings.byte_length(name).alias("bytes"),
        strings.append(name, F.lit("/"), segment).alias("joined"),
        strings.char_at(name, F.lit(2)).alias("third"),
        strings.compare(name, segment).alias("compared"),
        strings.first_token(F.concat(F.lit("  "), segment, F.lit(" x"))).alias("token"),
        strings.number_from(F.substring(name, -4, 4)).alias("number"),
    )


@query(
    "storage_arithmetic",
    """select p_partkey, case when p_size * 40 <= 128 then 0 when p_size * 40 <= 256 then 1 when p_size * 40 <= 512 then 2 when p_size * 40 <= 1024 then 3 when p_size * 40 <= 2048 then 4
        when p_size * 40 <= 4096 then 5 when p_size * 40 <= 8192 then 6 end as slab, cast((p_size + 7) // 8 * 8 as bigint) as aligned, cast(p_size as bigint) * 4294967296 + 12 as header, cast(12 as bigint) as key_size, cast(p_size as bigint) as value_size from part""",
)
def storage_arithmetic(spark, sf_dir):
    size = F.col("p_size")
    header = hashing.pack_header(F.lit(12), size)
    k, v = hashing.unpack_header(F.col("header"))
    made = table(spark, sf_dir, "part").select("p_partkey", hashing.slab_class(size * 40).alias("slab"), hashing.aligned(size).alias("aligned"), header.alias("header"))
    return made.select("*", k.alias("key_size"), v.alias("value_size"))


@query(
    "matrix_functions",
    """with p as (select s_suppkey, cast(s_suppkey % 7 + 1 as double) as a, cast(s_suppkey % 5 + 2 as double) as b from supplier)
    select s_suppkey, a * 2 as scaled_x, b * 3 + 1 as moved_y, round(1 / (a * 2), 9) as inverse_x, a as transposed from p""",
)
def matrix_functions(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 7 + 1).cast("double").alias("a"), (F.col("s_suppkey") % 5 + 2).cast("double").alias("b"))
    a, b, one = F.col("a"), F.col("b"), F.lit(1.0)
    p = p.withColumn("s", matrix.scale(a, b, one)).withColumn("t", matrix.translation(a, one, one)).withColumn("d", matrix.scale(F.lit(2.0), F.lit(3.0), one))
    p = p.withColumn("m", matrix.multiply(F.col("s"), F.col("d"))).withColumn("q", matrix.multiply(F.col("m"), matrix.translation(one, one, one)))
    return p.select("s_suppkey", F.col("m")[0].alias("scaled_x"), (F.col("m")[5] + F.col("q")[13]).alias("moved_y"), F.round(matrix.inverse(F.col("q"))[0], 9).alias("inverse_x"), matrix.transpose(F.col("t"))[3].alias("transposed"))


_ANGLE = "((s_suppkey % 7 + 1) / 8.0::double)"


@query(
    "matrix_projections",
    f"""select s_suppkey, round(1 / tan({_ANGLE} / 2) / 1.5, 9) as persp_x, round(1 / tan({_ANGLE} / 2), 9) as persp_y, round(100 / (100 - 0.5), 9) as persp_z, 1.0::double as persp_w, round(-0.5 * 100 / (100 - 0.5), 9) as persp_near,
        round(2 / {_ANGLE}, 9) as ortho_x, round(1 / (100 - 0.5), 9) as ortho_z, round(-0.5 / (100 - 0.5), 9) as ortho_near, round(cos({_ANGLE}), 9) as turned_cos, round(sin({_ANGLE}), 9) as turned_x, round(-sin({_ANGLE}), 9) as turned_z, 4.0::double as trace from supplier""",
)
def matrix_projections(spark, sf_dir):
    """Perspective and orthographic projections, rotations about each axis, the identity."""
    angle = (F.col("s_suppkey") % 7 + 1) / F.lit(8.0)
    p = table(spark, sf_dir, "supplier").select(
        "s_suppkey",
        matrix.perspective(angle, F.lit(1.5), F.lit(0.5), F.lit(100.0)).alias("p"),
        matrix.orthographic(angle, F.lit(2.0), F.lit(0.5), F.lit(100.0)).alias("o"),
        *[matrix.rotation(axis, angle).alias(f"r{axis}") for axis in "xyz"],
    )
    same = matrix.multiply(matrix.identity(), matrix.identity())
    cell = lambda name, k, alias: F.round(F.col(name)[k], 9).alias(alias)
    return p.select(
        "s_suppkey",
        *[cell("p", k, f"persp_{n}") for k, n in ((0, "x"), (5, "y"), (10, "z"), (11, "w"), (14, "near"))],
        *[cell("o", k, f"ortho_{n}") for k, n in ((0, "x"), (10, "z"), (14, "near"))],
        cell("rz", 0, "turned_cos"),
        cell("rx", 6, "turned_x"),
        cell("ry", 2, "turned_z"),
        sum((same[5 * k] for k in range(1, 4)), same[0]).alias("trace"),
    )


@query(
    "byte_functions",
    """select c_custkey, cast(octet_length(encode(c_name)) as int) as bytes, 67 + c_custkey % 3 as third, case when c_custkey % 4 = 0 then null else 2 + 2 * (c_custkey % 4) end as differs from (select c_custkey, 'é' || c_name as c_name from customer)""",
)
def byte_functions(spark, sf_dir):
    """The byte at a place, and the first byte that two strings differ in, of texts that aren't ASCII."""
    n = F.col("c_custkey") % 4
    name = F.concat(F.lit("é"), F.col("c_name"))
    a = F.concat(F.repeat(F.lit("é"), (n + 1).cast("int")), F.lit("x"))
    b = F.concat(F.repeat(F.lit("é"), (n + 1).cast("int")), F.when(n == 0, "x").otherwise("y"))
    third = F.concat(F.lit("é"), F.element_at(F.array(F.lit("C"), F.lit("D"), F.lit("E")), (F.col("c_custkey") % 3 + 1).cast("int")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.octet_length(name).alias("bytes"), strings.byte_at(third, 2).cast("bigint").alias("third"), strings.first_differing_byte(a, b).cast("bigint").alias("differs"))


# --- entities


def customers(spark, sf_dir):
    return ecs.component(table(spark, sf_dir, "customer"), "c_custkey", name="c_name", balance="c_acctbal", nation="c_nationkey")


def spending(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return ecs.component(totals, "o_custkey", orders="n")


def odd_nations(spark, sf_dir):
    return customers(spark, sf_dir).where("nation % 2 = 1").select(ecs.ID, (F.col("nation") * 10).alias("zone"))


_CUSTOMERS = "c as (select c_custkey as entity_id, c_name as name, c_acctbal as balance, c_nationkey as nation from customer)"
_SPENDING = "s as (select o_custkey as entity_id, count(*) as orders from orders group by 1)"
_ODD = "z as (select c_custkey as entity_id, c_nationkey * 10 as zone from customer where c_nationkey % 2 = 1)"


@query("ecs_view_join", f"with {_CUSTOMERS}, {_SPENDING}, {_ODD} select entity_id, name, balance, nation, orders, zone from c join s using (entity_id) join z using (entity_id)")
def ecs_view_join(spark, sf_dir):
    return ecs.view(customers(spark, sf_dir), spending(spark, sf_dir), odd_nations(spark, sf_dir))


@query("ecs_orders_view", "select o_orderkey, c_name, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def ecs_orders_view(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("ecs_group_sync", f"with {_CUSTOMERS}, {_SPENDING} select entity_id, name, balance, nation, orders from c join s using (entity_id) where entity_id % 11 <> 0")
def ecs_group_sync(spark, sf_dir):
    """A group of part of the entities, brought up to date by an insert and a delete."""
    c, s = customers(spark, sf_dir), spending(spark, sf_dir)
    group = ecs.Group(c.where("entity_id % 3 = 0"), s)
    group = group.sync(c.where("entity_id % 3 <> 0").select(ecs.ID), c, s)
    return group.desync(c.where("entity_id % 11 = 0").select(ecs.ID)).rows


@query("ecs_group_each", f"with {_CUSTOMERS}, {_SPENDING} select entity_id, balance * 2 + orders as score from c join s using (entity_id)")
def ecs_group_each(spark, sf_dir):
    """A function of the caller's own over a group's rows, batch by batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["entity_id"], pc.add(pc.multiply(b["balance"], 2.0), pc.cast(b["orders"], pa.float64()))], names=["entity_id", "score"])

    return ecs.Group(customers(spark, sf_dir), spending(spark, sf_dir)).each(score, "entity_id bigint, score double")


@query("ecs_group_sort_str", f"with {_CUSTOMERS} select entity_id, name, row_number() over (order by name desc, entity_id) - 1 as rank from c")
def ecs_group_sort_str(spark, sf_dir):
    return ecs.sort_by_string(customers(spark, sf_dir).select(ecs.ID, "name"), "name")


@query("ecs_group_sort_num", f"with {_CUSTOMERS} select entity_id, balance, row_number() over (order by (balance < 0) desc, abs(balance) desc, entity_id) - 1 as rank from c")
def ecs_group_sort_num(spark, sf_dir):
    return ecs.sort_by_number(customers(spark, sf_dir).select(ecs.ID, "balance"), "balance")


@query("ecs_group_sort_int", f"with {_CUSTOMERS} select entity_id, nation, row_number() over (order by (nation < 0) desc, nation desc, entity_id) - 1 as rank from c")
def ecs_group_sort_int(spark, sf_dir):
    return ecs.sort_by_number(customers(spark, sf_dir).select(ecs.ID, "nation"), "nation")


@query("ecs_destroy", f"with {_CUSTOMERS}, {_SPENDING} select entity_id, name, balance, nation, orders from c join s using (entity_id) where entity_id % 5 <> 0")
def ecs_destroy(spark, sf_dir):
    registry = ecs.Registry(spark)
    registry.set("customers", customers(spark, sf_dir))
    registry.set("spending", spending(spark, sf_dir))
    registry.destroy(customers(spark, sf_dir).where("entity_id % 5 = 0").select(ecs.ID))
    return registry.view("customers", "spending")


@query("ecs_update", f"with {_CUSTOMERS} select entity_id, name, case when entity_id % 4 = 0 then cast(entity_id as double) else balance end as balance, nation from c")
def ecs_update(spark, sf_dir):
    c = customers(spark, sf_dir)
    return ecs.update(c, c.where("entity_id % 4 = 0").select(ecs.ID, F.col(ecs.ID).cast("double").alias("balance")))


@query("ecs_add_remove", f"with {_CUSTOMERS} select entity_id, nation from c where entity_id % 7 <> 0 union all select 1000000 + range, null from range(50)")
def ecs_add_remove(spark, sf_dir):
    c = customers(spark, sf_dir).select(ecs.ID, "nation")
    return ecs.add(ecs.remove(c, c.where("entity_id % 7 = 0")), ecs.mass_add(spark, 50, 1_000_000, nation="int"))


@query("ecs_contains", f"with {_CUSTOMERS}, k as (select range * 2 as entity_id from range(2000)) select entity_id from k where entity_id in (select entity_id from c)")
def ecs_contains(spark, sf_dir):
    return ecs.contains(customers(spark, sf_dir), spark.range(2000).select((F.col("id") * 2).alias(ecs.ID)))


@query("ecs_capacity", f"with {_CUSTOMERS} select entity_id, name from c where entity_id < 900 order by entity_id limit 500")
def ecs_capacity(spark, sf_dir):
    return ecs.within_capacity(customers(spark, sf_dir).select(ecs.ID, "name"), 900, 500)


@query("ecs_reorder", f"with {_CUSTOMERS}, o as (select entity_id, row_number() over (order by entity_id desc) - 1 as pos from c where entity_id % 2 = 0), n as (select count(*) as k from o) select entity_id, name, coalesce(o.pos, n.k + row_number() over (partition by o.pos is null order by entity_id) - 1) as pos from c left join o using (entity_id), n")
def ecs_reorder(spark, sf_dir):
    c = customers(spark, sf_dir).select(ecs.ID, "name")
    order = ranking.ranked(c.where("entity_id % 2 = 0").select(ecs.ID), [(ecs.ID, False)], "pos")
    return ecs.reorder(c, order)


@query("ecs_create", "select n_name as name, row_number() over (order by n_name) - 1 as entity_id from nation")
def ecs_create(spark, sf_dir):
    return ecs.create_entities(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), "name")


@query("ecs_smallest", "select 'nations' as component, 25 as entities")
def ecs_smallest(spark, sf_dir):
    nations = ecs.component(table(spark, sf_dir, "nation"), "n_nationkey", name="n_name")
    name, n = ecs.smallest(customers=customers(spark, sf_dir), spending=spending(spark, sf_dir), nations=nations)
    return spark.range(1).select(F.lit(name).alias("component"), F.lit(n).cast("bigint").alias("entities"))


# --- space


def positions(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(ecs.ID), *[(e[k] * 10).cast("float").alias(p) for k, p in enumerate("xyz")])


_INV = "cast(cast(1.0 as float) / cast(0.55 as float) as float)"
_AXIS = lambda p: f"cast(trunc(cast({p} * {_INV} as float)) as bigint)"
_POS = "p as (select vec_id as entity_id, cast(embedding[1] * 10 as float) as x, cast(embedding[2] * 10 as float) as y, cast(embedding[3] * 10 as float) as z from embeddings)"
_CELLS = f"{_POS}, cells as (select entity_id, xor(xor({_AXIS('x')} * 73856093, {_AXIS('y')} * 19349663), {_AXIS('z')} * 83492791) & 131071 as cell from p)"


@query("spatial_cells", f"with {_CELLS} select entity_id, cell from cells")
def spatial_cells(spark, sf_dir):
    return spatial.with_cells(positions(spark, sf_dir)).select(ecs.ID, "cell")


@query("spatial_hist", f"with {_CELLS} select cell, count(*) as n from cells group by cell")
def spatial_hist(spark, sf_dir):
    return spatial.histogram(spatial.with_cells(positions(spark, sf_dir)))


@query("spatial_offsets", f"with {_CELLS}, h as (select cell, count(*) as n from cells group by cell) select cell, n, cast(coalesce(sum(n) over (order by cell rows between unbounded preceding and 1 preceding), 0) as bigint) as start from h")
def spatial_offsets(spark, sf_dir):
    return spatial.offsets(spatial.with_cells(positions(spark, sf_dir)))


@query("spatial_scatter", f"with {_CELLS} select entity_id, cell, row_number() over (order by cell, entity_id) - 1 as place from cells")
def spatial_scatter(spark, sf_dir):
    return spatial.scattered(spatial.with_cells(positions(spark, sf_dir)))


_GRID = lambda p: f"(cast(trunc(cast({p} + cast(500 as float) as float)) as int) % 64 + 64) % 64"


@query("grid_cap32", f"with {_POS}, g as (select entity_id, {_GRID('x')} as gx, {_GRID('y')} as gy, {_GRID('z')} as gz from p) select entity_id, gx, gy, gz, slot from (select *, row_number() over (partition by gx, gy, gz order by entity_id) - 1 as slot from g) where slot < 32")
def grid_cap32(spark, sf_dir):
    return spatial.grid(positions(spark, sf_dir))


# --- metrics


_RPS = """c as (select date_trunc('second', ts) as second, count(*) as n from events group by 1),
    s as (select unnest(generate_series((select min(second) from c), (select max(second) from c), interval 1 second)) as second),
    r as (select s.second, coalesce(n, 0) as ops from s left join c using (second))"""


@query("rps_1s", f"with {_RPS} select second, ops from r")
def rps_1s(spark, sf_dir):
    return metrics.per_second(table(spark, sf_dir, "events"))


@query("rps_last100", f"with {_RPS} select second, ops from r order by second desc limit 100")
def rps_last100(spark, sf_dir):
    return metrics.last_samples(metrics.per_second(table(spark, sf_dir, "events")))


@query("rps_plot", f"with {_RPS}, n as (select * from r order by second desc limit 100) select second, -1.0::double + 2.0::double * (row_number() over (order by second) - 1) / 100 as x, ops / 1e6 as y from n")
def rps_plot(spark, sf_dir):
    return metrics.plotted(metrics.per_second(table(spark, sf_dir, "events")))


@query("rps_delta", f"with {_RPS}, d as (select second, sum(ops) over (order by second) as total from (select * from r order by second desc limit 100)) select second, cast(total as bigint) as total, cast(total - coalesce(lag(total) over (order by second), 0) as bigint) as delta from d")
def rps_delta(spark, sf_dir):
    newest = metrics.last_samples(metrics.per_second(table(spark, sf_dir, "events")))
    totals = metrics.gauge(newest.withColumn("part", F.unix_seconds(F.col("second").cast("timestamp"))), "second", "ops", "part").select("second", F.col("gauge").alias("total"))
    return metrics.deltas(totals, "second", "total")


@query("conn_gauge", "select event_id, cast(sum(case event_type when 'signup' then 1 when 'error' then -1 else 0 end) over (order by event_id) as bigint) as gauge from events")
def conn_gauge(spark, sf_dir):
    change = F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    changes = table(spark, sf_dir, "events").select("event_id", change.alias("d"), F.expr("event_id div 1000").alias("part"))
    return metrics.gauge(changes, "event_id", "d", "part").select("event_id", "gauge")


_CHANGE = "case event_type when 'signup' then 1 when 'error' then -1 else 0 end"


@query("conn_plot", f"with {_RPS.replace('count(*)', f'sum({_CHANGE})', 1)}, g as (select second, sum(ops) over (order by second) as conns from r), n as (select * from g order by second desc limit 100) select second, -1.0::double + 2.0::double * (row_number() over (order by second) - 1) / 100 as x, conns / 2000.0::double as y from n")
def conn_plot(spark, sf_dir):
    """Open connections at the end of each of the last seconds."""
    events = table(spark, sf_dir, "events")
    seconds = metrics.per_second(events, amount=F.expr(_CHANGE))
    open_ = metrics.gauge(seconds.withColumn("part", F.expr("unix_seconds(cast(second as timestamp)) div 1000")), "second", "ops", "part")
    return metrics.plotted(open_.select("second", F.col("gauge").alias("conns")), column="conns", unit=2000.0)


@query("throughput", "select count(*) as ops, datediff('microsecond', min(ts), max(ts)) as micros, count(*) * 1000000 / datediff('microsecond', min(ts), max(ts)) as ops_per_s from events")
def throughput(spark, sf_dir):
    return metrics.throughput(table(spark, sf_dir, "events"))


@query(
    "latency_stats",
    """with o as (select cast(round(o_totalprice * 100) as bigint) as us from orders), r as (select us, row_number() over (order by us) - 1 as k, count(*) over () as n from o)
    select max(n) as n, round(avg(us), 3) as mean, max(us) filter (k = cast(floor(n * 0.5) as bigint)) as p50, max(us) filter (k = cast(floor(n * 0.95) as bigint)) as p95, max(us) filter (k = cast(floor(n * 0.99) as bigint)) as p99, max(us) as worst from r""",
)
def latency_stats(spark, sf_dir):
    samples = table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") * 100).cast("bigint").alias("us"))
    return metrics.latency(samples, "us").withColumn("mean", F.round("mean", 3))


@query(
    "thread_report",
    """with m as (select l_suppkey % 24 as thread, count(*) filter (l_returnflag <> 'R') as total_ops, sum(l_partkey) as parse_cycles, sum(l_orderkey) as exec_cycles, sum(l_linenumber) as send_cycles, sum(l_suppkey) as recv_cycles,
        count(*) filter (l_linestatus = 'O') as redirects, count(*) filter (l_returnflag = 'R') as parse_fails from lineitem group by 1)
    select thread, total_ops, cast(parse_cycles // total_ops as bigint) as avg_parse_cycles, cast(exec_cycles // total_ops as bigint) as avg_exec_cycles, cast(send_cycles // total_ops as bigint) as avg_send_cycles, cast(recv_cycles // total_ops as bigint) as avg_recv_cycles, redirects, parse_fails from m where total_ops <> 0""",
)
def thread_report(spark, sf_dir):
    """Threads stand for suppliers."""
    lines = table(spark, sf_dir, "lineitem")
    each = lines.select(
        (F.col("l_suppkey") % 24).alias("thread"),
        F.expr("cast(l_returnflag <> 'R' as bigint)").alias("total_ops"),
        F.col("l_partkey").alias("parse_cycles"),
        F.col("l_orderkey").alias("exec_cycles"),
        F.col("l_linenumber").cast("bigint").alias("send_cycles"),
        F.col("l_suppkey").alias("recv_cycles"),
        F.expr("cast(l_linestatus = 'O' as bigint)").alias("redirects"),
        F.expr("cast(l_returnflag = 'R' as bigint)").alias("parse_fails"),
    )
    return metrics.thread_report(each)


@query("verify_errors", f"with {KV}, {LAST} select count(*) as checked, count(*) filter (op <> 'SET' or value not like 'click:%') as errors from last")
def verify_errors(spark, sf_dir):
    """The state held against what a reader expects: clicks."""
    last = log.latest(kv(spark, sf_dir))
    return metrics.mismatches(last.select(F.concat(F.lit("click:"), F.substring_index("value", ":", -1)).alias("expected"), F.when(F.col("op") == "SET", F.col("value")).alias("actual")))


# --- streams


#: Bytes that a batch of a stream takes at most, so that a flush has about as many.
FLUSH_BYTES = 128 << 20


def event_stream(spark, sf_dir):
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxBytesPerTrigger", FLUSH_BYTES).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes no single file


@query("stream_state", f"with {KV}, {LAST} select key, value, seq from last where op = 'SET'")
def stream_state(spark, sf_dir):
    """The log streamed into levels of runs."""
    path = new_path(spark, "stream")
    sink = ingest.RunSink(runs.VersionedTable(spark, f"{path}/list"), f"{path}/runs")
    ingest.into_runs(log.from_events(event_stream(spark, sf_dir)), sink, f"{path}/checkpoint").awaitTermination()
    return sink.current().where("op = 'SET'").select("key", "value", "seq")


@query("stream_rates", "with c as (select date_trunc('second', ts) as second, count(*) as ops from events group by 1) select second, ops from c where second + interval 1 second <= (select max(ts) - interval 10 second from events)")
def stream_rates(spark, sf_dir):
    """Seconds that the watermark has closed."""
    path = new_path(spark, "rates")
    rates = ingest.rates(event_stream(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))
    rates.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.col("second").cast("timestamp_ntz").alias("second"), "ops")


#: The provider that keyed state needs.
STATE_STORE, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_stateful(spark: SparkSession, stream: DataFrame, path: str, mode: str) -> DataFrame:
    """All that a stream with keyed state gives, batch by batch into a folder, read back; the session's provider stays."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        # a batch that comes again replaces its own folder
        writer = stream.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"))
        writer.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@query("stream_keyed_state", ORACLE_SQL["kv_state_lww"])
def stream_keyed_state(spark, sf_dir):
    """The last writes held in the state store; of a key's changes the newest counts."""
    changes = run_stateful(spark, ingest.keyed_state(log.from_events(event_stream(spark, sf_dir))), new_path(spark, "keyed"), "update")
    return log.state(changes)


@query("stream_frames", ORACLE_SQL["resp_parse"])
def stream_frames(spark, sf_dir):
    """Buffers of a hundred commands cut into pieces of 999 bytes, streamed, and parsed with what is left of a piece carried over."""
    path = new_path(spark, "pieces")
    pieces = buffers(spark, sf_dir).select("conn", F.posexplode(F.expr("transform(sequence(0, greatest(octet_length(data) - 1, 0) div 999), k -> substring(cast(data as binary), cast(k * 999 + 1 as int), 999))")).alias("n", "data"))
    pieces.select("conn", F.col("n").cast("bigint").alias("n"), "data").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("conn bigint, n bigint, data binary").option("maxBytesPerTrigger", FLUSH_BYTES).parquet(f"{path}/in")
    out = run_stateful(spark, ingest.commands(stream), path, "append")
    return out.select("conn", "place", "op", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
