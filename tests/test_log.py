"""Logs, runs and routing on hand-written and random input."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import hashing, strings
from tidelog.operators import log, ranking, runs

TINY = [
    (1, "a", "SET", "1"), (2, "a", "GET", None), (3, "a", "SET", "2"), (4, "a", "DEL", None), (5, "a", "GET", None),
    (6, "b", "GET", None), (7, "c", "DEL", None), (8, "c", "SET", "x"), (9, "c", "GET", None), (10, "ab", "SET", ""),
    (11, "ab", "GET", None), (12, "é", "SET", "ü"), (13, "é", "GET", None),
]
SCHEMA = "seq bigint, key string, op string, value string"


def fold(rows):
    state, reads = {}, {}
    for seq, key, op, value in sorted(rows):
        if op == "GET":
            reads[seq] = state.get(key)
        elif op == "SET":
            state[key] = value
        else:
            state.pop(key, None)
    return state, reads


def random_log(seed, n=400):
    rng = random.Random(seed)
    return [(i, f"k{min(rng.randint(0, 12), rng.randint(0, 12))}", op, f"v{i}" if op == "SET" else None) for i, op in enumerate(rng.choices(["SET", "GET", "DEL"], [5, 4, 2], k=n))]


@pytest.mark.parametrize("rows", [TINY, random_log(1), random_log(2), []], ids=["tiny", "one", "two", "none"])
def test_state_and_reads_are_those_of_a_fold(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    state, reads = fold(rows)
    assert {r.key: r.value for r in log.state(df).collect()} == state
    for span in (None, 7, 50):
        assert {r.seq: r.value for r in log.get_asof(df, span).collect()} == reads
    replies = {r.seq: r.reply for r in log.replies(df).where("op = 'GET'").collect()}
    assert replies == {s: "$-1\r\n" if v is None else f"${len(v.encode())}\r\n{v}\r\n" for s, v in reads.items()}
    for size in (1, 3, 40, 1000):
        made = runs.snapshot(df, size)
        assert {r.key: r.value for r in runs.compact(made).collect()} == state


def test_tiers_mask_with_tombstones(spark):
    tier = lambda *rows: spark.createDataFrame(list(rows), "key string, op string, value string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    got = log.tiered_get(keys, tier(("a", "DEL", None)), tier(("a", "SET", "1"), ("b", "SET", "")), tier(("c", "SET", "3"), ("b", "SET", "old")))
    assert {r.key: (r.value, r.found, r.tier) for r in got.collect()} == {"a": (None, False, 0), "b": ("", True, 1), "c": ("3", True, 2), "d": (None, False, None)}


def test_delete_replies_say_whether_the_key_was_there(spark):
    got = {r.seq: (r.reply, r.existed) for r in log.replies(spark.createDataFrame(TINY, SCHEMA)).where("op = 'DEL'").collect()}
    assert got == {4: (":1\r\n", True), 7: (":1\r\n", False)}


def test_routing_hash_vectors(spark):
    # fixed values: key, hash
    vectors = {"": 10610984462542088678, "a": 18408156846829946570, "key:0000": 17163115094763094989, "key:00000000": 18062370131776129008, "key:00000001": 4409792577621435901, "key:00000042": 10391877811071253627, "lat:00000007": 5878452491961808761, "key:0000\0": 6387262201541170090}
    df = spark.createDataFrame([(k,) for k in vectors], "key string")
    got = df.select("key", hashing.routing_hash(F.col("key")).alias("h"), hashing.shard(F.col("key"), 11).alias("s")).collect()
    assert {r.key: int(r.h) for r in got} == vectors
    assert {r.key: r.s for r in got} == {k: v % 11 for k, v in vectors.items()}


def test_map_hash_is_the_routing_hash_mixed_once_more(spark):
    rng = random.Random(6)
    keys = ["", "a", "key:00000042", *("x" * rng.randint(1, 40) + str(rng.random()) for _ in range(30))]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    routed = df.withColumn("h", hashing.routing_hash(F.col("key")))
    for r in routed.withColumn("m", hashing.map_hash(F.col("h"))).collect():
        mixed = int(r.h) * 0xC4CEB9FE1A85EC53 % (1 << 64)
        assert int(r.m) == mixed ^ mixed >> 33


def test_replies_go_back_in_each_connections_order(spark):
    rng = random.Random(7)
    rows = [(c, k, f"{c}.{k};") for c in range(3) for k in range((0, 5, 23)[c])]
    got = log.reply_buffers(spark.createDataFrame(rng.sample(rows, len(rows)), "conn int, place bigint, reply string"), 10).collect()
    assert {(r.conn, r.part): r.data for r in got} == {(c, p): "".join(f"{c}.{k};" for k in range(p * 10, min(n, p * 10 + 10))) for c, n in ((1, 5), (2, 23)) for p in range(-(-n // 10))}


def test_versioned_table(spark, tmp_path):
    table = runs.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.read() is None
    table.publish(spark.range(3).toDF("x"))
    held = table.read()
    table.publish(held.union(spark.range(3, 5)))
    assert table.read().count() == 5 and held.count() == 3
    table.publish(spark.range(1).toDF("x"))
    assert table.read().count() == 1 and len(table.versions()) == 3


def test_written_runs_are_sorted_and_found(spark, tmp_path):
    df = spark.createDataFrame(random_log(3), SCHEMA)
    runs.write_runs(runs.snapshot(df, 100), f"file://{tmp_path}/r", shards=3)
    back = spark.read.parquet(f"file://{tmp_path}/r")
    assert {r.key: r.value for r in runs.compact(back).collect()} == fold(random_log(3))[0]
    for part in back.select("shard", "run").distinct().collect():
        keys = [r.key for r in back.where((F.col("shard") == part.shard) & (F.col("run") == part.run)).collect()]
        assert keys == sorted(keys, reverse=True)
    records = spark.range(5000).select(F.format_string("%05d", "id").alias("key"), F.col("id").cast("string").alias("value"))
    index = runs.sparse_index(records.select("key"))
    assert sorted(r.key for r in index.collect()) == ["00903", "01927", "02951", "03975", "04999"]


def test_sorted_tables_are_read_by_their_index(spark, tmp_path):
    records = spark.range(0, 10000, 2).select(F.format_string("%05d", "id").alias("key"), F.col("id").cast("string").alias("value"))
    # four files, as small ranges would be put together
    records.repartitionByRange(4, F.desc("key")).sortWithinPartitions(F.desc("key")).write.parquet(f"file://{tmp_path}/base")
    base, index = spark.read.parquet(f"file://{tmp_path}/base"), runs.file_index(spark, f"file://{tmp_path}/base", 100)
    assert index.select("file").distinct().count() == 4 and index.count() >= 50
    for key in ("00000", "02950", "04998", "09998", "09996", "00002"):
        assert [r.value for r in runs.indexed_lookup(base, index, key, 100).collect()] == [str(int(key))]
    for key in ("", "00001", "09999", "99999"):
        assert runs.indexed_lookup(base, index, key, 100).count() == 0
    firsts = [r.key for r in index.where("rn = 0").collect()]
    for key in firsts:
        assert runs.indexed_lookup(base, index, key, 100).count() == 1
    empty = f"file://{tmp_path}/empty"
    runs.sort_for_reads(records.where("false")).write.parquet(empty)
    assert runs.indexed_lookup(spark.read.parquet(empty), runs.file_index(spark, empty), "00000").count() == 0


def test_ranks_and_order_statistics(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "ab", "é", ""]), i) for i in range(300)]
    got = ranking.ranked(spark.createDataFrame(rows, "s string, i int"), [("s", False), ("i", True)], range_rows=40).collect()
    want = sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0].encode(), reverse=True)
    assert {(r.s, r.i): r["rank"] for r in got} == {x: k for k, x in enumerate(want)}
    assert ranking.ranked(spark.createDataFrame([], "s string"), [("s", True)]).count() == 0
    for data in ([rng.randint(0, 50) for _ in range(400)], [7] * 300 + list(range(100)), [1], list(range(1000))):
        found = ranking.order_statistics(spark.createDataFrame([(x,) for x in data] + [(None,)], "x int"), "x", [0.0, 0.5, 0.95, 0.99], small=20)
        assert found == {p: sorted(data)[int(len(data) * p)] for p in found} and len(found) == 4


def test_string_functions(spark):
    df = spark.createDataFrame([("abc", "abd"), ("a", "ab"), ("x", "x"), ("", "q")], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = df.select(strings.compare(a, b).alias("c"), strings.first_difference(a, b).alias("d"), strings.common_prefix(a, b).alias("p"), strings.number_from(a).alias("n")).collect()
    assert [tuple(r) for r in got] == [(-1, 2, "ab", None), (-1, 1, "a", None), (0, None, "x", None), (-1, 0, "", None)]
