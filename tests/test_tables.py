"""Entities, space, metrics, protocol, dumps, sources and streams."""

import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog.functions import matrix
from tidelog.operators import ecs, metrics, resp, runs, spatial
from tidelog.operators.log import state
from tidelog.sources import dumps, frames
from tidelog.streaming import ingest


def test_views_and_groups(spark):
    a = spark.createDataFrame([(i, i * 10) for i in range(6)], "entity_id bigint, a int")
    b = spark.createDataFrame([(i, f"b{i}") for i in range(2, 9)], "entity_id bigint, b string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(ecs.view(a, b)) == [(i, i * 10, f"b{i}") for i in range(2, 6)]
    group = ecs.Group(a.where("entity_id < 4"), b)
    grown = group.sync(a.select("entity_id"), a, b)
    assert rows(grown.rows) == rows(ecs.view(a, b))
    assert rows(grown.sync(a.select("entity_id"), a, b).rows) == rows(ecs.view(a, b))
    assert rows(grown.desync(spark.createDataFrame([(3,), (3,), (77,)], "entity_id bigint")).rows) == [r for r in rows(ecs.view(a, b)) if r[0] != 3]
    registry = ecs.Registry(spark)
    registry.set("a_set", a)
    registry.set("b_set", b)
    assert registry.next_entity() == 9
    registry.destroy(spark.createDataFrame([(2,), (8,)], "entity_id bigint"))
    assert rows(registry.view("a_set", "b_set")) == [(i, i * 10, f"b{i}") for i in (3, 4, 5)]
    assert rows(ecs.update(a, spark.createDataFrame([(1, 7), (2, None)], "entity_id bigint, a int")))[:3] == [(0, 0), (1, 7), (2, 20)]


def test_number_order_is_that_of_the_bits(spark):
    import struct

    rng = random.Random(1)
    floats = [struct.unpack("f", struct.pack("f", rng.uniform(-9, 9)))[0] for _ in range(50)] + [1.5, 1.5, -1.5, -1.5]
    df = spark.createDataFrame(list(enumerate(floats)), "entity_id bigint, x float")
    got = [r.entity_id for r in ecs.sort_by_number(df, "x").orderBy("rank").collect()]
    assert got == sorted(range(len(floats)), key=lambda i: (-struct.unpack("I", struct.pack("f", floats[i]))[0], i))
    ints = [rng.randint(-5, 5) for _ in range(40)]
    got = [r.entity_id for r in ecs.sort_by_number(spark.createDataFrame(list(enumerate(ints)), "entity_id bigint, x int"), "x").orderBy("rank").collect()]
    assert got == sorted(range(len(ints)), key=lambda i: (-(ints[i] & 0xFFFFFFFF), i))


def test_space(spark):
    rng = random.Random(2)
    points = [(i, *(rng.uniform(-3, 3) for _ in range(3))) for i in range(200)]
    df = spark.createDataFrame(points, "entity_id bigint, x float, y float, z float")
    places = {r.entity_id: (r.cell, r.place) for r in spatial.scattered(spatial.with_cells(df)).collect()}
    assert [e for e, _ in sorted(places.items(), key=lambda x: x[1][1])] == sorted(places, key=lambda e: (places[e][0], e))
    assert sorted(p for _, p in places.values()) == list(range(200))
    crowd = spark.range(100).select(F.col("id").alias("entity_id"), *[F.lit(1.0).cast("float").alias(p) for p in "xyz"])
    assert [r.entity_id for r in spatial.grid(crowd).orderBy("entity_id").collect()] == list(range(32))


def test_idle_seconds_are_zero(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00.5' as ts union all select timestamp_ntz'2024-01-01 00:00:03' union all select timestamp_ntz'2024-01-01 00:00:03.9'")
    assert [r.ops for r in metrics.per_second(df).orderBy("second").collect()] == [1, 0, 0, 2]
    assert metrics.per_second(df.limit(0)).count() == 0
    assert [r.ops for r in metrics.last_samples(metrics.per_second(df), 2).collect()] == [0, 2]


def test_matrices(spark):
    import numpy as np

    m = [float(v) for v in (2, 1, 0, 3, 0, 1, 4, 1, 5, 0, 1, 0, 1, 2, 0, 1)]
    df = spark.createDataFrame([(m, 0.3)], "m array<double>, a double")
    x = F.col("m")
    r = df.select(matrix.inverse(x).alias("i"), matrix.multiply(x, matrix.transpose(x)).alias("p"), matrix.multiply(matrix.rotation("z", F.col("a")), matrix.rotation("z", -F.col("a"))).alias("e"), matrix.determinant(x).alias("d"), matrix.inverse(matrix.scale(F.lit(0.0), F.lit(1.0), F.lit(1.0))).alias("s")).first()
    n = np.array(m).reshape(4, 4)
    assert np.allclose(np.array(r.i).reshape(4, 4) @ n, np.eye(4)) and np.allclose(np.array(r.p).reshape(4, 4), n @ n.T)
    assert np.allclose(np.array(r.e).reshape(4, 4), np.eye(4)) and abs(r.d - np.linalg.det(n)) < 1e-9
    assert abs(r.s[0] - 1e5) < 1e-6


GOOD = [("SET", b"k\xff", b"v\r\n*1\r\nx"), ("GET", b"k", None), ("WKS", None, None), ("DEL", b"", None), ("SET", b"e", b"")]


def wire(op, key, value):
    parts = [op.encode(), *([] if key is None else [key]), *([] if value is None else [value])]
    return b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts)


def test_frames_survive_any_split():
    data = b"".join(wire(*c) for c in GOOD)
    for at in range(len(data) + 1):
        first, rest = resp.parse(data[:at])
        second, end = resp.parse(rest + data[at:])
        assert [c[:3] for c in first + second] == GOOD and end == b"", at


def test_bad_frames_go_to_the_side():
    bad = [b"*1\r\n$4\r\nPING\r\n", b"*2\r\n$3\r\nget\r\n$1\r\nk\r\n", b"*2\r\n$3\r\nSET\r\n$1\r\nk\r\n", b"junk\r\n", b"*x\r\n"]
    for b in bad:
        found, rest = resp.parse(b + wire(*GOOD[1]))
        assert found[-1][:3] == GOOD[1] and all(c[0] is None and c[3] for c in found[:-1]) and not rest
    assert resp.parse(b"*2\r\n$3\r\nGE") == ([], b"*2\r\n$3\r\nGE")
    assert resp.parse(b"") == ([], b"")


def test_dumps_round_trip(spark, tmp_path):
    records = [(b"k%04d" % i, None if i % 7 == 0 else b"v" * (i % 30)) for i in range(3000)]
    data = dumps.encode_records(records)
    assert len(data) % 8 == 0 and [(k, v) for _, k, v in dumps.decode_records(data)] == sorted(records, reverse=True, key=lambda r: r[0])
    assert list(dumps.decode_records(data[:-6]))[-1][1] != b"k0000"
    (tmp_path / "shard_0_chunk_1.bin").write_bytes(data)
    got = dumps.read_runs(spark, f"file://{tmp_path}").collect()
    assert {(bytes(r.key), r.op, None if r.value is None else bytes(r.value)) for r in got} == {(k, "DEL" if v is None else "SET", v) for k, v in records}
    assert len(dumps.encode_index(data)) == 3 * 24


def test_frame_files_as_batch_and_stream(spark, tmp_path):
    frames.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.resp").write_bytes(wire("SET", b"k%d" % (n % 2), b"v%d" % n) + wire("GET", b"k", None) + (b"*1\r\n" if n == 2 else b""))
    batch = spark.read.format("resp_frames").option("path", f"file://{folder}").load()
    assert sorted((r.source, r.place, r.op) for r in batch.collect())[-1] == ("2.resp", 2, "REST") and batch.count() == 7
    stream = spark.readStream.format("resp_frames").option("path", f"file://{folder}").load()
    commands = stream.selectExpr("cast(split(source, '[.]')[0] as bigint) * 100 + place as seq", "cast(key as string) as key", "op", "cast(value as string) as value")
    sink = ingest.RunSink(runs.VersionedTable(spark, f"file://{tmp_path}/base"), f"file://{tmp_path}/runs")
    q = commands.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        (folder / "3.resp").write_bytes(wire("DEL", b"k1", None))
        q.processAllAvailable()
    finally:
        q.stop()
    assert {r.key: r.value for r in sink.current().where("op = 'SET'").collect()} == {"k0": "v2"}
    assert [r.level for r in sink.runs()] == [1]  # two batches, so a merge


def test_socket_source(spark):
    frames.register(spark)
    with socket.create_server(("127.0.0.1", 0)) as s:
        port = s.getsockname()[1]

    def client():
        for _ in range(100):
            try:
                with socket.create_connection(("127.0.0.1", port)) as c:
                    data = b"".join(wire(*g) for g in GOOD)
                    for k in range(0, len(data), 5):
                        c.sendall(data[k : k + 5])
                return
            except OSError:
                time.sleep(0.2)

    thread = threading.Thread(target=client)
    thread.start()
    got = spark.read.format("resp_socket").option("port", str(port)).load().collect()
    thread.join()
    assert [r.op for r in sorted(got, key=lambda r: r.place)] == [g[0] for g in GOOD]


def test_late_and_repeated_batches(spark, tmp_path):
    sink = ingest.RunSink(runs.VersionedTable(spark, f"file://{tmp_path}/base"), f"file://{tmp_path}/runs")
    rows = lambda *r: spark.createDataFrame(list(r), "seq bigint, key string, op string, value string")
    sink(rows((5, "a", "DEL", None), (6, "b", "SET", "6")), 0)
    sink(rows((3, "a", "SET", "late"), (7, "b", "SET", "7")), 1)
    sink(rows((8, "c", "SET", "")), 2)
    sink(rows((8, "c", "SET", "")), 2)
    assert {r.key: r.value for r in sink.current().where("op = 'SET'").collect()} == {"b": "7", "c": ""}


def test_levels_of_runs_drop_old_tombstones(spark, tmp_path):
    schema = "seq bigint, key string, op string, value string"
    rng = random.Random(8)
    sink = ingest.RunSink(runs.VersionedTable(spark, f"file://{tmp_path}/list"), f"file://{tmp_path}/runs", late=20)
    rows = [(i, f"k{rng.randint(0, 9)}", op, f"v{i}" if op == "SET" else None) for i, op in enumerate(rng.choices(["SET", "DEL", "GET"], [3, 3, 1], k=160))]
    for n in range(7):
        late = rows[n * 20 : n * 20 + 20]  # shuffled inside what may come late
        sink(spark.createDataFrame(rng.sample(late, 20), schema), n)
        assert len({r.level for r in sink.runs()}) == len(sink.runs()) <= 3
        want = {r.key: r.value for r in state(spark.createDataFrame(rows[: n * 20 + 20], schema)).collect()}
        assert {r.key: r.value for r in sink.current().where("op = 'SET'").collect()} == want
    folders = {p.name for p in (tmp_path / "runs").iterdir()}
    assert folders == {r.path for r in sink.runs()}
    sink(spark.createDataFrame(rows[140:], schema), 7)
    (only,) = sink.runs()  # eight equal flushes make one run
    assert only.level == 3 and sink.current().where("op = 'DEL' and seq < 139").count() == 0
    sink(spark.createDataFrame([], schema), 8)
    assert sink.runs() == [only]
    sink(spark.createDataFrame([(500, "k0", "SET", "new")], schema), 9)
    sink.finish()
    (only,) = sink.runs()
    assert only.top == 500 and sink.current().where("op = 'DEL'").count() == 0


def test_frames_cut_anywhere_are_carried_over(spark, tmp_path):
    from tidelog.plans import catalog

    data = b"".join(wire(*g) for g in GOOD) * 3
    cut = lambda size: [data[k : k + size] for k in range(0, len(data), size)]
    chunks = [("a", n, d) for n, d in enumerate(cut(7))] + [("b", n, d) for n, d in enumerate(cut(1000))] + [("c", 0, b""), ("c", 1, b"*2\r\n$3\r\nGE")]
    random.Random(9).shuffle(chunks)
    for n in range(4):  # chunks come in any order, and one file comes again
        spark.createDataFrame(chunks[n::4], "conn string, n bigint, data binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame(chunks[::4], "conn string, n bigint, data binary").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("conn string, n bigint, data binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = catalog.run_stateful(spark, ingest.commands(stream), f"file://{tmp_path}/out", "append").collect()
    want = [(k, g) for k, g in enumerate(GOOD * 3)]
    for conn in "ab":
        got = sorted((r.place, (r.op, r.key and bytes(r.key), r.value and bytes(r.value))) for r in out if r.conn == conn)
        assert got == want
    assert not [r for r in out if r.conn == "c"]


def test_files_of_a_connection_are_one_stream_of_frames(spark, tmp_path):
    from tidelog.plans import catalog

    folder = tmp_path / "in"
    folder.mkdir()
    data = b"".join(wire(*g) for g in GOOD)
    for k in range(0, len(data), 11):
        (folder / f"east.{k // 11}.resp").write_bytes(data[k : k + 11])
    (folder / "west.0.resp").write_bytes(data)
    (folder / "other.txt").write_bytes(data)
    stream = ingest.commands(frames.chunks(spark, f"file://{folder}", most_bytes=40))
    out = catalog.run_stateful(spark, stream, f"file://{tmp_path}/out", "append").collect()
    assert [(r.conn, r.place, r.op) for r in sorted(out, key=lambda r: (r.conn, r.place))] == [(c, k, g[0]) for c in ("east", "west") for k, g in enumerate(GOOD)]


def test_state_store_keeps_the_last_write(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(5)
    rows = [(i, f"k{rng.randint(0, 5)}", op, f"v{i}" if op == "SET" else None) for i, op in enumerate(rng.choices(["SET", "DEL", "GET"], k=120))]
    shuffled = rng.sample(rows, len(rows))
    schema = "seq bigint, key string, op string, value string"
    for n in range(3):
        spark.createDataFrame(shuffled[n * 40 : n * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = ingest.keyed_state(stream).writeStream.format("memory").queryName("last_writes").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.sql("select * from last_writes").collect():
        if r.key not in last or r.seq > last[r.key].seq:
            last[r.key] = r
    assert {k: r.value for k, r in last.items() if r.op == "SET"} == {r.key: r.value for r in state(spark.createDataFrame(rows, schema)).collect()}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return con


def test_catalogue_against_sql(spark, duck):
    from tidelog.plans import catalog

    cell = lambda v: round(v, 9) if isinstance(v, float) else v
    for name, run in catalog.QUERIES.items():
        df = run(spark, "/root/testdata/sf0.001")
        columns = sorted(df.columns)
        cursor = duck.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns, name
        got = sorted(repr([cell(r[c]) for c in columns]) for r in df.collect())
        assert got == sorted(repr([cell(r[names.index(c)]) for c in columns]) for r in cursor.fetchall()), name


def test_dump_sizes_report_runs_of_any_length(spark, tmp_path):
    from tidelog.plans import catalog

    events = spark.range(5100).select(F.col("id").alias("event_id"), F.when(F.col("id") < 2500, F.col("id")).otherwise(F.col("id") % 50).alias("user_id"), F.lit("click").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.run: r for r in catalog.kv_dump_sizes(spark, str(tmp_path)).collect()}
    assert {k: r.entries for k, r in got.items()} == {0: 3, 1: 1, 2: 1}
    assert got[0].bytes == sum((8 + 12 + len(f"click:{k}") + 7) // 8 * 8 for k in range(2500))


def test_threads_without_operations_are_left_out(spark):
    names = ("total_ops", "parse_cycles", "exec_cycles", "send_cycles", "recv_cycles", "redirects", "parse_fails")
    rows = [(1, 2, 10, 20, 30, 40, 0, 1), (1, 3, 5, 5, 5, 5, 1, 0), (2, 0, 9, 9, 9, 9, 1, 1)]
    got = metrics.thread_report(spark.createDataFrame(rows, "thread int, " + ", ".join(f"{n} bigint" for n in names))).collect()
    assert [tuple(r) for r in got] == [(1, 5, 3, 5, 7, 9, 1, 1)]


def test_frame_stream_takes_files_whatever_their_names(spark, tmp_path):
    frames.register(spark)
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()

    def go():
        stream = spark.readStream.format("resp_frames").option("path", f"file://{folder}").option("maxBytes", "40").load()
        stream.select(F.col("key").cast("string").alias("key")).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).start().processAllAvailable()
        for q in spark.streams.active:
            q.stop()
        return sorted(r.key for r in spark.read.parquet(str(out)).collect())

    for k in (9, 8, 7):
        (folder / f"{k}.resp").write_bytes(f"*2\r\n$3\r\nGET\r\n$2\r\nk{k}\r\n".encode())
    assert go() == ["k7", "k8", "k9"]
    time.sleep(0.05)
    (folder / "1.resp").write_bytes(b"*2\r\n$3\r\nGET\r\n$2\r\nk1\r\n")
    assert go() == ["k1", "k7", "k8", "k9"]


def test_gauge_and_prefix_sums_over_many_parts(spark, monkeypatch):
    from tidelog.operators import ranking

    monkeypatch.setattr(ranking, "GROUP", 7)
    rng = random.Random(3)
    rows = [(k, rng.randint(-3, 3), k // 5) for k in range(300) if rng.random() < 0.8]
    got = {r.t: r.gauge for r in metrics.gauge(spark.createDataFrame(rows, "t bigint, d int, p bigint"), "t", "d", "p").collect()}
    total, want = 0, {}
    for t, d, _ in rows:
        total += d
        want[t] = total
    assert got == want
