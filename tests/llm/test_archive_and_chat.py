"""WARC archives, chat views and the pipeline."""

import base64
import hashlib
import os

import duckdb
import pytest

from tidelog.llm import chat_rotation, queries, shared, warc

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    names = sorted(df.columns)
    return sorted(repr([r[n] for n in names]) for r in df.collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    order = [columns.index(n) for n in sorted(got.columns)]
    assert sorted(columns) == sorted(got.columns)
    assert rows_of(got) == sorted(repr([r[k] for k in order]) for r in cursor.fetchall())


PAGES = [(1, "http://a/ b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (0, "http://e", "x" * 100_000), (2, "http://f", "other"), (1, "http://a/ b", "<p>é</p>"), (None, "http://n", "<p>é</p>"), (None, None, None)]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id bigint, url string, html string, digest string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(pages, path, roll_bytes=400, range_bytes=1000)
    names = sorted(os.listdir(tmp_path / "a"))
    assert "manifest.json" in names and not any("tmp" in n or "temporary" in n for n in names) and len(names) > 3
    got = warc.read_archive(spark, path).collect()
    assert len(got) == len(PAGES)
    least = {}
    for p, _, h in PAGES:
        if p is not None:
            least[h or ""] = min(p, least.get(h or "", p))
    for r in got:
        html = next((h or "") for p, u, h in PAGES if p == r.page_id and base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r.payload_digest)
        first = least.get(html)
        again = r.page_id is not None and r.page_id > first
        assert (r.record_type, r.refers_to, r.payload_bytes) == (("revisit", first) if again else ("response", None)) + (len(html.encode()),)
        assert r.payload == (None if again else html)
    warc.write_archive(pages.repartition(5), f"file://{tmp_path}/b", roll_bytes=400, range_bytes=1000)
    read = lambda d: {n: (tmp_path / d / n).read_bytes() for n in sorted(os.listdir(tmp_path / d)) if n[0] != "."}
    assert read("a") == read("b")
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/c")
    assert warc.read_archive(spark, f"file://{tmp_path}/c").count() == 0


def test_one_page_id_in_many_ranges(spark, tmp_path):
    rows = [(k if k % 3 else 7, f"http://x/{k % 50}", f"page {k % 40} " * 20) for k in range(600)] + [(None, f"u{k}", "page 1 " * 20) for k in range(20)]
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "hot"), range_bytes=2000)
    back = warc.read_archive(spark, str(tmp_path / "hot")).collect()
    first = {}
    for k, _, html in rows:
        first[html] = min(x for x in (k, first.get(html)) if x is not None)
    assert sorted((r.page_id or -1, r.url, r.refers_to or -1, r.payload or "") for r in back) == sorted(
        (-1 if k is None else k or -1, u, (first[h] if k is not None and k > first[h] else -1) or -1, "" if k is not None and k > first[h] else h) for k, u, h in rows
    )
    assert len({r.file for r in back if r.page_id == 7}) > 5


def test_reading_is_linear_and_streams(tmp_path, monkeypatch):
    import io
    import random
    import time

    rng = random.Random(1)
    page = lambda k: warc.member(warc.page_record(k, "u", rng.randbytes(1600), None, "d"))
    data = b"".join(page(k) for k in range(20_000))
    assert len(data) > 32 << 20
    began = time.perf_counter()
    assert sum(1 for _ in warc.records(io.BytesIO(data))) == 20_000
    assert time.perf_counter() - began < 4
    for block in (1, 7, 1000):
        monkeypatch.setattr(warc, "BLOCK", block)
        assert list(warc.members(io.BytesIO(warc.member(b"") + warc.member(b"a" * 5000) + warc.member(b"b")))) == [b"", b"a" * 5000, b"b"]
    with pytest.raises(ValueError, match="no end"):
        list(warc.members(io.BytesIO(warc.member(rng.randbytes(5000))[:-9])))


def test_a_second_write_loses_nothing(spark, tmp_path):
    one = spark.createDataFrame(PAGES[:2], "page_id bigint, url string, html string")
    two = spark.createDataFrame(PAGES[3:5], "page_id bigint, url string, html string")
    path = f"file://{tmp_path}/a"
    warc.write_archive(one, path, roll_bytes=1, range_bytes=10)
    with pytest.raises(Exception, match="has an archive"):
        warc.write_archive(two, path)
    assert {r.page_id for r in warc.read_archive(spark, path).collect()} == {1, 2}
    (tmp_path / "a" / "_temporary" / "other").mkdir(parents=True)
    warc.write_archive(two, path, overwrite=True)
    assert {r.page_id for r in warc.read_archive(spark, path).collect()} == {4, 0}
    assert (tmp_path / "a" / "_temporary" / "other").exists()  # of another write
    assert len([n for n in os.listdir(tmp_path / "a") if n.endswith(".gz")]) == 1
    (tmp_path / "a" / "part-00000-00000.warc.gz").write_bytes(b"")
    with pytest.raises(Exception, match="manifest says"):
        warc.read_archive(spark, path).collect()


def test_urls_come_back_whole(spark, tmp_path):
    urls = ["http://a/ b", "http://a/b", "http://a/%20b", " \t\r\n x: y\u2028é", "", None]
    warc.write_archive(spark.createDataFrame([(k, u, "p") for k, u in enumerate(urls)], "page_id bigint, url string, html string"), str(tmp_path / "u"))
    assert {r.page_id: r.url for r in warc.read_archive(spark, str(tmp_path / "u")).collect()} == dict(enumerate(urls))


def test_least_bytes(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:4], "page_id bigint, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/a", least_bytes=5)
    assert {r.page_id: r.refers_to for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_rotation_masks(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, None, None, "x"), (None, 600, "a", "é"), (None, 1, "a", "b"), (3, 0, "system", "alone")]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id bigint, turn bigint, role string, text string, ts string")
    got = {(r.conv_id, r.participant, r.part): r for r in chat_rotation.rotations(df).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", 0), (None, "a", 0)}
    ann = got[(1, "ann", 0)]
    assert ann.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\n<|end|>\n" + "<|assistant|>\nbye<|end|>\n" * 2
    assert [ann.rendered[m["first"] : m["end"]] for m in ann["mask"]] == ["hi<|end|>\n", "bye<|end|>\n", "bye<|end|>\n"]
    assert ann.mask_chars == sum(m["end"] - m["first"] for m in ann["mask"]) and ann.n_own == 3
    bob = got[(1, "bob", 0)]
    assert [bob.rendered[m["first"] : m["end"]] for m in bob["mask"]] == ["<|end|>\n"]
    assert chat_rotation.rotations(df.limit(0)).count() == 0


def brute_rotations(turns, span):
    talks, out = {}, {}
    for c, t, r, x in turns:
        talks.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    for c, talk in talks.items():
        said = [(r, x) for _, _, r, x in sorted(talk)]
        first = next((k for k, (r, _) in enumerate(said) if r == "system"), None)
        for who in {r for r, _ in said} - {"system"}:
            for part in range(-(-len(said) // span)):
                seen = said[part * span : (part + 1) * span]
                if first is not None and first // span < part:
                    seen = [said[first], *seen]
                text, mask = "", []
                for r, x in seen:
                    text += "<|assistant|>\n" if r == who else "<|system|>\n" if r == "system" else f"<|user name={r}|>\n"
                    if r == who:
                        mask.append((len(text), len(text) + len(x) + 8))
                    text += f"{x}<|end|>\n"
                out[(c, who, part)] = (text, mask, len(seen))
    return out


@pytest.mark.parametrize("span", [1, 3, 512])
def test_rotation_of_long_conversations(spark, span):
    import random

    rng = random.Random(2)
    turns = [(rng.choice([1, 2, None, 4]), rng.choice([None, 0, 5, rng.randrange(2000)]), rng.choice(["ann", "bob", "system", None, "é"]), rng.choice(["x", "yy", None, ""])) for _ in range(120)]
    turns += [(9, 1, "early", "only before turn 512")] + [(9, k, "bob", f"t{k}") for k in range(510, 530)] + [(9, 0, "system", "be kind"), (9, 528, "system", "be brief"), (7, 1, "system", "alone"), (7, 2, "system", "alone")]
    turns += [(8, 5, "ann", "same")] * 12 + [(8, 5, "bob", "same")]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {(r.conv_id, r.participant, r.part): (r.rendered, [tuple(m) for m in r["mask"]], r.n_turns) for r in chat_rotation.rotations(rows, span=span).collect()}
    assert got == brute_rotations(turns, span)


def test_rotation_sql_of_long_conversations(spark, tmp_path, monkeypatch):
    talk = [(c, *t) for c in (5, None) for t in [(0, "system", "be kind"), (1, "early", "hi"), *((k, "bob", f"t{k}") for k in range(2, 1200)), (700, "system", "be brief"), (None, "late", None)]]
    spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.QUERIES["op6_chat_rotation"](spark, str(tmp_path))
    cursor = con.execute(queries.ORACLE_SQL["op6_chat_rotation"])
    columns = [d[0] for d in cursor.description]
    assert rows_of(got) == sorted(repr([r[columns.index(n)] for n in sorted(got.columns)]) for r in cursor.fetchall())
    assert {(r.participant, r.part) for r in got.collect()} == {(who, part) for who in ("early", "bob", "late") for part in range(3)}


@pytest.mark.parametrize("block", [1, 200_000])
def test_items_without_id_hit_words(spark, tmp_path, monkeypatch, block):
    from tidelog.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    words = [f"w{chr(97 + k)}" for k in range(24)]
    docs = [(1, " ".join(["x", *words[:12], "y"])), (2, " ".join([*words[:10], "z", *words[12:22]])), (3, "x y z")]
    items = [(None, " ".join(words[:12])), (7, " ".join(words[12:22])), (None, " ".join(words[12:22]))]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.QUERIES["op4_decontaminate"](spark, str(tmp_path))
    assert rows_of(got) == rows_of(spark.createDataFrame(con.execute(queries.ORACLE_SQL["op4_decontaminate"]).fetchall(), got.schema))
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in got.collect()} == {1: (12, 0, True), 2: (20, 1, True), 3: (0, 0, False)}


def test_pipeline_stages(spark):
    import corpus_pipeline
    from tests.llm.test_text_operators import brute_fingerprint, brute_repeats
    from tidelog.llm import decontaminate, quality_rules

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.union(docs.where("doc_id < 3")).union(spark.createDataFrame([(None, None, None, None, None), (9000, "", "en", "s", 0)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    verdict = {(r.doc_id, r.n_words): r.kept for r in quality_rules.judge(docs).collect()}
    kept = shared.cut(stages["quality_rules"](spark, docs, SMALL), "t")
    assert kept.columns == docs.columns
    assert kept.count() == sum(verdict[(r.doc_id, len((r.text or "").split()))] for r in docs.collect())

    rows = kept.collect()
    once = shared.cut(stages["simhash"](spark, kept, SMALL), "t").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in rows}
    assert len(once) == len({r.doc_id for r in once})
    links = {r.doc_id: {x for x, f in fps.items() if (f ^ fps[r.doc_id]).bit_count() <= 4} for r in rows}
    for r in once:  # whatever a kept document reaches has a larger id and is gone
        reached, todo = {r.doc_id}, [r.doc_id]
        while todo:
            new = links[todo.pop()] - reached
            reached |= new
            todo += new
        assert min(reached) == r.doc_id and not (reached - {r.doc_id}) & {x.doc_id for x in once}

    frame = spark.createDataFrame(once, docs.schema)
    cut = stages["suffix_dedup"](spark, frame, SMALL).collect()
    want = brute_repeats([r.text for r in once], 200)
    assert {r.doc_id: r.text for r in cut} == {r.doc_id: w[1].decode(errors="ignore") for r, w in zip(once, want)}
    assert all(r.n_chars == len(r.text) for r in cut)

    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    clean = stages["decontaminate"](spark, spark.createDataFrame(cut, docs.schema), SMALL)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in cut}
    windows = {tuple(w.split(" ")) for r in bench.collect() for w in decontaminate.windows_of(r.text, 10)}
    before = {r.doc_id: r.text for r in cut}
    for r in clean.collect():
        words = decontaminate.words_of(before[r.doc_id])
        hit = {p for i in range(len(words)) if tuple(words[i : i + 10]) in windows for p in range(i, i + 10)}
        assert decontaminate.words_of(r.text) == [w for k, w in enumerate(words) if k not in hit]
    assert stages["sentencepiece"](spark, clean, SMALL).count() == len(cut)


@pytest.mark.parametrize("block", [4096, 2])
def test_near_copies_of_five_word_shingles(spark, monkeypatch, block):
    import random

    import corpus_pipeline
    from tidelog.llm import near_copies, simhash

    monkeypatch.setattr(near_copies, "BLOCK", block)  # a bucket of more is compared by blocks
    rng = random.Random(3)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(4000)}" for _ in range(200)]
        texts.append(base)
        for edits in (2, 5, 5, 7, 12):
            copy = list(base)
            for at in rng.sample(range(0, 200, 7), edits):
                copy[at] = f"n{rng.randrange(4000)}"
            texts.append(copy)
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, ""), (901, None), (902, "one two"), (903, "ONE  two")]
    sets = {k: near_copies.shingles(t) for k, t in docs}
    fps = {k: simhash.fingerprint(t) for k, t in docs}
    root = {k: k for k, _ in docs}
    apart = 0
    for a, _ in docs:
        for b, _ in docs:
            near = bool(sets[a] | sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
            apart += near and (fps[a] ^ fps[b]).bit_count() > 4
            if a < b and (near or (fps[a] ^ fps[b]).bit_count() <= 4) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert apart > 20
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_copies.groups(df).collect()} == root
    kept = corpus_pipeline.near_duplicate_stage(spark, df, SMALL)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    assert near_copies.groups(df.limit(0)).count() == 0


def test_whole_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 100 < out.count() < 200
