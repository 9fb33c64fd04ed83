"""The operators on documents against brute force, over nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, language_id, ngrams, quality_model, quality_rules, queries, sentencepiece_codec, sharding, simhash, suffix_dedup

WHITE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, id string, fp string, words string, kept string, spans string, lang string"


def table(spark, texts, first=0):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "en") for i, t in (texts if texts and isinstance(texts[0], tuple) else enumerate(texts, first))], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéß日XYZ") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(45)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages)[rng.randint(0, 40) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(0, 5))]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    out += [None, "", " \n\t", "one", "a b", out[3], out[3], "x" * 900, "ab " * 2000, "###!!! " * 80, "A\x00b ▁ x", "\x0b\x0c\x1c\x85 z"]
    return out


TEXTS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).cache()


def test_pieces_are_those_of_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    got = {r.doc_id: (r.ids, r.decoded) for r in sentencepiece_codec.encode_decode(docs, queries.piece_model()).collect()}
    for i, t in enumerate(TEXTS):
        ids = model.encode(t or "", add_eos=True)
        assert got[i] == (ids, model.decode(ids)), i
    back = sentencepiece_codec.decode(spark.createDataFrame([(1, [3 + 0xE3, 3 + 0x81, 28705]), (2, None), (3, [1, 2])], "doc_id int, ids array<int>"), queries.piece_model())
    assert {r.doc_id: r.decoded for r in back.collect()} == {1: model.decode([3 + 0xE3, 3 + 0x81, 28705]), 2: "", 3: ""}


def test_piece_digests(docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    for r in queries.piece_digests(docs).collect():
        ids = model.encode(TEXTS[r.doc_id] or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("hot", [4096, 1])
def test_simhash_groups(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)  # a bucket of more is dealt again
    near = " ".join(f"w{i}" for i in range(400))
    texts = [*TEXTS, *(near.replace(f"w{k} ", f"v{k} ", 1) for k in range(0, 60, 3))]
    rows = simhash.near_duplicates(table(spark, texts)).collect()
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    assert {r.doc_id: np.int64(r.fp).astype(np.uint64) for r in rows} == dict(enumerate(fps))
    close = np.bitwise_count(fps[:, None] ^ fps) <= 4
    least = np.arange(len(texts))
    while True:
        new = np.array([least[close[i]].min() for i in range(len(texts))])
        if (new == least).all():
            break
        least = new
    assert {r.doc_id: r.component_id for r in rows} == dict(enumerate(least.tolist()))
    assert len(set(least[-20:].tolist())) < 20


def test_large_buckets_are_searched_exactly():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 1, np.uint64)
    flips = [base[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(300)]
    fps = np.unique(np.array(flips, np.uint64))
    parent = {int(f): int(f) for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in simhash.linked(fps, simhash.pivot_table(fps), 4):
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() <= 4
            parent[root(x)] = root(y)
    for i, x in enumerate(fps.tolist()):
        for y in fps[i + 1 :].tolist():
            if (x ^ y).bit_count() <= 4:
                assert root(x) == root(y)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}


def test_quality_measures(docs):
    rows = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, t in enumerate(TEXTS):
        words = WHITE.findall(t or "")
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {p + k for p, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WHITE.search(line):
                dup += line in seen
                seen.add(line)
        r = rows[i]
        want = (len(words), sum(map(len, words)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_estimation_finds_the_bad_rows():
    n = len(quality_rules.RULES)
    good, odd, bad, worse = (1,) * n, (1, 1, 1, -1, *[1] * (n - 4)), (-1, -1, *[1] * (n - 2)), (-1, -1, -1, *[1] * (n - 3))
    for times in (1, 10, 100):  # the same kinds of documents, the same verdicts
        patterns = [(good, 90 * times), (odd, 2 * times), (bad, 6 * times), (worse, 3 * times), ((0, *[1] * (n - 1)), times)]
        share, chances = quality_rules.fit(patterns)
        verdict = {p: quality_rules.posterior(share, chances, p) for p, _ in patterns}
        assert verdict[good] > 0.9 and verdict[odd] > 0.5 and verdict[bad] < 0.5 and verdict[worse] < 0.5
        assert 0.8 < share < 0.97
    assert quality_rules.fit([])[0] == 0.5


def test_estimates_are_at_a_peak_of_the_likelihood():
    rng = random.Random(8)
    n = len(quality_rules.RULES)
    kinds = [(0.9, 0.06, 0.04), (0.3, 0.2, 0.5)]
    drawn = Counter(tuple(rng.choices((1, 0, -1), kinds[rng.random() < 0.15], k=n)) for _ in range(4000))
    patterns = sorted(drawn.items())

    def likelihood(share, chances):
        """Of the documents and the made-up ones, by the definition."""
        out = sum(m * np.log(share * np.prod([c[v][0] for c, v in zip(chances, p)]) + (1 - share) * np.prod([c[v][1] for c, v in zip(chances, p)])) for p, m in patterns)
        for c in chances:
            out += sum(quality_rules.PRIOR[v][k] * np.log(c[v][k]) for v in c for k in (0, 1))
        prior = [sum(quality_rules.PRIOR[v][k] for v in quality_rules.PRIOR) for k in (0, 1)]
        return out + prior[0] * np.log(share) + prior[1] * np.log(1 - share)

    share, chances = quality_rules.fit(patterns)
    best = likelihood(share, chances)
    assert abs(share - 0.85) < 0.03
    for _ in range(100):
        j, k, factor = rng.randrange(n), rng.randrange(2), rng.uniform(0.8, 1.25)
        moved = [dict(c) for c in chances]
        raw = {v: [*x] for v, x in moved[j].items()}
        v = rng.choice((1, 0, -1))
        raw[v][k] *= factor
        total = sum(x[k] for x in raw.values())
        moved[j] = {u: tuple(y / total if i == k else y for i, y in enumerate(x)) for u, x in raw.items()}
        assert likelihood(share, moved) <= best + 1e-4
        assert likelihood(min(0.999, share * factor), chances) <= best + 1e-4


def windows_by_words(items):
    """window of words -> the ids of the items that have it."""
    out = {}
    for item, text in items:
        for window in decontaminate.windows_of(text, 10):
            out.setdefault(tuple(window.split(" ")), set()).update(() if item is None else (item,))
    return out


def hits_by_brute_force(text, windows):
    words, hit, found = decontaminate.words_of(text), set(), set()
    for n in {len(w) for w in windows}:
        for i in range(len(words) - n + 1):
            if (ids := windows.get(tuple(words[i : i + n]))) is not None:
                hit |= set(range(i, i + n))
                found |= ids
    return len(words), hit, sorted(found, key=str)


def test_decontamination(spark, docs, monkeypatch):
    items = [(1, TEXTS[0]), (2, TEXTS[7]), (30, "one"), (4, ""), (5, None), (6, TEXTS[0]), (7, "Ab ab"), (None, TEXTS[9]), (1, TEXTS[0])]
    bench = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id bigint, text string, spans string")
    windows = windows_by_words(items)
    rows = docs.unionByName(docs.where("doc_id in (0, 3)")).unionByName(docs.where("doc_id = 7").selectExpr("cast(null as bigint) doc_id", *docs.columns[1:]))
    texts = {**dict(enumerate(TEXTS)), None: TEXTS[7]}
    for block, shard in ((200_000, 1 << 19), (3, 1 << 19), (200_000, 40)):  # one block, many, long texts in parts
        monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        got = decontaminate.find_phrases(rows, bench, 10, remove=True).collect()
        assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in rows.select("doc_id").collect())
        for r in got:
            text = texts[r.doc_id]
            n, hit, found = hits_by_brute_force(text, windows)
            assert (r.n_words, {p for a, b in r.spans for p in range(a, b)}, r["items"]) == (n, hit, found)
            assert (r.text is None) == (text is None)
            if hit:
                assert [w for k, w in enumerate(decontaminate.words_of(text)) if k not in hit] == decontaminate.words_of(r.text)
    none = decontaminate.find_phrases(docs, bench.limit(0), 10)
    assert all(not r.spans for r in none.collect())


def test_decontamination_of_small_shards(spark):
    rng = random.Random(6)
    clean = lambda n: " ".join(rng.choice("uvwxyz") * rng.randint(1, 5) for _ in range(n))
    passage = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    windows = windows_by_words([(1, passage)])
    texts = [None, "", "a", "q1", clean(5), clean(200_000), passage, clean(3) + " " + passage + " " + clean(100_000)]
    for n in range(1, 41):  # shards of n clean documents
        for phrases in (decontaminate.Phrases(list(map(" ".join, windows)), [1] * len(windows)), decontaminate.Phrases([], [])):
            assert decontaminate.search_shard([clean(k % 4).split() for k in range(n)], [phrases]) == [([], set())] * n
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(len(texts), "doc_id")
    got = {r.doc_id: r for r in decontaminate.find_phrases(rows, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, found = hits_by_brute_force(t, windows)
        assert (got[i].n_words, sum(b - a for a, b in got[i].spans), got[i]["items"]) == (n, len(hit), found)


def test_fm_index_on_random_sequences():
    rng = np.random.default_rng(1)
    for _ in range(20):
        values = np.r_[rng.integers(1, rng.integers(2, 9), rng.integers(1, 400)), 0]
        index = decontaminate.FMIndex(values)
        for n in (1, 2, 3, 5):
            phrases = rng.integers(1, 9, (30, n))
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi):
                want = [i for i in range(len(values) - n) if (values[i : i + n] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = {p for i in range(len(r) - length + 1) if count[r[i : i + length]] > 1 for p in range(i, i + length)}
        out.append((frozenset(gone), bytes(b for k, b in enumerate(r) if k not in gone)))
    return out


@pytest.mark.parametrize(("hot", "batch", "family"), [(4096, 1 << 20, 32 << 20), (2, 3000, 1), (4096, 700, 5000)])
def test_suffix_dedup(spark, monkeypatch, hot, batch, family):
    monkeypatch.setattr(suffix_dedup, "HOT_SNIPPETS", hot)
    monkeypatch.setattr(suffix_dedup, "BATCH", batch)
    monkeypatch.setattr(suffix_dedup, "FAMILY", family)
    rows = [*enumerate(TEXTS), (3, TEXTS[3]), (3, TEXTS[3]), (None, TEXTS[2]), (4, "another text of the same id " * 3)]
    got = Counter((r.doc_id, frozenset(p for a, b in r.removed for p in range(a, b)), bytes(r.kept)) for r in suffix_dedup.remove_repeats(table(spark, rows), 60).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 60)))


def test_very_long_texts_are_cut_in_parts(spark):
    letters = np.random.default_rng(5).integers(97, 123, 18_000_000).astype(np.uint8).tobytes().decode()
    edge = suffix_dedup.BLOCK  # where the first part's strings end
    rows = [(1, letters), (2, "#" + letters[17_500_000:17_500_500] + "#" + letters[edge - 300 : edge + 300] + "#")]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in suffix_dedup.remove_repeats(table(spark, rows), 200).select("doc_id", "removed").collect()}
    assert got == {1: [(edge - 300, edge + 300), (17_500_000, 17_500_500)], 2: [(1, 501), (502, 1102)]}


def test_index_family_over_many_batches():
    rng = np.random.default_rng(3)
    length, index, strings, classes = 24, suffix_dedup.IndexFamily(24), [], []
    pool = [rng.integers(97, 100, 60).astype(np.uint8) for _ in range(5)]
    for _ in range(12):
        parts = [pool[rng.integers(5)][rng.integers(0, 30) :] if rng.random() < 0.4 else rng.integers(97, 123, 50).astype(np.uint8) for _ in range(4)]
        buffer = np.concatenate(parts)
        windows = np.arange(len(buffer) - length + 1)
        classes += index.add(buffer, windows, np.zeros(len(windows), bool)).tolist()
        strings += [bytes(buffer[w : w + length]) for w in windows]
    count = Counter(strings)
    assert [bool(index.repeats[c]) for c in classes] == [count[s] > 1 for s in strings]
    assert len({(s, c) for s, c in zip(strings, classes)}) == len(count)
    sizes = [len(x.places) for x in index.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


def test_merge_scan_of_two_levels():
    rng = np.random.default_rng(9)

    def level(n, length, letters):
        buffer = rng.integers(97, 97 + letters, n).astype(np.uint8)
        if letters == 2:  # long equal beginnings
            buffer[rng.random(n) < 0.9] = 97
        strings = {bytes(buffer[i : i + length]): i for i in range(n - length + 1)}
        order = sorted(strings)
        return suffix_dedup.Level(buffer, np.array([strings[x] for x in order]), np.arange(len(order))), order

    for length, letters in ((24, 2), (9, 3), (13, 26), (32, 2), (8, 2)):
        for sizes in ((400, 300), (60, 900), (900, 40)):
            (a, mine), (b, theirs) = (level(n, length, letters) for n in sizes)
            at, here = a.scan(b, length)
            assert here.tolist() == [x in set(mine) for x in theirs]
            assert at.tolist() == [sum(y < x for y in mine) for x in theirs]


def test_shards_hold_all_rows_evenly(spark, docs, monkeypatch):
    rows = table(spark, [*enumerate(TEXTS), *[(5, "same")] * 50, (None, None), *[(None, None)] * 3])
    want = Counter((r.doc_id, r.text) for r in rows.collect())
    orders = []
    for hot, most, parts in ((10_000, 20_000, 3), (10_000, 20_000, 5), (2, 20_000, 2), (2, 20_000, 4), (10_000, 3, 2), (7, 2, 1)):
        monkeypatch.setattr(sharding, "HOT_ROWS", hot)
        monkeypatch.setattr(sharding, "MAX_BUCKETS", most)
        got = sharding.shards(rows.repartition(parts), 7, bucket_bytes=4000).collect()
        assert Counter((r.doc_id, r.text) for r in got) == want
        sizes = Counter(r["__shard"] for r in got)
        assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 1
        assert all(sorted(r["__slot"] for r in got if r["__shard"] == s) == list(range(n)) for s, n in sizes.items())
        orders.append([(r.doc_id, r.text) for r in sorted(got, key=lambda r: (r["__shard"], r["__slot"]))])
    # however the rows are dealt to tasks; where there are no hot rows, in one round or two
    assert orders[0] == orders[1] and orders[2] == orders[3]
    order = lambda seed: [r.doc_id for r in sharding.shards(docs, 1, bucket_bytes=4000, seed=seed).orderBy("__slot").collect()]
    assert order(8) == order(8) != order(9)


def test_shards_against_a_plain_shuffle(spark):
    """By hand: bucket and order by the engine's hashes, then the same Fisher-Yates, one bucket after the other."""
    rows = [(i, f"text {i % 90} " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    size = sum(len(t) + 64 for _, t in rows)
    n = -(-size // 3000)
    key = F.xxhash64(F.lit(8), "doc_id", "text")
    hashed = df.select("doc_id", "text", key.alias("k"), F.xxhash64(F.lit(10), "text", "doc_id").alias("t")).withColumn("b", F.pmod(F.xxhash64(F.lit(9), "k", F.lit(0).cast("bigint")), F.lit(n))).collect()
    want = []
    for b in range(n):
        members = sorted((r.k, r.t, r.doc_id) for r in hashed if r.b == b)
        drawn = spark.createDataFrame([(list(range(len(members))),)], "a array<int>").select(F.shuffle("a", 8).alias("a")).first().a
        want += [members[k][2] for k in drawn]
    got = sharding.shards(df, 4, bucket_bytes=3000).orderBy("__shard", "__slot").collect()
    assert sorted(r.doc_id for r in got) == sorted(want) == list(range(200))
    per = [[r.doc_id for r in got if r["__shard"] == s] for s in range(4)]
    assert all(len(p) == 50 for p in per)
    buckets = {r.doc_id: r.b for r in hashed}
    assert [buckets[i] for p in per for i in p] == sorted(buckets.values())  # buckets follow one another
    assert len({tuple(p) for p in per}) == 4


def test_shards_carry_columns_of_any_type(spark):
    rows = spark.range(30).selectExpr("id as doc_id", "if(id % 3 = 0, null, 'x') as text", "map('a', id) as m", "array(struct(map(1, id) as n)) as deep", "id as `a.b`")
    got = sharding.shards(rows, 4, bucket_bytes=500).collect()
    assert Counter((r.doc_id, r.text, r.m["a"], r.deep[0].n[1], r["a.b"]) for r in got) == Counter((i, None if i % 3 == 0 else "x", i, i, i) for i in range(30))


def test_fold(spark):
    import zlib

    rows = spark.range(50).select("id", ngrams.fold("id", 5).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_class_samples_are_the_smallest_hashes(spark):
    rows = spark.range(3000).selectExpr("id", "if(id % 10 = 0, 'a', 'b') as y").unionByName(spark.range(400).selectExpr("7L as id", "'c' as y"))
    got = Counter(r.y for r in ngrams.class_sample(rows, ["id"], "y", 20).collect())
    assert got == {"a": 20, "b": 20, "c": 1}  # equal rows are one
    chosen = {r.id for r in ngrams.class_sample(rows, ["id"], "y", 20).where("y = 'b'").collect()}
    order = rows.where("y = 'b'").selectExpr("id", "shiftrightunsigned(xxhash64(id), 11) as h").orderBy("h").limit(20).collect()
    assert chosen == {r.id for r in order}


def test_samples_are_bounded_by_rows(spark):
    one = spark.range(9000).selectExpr("5L as id", "'good' as y", "concat('text ', id) as text")
    rows = one.unionByName(spark.range(4000).selectExpr("6L as id", "'bad' as y", "'same' as text")).unionByName(spark.range(30).selectExpr("if(id < 5, null, id) as id", "'bad' as y", "if(id % 2 = 0, null, 'q') as text"))
    hashed = ngrams.hashed_texts(rows, "id", "text", F.col("y"))
    got = ngrams.sampled_texts(hashed, hashed, 20).collect()
    assert Counter(r.y for r in got) == {"good": 20, "bad": 20} and len({(r.id, r.text) for r in got}) == 40
    labels = spark.createDataFrame([(5, 1), (5, 1), (6, 0), (None, 1)], "doc_id bigint, quality int")
    docs = rows.select(F.col("id").alias("doc_id"), "text", F.lit("x").alias("y"), F.lit(1).alias("th"), F.lit(2).alias("id"), F.lit(3).alias("quality"))
    model = quality_model.train_model(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality_model.score(docs, model).limit(50).collect())


def test_ratios_and_descent_against_their_definitions():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 8))).astype(np.int32) for _ in range(60)]
    labels = np.array([int(3 in r) ^ int(rng.random() < 0.1) for r in rows])
    ratios = quality_model.log_count_ratios(rows, labels)
    size = len(ratios)
    for f in range(14):
        p, q = (1 + sum(f in r for r, y in zip(rows, labels) if y == c) for c in (1, 0))
        total = [size + sum(len(r) for r, y in zip(rows, labels) if y == c) for c in (1, 0)]
        assert ratios[f] == pytest.approx(np.log(p / total[0]) - np.log(q / total[1]))
    values = [ratios[r] / np.sqrt(len(r)) for r in rows]
    w, bias = quality_model.dual_coordinate_descent(rows, values, labels, size, rounds=3000)

    def loss(w, b):
        margins = np.array([(1 if y else -1) * (w[r] @ v + b) for r, v, y in zip(rows, values, labels)])
        return (w @ w + b * b) / 2 + np.maximum(0, 1 - margins).sum()

    best = loss(w, bias)  # a convex function: where no small step leads down is its least
    for _ in range(300):
        step = np.where(np.arange(size) < 12, rng.normal(0, 10.0 ** rng.integers(-3, 1), size), 0)
        assert loss(w + step, bias + rng.normal(0, 0.1)) >= best - 1e-3


def test_regularised_leader_and_temperature_against_plain_loops():
    rng = np.random.default_rng(6)
    languages, size = ["a", "b", "c"], 1 << language_id.BITS
    idf = rng.uniform(1, 3, size)
    rows = []
    for _ in range(60):
        y = int(rng.integers(3))
        which = np.unique(rng.integers(10 * y, 10 * y + 14, 6))
        rows.append((which, rng.integers(1, 4, len(which)), y))
    model = language_id.train(rows, languages, idf, rounds=2)
    z, n = {}, {}

    def weight(f, c):
        if abs(z.get((f, c), 0.0)) <= 0.02:
            return 0.0
        return -(z[f, c] - np.sign(z[f, c]) * 0.02) / ((1 + np.sqrt(n[f, c])) / 1.0 + 0.1)

    order, shuffler = np.arange(len(rows)), np.random.default_rng(7)
    for _ in range(2):
        shuffler.shuffle(order)
        for i in order:
            which, counts, y = rows[i]
            x = {int(f): (1 + np.log(k)) * idf[f] for f, k in zip(which, counts)}
            norm = np.sqrt(sum(v * v for v in x.values()))
            x = {f: v / norm for f, v in x.items()} | {size: 1.0}
            scores = [sum(weight(f, c) * v for f, v in x.items()) for c in range(3)]
            p = np.exp(np.array(scores) - max(scores))
            p /= p.sum()
            old = {(f, c): weight(f, c) for f in x for c in range(3)}
            for (f, c), w in old.items():
                g = (p[c] - (c == y)) * x[f]
                z[f, c] = z.get((f, c), 0.0) + g - (np.sqrt(n.get((f, c), 0.0) + g * g) - np.sqrt(n.get((f, c), 0.0))) * w
                n[f, c] = n.get((f, c), 0.0) + g * g
    for f in [*range(40), size]:
        for c in range(3):
            assert (model.bias if f == size else model.weights[f])[c] == pytest.approx(weight(f, c), abs=1e-9)
    t = language_id.calibrate(model, rows)

    def loss(t):
        total = 0.0
        for which, counts, y in rows:
            s = [v / t for v in model.logits(which, counts)]
            total += np.log(sum(np.exp(v) for v in s)) - s[y]
        return total

    assert loss(t) <= min(loss(2.0 ** (k / 4)) for k in range(-16, 17)) + 1e-9


def test_classifiers_take_empty_tables_and_clashing_names(spark, docs):
    more = docs.withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "y": F.lit(2), "f": F.lit(3), "quality": F.lit(4)})
    labels = spark.createDataFrame([(i, i % 2, "z") for i in range(40)] + [(None, 1, "z")], "doc_id bigint, quality int, text string")
    repeated = more.unionByName(more).unionByName(more.limit(3).withColumn("doc_id", F.lit(None).cast("bigint")))
    model, language = quality_model.train_model(repeated, labels), language_id.train_model(repeated)
    scored, told = quality_model.score(repeated, model).collect(), language_id.predict(repeated, language).collect()
    assert len(scored) == len(told) == repeated.count()
    assert {r.lang_pred for r in told} <= {"en", "und"}
    assert quality_model.score(more.limit(0), model).count() == language_id.predict(more.limit(0), language).count() == 0
    # a null text has a score, a text of many characters too
    long = spark.createDataFrame([(1, "word " * 400_000), (2, None)], "doc_id bigint, text string")
    assert all(0 <= r.score <= 1 for r in quality_model.score(long, model).collect() + language_id.predict(long, language).collect())


def test_language_id(spark):
    rng = random.Random(4)
    forms = {"de": ["der", "und", "schön", "über", "lich"], "fr": ["été", "que", "ment", "eau", "oui"], "en": ["the", "ing", "with", "and", "of"]}
    data = [(i, " ".join(rng.choice(forms[k]) for _ in range(rng.randint(3, 30))), k) for i, k in enumerate(rng.choices(list(forms), k=300))]
    rows = spark.createDataFrame([*data, (900, None, "en"), (901, "", "de"), (902, "12 !?", "fr"), (903, "the with and", None)], "doc_id bigint, text string, lang string")
    model = language_id.train_model(rows.where("doc_id is null or doc_id % 3 > 0"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(rows, model).collect()}
    assert sum(got[i][0] == k for i, _, k in data if i % 3 == 0) >= 95
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert (model.weights == 0).mean() > 0.5
    empty = language_id.train_model(rows.limit(0))
    assert {r.lang_pred for r in language_id.predict(rows, empty).collect()} == {"und"}


def test_quality_model(spark):
    rng = random.Random(5)
    data = [(i, " ".join(rng.choice(["good", "fine", "words"] if i % 4 else ["BAD!!", "WORSE!!", "words"]) for _ in range(rng.randint(5, 60))), int(i % 4 > 0)) for i in range(240)]
    docs = spark.createDataFrame([d[:2] for d in data] + [(900, None), (901, ""), (5, data[5][1])], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in data if d[0] % 5] + [(1, None)], "doc_id bigint, quality int")
    model = quality_model.train_model(docs, labels)
    got = {r.doc_id: r.score for r in quality_model.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in data if i % 5 == 0]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    one = quality_model.train_model(docs, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in quality_model.score(docs, one).collect())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    outs = [
        sentencepiece_codec.encode_decode(none, queries.piece_model()),
        simhash.near_duplicates(none),
        quality_rules.judge(none),
        decontaminate.find_phrases(none, bench),
        suffix_dedup.remove_repeats(none),
        sharding.shards(none, 3),
        quality_model.score(none, quality_model.train_model(none, spark.createDataFrame([], "doc_id bigint, quality int"))),
    ]
    assert [o.count() for o in outs] == [0] * len(outs)
