"""The queries of these operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_rotation, decontaminate, language_id, quality_model, quality_rules, sentencepiece_codec, sharding, simhash, suffix_dedup, warc
from .ngrams import fold

N_SHARDS = 40
WINDOW = 10


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))


def piece_digests(docs: DataFrame) -> DataFrame:
    out = sentencepiece_codec.encode_decode(docs, piece_model())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, limit=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    items = F.array_join(F.col("items").cast("array<string>"), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = quality_model.score(docs, quality_model.train_model(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_rotation.rotations(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["first"], m["end"])), ",")
    return views.select("conv_id", "participant", "part", "n_turns", "n_own", "rendered", mask.alias("mask"), "mask_chars")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold("doc_id", 3) == 1, F.lit(False))
    model = language_id.train_model(docs.where(fold("doc_id", 3) != 1))
    return language_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shards(table(spark, sf_dir, "documents"), N_SHARDS)
    text = F.coalesce("text", F.lit(""))
    return dealt.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.remove_repeats(docs, 200)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_quality_rules, op4_decontaminate, op5_quality_model, op6_chat_rotation, op7_language_id, op8_shuffle_shards, op9_suffix_dedup, op10_warc)
}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op4_decontaminate": rf"""
with d as (
    select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents
), b as (
    select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from benchmark
), p as (
    select distinct item_id, least(len(w), {WINDOW}) as n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') as phrase
    from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as i from b where len(w) > 0)
), x as (
    select k, n, i, array_to_string(w[i : i + n - 1], ' ') as phrase
    from (select k, w, n, unnest(range(1, len(w) - n + 2)) as i from d, (select distinct n from p) where len(w) >= n)
), h as (
    select x.k, x.i, x.n, p.item_id from x join p on x.n = p.n and x.phrase = p.phrase
), hit as (
    select k, count(distinct place) as n_hit from (select k, unnest(range(i, i + n)) as place from h) group by k
), items as (
    select k, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by k
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join hit using (k) left join items using (k)
""",
    "op6_chat_rotation": f"""
with n as (
    select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as body,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) as k
    from conversations
), f as (
    select conv_id, min(k) as k from n where role = 'system' group by conv_id
), p as (
    select conv_id, (k - 1) // {chat_rotation.SPAN} as part, k, role, body from n
), t as (
    select * from p
    union all
    select p.conv_id, later.part, p.k, p.role, p.body from p join f on p.conv_id is not distinct from f.conv_id and p.k = f.k
        join (select distinct conv_id, part from p) as later on later.conv_id is not distinct from p.conv_id and later.part > p.part
), s as (
    select distinct conv_id, role as participant from n where role <> 'system'
), v as (
    select s.conv_id, t.part, s.participant, t.k, t.role = s.participant as own,
        case when t.role = s.participant then '<|assistant|>' || chr(10) when t.role = 'system' then '<|system|>' || chr(10) else '<|user name=' || t.role || '|>' || chr(10) end as head,
        t.body || '<|end|>' || chr(10) as body
    from s join t on s.conv_id is not distinct from t.conv_id
), w as (
    select *, sum(length(head) + length(body)) over (partition by conv_id, part, participant order by k) as ends from v
)
select conv_id, participant, part, count(*) as n_turns, count(*) filter (own) as n_own, string_agg(head || body, '' order by k) as rendered,
    coalesce(string_agg(cast(ends - length(body) as varchar) || '-' || cast(ends as varchar), ',' order by k) filter (own), '') as mask,
    cast(coalesce(sum(length(body)) filter (own), 0) as bigint) as mask_chars
from w group by conv_id, participant, part
""",
    "op10_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as hex from p),
f as (select hex, n, min(page_id) as first from q group by hex, n)
select page_id, cast(n as bigint) as payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        cast(list_reduce(list_transform(range(0, 5), lambda j: (
            ((strpos('0123456789abcdef', substr(hex, cast((5 * k + j) // 4 as integer) + 1, 1)) - 1) >> cast(3 - (5 * k + j) % 4 as integer)) & 1)),
            lambda a, c: a * 2 + c) as integer) + 1, 1)), '') as payload_digest,
    case when page_id > first then 'revisit' else 'response' end as record_type,
    case when page_id > first then first end as refers_to
from q join f using (hex, n)
""",
}
