"""A corpus pipeline of the training-data operators, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, near_copies, quality_rules, queries, shared, suffix_dedup


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep; each row is judged by itself."""
    judged = quality_rules.judge(docs.select(F.struct(*docs.columns).alias("doc_id"), "text"))
    return judged.where("kept").select("doc_id.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of five-word shingles, or op2's 4 bits): that with the smallest id,
    and one row of it."""
    key = F.struct("doc_id", F.xxhash64("text").alias("th"))
    found = near_copies.groups(docs.select(key.alias("doc_id"), "text"))
    first = shared.cut(found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n")), "first")
    kept = docs.join(first.select(F.col("doc_id").alias("__key")), key.eqNullSafe(F.col("__key")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]) if first.where("n > 1").limit(1).count() else kept


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes are taken out; a character that is cut in part goes as a whole."""
    out = suffix_dedup.remove_repeats(docs, 200, as_text=True)
    return _with_text(out, docs, F.size("removed") > 0, F.col("kept"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of benchmark passages are taken out."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])
    out = decontaminate.find_phrases(docs.select(rest.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), queries.WINDOW, remove=True)
    return _with_text(out.select("doc_id.*", "text", "spans"), docs, F.size("spans") > 0, F.col("text"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text that they give back."""
    return queries.piece_digests(docs)


def _with_text(out: DataFrame, docs: DataFrame, changed: Column, text: Column) -> DataFrame:
    """The columns of docs, with the text and n_chars anew where a row has changed."""
    new = {"text": F.when(changed, text).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("simhash", near_duplicate_stage),
    ("suffix_dedup", repeat_stage),
    ("decontaminate", decontamination_stage),
    ("sentencepiece", piece_stage),
]

#: SQL has no iterative estimation, fingerprints or encoder; the stages are tested against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.cut(docs, name)
    return docs
