"""Hashed character n-grams, and class samples to learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(points: np.ndarray, longest: int, bits: int) -> np.ndarray:
    """The n-grams of 1 to `longest` code points, each as a number below 2**bits."""
    out, value = [], np.zeros(len(points), np.uint64)
    for n in range(1, longest + 1):
        if len(points) < n:
            break
        value = (value[: len(points) - n + 1] * np.uint64(0x100000001B3) + points[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        out.append(((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def class_sample(rows: DataFrame, keys: list[str], label: str, per_class: int) -> DataFrame:
    """At most `per_class` different (keys, label) of each label, those with the smallest hash of their keys.

    They are looked for among the rows with a hash below a bound that three times as many are expected under; a label
    with too few different ones there (many equal rows) is taken whole. So the numbering doesn't see all rows of a
    frequent label, and equal rows, however many, are one.
    """
    rows = rows.select(*keys, label).withColumn("__u", F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53))
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # a number for each label
    bounds = {y: 3 * per_class / n for y, n in counts.items() if n > 3 * per_class}

    def below() -> DataFrame:
        bound = F.lit(2.0)
        for y, b in bounds.items():
            bound = F.when(F.col(label).eqNullSafe(F.lit(y)), b).otherwise(bound)
        return rows.where(F.col("__u") < bound).distinct()

    if bounds:
        found = {r[0]: r[1] for r in below().groupBy(label).count().collect()}
        bounds = {y: b for y, b in bounds.items() if found.get(y, 0) >= per_class}
    order = Window.partitionBy(label).orderBy("__u", *keys)
    return below().withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= per_class).select(*keys, label)


def hashed_texts(df: DataFrame, id_column: str, text_column: str, *more: Column) -> DataFrame:
    """id, text and its hash th, and more columns."""
    return df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.xxhash64(text_column).alias("th"), *more)


def sampled_texts(docs: DataFrame, labelled: DataFrame, per_class: int) -> DataFrame:
    """At most `per_class` different texts of each label y of (id, th, y): id, y, text. The bound is on rows, not ids.

    Only ids and hashes are numbered and joined; the texts are read again for those chosen, a bounded number.
    """
    chosen = class_sample(labelled, ["id", "th"], "y", per_class).select(F.col("id").alias("__id"), F.col("th").alias("__th"), "y")
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    return docs.select("id", "text", "th").join(F.broadcast(chosen), same).dropDuplicates(["id", "th", "y"]).select("id", "y", "text")
