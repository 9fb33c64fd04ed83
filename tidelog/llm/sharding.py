"""Two-pass external shuffle into shards.

First pass: rows are scattered uniformly into buckets of bounded bytes by a seeded hash of all their columns. Second pass:
each bucket, one partition, is put in the order of two such hashes, shuffled by Fisher-Yates (the engine's own `shuffle`,
seeded) and written with each row's place. Buckets in order are the shuffled corpus; it is cut into shards whose row
counts differ by one at most (law `rows`). The result depends on the rows and the seed alone, not on how they are dealt
to tasks, so a task that runs again gives the same.

Rows that are equal in all columns can't be told apart by a hash; where they are over HOT_ROWS, they are counted, one of
them is kept, and it is given back in numbered copies, which scatter like any other rows. Beyond MAX_BUCKETS buckets the
scatter is in two rounds: runs of MAX_BUCKETS buckets are written first, then each run is dealt into its buckets. The
buckets' counts, a number for each, are added up in groups and reach their buckets with the rows; the driver has only the
total.

Null texts have size 16 and checksum 0 and stay null; null ids, repeated rows and ties are rows like any other, columns of
any type are carried; an empty table gives an empty one. The internal columns start with two underscores, so other columns
of the table can't clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from tidelog.operators.ranking import prefix_sums

from .shared import cut, new_path

#: Equal rows beyond which they are counted and given back as copies; buckets that one scatter deals into.
HOT_ROWS, MAX_BUCKETS = 10_000, 20_000


def _hashable(name: str, kind: DataType) -> Column:
    """The column itself, or as text where a map is in it."""
    column = F.col(f"`{name}`")
    return F.to_json(F.struct(column)) if "map<" in kind.simpleString() else column


def _given_back(one: DataFrame, copies: int) -> DataFrame:
    """Rows with a count `__n` as that many rows with numbers `__copy`: blocks of `copies` first, so none is one task's."""
    blocks = one.withColumn("__block", F.explode(F.expr(f"sequence(0L, (__n - 1) div {copies})"))).repartition("__key", "__block")
    last = F.expr(f"least(__n, (__block + 1) * {copies}) - 1")
    return blocks.withColumn("__copy", F.explode(F.sequence(F.expr(f"__block * {copies}"), last))).drop("__block", "__n")


def _numbered(df: DataFrame, seed: int) -> DataFrame:
    """The row as `__row`, two hashes of it, and `__copy`: the number of a row that many are equal to, else 0."""
    parts = [_hashable(f.name, f.dataType) for f in df.schema.fields]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.xxhash64(F.lit(seed), *parts).alias("__key"), F.xxhash64(F.lit(seed + 2), *reversed(parts)).alias("__tie"))
    counts = rows.groupBy("__key", "__tie").agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS)
    hot = cut(counts, "hot")
    if not hot.limit(1).count():
        return rows.withColumn("__copy", F.lit(0).cast("bigint"))
    one = rows.join(hot, ["__key", "__tie"]).groupBy("__key", "__tie", "__n").agg(F.first("__row").alias("__row"))
    back = _given_back(one, HOT_ROWS)
    rest = rows.join(hot, ["__key", "__tie"], "left_anti").withColumn("__copy", F.lit(0).cast("bigint"))
    return rest.unionByName(back)


def _second_pass(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """Buckets as partitions, shuffled: `__g`, the row's place in the whole table, and its columns."""
    together = rows.repartitionById(n, F.col("__bucket")).groupBy("__bucket")  # one exchange: the bucket is the partition
    together = together.agg(F.collect_list(F.when(F.col("__row").isNotNull(), F.struct("__key", "__tie", "__copy", "__row"))).alias("__rows"), F.max("__start").alias("__start"))
    order = F.array_sort(F.transform("__rows", lambda r, i: F.struct(r["__key"], r["__copy"], r["__tie"], i.alias("i"))))
    drawn = F.transform(F.shuffle(order, seed), lambda o: F.get("__rows", o["i"])["__row"])
    placed = together.select("__start", F.posexplode(drawn).alias("__place", "__row"))
    return placed.select((F.col("__start") + F.col("__place")).alias("__g"), "__row.*")


def scatter_shuffle(df: DataFrame, text_column: str = "text", bucket_bytes: int = 16 << 20, seed: int = 8) -> tuple[DataFrame, int]:
    """All columns and `__g`, the row's place from 0 in the shuffled table, as the second pass wrote them; and their number."""
    size = F.coalesce(F.octet_length(text_column), F.lit(0)) + 64
    total, n_rows = df.agg(F.sum(size.cast("bigint")), F.count("*")).first()
    n = max(1, -(-(total or 0) // bucket_bytes))
    rows = _numbered(df, seed)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "__key", "__copy"), F.lit(n)).cast("int"))
    counts = rows.groupBy("__bucket").agg(F.count("*").alias("__n"))
    starts = prefix_sums(counts, "__bucket", "__n", "__start")
    nothing = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("__row", "__key", "__tie", "__copy")]
    # a row for each bucket brings its start along
    dealt = rows.withColumn("__start", F.lit(None).cast("bigint")).unionByName(starts.select(*nothing, "__bucket", F.col("__start").cast("bigint")))
    if n <= MAX_BUCKETS:
        return cut(_second_pass(dealt, n, seed), "shuffled"), n_rows
    coarse = new_path(df.sparkSession, "coarse")
    runs = -(-n // MAX_BUCKETS)
    dealt.withColumn("__run", F.expr(f"__bucket div {MAX_BUCKETS}")).repartition(runs, "__run").write.partitionBy("__run").parquet(coarse)
    written = df.sparkSession.read.schema(StructType([*dealt.schema.fields, StructField("__run", LongType())])).parquet(coarse)
    inside = F.pmod("__bucket", F.lit(MAX_BUCKETS)).cast("int")
    done = [cut(_second_pass(written.where(F.col("__run") == r).drop("__run").withColumn("__bucket", inside), MAX_BUCKETS, seed), "shuffled") for r in range(runs)]
    return reduce(DataFrame.unionByName, done), n_rows


def shards(df: DataFrame, n_shards: int, text_column: str = "text", bucket_bytes: int = 16 << 20, seed: int = 8) -> DataFrame:
    """All columns, `__shard` and `__slot`: consecutive runs of the shuffled table, slots gapless from 0."""
    written, total = scatter_shuffle(df, text_column, bucket_bytes, seed)
    shard = F.expr(f"((__g + 1) * {n_shards} - 1) div {max(total, 1)}").cast("int")
    out = written.withColumn("__shard", shard).withColumn("__slot", F.expr(f"__g - (cast(__shard as bigint) * {total}) div {n_shards}"))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "__shard", "__slot")
