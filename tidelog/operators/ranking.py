"""Global ranks and exact order statistics without a single-task sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.storage import drop, written

Order = list[tuple[str, bool]]


#: Rows of a range; ranges whose starts one task adds up.
RANGE_ROWS, GROUP = 1 << 19, 4096


def prefix_sums(sums: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """(key, name): the sum of `value` over all smaller keys, for unique whole-number keys.

    Keys are taken in groups of GROUP consecutive numbers, whose sums are added up first, so that no task has them all.
    """
    grouped = sums.select(key, F.col(value).alias("__v"), F.floor(F.col(key) / GROUP).alias("__g"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("__g").agg(F.sum("__v").alias("__s"))
    groups = groups.select("__g", F.coalesce(F.sum("__s").over(before("__g")), F.lit(0)).alias("__b"))  # a row for each group
    inside = grouped.withColumn("__i", F.coalesce(F.sum("__v").over(before("__g", key)), F.lit(0)))
    return inside.join(groups, "__g").select(key, (F.col("__b") + F.col("__i")).alias(name))


def ranked(df: DataFrame, order: Order, name: str = "rank", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Adds the row's place from 0 in the order of (column, ascending); nulls are first where it ascends.

    The rows are written, and counted by what was written; then dealt into ranges of about `range_rows` by the engine's
    sample, sorted in them and written again with range and place, so that both are fixed. The ranges' counts are added
    up: a window over everything would be one task. Rows that agree in all columns of the order stay in one range.
    """
    rows = written(df, "rows")
    parts = max(1, -(-rows.count() // range_rows))
    by = [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in order]
    dealt = rows.repartitionByRange(parts, *by) if parts > 1 else rows.coalesce(1)
    # a partition's number in the high bits, the row's place in it in the low 33
    placed = written(dealt.sortWithinPartitions(*by).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    drop(rows)
    placed = placed.withColumn("__part", F.shiftright("__id", 33))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = prefix_sums(counts, "__part", "__n", "__start")
    place = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__start")
    # a row for each range
    return placed.join(F.broadcast(starts), "__part").withColumn(name, place.cast("bigint")).drop("__part", "__id", "__start")


def order_statistics(df: DataFrame, column: str, shares: list[float], small: int = 10_000) -> dict[float, float]:
    """The element at place floor(n * p), from 0, of the sorted column, for each share p; nulls don't count.

    Approximate percentiles bracket each element; a bracket is narrowed, all of them in one pass, until few values are in
    it or it is one value. A bracket that the counts show to miss its element is taken again with twice the margin.
    """
    x = F.col("x")
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    n, least, most = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return {}
    place = {p: min(n - 1, int(n * p)) for p in shares}
    held = {p: (least, most, 0, n) for p in shares}  # low, high, values below, values inside
    margin = dict.fromkeys(shares, 0.001)
    within = lambda low, high: (x >= F.lit(low)) & (x <= F.lit(high))
    done = lambda p: held[p][3] <= small or held[p][0] == held[p][1] or margin[p] >= 1
    while wide := [p for p in shares if not done(p)]:
        cuts = {p: [min(1.0, max(0.0, (place[p] - held[p][2]) / held[p][3] + d * margin[p])) for d in (-1, 1)] for p in wide}
        found = values.agg(*[F.percentile_approx(F.when(within(*held[p][:2]), x), cuts[p], 10_000) for p in wide]).first()
        counts = values.agg(*[c for low, high in found for c in (F.count_if(x < F.lit(low)), F.count_if(within(low, high)))]).first()
        for k, p in enumerate(wide):
            below, inside = counts[2 * k], counts[2 * k + 1]
            if below <= place[p] < below + inside and inside < held[p][3]:
                held[p] = (*found[k], below, inside)
            else:
                margin[p] *= 2
    some = F.lit(False)
    for low, high, _, _ in held.values():
        some = some | within(low, high)
    tally = sorted((r["x"], r["count"]) for r in values.where(some).groupBy("x").count().toLocalIterator())
    out = {}
    for p in shares:
        low, high, at, _ = held[p]
        for value, count in tally:
            if low <= value <= high:
                at += count
                if at > place[p]:
                    out[p] = value
                    break
    return out
