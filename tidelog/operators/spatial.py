"""Spatial buckets: cells of a grid, hashed cells, their counts and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.ecs import ID, first_rows

# Fixed values of the buckets.
HASH_CELL = 0.55
HASH_FACTORS = (73856093, 19349663, 83492791)
HASH_SIZE = 131072
GRID_SIDE, GRID_OFFSET, GRID_CAP = 64, 500, 32


def cell(x: Column) -> Column:
    """The cell number along an axis, in float arithmetic, cut towards zero."""
    return (x.cast("float") * (F.lit(1.0).cast("float") / F.lit(HASH_CELL).cast("float")).cast("float")).cast("float").cast("bigint")


def hashed_cell(x: Column, y: Column, z: Column) -> Column:
    a, b, c = (cell(p) * f for p, f in zip((x, y, z), HASH_FACTORS, strict=True))
    return a.bitwiseXOR(b).bitwiseXOR(c).bitwiseAND(F.lit(HASH_SIZE - 1).cast("bigint"))


def grid_index(x: Column) -> Column:
    """A grid coordinate; negative ones wrap round."""
    return F.pmod((x.cast("float") + F.lit(GRID_OFFSET).cast("float")).cast("int"), F.lit(GRID_SIDE))


def with_cells(positions: DataFrame) -> DataFrame:
    return positions.withColumn("cell", hashed_cell(F.col("x"), F.col("y"), F.col("z")))


def histogram(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.count("*").alias("n"))


def offsets(cells: DataFrame) -> DataFrame:
    """Counts with each cell's first place: a sum over at most HASH_SIZE cells."""
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return histogram(cells).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))


def scattered(cells: DataFrame) -> DataFrame:
    """Each entity's place in the order of cells: its cell's start and its rank in the cell by id."""
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(ID)) - 1
    starts = F.broadcast(offsets(cells).select("cell", "start"))  # at most HASH_SIZE rows
    return cells.withColumn("r", rank).join(starts, "cell").select(ID, "cell", (F.col("start") + F.col("r")).alias("place"))


def grid(positions: DataFrame, cap: int = GRID_CAP) -> DataFrame:
    """The entities of each grid cell, at most `cap` of them, by id."""
    cells = positions.select(ID, *[grid_index(F.col(p)).alias(f"g{p}") for p in "xyz"])
    return first_rows(cells, ["gx", "gy", "gz"], ID, cap)
