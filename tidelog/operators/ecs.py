"""Entities and components: a component is a DataFrame of entity_id and its fields, one row an entity."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.ranking import Order, ranked

ID = "entity_id"


def component(df: DataFrame, id_column: str, **fields: str) -> DataFrame:
    """A component from a table: new field name = column."""
    return df.select(F.col(id_column).alias(ID), *[F.col(c).alias(f) for f, c in fields.items()])


def view(*components: DataFrame) -> DataFrame:
    """Entities that have all components, with all fields; the optimizer takes the smallest first."""
    return reduce(lambda a, b: a.join(b, ID), components)


def smallest(**components: DataFrame) -> tuple[str, int]:
    """The component with the fewest entities."""
    return min(((name, c.count()) for name, c in components.items()), key=lambda x: (x[1], x[0]))


class Group:
    """A materialised view, kept up by deltas."""

    def __init__(self, *components: DataFrame, rows: DataFrame | None = None) -> None:
        self.components = components
        self.rows = (view(*components) if rows is None else rows).persist()

    def sync(self, ids: DataFrame, *components: DataFrame) -> Group:
        """After inserts: entities among ids that now have all components join the group."""
        fresh = ids.select(ID).distinct().join(self.rows, ID, "left_anti")
        return Group(*components, rows=self.rows.unionByName(view(*[c.join(fresh, ID, "left_semi") for c in components])))

    def desync(self, ids: DataFrame) -> Group:
        """After deletes: the ids leave the group."""
        return Group(*self.components, rows=self.rows.join(ids.select(ID).distinct(), ID, "left_anti"))

    def each(self, fn: Callable, schema: str) -> DataFrame:
        """An arbitrary function of Arrow batches over the group."""
        return self.rows.mapInArrow(fn, schema)

    def release(self) -> None:
        self.rows.unpersist()


class Registry:
    """Components by name."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.components = spark, {}

    def set(self, name: str, df: DataFrame) -> None:
        self.components[name] = df
        df.createOrReplaceTempView(name)

    def get(self, name: str) -> DataFrame:
        return self.components[name]

    def view(self, *names: str) -> DataFrame:
        return view(*map(self.get, names))

    def group(self, *names: str) -> Group:
        return Group(*map(self.get, names))

    def next_entity(self) -> int:
        """One more than the largest id in use."""
        return 1 + max([-1, *(r[0] for c in self.components.values() if (r := c.agg(F.max(ID)).first())[0] is not None)])

    def destroy(self, ids: DataFrame) -> None:
        """Takes queued entities out of every component; the queue has no limit."""
        for name, c in list(self.components.items()):
            self.set(name, remove(c, ids))


def add(c: DataFrame, new: DataFrame) -> DataFrame:
    """New entities' rows, one an id; ids that are there keep theirs."""
    return c.unionByName(new.dropDuplicates([ID]).join(c, ID, "left_anti"))


def remove(c: DataFrame, ids: DataFrame) -> DataFrame:
    return c.join(ids.select(ID).distinct(), ID, "left_anti")


def update(c: DataFrame, changes: DataFrame) -> DataFrame:
    """Fields of entities set to the changes' values, where those aren't null."""
    fields = [f for f in changes.columns if f != ID]
    new = changes.select(ID, *[F.col(f).alias(f"__{f}") for f in fields])
    kept = [F.coalesce(f"__{f}", f).alias(f) if f in fields else F.col(f) for f in c.columns]
    return c.join(new, ID, "left").select(*kept)


def mass_add(spark: SparkSession, count: int, first: int, **fields: str) -> DataFrame:
    """Entities with null fields of the given types."""
    return spark.range(first, first + count).select(F.col("id").alias(ID), *[F.lit(None).cast(t).alias(f) for f, t in fields.items()])


def create_entities(df: DataFrame, key: str) -> DataFrame:
    """Ids from 0 in the order of a unique key."""
    return ranked(df, [(key, True)], ID)


def contains(c: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.join(c.select(ID), ID, "left_semi")


def within_capacity(c: DataFrame, most: int, capacity: int) -> DataFrame:
    """Entities with an id below `most`, the first `capacity` of them by id."""
    return c.where(F.col(ID) < most).orderBy(ID).limit(capacity)


def sort_by_string(group: DataFrame, column: str) -> DataFrame:
    """The group's rows with their place by a text column, descending by bytes, ties by entity."""
    return ranked(group, [(column, False), (ID, True)], "rank")



def sort_by_number(group: DataFrame, column: str) -> DataFrame:
    """Descending by the unsigned bit pattern: negative numbers first, of floats those furthest from zero."""
    x = F.col(column)
    kind = group.schema[column].dataType.typeName()
    key = F.abs(x) if kind in ("float", "double") else x
    keyed = group.withColumns({"__negative": (x < 0).cast("int"), "__key": key})
    return ranked(keyed, [("__negative", False), ("__key", False), (ID, True)], "rank").drop("__negative", "__key")


def reorder(c: DataFrame, order: DataFrame) -> DataFrame:
    """Rows by given places (entity_id, pos), the others behind them by id; as the column pos."""
    last = order.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
    given = c.join(order.select(ID, "pos"), ID)
    rest = c.join(order.select(ID), ID, "left_anti")
    behind = ranked(rest, [(ID, True)], "pos").withColumn("pos", F.col("pos") + last)
    return given.withColumn("pos", F.col("pos").cast("bigint")).unionByName(behind)


def first_rows(c: DataFrame, keys: list[str], order: str, most: int) -> DataFrame:
    """At most so many rows of each key, in order; the engine limits each task's rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order)
    return c.withColumn("slot", F.row_number().over(w) - 1).where(F.col("slot") < most)
