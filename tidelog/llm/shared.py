"""What the operators share: written cuts of the lineage, Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.storage import drop, new_path  # noqa: F401
from tidelog.storage import written as cut  # noqa: F401

#: Rows of a batch that Python gets.
ARROW_ROWS = 2000


def short_batches(df: DataFrame) -> DataFrame:
    """Has the session hand at most ARROW_ROWS rows at a time to Python: texts are long, and buffers stay allocated."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of a column, at least a row each."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(size, batch.column(column).nbytes))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; batches without rows are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return short_batches(df).mapInArrow(run, schema)


def texts_of(column: pa.Array) -> list[str]:
    """The column's strings, null as the empty string."""
    return ["" if t is None else t for t in column.to_pylist()]


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null is empty."""
    return (text or "").encode().lower()
