"""Rows of texts as Arrow batches, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of texts that are handed to Python, or back to Spark, at a time: texts can be long.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def texts_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """The columns ``doc_id`` (long) and ``text``; other columns are not read, a null text is empty.

    With the name of a column that numbers the rows, the columns are ``number``, ``rank`` (the id) and ``text``.
    """
    columns = [F.col(doc_id).cast("long").alias("doc_id" if row is None else "rank"),
               F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")]
    return docs.select(*columns) if row is None else docs.select(F.col(row).alias("number"), *columns)


def columns_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """The rows of a batch, a few at a time, so that few Python strings are alive at once."""
    for start in range(0, batch.num_rows, 256):
        part = batch.slice(start, 256)
        yield from zip(*(column.to_pylist() for column in part.columns))


def as_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Tuples to batches of the schema."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def map_rows(frame: DataFrame, function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: pa.Schema) -> DataFrame:
    """Send each partition's rows through a generator of tuples."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return as_batches(function(row for batch in batches for row in columns_of(batch)), schema)

    return in_small_batches(frame).mapInArrow(run, ddl(schema))


def in_small_batches(frame: DataFrame) -> DataFrame:
    """The frame, in a session that sends at most ``BATCH_ROWS`` rows at a time to Python."""
    conf = frame.sparkSession.conf
    if not 0 < int(conf.get(_BATCH)) <= BATCH_ROWS:
        conf.set(_BATCH, str(BATCH_ROWS))
    return frame


_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean",
          pa.float64(): "double", pa.binary(): "binary"}


def _kind(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_kind(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return f"struct<{', '.join(f'`{f.name}`: {_kind(f.type)}' for f in kind)}>"
    return _KINDS[kind]


def ddl(schema: pa.Schema) -> str:
    """The Spark schema of an Arrow schema."""
    return ", ".join(f"`{f.name}` {_kind(f.type)}" for f in schema)


def with_few(frame: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner", most: int = 20_000) -> DataFrame:
    """Join a stored table that has a row per key: sent to all tasks if it has at most ``most`` rows, else dealt by key."""
    return frame.join(F.broadcast(few) if few.count() <= most else few, on, how)


def fresh(name: str, frame: DataFrame) -> str:
    """A column name that the frame does not have, in any case."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
