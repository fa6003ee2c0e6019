"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.lineage import checkpointed as checkpointed

#: The white space that separates words, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def documents(df: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """``doc_id`` long and ``text`` string of a table, whatever else it holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)


def bucket(column, parts: int):
    """crc32 of a number's decimal text, modulo parts (null: -1, so in no fold)."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts)), F.lit(-1))


#: Empties what an operator keeps in a worker for its next task.
CACHES: list[Callable[[], None]] = []


def let_go(keep: bool = False) -> None:
    """Gives back what a task has freed, and what other operators keep here: workers live on through all stages, each
    as large as its largest task was. keep: this operator's own tasks go on with what is kept."""
    for clear in () if keep else CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's, made without Python workers: those of createDataFrame from tuples have a daemon of
    their own, which stays in each executor."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)
    columns = list(zip(*rows, strict=True)) or [()] * len(arrow)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, arrow, strict=True)], schema=arrow), kinds)


def slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for at in range(0, batch.num_rows, rows))


def map_batches(df: DataFrame, func: Callable[[pa.RecordBatch], Iterator[dict] | dict], schema: str, keep: bool = False) -> DataFrame:
    """mapInArrow with a function that turns one batch into one or more dicts of columns. keep: see let_go."""
    kinds = T._parse_datatype_string(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        let_go(keep)
        arrow, batch, found, columns = to_arrow_schema(kinds), None, None, None
        for batch in batches:
            found = func(batch)
            for columns in [found] if isinstance(found, dict) else found:
                yield pa.RecordBatch.from_arrays(
                    [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in ((columns[f.name], f) for f in arrow)],
                    schema=arrow,
                )
        del batch, found, columns
        let_go(keep)

    return df.mapInArrow(run, kinds)


def filter_batches(df: DataFrame, stays: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows, as they are, for which stays(batch) is true."""

    def run(batches):
        let_go()
        batch = None
        for batch in batches:
            yield batch.filter(pa.array(stays(batch), pa.bool_()))
        del batch
        let_go()

    return df.mapInArrow(run, df.schema)
