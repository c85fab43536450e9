"""Arrow functions for the few steps that built-in functions cannot express."""

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Python objects are made for this many rows at a time, whatever the batch size.
ROWS_AT_ONCE = 64


def row_function(result: T.DataType, prepare: Callable[[], Callable[..., Any]]) -> Callable:
    """An Arrow function that calls ``prepare()`` once per task and the function it
    returns once per row; any number of columns.

    It is declared non-deterministic so that the optimizer neither repeats it in
    several expressions nor moves filters on its result below it.
    """
    arrow_type = to_arrow_type(result)

    def convert(batches):
        each_row = prepare()
        for batch in batches:
            columns = batch if isinstance(batch, tuple) else (batch,)
            for start in range(0, len(columns[0]), ROWS_AT_ONCE):
                part = [column.slice(start, ROWS_AT_ONCE).to_pylist() for column in columns]
                yield pa.array([each_row(*row) for row in zip(*part)], arrow_type)

    def declare(width: int):
        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            return convert(batches)

        def two(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            return convert(batches)

        def three(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            return convert(batches)

        return F.arrow_udf({1: one, 2: two, 3: three}[width], result).asNondeterministic()

    return lambda *columns: declare(len(columns))(*columns)
