"""Running a function over Arrow batches of a few columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Texts that are Python objects at once.
_AT_ONCE = 256


def map_columns(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """`df` through `step`, a generator over record batches; only the columns of `df` cross to Python."""
    return df.mapInArrow(step, schema)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for at in range(0, len(column), _AT_ONCE):
        for x in column.slice(at, _AT_ONCE).cast(pa.large_binary()).to_pylist():
            yield x or b""
