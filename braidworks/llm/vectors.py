"""Vector columns: which rows are sound, and their values as matrices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of one matrix at most.
ENTRIES = 1 << 20


def is_sound(vector: Column) -> Column:
    """Whether a vector is there and neither empty nor holds a null or non-finite entry."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def of_common_length(rows: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows whose vector has the length that most have (of equally many, the longest), and that length; 0 if there are no rows."""
    lengths = rows.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"]
    return rows.where(F.size(vector) == F.lit(most)), most or 0


def matrix(column: pa.ChunkedArray | pa.Array, length: int, dtype) -> np.ndarray:
    """A column of lists of one length, without nulls, as a matrix."""
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, length)


def slices(batches: Iterator[pa.RecordBatch], length: int, most_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ENTRIES numbers, and of `most_rows`."""
    step = max(1, min(ENTRIES // max(1, length), most_rows or ENTRIES))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
