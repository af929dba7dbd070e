"""Arrow batches of a modest size, and whole numbers in few bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
SPARK_DEFAULT, MODEST = 64 * 1024 * 1024, 8 * 1024 * 1024


def keep_modest(spark: SparkSession) -> None:
    """Rows of whole texts are large: batches of 8 MB, unless the session has its own size.

    A batch is held by the JVM, by the Python worker, and once more on its way back.
    """
    if str(spark.conf.get(BYTES)).lower().rstrip("b") == str(SPARK_DEFAULT):
        spark.conf.set(BYTES, str(MODEST))


def compact(cells: np.ndarray) -> bytes:
    """Rows of whole numbers in the narrowest type that holds them all; read back by `cells_of`."""
    low, high = int(cells.min(initial=0)), int(cells.max(initial=0))
    kinds = (np.int8, np.int16, np.int32, np.int64)
    return cells.astype(next(t for t in kinds if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def cells_of(packed, rows: int, width: int) -> np.ndarray:
    """The rows behind `compact`, as int64."""
    size = len(packed) // max(1, rows * width) or 8
    return np.frombuffer(packed, f"i{size}").reshape(rows, width).astype(np.int64)
