"""What the operators on `embeddings` share: integer components, rows of their own, padded arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components beyond this are held at it: products of two, summed over 2048 positions, stay in 64 bits.
LARGEST = 1 << 26


def integer_vectors(vectors: DataFrame, scale: int, *others: str) -> DataFrame:
    """`row` (a number of the row's own), `vec_id`, the columns `others` and `v`: floor(scale * x) of every component as an int.

    Rows whose vector is null or holds a null, a NaN or an infinity are left out. An empty vector stays, repeated rows stay, a
    null id stays. Components beyond +-2**26 are held there. `row` is stable only once the table is written (see `cut`).
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), F.floor(F.lit(float(scale)) * c))).cast("int"))
    return vectors.filter(fine).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), *others, whole.alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Lists of ints as the rows of a matrix, shorter ones filled up with zeros to the longest (or to `width`)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int32)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def widened(rows: np.ndarray, width: int) -> np.ndarray:
    """Zeros added on the right up to `width` columns."""
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))
