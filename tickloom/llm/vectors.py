"""What the operators on embeddings share: which vectors take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not all zero."""
    c = F.col(col).cast("array<double>")
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, dim: int | None = None, dtype=np.float64) -> np.ndarray:
    """A list column whose rows have one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, dim if dim is not None else (len(flat) // n if n else 0))
