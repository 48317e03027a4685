"""Bit patterns of numbers, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, LongType

from ckptlake.types import UsageError

#: How numpy views the patterns of each number type. A BF16 is the upper half of an F32.
VIEWS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "<i1", "U8": "<u1", "BOOL": "<u1"}


@arrow_udf(ArrayType(LongType()))
def float_bits(values: pa.Array) -> pa.Array:
    """The 32-bit patterns of arrays of floats, as unsigned numbers: one view over all arrays of a batch."""
    sizes = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float32).view(np.uint32).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=values.is_null() if values.null_count else None)


def widen(raw: np.ndarray, dtype: str) -> np.ndarray:
    """Unsigned patterns as 32-bit floats; whole numbers by their value. Unknown types raise."""
    if dtype == "BF16":
        halves = np.zeros((len(raw), 2), "<u2")
        halves[:, 1] = raw
        return halves.view("<f4").ravel()
    if dtype not in VIEWS:
        raise UsageError(f"numbers of {dtype} have no float form")
    return raw.view(VIEWS[dtype]).astype(np.float32)


def narrow(values: np.ndarray, dtype: str) -> np.ndarray:
    """32-bit floats as patterns of a float type. A BF16 takes the upper half, one more where the lower half has its top bit."""
    if dtype == "BF16":
        pattern = values.astype("<f4").view("<u4")
        return ((pattern >> 16) + (pattern >> 15 & 1)).astype("<u2")
    if dtype not in ("F16", "F32"):
        raise UsageError(f"floats aren't written as {dtype}")
    own = values.astype(VIEWS[dtype])
    return own.view(f"<u{own.itemsize}")
