"""Vectors: similarity to a query, and the codec of stored blobs."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Up to so many dimensions the sum is written out, so that it is compiled.
_UNROLLED = 256


def _number(x: float) -> str:
    """A double as an SQL literal."""
    return f"{float(x)!r}D" if np.isfinite(x) else f"double('{float(x)!r}')"


def _dot(a: Column | str, b: Sequence[float] | Column) -> Column:
    """Numbers are given as one SQL text: a call to the JVM for each of them takes longer than small queries do."""
    if not isinstance(b, Column):
        if isinstance(a, str) and 0 < len(b) <= _UNROLLED:
            name = "`" + a.replace("`", "``") + "`"
            return F.expr(" + ".join(f"cast(get({name}, {i}) AS double) * {_number(x)}" for i, x in enumerate(b)))
        b = F.expr(f"cast(array({', '.join(map(_number, b))}) AS array<double>)")
    product = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(vector: Column | str, query: Sequence[float] | Column) -> Column:
    """Cosine similarity, summed in double precision.

    0 where the lengths differ, or where either vector is null, empty or zero.
    The vector is a column or, to have the sum compiled, a column's name.
    """
    own = F.col(vector) if isinstance(vector, str) else vector
    if isinstance(query, Column):
        size, norm = F.size(query), _norm(query)
    else:
        size, norm = F.lit(len(query)), F.lit(float(np.sqrt(np.square(np.asarray(query, float)).sum())) if len(query) else 0.0)
    lengths = _norm(own) * norm
    comparable = own.isNotNull() & (F.size(own) == size) & (F.size(own) > 0) & (lengths > 0)
    return F.when(comparable, _dot(vector, query) / lengths).otherwise(0.0)


@F.pandas_udf(T.BinaryType())
def encode_floats(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats as a blob."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_floats(blobs: pd.Series) -> pd.Series:
    """The floats of a blob; bytes that make no whole float are dropped."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def pack(values: Sequence[float]) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)
