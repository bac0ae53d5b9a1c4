"""The content hash of files: xxHash64, seed 0, hexadecimal without padding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_bytes(data: bytes) -> str:
    import xxhash

    return f"{xxhash.xxh64_intdigest(data, 0):x}"


@F.pandas_udf(T.StringType())
def content_hash(contents: pd.Series) -> pd.Series:
    """Spark's own ``xxhash64`` has another seed and so other values."""
    return contents.map(lambda data: None if data is None else hash_bytes(bytes(data)))
