"""Super-features: chunks that share much content are likely to share one of three digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Window, base and modulus of the polynomial hash; sub-chunks, and how they are grouped.
WINDOW, BASE, MODULUS = 48, 37, 1_000_000_007
FEATURES, GROUPS, SLOTS = 12, 4, 3
_COEFFICIENTS = np.array([pow(BASE, WINDOW - 1 - k, MODULUS) for k in range(WINDOW)], np.float64)


def features(data: bytes) -> list[int]:
    """For each of twelve equal sub-chunks the largest hash of its 48-byte windows, 0 where it is shorter."""
    n = len(data)
    if n < WINDOW:
        return [0] * FEATURES
    # 48 terms below 2**8 * 2**30 sum up exactly in double precision.
    hashes = np.correlate(np.frombuffer(data, np.uint8).astype(np.float64), _COEFFICIENTS, "valid").astype(np.int64) % MODULUS
    edges = [i * n // FEATURES for i in range(FEATURES + 1)]
    return [int(hashes[a : b - WINDOW + 1].max()) if b - a >= WINDOW else 0 for a, b in zip(edges, edges[1:], strict=False)]


def super_features(data: bytes) -> list[str]:
    """Digests of the r-th smallest features of the four groups, r = 0, 1, 2, as little-endian 64-bit integers."""
    found = features(data)
    groups = [sorted(found[g * SLOTS : (g + 1) * SLOTS]) for g in range(GROUPS)]
    return [hashlib.sha256(b"".join(g[r].to_bytes(8, "little") for g in groups)).hexdigest() for r in range(SLOTS)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _super_features(data: pd.Series) -> pd.Series:
    return pd.Series([None if d is None else super_features(d) for d in data], dtype=object)


def super_feature(payload: Column) -> Column:
    """Array of three lower-case hex digests; null for a null payload."""
    return _super_features(payload)
