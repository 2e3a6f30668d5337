"""Products of sparse vectors in two columns each.

Spark has no expression that merges two sorted lists: a lookup per entry is a scan of the
other list, and exploding both sides of every pair makes a row per entry.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


@pandas_udf(DoubleType())
def sparse_dot(keys_a: pd.Series, w_a: pd.Series, keys_b: pd.Series, w_b: pd.Series) -> pd.Series:
    """Sum of products over the keys that both rows have; keys occur once per row."""
    out = np.zeros(len(keys_a))
    for i, (ka, wa, kb, wb) in enumerate(zip(keys_a, w_a, keys_b, w_b)):
        _, at_a, at_b = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        out[i] = wa[at_a] @ wb[at_b]
    return pd.Series(out)
