"""Sorted keys that cut the key space into slots, so that a range look-up becomes an equality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def slots(fences: list[str], side: str = "right"):
    """Of a key, how many of the sorted fences aren't above it (side="left": are below it). Strings compare by code point, which is the
    order of their UTF-8 bytes too."""
    held = np.array(fences, dtype=object)

    @F.pandas_udf("long")
    def slot(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held, keys.to_numpy(), side=side) if len(held) else np.zeros(len(keys), np.int64), dtype="int64")

    return slot
