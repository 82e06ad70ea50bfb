"""All-against-all work in blocks.

Points are dealt to blocks by a hash of their id.  A pair of blocks meets in one task, so that
memory is bounded by the block size, and n points in blocks of b cost n * n / b shuffled rows,
not n * n.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 2048


def matrix(column: pd.Series) -> np.ndarray:
    """A column of equal-length arrays as float64 rows."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a few rows at a time: exact zeros, no cancellation."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for at in range(0, len(a), step):
        d = a[at : at + step, None, :] - b[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
    return out


def against(left: DataFrame, right: DataFrame, f: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, *, block: int = BLOCK, key: str = "i") -> DataFrame:
    """f(rows of a left block, rows of a right block) for every pair of blocks, in parallel."""
    n_left, n_right = max(1, -(-left.count() // block)), max(1, -(-right.count() // block))
    deal = lambda df, own, n_own, other, n_other: df.select(
        *[F.col(c).alias(c) for c in df.columns], F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
    )
    a = deal(left, "_lb", n_left, "_rb", n_right).groupBy("_lb", "_rb")
    b = deal(right, "_rb", n_right, "_lb", n_left).groupBy("_lb", "_rb")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return f(x.reset_index(drop=True), y.reset_index(drop=True))

    return a.cogroup(b).applyInPandas(run, schema)
