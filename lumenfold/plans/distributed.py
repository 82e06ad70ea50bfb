"""Block eigensolver whose vectors stay in DataFrames, for components beyond one task.

A round joins the residuals to the Laplacian once (k columns together, combined before the
shuffle), adds up a Gram matrix of 3k columns, solves that on the driver, and forms the new
vectors row by row.  Nothing that comes to the driver grows with the graph.  Each round is
cut from its lineage.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators.laplacian import spmm
from lumenfold.operators.lineage import cut

_STATE = "i long, x array<double>, ax array<double>, p array<double>, ap array<double>"


def _rows(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _gram(blocks: DataFrame, names: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """S'S and S'AS over the columns ``names`` and their images a + name."""

    def part(batches):
        s2, sas = np.zeros((width, width)), np.zeros((width, width))
        for pdf in batches:
            if len(pdf):
                s = np.concatenate([_rows(pdf[c]) for c in names], axis=1)
                a = np.concatenate([_rows(pdf["a" + c]) for c in names], axis=1)
                s2, sas = s2 + s.T @ s, sas + s.T @ a
        yield pd.DataFrame({"g": [np.concatenate([s2.ravel(), sas.ravel()]).tolist()]})

    parts = blocks.select(*names, *["a" + c for c in names]).mapInPandas(part, "g array<double>")
    summed = parts.select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    g = np.zeros(2 * width * width)
    for r in summed:
        g[r["pos"]] = r["v"]
    return g[: width * width].reshape(width, width), g[width * width :].reshape(width, width)


def _small(s2: np.ndarray, sas: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest k pairs of the projected problem; nearly dependent directions are left out."""
    scale = 1 / np.sqrt(np.maximum(np.diag(s2), 1e-300))
    m = s2 * scale[:, None] * scale
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    good = values > 1e-10
    half = scale[:, None] * (vectors[:, good] / np.sqrt(values[good]))
    a = half.T @ sas @ half
    lam, c = np.linalg.eigh((a + a.T) / 2)
    return lam[:k], half @ c[:, :k]


def smallest_pairs(lap: DataFrame, degs: DataFrame, k: int, *, seed: int = 42, tol: float = 1e-5, rounds: int = 300) -> tuple[np.ndarray, DataFrame, float, int]:
    """(values, (i, x array of k) vectors, worst residual, rounds) of the Laplacian (i, j, l).

    ``degs`` is (i, sqrt_deg); it gives the trivial vector and the rows of isolated nodes.
    """
    noise = F.array(*[(F.xxhash64(F.lit(seed), "i", F.lit(c)) / float(1 << 63)).cast("double") for c in range(1, k)])
    start = cut(degs.select("i", F.concat(F.array(F.col("sqrt_deg").cast("double")), noise).alias("x")))
    ax = spmm(lap, start, k)
    state = start.join(ax, "i").select("i", "x", F.col("y").alias("ax"))
    state = cut(state)
    s2, sas = _gram(state, ["x"], k)
    lam, c = _small(s2, sas, k)
    coefficient = c
    names: list[str] = ["x"]
    worst = math.inf
    for done in range(rounds + 1):
        fixed, columns = coefficient, list(names)

        def step(batches, fixed=fixed, columns=columns, lam=lam):
            for pdf in batches:
                if not len(pdf):
                    continue
                s = np.concatenate([_rows(pdf[n]) for n in columns], axis=1)
                a = np.concatenate([_rows(pdf["a" + n]) for n in columns], axis=1)
                x, ax = s @ fixed, a @ fixed
                rest = fixed.copy()
                rest[:k] = 0
                yield pd.DataFrame({"i": pdf["i"], "x": list(x), "ax": list(ax), "p": list(s @ rest), "ap": list(a @ rest), "w": list(ax - x * lam)})

        state = cut(state.mapInPandas(step, _STATE + ", w array<double>"))
        norms = state.agg(*[F.sqrt(F.sum(F.col("w")[c] * F.col("w")[c])).alias(f"n{c}") for c in range(k)], *[F.sqrt(F.sum(F.col("x")[c] * F.col("x")[c])).alias(f"x{c}") for c in range(k)]).first()
        worst = max(norms[c] / max(norms[k + c], 1e-300) for c in range(k))
        if worst < tol or done == rounds:
            return lam, state.select("i", "x"), worst, done
        aw = spmm(lap, state.select("i", F.col("w").alias("x")), k).select("i", F.col("y").alias("aw"))
        state = cut(state.join(aw, "i"))
        names = ["x", "w", "p"] if len(names) == 3 or done else ["x", "w"]
        s2, sas = _gram(state, names, k * len(names))
        lam, coefficient = _small(s2, sas, k)
    raise AssertionError
