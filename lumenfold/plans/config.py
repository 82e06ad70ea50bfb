"""Settings and errors of the embedding plans."""

from __future__ import annotations

import os
from dataclasses import dataclass
from enum import Enum


class ComputeMode(Enum):
    #: Degrees in single precision, as column sums in row order; eigenvalues are then off by about 1e-8.
    COMPAT = "compat"
    #: Degrees in double precision, as row sums.
    NATIVE = "native"


class SpectralError(ValueError):
    """Base of the errors that a caller can act on."""


class InvalidGraph(SpectralError):
    pass


class TooFewNodes(SpectralError):
    def __init__(self, n: int, dims: int):
        super().__init__(f"{n} nodes are too few for {dims} dimensions")
        self.n, self.dims = n, dims


class ConvergenceFailure(SpectralError):
    pass


@dataclass(frozen=True)
class SpectralConfig:
    compute_mode: ComputeMode = ComputeMode.COMPAT
    #: Dense solving under so many nodes.
    dense_below: int = 2000
    #: The last, dense level takes so many nodes at most.
    dense_most: int = 20_000
    rsvd_oversampling: int | None = None
    rsvd_power_iterations: int = 2
    #: A component of up to so many stored edges is solved within one task, others in DataFrames.
    local_edges: int = 4_000_000
    #: Components that are placed by the affinity of their data: their pairs come to the driver.
    most_placed: int = 4096
    expansion: float = 10.0
    noise: float = 1e-4

    @classmethod
    def from_env(cls, **changes) -> SpectralConfig:
        """Settings with LUMENFOLD_DENSE_BELOW, LUMENFOLD_RSVD_OVERSAMPLING and
        LUMENFOLD_RSVD_POWER_ITERATIONS from the environment where they are set."""
        for name in ("dense_below", "rsvd_oversampling", "rsvd_power_iterations"):
            if (v := os.environ.get(f"LUMENFOLD_{name.upper()}")) is not None:
                changes.setdefault(name, int(v))
        return cls(**changes)
