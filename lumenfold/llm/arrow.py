"""Arrow-batch plumbing shared by the operators that run Python on executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lumenfold.llm.names import col

#: Rows, and bytes of them unless a single row has more, that a function gets at a time; what it
#: makes of them is in proportion.  Batches themselves are bounded by spark.sql.execution.arrow.maxBytesPerBatch.
ROWS, BYTES = 512, 1 << 22


#: What the tasks of one operator share in a worker: models and words seen.  One operator's at a
#: time, so that a worker that lives on does not gather those of all stages of a pipeline.
_HELD: dict[tuple, object] = {}


def held(key: tuple, build: Callable[[], object]) -> object:
    """The object of this key, built where the worker does not hold it yet."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def release(key: tuple | None = None) -> None:
    """Let go of what is held for other keys, and give free memory back to the system."""
    if any(k != key for k in _HELD):
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(AttributeError, OSError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def _sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value; a number counts as eight."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.full(len(column), 8)


def blocks_of(batch: pa.RecordBatch, rows: int = ROWS, most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of up to ``rows`` rows and ``most`` bytes, of one row at least."""
    ends = np.cumsum(np.sum([_sizes(c) for c in batch.columns], axis=0)) if batch.num_columns else np.zeros(batch.num_rows)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        fit = int(np.searchsorted(ends, before + most, side="right"))
        end = min(batch.num_rows, at + rows, max(at + 1, fit))
        yield batch.slice(at, end - at)
        at = end


def map_rows(
    df: DataFrame,
    columns: list[str],
    schema: str | StructType,
    make: Callable[[], Callable[[list[list]], list[list]]],
    key: tuple | None = None,
    keep: list[str] | None = None,
    rows: int = ROWS,
) -> DataFrame:
    """Map rows in small blocks on executors, without a shuffle.

    ``make()`` runs once per task (load models there) and returns a function from input
    columns, as lists, to output columns, as lists of equal length.  Only ``columns`` and
    ``keep`` are read, so that the scan is pruned to them; those of ``keep`` come out as they
    are, before the columns of ``schema``.  ``key``: of what ``make`` holds across tasks;
    ``rows``: of a block at most.
    """
    keep = keep or []
    names = list(dict.fromkeys([*keep, *columns]))
    given = df.select(*[col(c) for c in names])
    read = [names.index(c) for c in columns]
    made = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    # Numbered names on the way, since names with dots are not accepted.
    out = StructType([*[StructField(f"kept{k}", f.dataType) for k, f in enumerate(given.schema.fields[: len(keep)])], *[StructField(f"made{k}", f.dataType) for k, f in enumerate(made.fields)]])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(key)
        f = make()
        for batch in batches:
            for part in blocks_of(batch, rows):
                kept = [c if c.type == t.type else c.cast(t.type) for c, t in zip(part.columns[: len(keep)], arrow, strict=False)]
                got = f([part.columns[k].to_pylist() for k in read])
                new = [v if isinstance(v, pa.Array) else pa.array(v, t.type) for v, t in zip(got, list(arrow)[len(keep) :], strict=True)]
                yield pa.RecordBatch.from_arrays([*kept, *new], schema=arrow)

    return given.toDF(*[f"given{k}" for k in range(len(names))]).mapInArrow(run, out).toDF(*keep, *made.names)
