"""Cutting lineage with files in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from spark.checkpoint.dir.

    Only where the session names none, as in tests on one machine, a temporary folder is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="lumenfold-")
        sc.setCheckpointDir(named)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


_MADE: list[str] = []


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when this process ends its session in good order."""
    if not _MADE:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit, spark)
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    return _MADE[-1]


def made() -> list[str]:
    """Paths named so far and not deleted."""
    return list(_MADE)


def clear(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete tables that ``shared_path`` has named in this process, all or those given; results that
    still read them must be written first.  Checkpoints are left to Spark's own cleaner."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for name in made() if paths is None else paths:
        if name in _MADE:
            _MADE.remove(name)
            path = jvm.org.apache.hadoop.fs.Path(name)
            gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def _at_exit(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may be stopped
        if spark.sparkContext._jsc is not None:
            clear(spark)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """``df`` read back from the shared folder, so that lost executors cost no long recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, with column pruning."""
    path = shared_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
