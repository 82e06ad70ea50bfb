"""Reports: metric rows, JSON and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def metric_row(dataset: str, n: int, name: str, value: float, threshold: float, passed: bool, dimension: int = 0) -> Row:
    return Row(dataset=dataset, n=int(n), name=name, dimension=int(dimension), value=float(value), threshold=float(threshold), passed=bool(passed))


def nested(report: DataFrame) -> DataFrame:
    """(dataset, n, metrics array): the flat report by dataset."""
    return report.groupBy("dataset", "n").agg(F.array_sort(F.collect_list(F.struct("name", "dimension", "value", "threshold", "passed"))).alias("metrics"))


def write_json(report: DataFrame, path: str) -> None:
    nested(report).write.mode("overwrite").json(path)


def to_json(report: DataFrame) -> DataFrame:
    """(dataset, json): one JSON text for each dataset."""
    return nested(report).select("dataset", F.to_json(F.struct("dataset", "n", "metrics")).alias("json"))


def to_markdown(report: DataFrame, most: int = 10_000) -> str:
    """A table for readers; reports are small, and longer ones than ``most`` rows are refused."""
    rows = report.orderBy("dataset", "name", "dimension").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report of over {most} rows")
    head = ["dataset", "n", "name", "dimension", "value", "threshold", "passed"]
    lines = ["| " + " | ".join(head) + " |", "|" + "-|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join(f"{r[c]:.6g}" if isinstance(r[c], float) else str(r[c]) for c in head) + " |" for r in rows]) + "\n"
