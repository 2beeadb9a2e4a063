"""Sinks: result tables, reports as JSON lines or Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A table of a report; reports are aggregates, of which the first ``most`` rows are shown."""
    got = rows.limit(most).collect()
    head = "| " + " | ".join(rows.columns) + " |"
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got]
    return "\n".join([head, "|" + " --- |" * len(rows.columns), *body])
