"""Results to text and files."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

FORMATS = ("table", "json", "csv", "tsv", "raw", "value", "vertical")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Every row as a JSON line, under a folder."""
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str) -> None:
    """Events by index and day, the layout that time filters prune."""
    from pyspark.sql import functions as F

    df.withColumn("date", F.to_date("_time")).write.mode("append").partitionBy("index", "date").parquet(path)


def stream_json(df: DataFrame) -> Iterator[str]:
    """JSON lines, a partition at a time."""
    yield from df.toJSON().toLocalIterator()


def shown(value: object) -> str:
    """A cell: whole floats without a fraction, nulls empty."""
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
        return str(int(value))
    return value.isoformat() if hasattr(value, "isoformat") else str(value)


def render(df: DataFrame, format: str = "table", limit: int = 10_000) -> str:
    """At most `limit` rows of a result as text."""
    from tidelog.engine import ordered_columns

    df = ordered_columns(df)
    if format == "json":
        return "\n".join(json.dumps(json.loads(x), sort_keys=True, ensure_ascii=False) for x in df.limit(limit).toJSON().collect())
    rows = [[shown(v) for v in r] for r in df.limit(limit).collect()]
    if format in ("csv", "tsv"):
        out = io.StringIO()
        writer = csv.writer(out, delimiter="," if format == "csv" else "\t", lineterminator="\n")
        writer.writerow(df.columns)
        writer.writerows(rows)
        return out.getvalue().rstrip("\n")
    if format == "raw":
        at = df.columns.index("_raw") if "_raw" in df.columns else None
        return "\n".join(r[at] if at is not None else "\t".join(r) for r in rows)
    if format == "value":
        return rows[0][0] if rows and rows[0] else ""
    if format == "vertical":
        width = max(map(len, df.columns), default=0)
        return "\n\n".join("\n".join(f"{c:<{width}}  {v}" for c, v in zip(df.columns, r)) for r in rows)
    if format != "table":
        raise ValueError(f"unknown output format {format}; there are {', '.join(FORMATS)}")
    widths = [max([len(c), *(len(r[i]) for r in rows)]) for i, c in enumerate(df.columns)]
    line = lambda cells: "  ".join(f"{x:<{w}}" for x, w in zip(cells, widths)).rstrip()
    return "\n".join([line(df.columns), line(["-" * w for w in widths]), *map(line, rows)])
