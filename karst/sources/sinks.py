"""Sinks: JSON lines, CSV, appended logs, atomic pointer files, reports."""

from __future__ import annotations

import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, columns: list[str] | None = None, mode: str = "error") -> None:
    """Rows as JSON lines in UTF-8, null fields left out; the job's commit makes them visible at once."""
    df.select(columns or df.columns).write.mode(mode).json(path)


def csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def metrics_row(df: DataFrame) -> str:
    """The one row of df as JSON; more or fewer rows are an error."""
    rows = df.limit(2).select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).collect()
    if len(rows) != 1:
        raise ValueError(f"one row was expected; there are {'more' if rows else 'none'}")
    return rows[0]["j"]


def replace_file(path: str | Path, data: bytes) -> bool:
    """Replace a small local file in one step, surviving a crash; False if it already holds the bytes."""
    path = Path(path)
    if path.exists() and path.read_bytes() == data:
        return False
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}")
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    folder = os.open(path.parent, os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)
    return True


def pretty_json(path: str | Path, value: object) -> bool:
    """Indented JSON with NaN and infinities as errors."""
    return replace_file(path, (json.dumps(value, ensure_ascii=False, indent=2, allow_nan=False) + "\n").encode())


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """Small result as a Markdown table; more rows than the limit are an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"


def html(df: DataFrame, limit: int = 1000) -> str:
    """Small result as an HTML table."""
    from html import escape

    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{'' if c is None else escape(str(c))}</{tag}>" for c in row) + "</tr>"
    return "<table>" + cells("th", df.columns) + "".join(cells("td", r) for r in rows) + "</table>"


def with_lineage(parts: dict[str, DataFrame]) -> DataFrame:
    """All parts as one bag with a column of origin; columns that a part lacks are null."""
    out = None
    for origin, df in parts.items():
        one = df.withColumn("origin", F.lit(origin))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
