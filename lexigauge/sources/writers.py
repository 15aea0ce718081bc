"""Small result tables as CSV and JSON files: one row per model and group, written by the driver."""

from __future__ import annotations

import csv
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame


def rendered(value):
    """Infinite as the text inf, null as nothing."""
    if isinstance(value, float) and math.isinf(value):
        return "inf"
    return "" if value is None else value


def write_csv(df: DataFrame, path: str, order: list, columns: list[str] | None = None) -> list[dict]:
    """UTF-8 with a byte order mark, LF line ends, rows in the given order; returns the rows."""
    df = df.select(columns) if columns else df
    rows = [r.asDict() for r in df.orderBy(*order).collect()]
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        writer = csv.DictWriter(f, df.columns, lineterminator="\n")
        writer.writeheader()
        writer.writerows({k: rendered(v) for k, v in r.items()} for r in rows)
    return rows


def write_json(value: dict, path: str) -> None:
    Path(path).write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8", newline="\n")


def write_texts(texts: DataFrame, path: str) -> int:
    """One Markdown file per (sample_id, text), LF line ends, streamed through the driver; returns their count."""
    Path(path).mkdir(parents=True, exist_ok=True)
    n = 0
    for row in texts.select("sample_id", "text").toLocalIterator():
        (Path(path) / f"{row['sample_id']}.md").write_text((row["text"] or "").replace("\r\n", "\n").replace("\r", "\n"), encoding="utf-8", newline="\n")
        n += 1
    return n
