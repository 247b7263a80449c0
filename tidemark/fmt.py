"""Results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def table_text(rows: list[dict]) -> str:
    """Columns in alphabetical order, a row number in front, the number of rows at the end."""
    columns = sorted({c for r in rows for c in r})
    cells = [["", *columns], *[[str(i), *["" if r.get(c) is None else str(r[c]) for c in columns]] for i, r in enumerate(rows)]]
    width = [max(len(line[k]) for line in cells) for k in range(len(columns) + 1)]
    lines = [" ".join(c.ljust(w) for c, w in zip(line, width, strict=True)).rstrip() for line in cells]
    return "\n".join([*lines, f"({len(rows)} rows)"]) + "\n"


def result_text(df: DataFrame, limit: int = 1000) -> str:
    """At most ``limit`` rows of a result, for people to read."""
    if df.columns == ["op", "unit", "count"]:
        return "".join(f"{r['op']} {r['count']} {r['unit']}\n" for r in df.take(1))
    return table_text([r.asDict() for r in df.take(limit)])
