"""Tables as cells, and whole rows as one key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, under its own name."""
    return df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in df.columns])


def cells(df: DataFrame, positions: list[int] | None = None, start: int = 0) -> DataFrame:
    """One row ``(position, cell)`` per column of each row, positions counted from ``start``. Columns left out are not read."""
    chosen = range(len(df.columns)) if positions is None else positions
    text = df.select(*[F.col(quoted(df.columns[i])).cast("string").alias(str(start + i)) for i in chosen])
    return text.unpivot([], [quoted(str(start + i)) for i in chosen], "position", "cell")


def tagged_text(columns: list[Column]) -> Column:
    """A row as one text. Each cell carries its length, so no two rows can be confused by moving characters between
    cells, and NULL differs from an empty cell."""
    parts = []
    for column in columns:
        text = column.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.concat(*parts) if parts else F.lit("")


def row_key(columns: list[Column]) -> Column:
    """A 128-bit key of a whole row, cells as they are."""
    return F.unhex(F.md5(tagged_text(columns)))
