"""Names for columns that an operator adds to an input it doesn't know."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, stem: str) -> str:
    """A prefix that begins no column of ``df``, whatever its case: ``stem`` with as many underscores as that takes."""
    taken = [c.lower() for c in df.columns]
    prefix = f"__{stem}_"
    while any(c.startswith(prefix) for c in taken):
        prefix = "_" + prefix
    return prefix
