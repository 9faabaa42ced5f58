"""Names for columns that a user's table may not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(*tables: DataFrame | list[str], wanted: list[str]) -> list[str]:
    """Each wanted name with as many leading underscores as no column of the tables has (letters count in either case)."""
    taken = {c.lower() for t in tables for c in (t.columns if isinstance(t, DataFrame) else t)}
    return [next(name for k in range(len(taken) + 1) if (name := f"{'_' * (k + 2)}{w}") and name.lower() not in taken) for w in wanted]
