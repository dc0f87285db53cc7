"""Counter-based random numbers: the same for a key on any partitioning, and in plain SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int | float) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_sql(*keys: str) -> str:
    """The same in DuckDB's SQL; keys are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})), 1, 8))::BIGINT / 4294967296.0)"
