"""Joins whose broadcast is decided by the size of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeline.plans.lineage import cut

#: Bytes up to which a side is broadcast, a string with its length and other values with 16 bytes each, an array with those of its items.
SMALL_BYTES = 16 << 20


def small(df: DataFrame, most: int = SMALL_BYTES) -> DataFrame:
    """df, written once, with a broadcast hint if it takes at most `most` bytes; otherwise for a shuffled join."""
    kept = cut(df)
    least = lambda c: F.coalesce(c, F.lit(0))
    row = F.lit(16 * len(df.columns))
    for c, kind in df.dtypes:
        if kind in ("string", "binary"):
            row += least(F.octet_length(F.col(c)))
        elif kind.startswith("array"):
            row += 16 * F.greatest(F.size(c), F.lit(0)) + (least(F.octet_length(F.array_join(c, ""))) if kind == "array<string>" else 0)
    size = kept.agg(F.sum(row.cast("long"))).first()[0] or 0
    return F.broadcast(kept) if size <= most else kept
