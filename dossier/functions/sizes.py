"""Size checks that stand before every broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.lineage import cut

# A side of at most this many narrow rows (some tens of bytes each) may be broadcast.
BROADCAST_ROWS = 500_000


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if `df` has at most `max_rows` rows; reads no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if(small: bool, df: DataFrame) -> DataFrame:
    """Broadcast hint for a side that passed its check; otherwise Spark chooses the join."""
    return F.broadcast(df) if small else df


def written_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A derived join side, written once, with a broadcast hint if its counted size allows it."""
    written = cut(df)
    return broadcast_if(is_small(written, max_rows), written)
