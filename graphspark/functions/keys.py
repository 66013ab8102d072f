"""Deterministic orders and draws from hashed keys.

Sampling is by rank of a hash of (seed, batch, layer, node, neighbour): the
same on any partitioning, on any number of executors and after a retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, *parts: Column | str | int) -> Column:
    """Hex digest of the seed and the parts, joined by ``|``."""
    columns = [F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def draw(key: Column, size: Column) -> Column:
    """A number in 0..size-1 from the first 32 bits of a hex digest."""
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), size)
