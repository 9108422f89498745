"""All pairs of packed rows without sending a row once a partner: rows are dealt to square tiles of blocks.

With ``side`` blocks a tile, a row is sent to as many tiles as there are tiles a side, not to as many blocks. A tile is one
group of at most two sides of rows, whose bytes are bounded when ``side`` is chosen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE_BYTES = 64 << 20
ZERO = 48  # the byte of state 0 in a packed row


def packed(states: Column) -> Column:
    """An array of states as bytes, a byte a state."""
    return F.array_join(F.transform(states, lambda x: F.chr(x.cast("int") + ZERO)), "").cast("binary")


def tile_side(n_blocks: int, block_bytes: int, parallelism: int, spread: bool = True) -> int:
    """Blocks a side: as many as fit ``TILE_BYTES`` in two sides, but with ``spread`` few enough that every core gets tiles."""
    fits = max(1, TILE_BYTES // max(1, 2 * block_bytes))
    most = max(1, int(n_blocks / max(1.0, (4 * parallelism) ** 0.5))) if spread else n_blocks
    return max(1, min(fits, most))


def deal(rows: DataFrame, n_blocks: int, side: int) -> DataFrame:
    """``rows`` (with ``blk``) with the tile ``ti <= tj`` and ``at``: 0 on the tile's left, 1 on its right side. Rows of a
    tile on the diagonal come once, as left ones."""
    last = max(0, n_blocks - 1) // side
    own = F.floor(F.col("blk") / side).cast("int")
    left = rows.withColumn("ti", own).withColumn("tj", F.explode(F.sequence("ti", F.lit(last)))).withColumn("at", F.lit(0))
    right = rows.withColumn("tj", own).withColumn("ti", F.explode(F.sequence(F.lit(0), F.col("tj")))).where("ti < tj").withColumn("at", F.lit(1))
    return left.unionByName(right)


def numbered_parts(rows: DataFrame, n: int, number: str) -> DataFrame:
    """Partitions in order of ``number``, 0 to ``n - 1``. Known numbers need no sample of the rows, which would make them twice; before
    Spark 4.1 one is taken."""
    return rows.repartitionById(n, F.col(number)) if hasattr(rows, "repartitionById") else rows.repartitionByRange(n, number)
