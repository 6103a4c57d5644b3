"""Two sides that are both too big to be sent to every task, compared tile by tile.

One side is cut into blocks, and each row of the other names the blocks it may have a partner in. A tile is one block with
a slice of the rows dealt to it: both come together by one shuffle, so no side passes the driver and no row is read
twice. A tile's size is set by the block and the slice and does not grow with either side.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 1 << 17  # rows in a tile, on average at most


def match_in_tiles(
    rows: DataFrame,
    blocks: DataFrame,
    total_rows: int,
    match: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """``match`` of every tile. ``rows`` (``row_no, block, ...``) holds a row once for each block it goes to, of which no block gets more
    than ``total_rows``; ``blocks`` (``block, ...``) holds each row of the other side once."""
    slices = max(1, -(-total_rows // tile_rows))
    dealt = rows.withColumn("slice", F.pmod(F.xxhash64("row_no"), F.lit(slices)).cast("int"))
    copies = blocks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    tile = ("block", "slice")
    return dealt.groupBy(*tile).cogroup(copies.groupBy(*tile)).applyInArrow(match, schema)
