"""Ordered series cut into overlapping chunks that each fit in one task.

A smoother or spline looks at neighbours only as far as a known reach.  Rows
get their position in their series, positions are cut into chunks of ``width``
rows, and the rows within ``halo`` of a chunk's edge are copied to the chunk
beyond it.  Values computed from a chunk and its halo are right for its own
rows, so neither a long series nor a hot key meets in one task.

Chunks lie whole and in order in the partitions of the result, and stay so in a
checkpoint of it, so that rounds over the chunks need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import col

#: columns of a chunked table besides the caller's: chunk, position, first row of its chunk, not a copy
MARKS = ["_chunk", "_at", "_first", "_own"]


def overlapping(numbered: DataFrame, keys: list[str], at: Column, width: int, halo: int, columns: list[str]) -> DataFrame:
    """Keys, ``columns`` and ``MARKS`` of every row, and of its copies in the neighbouring chunks.

    ``at`` is the position in the row's series, from 0 without gaps.  The halo
    may not be wider than a chunk.
    """
    if halo > width:
        raise ValueError("a halo reaches no further than the next chunk")
    home = F.floor(at / width)
    inside = at - home * width
    none = F.array().cast("array<bigint>")
    targets = F.concat(
        F.array(home),
        F.when(inside >= width - halo, F.array(home + 1)).otherwise(none),
        F.when((inside < halo) & (home > 0), F.array(home - 1)).otherwise(none),
    )
    copied = numbered.select(*[col(c) for c in keys + columns], at.alias("_at"), home.alias("_home"), F.explode(targets).alias("_chunk"))
    own = F.col("_chunk") == F.col("_home")
    first = F.col("_at") == F.greatest(F.lit(0), F.col("_chunk") * width - halo)
    marked = copied.select(*[col(c) for c in keys + columns], "_chunk", "_at", first.alias("_first"), own.alias("_own"))
    place = [col(k) for k in keys] + [F.col("_chunk")]
    return marked.repartition(*place).sortWithinPartitions(*place, "_at")


def each_chunk(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """Put the batches' rows together chunk by chunk, as ``_first`` tells, and yield what ``work`` makes of each.

    A chunk that is only the copied edge of a chunk before it (a series that
    ends there) has no rows of its own and is left out.
    """
    held: list[pa.RecordBatch] = []

    def done():
        table = pa.Table.from_batches(held)
        if any(table.column("_own").to_numpy(zero_copy_only=False)):
            made = work(table)
            if made is not None:
                yield from made.combine_chunks().to_batches()

    for batch in batches:
        starts = np.flatnonzero(batch.column(batch.schema.get_field_index("_first")).to_numpy(zero_copy_only=False))
        begin = 0
        for start in starts:
            if start > begin:
                held.append(batch.slice(begin, start - begin))
            if held:
                yield from done()
                held = []
            begin = start
        if batch.num_rows > begin:
            held.append(batch.slice(begin))
    if held:
        yield from done()
