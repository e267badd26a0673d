"""Integer vectors in Arrow batches, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_vector(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null if the vector is null or holds null or non-finite components.

    Null as well where a sum of squared differences might not fit a long, that is
    from an absolute component of sqrt(2^61 / length) on.
    """
    scaled = F.transform(vector, lambda x: x.cast("double") * scale)
    most = F.sqrt(F.lit(float(1 << 61)) / F.greatest(F.size(vector), F.lit(1)))
    good = F.forall(scaled, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < most - 1), F.lit(False)))
    return F.when(vector.isNotNull() & good, F.transform(scaled, lambda x: F.floor(x)))


def matrices(lists: pa.Array):
    """(length, rows, matrix) for each vector length of a batch's list column."""
    starts = lists.offsets.to_numpy()[:len(lists)].astype(np.int64)
    sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield dim, rows, values[starts[rows][:, None] + np.arange(dim)]


def exact_in_doubles(most: float, dim: int) -> bool:
    """Whether products and squared differences of components up to ``most``, summed over ``dim``, are exact."""
    return 4.0 * float(most) * float(most) * max(dim, 1) < float(1 << 52)


class Gathered:
    """Rows of equal vector length, gathered over batches and given out in blocks of a stated size."""

    def __init__(self, size: int):
        self.size, self.parts, self.rows = size, {}, {}

    def add(self, batch: pa.RecordBatch, vectors_at: int):
        """Full blocks: (length, other columns of the rows by position, matrix)."""
        for dim, rows, matrix in matrices(batch.column(vectors_at)):
            others = [None if i == vectors_at else batch.column(i).take(pa.array(rows)) for i in range(batch.num_columns)]
            self.parts.setdefault(dim, []).append((others, matrix))
            self.rows[dim] = self.rows.get(dim, 0) + len(rows)
            if self.rows[dim] >= self.size:
                yield from self.close(dim)

    def close(self, dim: int):
        parts = self.parts.pop(dim)
        self.rows.pop(dim)
        matrix = np.concatenate([m for _, m in parts])
        others = [None if c[0] is None else pa.concat_arrays(list(c)) for c in zip(*(o for o, _ in parts), strict=True)]
        for at in range(0, len(matrix), self.size):
            yield dim, [None if c is None else c.slice(at, self.size) for c in others], matrix[at:at + self.size]

    def rest(self):
        for dim in list(self.parts):
            yield from self.close(dim)
