"""All-pairs work inside groups of any size, in tasks of bounded size.

A group of up to ``block`` members is one unit of work.  A larger one is cut
by a hash of the member into k blocks; unit (i, j) with i <= j holds blocks i
and j, so each pair of members meets in exactly one unit and no unit holds
more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(rows: DataFrame, key: str, member: str, size: str, block: int, weight: str | None = None, most: int = 0) -> DataFrame:
    """Add ``bi``, ``bj`` (the unit) and ``own`` (the member's block) and gather the units.

    ``size`` names the column with the number of the group's members.  With
    ``weight``, the column of what all members weigh, blocks are also cut to
    about ``most`` of it, down to single members.
    """
    need = F.ceil(F.col(size) / block)
    if weight is not None:
        need = F.greatest(need, F.least(F.col(size), F.ceil(F.col(weight) / most)))
    own = F.pmod(F.xxhash64(F.col(member), F.lit(77)), F.col("_k")).cast("int")
    out = rows.withColumn("_k", need.cast("long")).withColumn("own", own)
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), (F.col("_k") - 1).cast("int"))))
    out = out.withColumn("bi", F.least("own", "_o")).withColumn("bj", F.greatest("own", "_o")).drop("_k", "_o")
    return out.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs of equal keys, and the bounds of the runs.

    The input is sorted by ``keys`` (integers without nulls); a run that is
    still open at the end of a batch is held back.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for name in keys:
            v = table.column(name).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        bounds = np.flatnonzero(change)
        cut = int(bounds[-1])
        if cut:
            yield table.slice(0, cut), bounds
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


class Forest:
    """Union-find over the rows of one unit of work."""

    def __init__(self, n: int) -> None:
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        """True if x and y were apart."""
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y
