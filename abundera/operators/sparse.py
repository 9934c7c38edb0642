"""The measured cells of a sparse matrix as plain arrays, for methods that need all of it at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundera.session import collect_bounded, materialize

#: Names of columns that come to the driver.
MAX_COLUMNS = 100_000


@dataclass
class Cells:
    """Measured cells by row, then column; rows and columns by name."""

    names: list[str]
    columns: list[tuple]
    row: np.ndarray
    col: np.ndarray
    y: np.ndarray

    def rows(self, keep: np.ndarray) -> Cells:
        """The rows in ``keep`` only; columns stay."""
        own = keep[self.row]
        return Cells([n for n, k in zip(self.names, keep) if k], self.columns, (np.cumsum(keep) - 1)[self.row[own]].astype(np.int32), self.col[own], self.y[own])


def measured_cells(long: DataFrame, limit: int, entity: str = "protein", keys: tuple[str, ...] = ("sample",)) -> Cells:
    """``(entity, *keys, y)`` as arrays, 16 bytes a cell, after a check of their number."""
    rows = materialize(long.dropna(subset=[entity, *keys, "y"]).select(entity, *keys, "y"), "measured")
    n = rows.count()
    if n > limit:
        raise ValueError(f"the matrix has {n} measured values, more than {limit}")
    columns = sorted(tuple(r) for r in collect_bounded(rows.select(*keys).distinct(), MAX_COLUMNS, "samples"))
    if not n:
        return Cells([], [], np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))
    codes = long.sparkSession.createDataFrame([(*c, i) for i, c in enumerate(columns)], ", ".join(f"{k} string" for k in keys) + ", _c int")
    lists = rows.join(F.broadcast(codes), list(keys)).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_c", "y"))).alias("l"))
    table = lists.select(entity, F.col("l._c").alias("c"), F.col("l.y").alias("y")).toArrow()
    names = table.column(0).to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = table.take(pa.array(order, pa.int64())).combine_chunks()
    c, y = table.column(1).chunk(0), table.column(2).chunk(0)
    row = np.repeat(np.arange(len(order), dtype=np.int32), pc.list_value_length(c).to_numpy())
    return Cells([names[i] for i in order], columns, row, c.flatten().to_numpy().astype(np.int32), y.flatten().to_numpy())
