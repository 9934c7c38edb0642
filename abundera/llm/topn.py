"""Top N items within every group by statistics-guided skipping.

The table is clustered once: range-partitioned and sorted by group and falling
score, written with small row groups whose footers carry the minimum and
maximum of group and score.  A group too large for one file continues in the
next, because the score is part of the range key.  The layout can be kept and
read again for any N.  Each file is read in falling order of its row groups'
maximum scores; a row group is skipped when that maximum lies strictly below
the current N-th score of every group it contains.  In this order of rows a
small group stands whole in one row group, which therefore holds groups not met
before and is read; what is skipped are the row groups inside large groups,
where one group is the only one.  The files' tops (at most N rows a group and
row group) are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.session import scratch_path

#: Bytes of a row group: small enough that a hot group spans many of them.
ROW_GROUP_BYTES = 256 * 1024
#: 96-bit key of a group, far narrower to sort than the values it stands for.
G = ["ga", "gb"]
_COLS = [*G, "item", "score", "id"]
_TYPES = "ga bigint, gb int, item string, score double, id bigint"


def group_key(group: list[str]) -> list:
    """The key columns of a row's group; null is a value of its own."""
    cols = [c for g in group for c in (F.col(g).isNull(), F.col(g))]
    return [F.xxhash64(*cols).alias("ga"), F.hash(*cols).alias("gb")]


def cluster(df: DataFrame, group: list[str], item: str, score: str, row_id: str) -> str:
    """Write ``(ga, gb, item, score, id)`` clustered by group and falling score; returns the folder."""
    path = scratch_path(df.sparkSession, "clustered")
    rows = df.select(*group_key(group), F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score"), F.col(row_id).cast("bigint").alias("id"))
    rows = rows.where(F.col("item").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score") & F.col("id").isNotNull())
    order = [*G, F.col("score").desc(), F.col("id")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", ROW_GROUP_BYTES // 4).option("parquet.block.size.row.check.min", 100).parquet(path)
    return path


def tops_of(table: pa.Table, n: int) -> pa.Table:
    """Of rows sorted by group, falling score and id: each group's N best items, each by its first row."""
    if not table.num_rows:
        return table
    ga, gb, score = (table.column(c).to_numpy() for c in ("ga", "gb", "score"))
    code = np.concatenate([[0], np.cumsum((ga[1:] != ga[:-1]) | (gb[1:] != gb[:-1]))])
    items = table.column("item").combine_chunks().dictionary_encode()
    names = np.array(items.dictionary.to_pylist(), dtype=object)
    place = np.empty(len(names), dtype=np.int64)
    place[np.argsort(names, kind="stable")] = np.arange(len(names))  # order of the items as texts
    rank = place[items.indices.to_numpy()]
    _, first = np.unique(code * len(names) + rank, return_index=True)
    best = first[np.lexsort((rank[first], -score[first], code[first]))]
    g = code[best]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    nth = np.arange(len(g)) - np.repeat(start, np.diff(np.append(start, len(g))))
    return table.take(pa.array(best[nth < n]))


class Floors:
    """Current N-th score of the groups that may go on in other row groups."""

    def __init__(self, n: int) -> None:
        self.n, self.best = n, {}

    def add(self, tops: pa.Table) -> None:
        if not tops.num_rows:
            return
        keys = list(zip(tops.column("ga").to_pylist(), tops.column("gb").to_pylist()))
        items, scores = tops.column("item").to_pylist(), tops.column("score").to_pylist()
        for edge in {keys[0], keys[-1]}:  # a group inside stands whole in its row group
            held = self.best.setdefault(edge, {})
            for k, item, score in zip(keys, items, scores):
                if k == edge and score > held.get(item, float("-inf")):
                    held[item] = score
            if len(held) > self.n:
                self.best[edge] = dict(sorted(held.items(), key=lambda kv: -kv[1])[: self.n])

    def of(self, group: tuple[int, int]) -> float:
        held = self.best.get(group, {})
        return min(held.values()) if len(held) == self.n else float("-inf")


def read_file_tops(path: str, n: int) -> tuple[list[pa.Table], int, int]:
    """Tops of the row groups of one clustered file, with the numbers of those read and skipped."""
    where, name = fs.FileSystem.from_uri(path)
    tops, floors, read, skipped = [], Floors(n), 0, 0
    with where.open_input_file(name) as source:
        file = pq.ParquetFile(source)
        meta = file.metadata
        index = {meta.schema.column(i).name: i for i in range(meta.num_columns)}
        order = []
        for r in range(meta.num_row_groups):
            stats = [meta.row_group(r).column(index[c]).statistics for c in (*G, "score")]
            known = all(s is not None and s.has_min_max for s in stats)
            # a span of one group holds only that group; a wider one holds groups not met before
            sole = (stats[0].min, stats[1].min) if known and all(s.min == s.max for s in stats[:2]) else None
            order.append((-stats[2].max if known else float("-inf"), r, sole))
        for top, r, sole in sorted(order, key=lambda o: o[:2]):
            if sole is not None and -top < floors.of(sole):
                skipped += 1
                continue
            read += 1
            found = tops_of(file.read_row_group(r, columns=_COLS).select(_COLS), n)
            floors.add(found)
            tops.append(found)
    return tops, read, skipped


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length")
    return files.select("path").repartition(max(1, min(10_000, files.count())))


def top_of_layout(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """``(ga, gb, item, score, id, place)`` from a kept layout of ``cluster``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for table in read_file_tops(path, n)[0]:
                    yield from table.to_batches(max_chunksize=20_000)

    tops = _files(spark, folder).mapInArrow(scan, _TYPES)
    best = tops.groupBy(*G, "item").agg(F.max("score").alias("score"), F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("id"))
    return best.withColumn("place", F.row_number().over(W.partitionBy(*G).orderBy(F.col("score").desc(), "item"))).where(F.col("place") <= n)


def skipping(spark: SparkSession, folder: str, n: int) -> DataFrame:
    """``(path, row_groups_read, row_groups_skipped)`` of each file of a kept layout."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                _, read, skipped = read_file_tops(path, n)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([read], pa.int64()), pa.array([skipped], pa.int64())], names=["path", "row_groups_read", "row_groups_skipped"])

    return _files(spark, folder).mapInArrow(scan, "path string, row_groups_read bigint, row_groups_skipped bigint")


def top_items(df: DataFrame, group: list[str], item: str, score: str, row_id: str, n: int) -> DataFrame:
    """``(ga, gb, item, score, id, place)``: of each group the N best items, each by its best row.

    An item's best row is that of highest score, then smallest id; items are
    ordered by score falling, then item.  ``ga`` and ``gb`` are the group's key
    (``group_key``); a null group column makes a group of its own.  Rows whose
    item, score or id is null or whose score is NaN are left out.  Repeated rows
    count once, an empty table gives no row.
    """
    return top_of_layout(df.sparkSession, cluster(df, group, item, score, row_id), n)
