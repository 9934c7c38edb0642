"""Per-key results when a handful of keys hold most rows.

Heavy keys are found by a mergeable frequent-items sketch (at most
``1 / min_share`` keys can reach the share, which bounds everything that is
broadcast), their rows are taken out by a broadcast join and aggregated spread
over their items; all other rows go through the ordinary shuffle; the two
results are united.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the frequent-items sketch: its count error stays below 0.1 % of the rows.
SKETCH_ITEMS = 8192


def heavy_keys(df: DataFrame, key: str, min_share: float = 0.01) -> DataFrame:
    """Candidates for keys with at least ``min_share`` of all rows.

    Returns ``(key, sketch_rows, total_rows)``, at most ``2 / min_share`` rows
    and never a null key; every key that reaches the share is in it (the sketch
    errs by far less than half the share), some below it may be.  An empty
    table gives no row.
    """
    if not 0.001 <= min_share <= 1:
        raise ValueError("min_share must lie between 0.001 and 1")
    k = math.ceil(2 / min_share)
    sketched = df.agg(
        F.expr(f"approx_top_k(`{key}`, {k}, {max(SKETCH_ITEMS, k)})").alias("items"), F.count(F.lit(1)).alias("total_rows")
    )
    return (
        sketched.select(F.explode("items").alias("i"), "total_rows")
        .select(F.col("i.item").alias(key), F.col("i.count").alias("sketch_rows"), "total_rows")
        .where(F.col(key).isNotNull() & (F.col("sketch_rows") >= 0.5 * min_share * F.col("total_rows")))
    )


def spread_over_keys(df: DataFrame, key: str, item: str, value: str, min_share: float = 0.01) -> DataFrame:
    """Rows, summed value and distinct items of every key, without long tasks for heavy keys.

    Returns ``(key, n_rows, sum_value, n_items, is_heavy, total_rows)``, one row
    per key; rows without a key form the group null, which is never heavy.
    ``value`` null adds nothing, a key without values has the sum null; null
    items are not counted.  ``is_heavy`` holds the exact test on ``min_share``;
    ``total_rows`` is null for keys that were no candidates.
    """
    rows = df.select(F.col(key).alias("_key"), F.col(item).alias("_item"), F.col(value).cast("double").alias("_value"))
    heavy = F.broadcast(heavy_keys(rows, "_key", min_share).select("_key", "total_rows"))
    of_heavy = (
        rows.join(heavy, "_key")
        .groupBy("_key", "_item")  # the items spread a heavy key over all tasks
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_value").alias("s"), F.first("total_rows").alias("total_rows"))
        .groupBy("_key")  # combined before this shuffle: one row a task and key
        .agg(F.sum("n").alias("n_rows"), F.sum("s").alias("sum_value"), F.count("_item").alias("n_items"), F.first("total_rows").alias("total_rows"))
        .withColumn("is_heavy", F.col("n_rows") >= F.lit(min_share) * F.col("total_rows"))
    )
    of_rest = (
        rows.join(heavy, "_key", "left_anti")
        .groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("_value").alias("sum_value"), F.count_distinct("_item").alias("n_items"))
        .withColumns({"total_rows": F.lit(None).cast("bigint"), "is_heavy": F.lit(False)})
    )
    return of_heavy.unionByName(of_rest).select(F.col("_key").alias(key), "n_rows", "sum_value", "n_items", "is_heavy", "total_rows")


def salted(df: DataFrame, key: str, spread: Column, share: float = 0.001, name: str = "_salt") -> DataFrame:
    """``df`` with a salt column, so that no (key, salt) holds much more than ``share`` of all rows.

    A key gets as many salts as its rows are multiples of that share, ordinary
    keys the salt 0.  ``spread`` decides which salt a row gets and must be
    reproducible (a hash of stable columns), so that a recomputed task finds the
    same salts.
    """
    salts = F.ceil(F.col("sketch_rows") / (share * F.col("total_rows"))).cast("int").alias("_salts")
    heavy = F.broadcast(heavy_keys(df.select(key), key, share).select(key, salts))
    tagged = df.join(heavy, key, "left")
    return tagged.withColumn(name, F.coalesce(F.pmod(spread, F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")


def hot_hashes(df: DataFrame, keys: dict[str, Column], share: float = 0.005) -> dict[str, list[int]]:
    """For each named key, the 64-bit hashes held by at least about ``share`` of the rows; one pass, at most ``2 / share`` each.

    A hash only routes rows, so two keys of one hash do no harm.
    """
    k = math.ceil(2 / share)
    aggs = [F.expr(f"approx_top_k(`_h_{n}`, {k}, {max(SKETCH_ITEMS, k)})").alias(n) for n in keys]
    found = df.select(*[F.xxhash64(c).alias(f"_h_{n}") for n, c in keys.items()]).agg(*aggs, F.count(F.lit(1)).alias("_n")).first()
    return {n: sorted(i["item"] for i in found[n] or () if i["count"] >= 0.5 * share * found["_n"]) for n in keys}


def join_hot(rows: DataFrame, keyed: DataFrame, keys: list[str], by: Column, hot: list[int], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``keyed``, which has one row a key, without gathering a hot key's rows in one task.

    ``hot`` are the hashes of ``by`` (a column of both sides) from
    ``hot_hashes``; their few rows of ``keyed`` are broadcast, all other keys
    meet by an ordinary shuffle.
    """
    if not hot:
        return rows.join(keyed, keys, how)
    is_hot = F.xxhash64(by).isin(*hot)
    return rows.where(is_hot).join(F.broadcast(keyed.where(is_hot)), keys, how).unionByName(rows.where(~is_hot).join(keyed.where(~is_hot), keys, how))
