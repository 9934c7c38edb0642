"""Rank, share and ordinal helpers, and the cumulative windows of multiple testing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.session import materialize


def global_ordinals(df: DataFrame, col: str, name: str) -> DataFrame:
    """``(col, name)``: the place of each distinct value in sorted order, from 0, without one task that holds them all.

    The values are range-partitioned and written once; the places within a
    partition are moved by the sizes of those before it (one number a partition).
    """
    parts = materialize(df.select(col).distinct().repartitionByRange(col).withColumn("_p", F.spark_partition_id()), "ordinals")
    sizes = sorted((r["_p"], r["n"]) for r in parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())
    moved, at = [], 0
    for p, n in sizes:
        moved.append((p, at))
        at += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(moved, "_p int, _o bigint"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(col)) - 1
    return parts.withColumn("_i", place).join(offsets, "_p").select(col, (F.col("_i") + F.col("_o")).alias(name))


def run_ordinals(ions: DataFrame) -> DataFrame:
    """``(sample, run, ordinal)``: place of each run among its sample's runs, over the distinct pairs only."""
    pairs = ions.select("sample", "run").distinct()
    return pairs.withColumn("ordinal", F.row_number().over(W.partitionBy("sample").orderBy("run")).cast("bigint"))


def tech_replicates(ions: DataFrame) -> DataFrame:
    """``(sample, run, techrep)``: the number at the end of the run where every run of the sample has one, else the ordinal."""
    from abundera.functions.keys import tech_replicate

    named = run_ordinals(ions).withColumn("_n", tech_replicate("run"))
    by_name = named.groupBy("sample").agg(F.bool_and(F.col("_n").isNotNull()).alias("_all"))
    return named.join(by_name, "sample").select("sample", "run", F.when(F.col("_all"), F.col("_n")).otherwise(F.col("ordinal").cast("int")).alias("techrep"))


def share_of_group(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Each value's share of its group's total, by aggregate and join so that a large group is spread."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return df.join(totals, list(by)).withColumn(name, F.try_divide(F.col(value), F.col("_total"))).drop("_total")


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Rank within the group, ties sharing their mean rank; over distinct values, so repeated values cost one row."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranks = counts.withColumn(name, F.coalesce(before, F.lit(0)) + (F.col("_n") + 1) / 2.0).drop("_n")
    return join_null_safe(df, ranks, [*by, value])


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet null keys; the keys stand once in the result."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(other[f"_r_{k}"]) for k in keys]
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def factorize(df: DataFrame, col: str, order: str) -> DataFrame:
    """``(value, code)``: codes from 0 in order of first appearance, over the distinct values."""
    first = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.min(order).alias("_first"))
    return first.select(col, (F.row_number().over(W.orderBy("_first")) - 1).cast("bigint").alias("code"))


def benjamini_hochberg(df: DataFrame, p: str = "pvalue", name: str = "adj_pvalue", by: Sequence[str] = ("contrast",)) -> DataFrame:
    """Adjusted p-values per contrast: reverse cumulative minimum of p * m / rank over the distinct p-values; null p stays null."""
    have = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    up = W.partitionBy(*by).orderBy(p)
    ranked = have.withColumn("_r", F.sum("_n").over(up.rowsBetween(W.unboundedPreceding, W.currentRow))).withColumn("_m", F.sum("_n").over(W.partitionBy(*by)))
    down = W.partitionBy(*by).orderBy(F.col(p).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    adjusted = ranked.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_r")).over(down))).select(*by, p, name)
    return df.join(adjusted, [*by, p], "left")
