"""Roll-ups from ions to peptides to proteins, ratios, counts, and plain aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions.values import is_measured, log2_positive

CELL = ("protein", "sample")
PEPTIDE = ("protein", "peptide", "sample", "biorep", "condition")
ION = ("protein", "peptide", "peptidoform", "charge", "sample", "condition", "biorep")


def best_ions(ions: DataFrame, key: Sequence[str] = ION) -> DataFrame:
    """One row per ion and context, that of highest intensity (ties: smallest run, then row order columns do not matter)."""
    rest = [c for c in ions.columns if c not in key]
    rank = F.struct((-F.col("intensity")).alias("i"), F.col("run").alias("r"))
    best = ions.groupBy(*key).agg(F.min_by(F.struct(*rest), rank).alias("_best"))
    return best.select(*key, "_best.*")


def peptides_from_ions(ions: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Two-level roll-up: the maximum per ion and context, then the sum per peptide (``extra`` keys for run or species level)."""
    ion_key = [c for c in dict.fromkeys([*ION, *extra])]
    top = ions.groupBy(*ion_key).agg(F.max("intensity").alias("intensity"))
    return top.groupBy(*dict.fromkeys([*PEPTIDE, *extra])).agg(F.sum("intensity").alias("intensity"))


def peptide_species(ions: DataFrame) -> DataFrame:
    """The variant that keeps peptidoform and charge apart, as a ratio-based roll-up needs."""
    return peptides_from_ions(ions, ("peptidoform", "charge"))


def sum_of_peptides(peptides: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    return peptides.groupBy(*by).agg(F.sum("intensity").alias("value"))


def median_of_peptides(peptides: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    return peptides.groupBy(*by).agg(F.median("intensity").alias("value"))


def mean_of_peptides(peptides: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    return peptides.groupBy(*by).agg(F.avg("intensity").alias("value"))


def top_n_mean(peptides: DataFrame, n: int = 3, by: Sequence[str] = CELL) -> DataFrame:
    """Mean of the ``n`` largest (fewer where fewer exist); ``row_number <= n`` is pushed below the shuffle as a group limit."""
    order = W.partitionBy(*by).orderBy(F.col("intensity").desc(), "peptide")
    top = peptides.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n)
    return top.groupBy(*by).agg(F.avg("intensity").alias("value"))


def log2_abundance(peptides: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Median log2 intensity; values not above 0 are missing."""
    return peptides.groupBy(*by).agg(F.median(log2_positive("intensity")).alias("value"))


def peptide_count(peptides: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    """Peptide rows per cell: one per peptide, biological replicate and condition."""
    return peptides.groupBy(*by).agg(F.count(F.lit(1)).alias("value"))


def peptide_count_distinct(peptides: DataFrame, by: Sequence[str] = CELL) -> DataFrame:
    return peptides.groupBy(*by).agg(F.count_distinct("peptide").alias("value"))


def spectral_count(psms: DataFrame, groups: DataFrame, by: Sequence[str] = ("protein",), min_unique: int = 0) -> DataFrame:
    """Distinct PSMs per protein group: PSMs joined to their feature's group, decoys removed.

    ``groups`` is ``(feature_id, protein, ...)``; a null decoy flag counts as no
    decoy.  With ``min_unique`` only groups with so many distinct sequences stay.
    """
    rows = psms.where(~F.coalesce("is_decoy", F.lit(False)) & F.col("feature_id").isNotNull()).join(groups.where("protein IS NOT NULL"), "feature_id")
    return rows.groupBy(*by).agg(F.count_distinct("psm_id").alias("value"), F.count_distinct("sequence").alias("_seqs")).where(F.col("_seqs") >= min_unique).drop("_seqs")


def repeated_ids(psms: DataFrame) -> DataFrame:
    """PSM ids that stand in more than one row: an error in the source."""
    return psms.groupBy("psm_id").count().where("count > 1")


def merge_fractions(ions: DataFrame, key: Sequence[str], how: str = "max") -> DataFrame:
    """One intensity over the fractions: the maximum or the mean."""
    agg = {"max": F.max, "mean": F.avg}[how]
    return ions.groupBy(*key).agg(agg("intensity").alias("intensity"))


def ratio_to_reference(ions: DataFrame, fraction: str = "max") -> DataFrame:
    """Log2 ratios to the plex reference, median per peptide, then per protein; reference samples dropped.

    ``ions`` has ``protein, peptide, charge, plex, sample, is_reference,
    intensity``.  Rows without a reference value in their plex are dropped.
    """
    merged = merge_fractions(ions.where(is_measured("intensity")), ["protein", "peptide", "charge", "plex", "sample", "is_reference"], fraction)
    ref = merged.where("is_reference").groupBy("protein", "peptide", "charge", "plex").agg(F.avg("intensity").alias("_ref"))
    q = F.col("intensity") / F.col("_ref")
    log_ratio = F.when(is_measured(q), F.log2(q)).otherwise(F.log2("intensity") - F.log2("_ref"))  # a quotient can leave the range of doubles
    ratios = merged.where("NOT is_reference").join(ref, ["protein", "peptide", "charge", "plex"]).withColumn("_r", log_ratio)
    return ratios.groupBy("protein", "peptide", "sample").agg(F.median("_r").alias("_r")).groupBy("protein", "sample").agg(F.median("_r").alias("value"))


def deqms_counts(peptides: DataFrame) -> DataFrame:
    """Per protein the smallest number of distinct peptides over its samples."""
    return peptide_count_distinct(peptides).groupBy("protein").agg(F.min("value").alias("count"))


def summary_stats(long: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """count, mean, sd, min, quartiles, max of a column per group."""
    q = lambda p: F.percentile(col, p)
    return long.groupBy(*by).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"),
        q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(col).alias("max"),
    )


def cube_counts(df: DataFrame, dims: Sequence[str], col: str) -> DataFrame:
    """Grouping sets over all subsets of the dimensions."""
    ids = [F.grouping(d).cast("int").alias(f"g_{d}") for d in dims]
    return df.cube(*dims).agg(*ids, F.count(F.lit(1)).alias("n"), F.sum(col).alias("total"))


def rollup_counts(df: DataFrame, dims: Sequence[str], col: str) -> DataFrame:
    ids = [F.grouping(d).cast("int").alias(f"g_{d}") for d in dims]
    return df.rollup(*dims).agg(*ids, F.count(F.lit(1)).alias("n"), F.sum(col).alias("total"))


def max_by_key(df: DataFrame, by: Sequence[str], value: str, order: Column) -> DataFrame:
    """Of each group the value of the row that comes first in ``order``."""
    return df.groupBy(*by).agg(F.min_by(value, order).alias(value))
