"""Multiple testing: step-up adjustments, the share of true nulls, q-values, hypothesis weighting, effect-size gates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions.special import two_gaussians
from abundera.operators.windows import benjamini_hochberg

LAMBDAS = tuple(round(0.05 * i, 2) for i in range(1, 20))


def lambda_counts(df: DataFrame, p: str = "pvalue") -> DataFrame:
    """One row: tests, and tests with p at or above each grid point; the only thing a driver-side fit needs."""
    ge = [F.count(F.when(F.col(p) >= x, 1)).alias(f"ge_{i}") for i, x in enumerate(LAMBDAS)]
    return df.where(F.col(p).isNotNull()).agg(F.count(F.lit(1)).alias("n"), *ge, F.count(F.when(F.col(p) < 0.05, 1)).alias("low"), F.count(F.when(F.col(p) >= 0.5, 1)).alias("high"))


def pi0_curve(counts: Sequence[int], n: int) -> np.ndarray:
    return np.array([c / n / (1 - x) for c, x in zip(counts, LAMBDAS)]) if n else np.ones(len(LAMBDAS))


def pi0_smooth(curve: np.ndarray) -> float:
    """Cubic through the grid by least squares, read at the largest lambda; never below the curve's minimum, within (0, 1]."""
    x = np.array(LAMBDAS)
    fit = np.polynomial.Polynomial.fit(x, curve, 3)(x[-1])
    return float(min(1.0, max(fit, curve.min(), 1e-8)))


def pi0_bootstrap(counts: Sequence[int], n: int) -> float:
    """Grid point of least mean squared error against the curve's 10 % quantile, by the binomial variance."""
    curve = pi0_curve(counts, n)
    floor = np.quantile(curve, 0.1)
    x = np.array(LAMBDAS)
    mse = np.array(counts) / (n**2 * (1 - x) ** 2) * (1 - np.array(counts) / n) + (curve - floor) ** 2
    return float(min(1.0, max(curve[mse.argmin()], 1e-8)))


def estimate_pi0(df: DataFrame, p: str = "pvalue", method: str = "smoother") -> float:
    r = lambda_counts(df, p).first()
    counts = [r[f"ge_{i}"] for i in range(len(LAMBDAS))]
    if not r["n"]:
        return 1.0
    return pi0_bootstrap(counts, r["n"]) if method == "bootstrap" else pi0_smooth(pi0_curve(counts, r["n"]))


def qvalues(df: DataFrame, p: str = "pvalue", pi0: float | None = None, by: Sequence[str] = ("contrast",), name: str = "qvalue") -> DataFrame:
    """pi0 times the step-up adjustment, at most 1."""
    share = estimate_pi0(df, p) if pi0 is None else pi0
    return benjamini_hochberg(df, p, "_bh", by).withColumn(name, F.least(F.lit(1.0), F.col("_bh") * share)).drop("_bh")


def two_stage(df: DataFrame, alpha: float = 0.05, p: str = "pvalue", by: Sequence[str] = ("contrast",), name: str = "adj_pvalue") -> DataFrame:
    """Two-stage step-up: a first pass at alpha / (1 + alpha) counts rejections, which scale the second."""
    first = benjamini_hochberg(df, p, "_bh", by)
    level = alpha / (1 + alpha)
    counts = first.where(F.col(p).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_m"), F.count(F.when(F.col("_bh") <= level, 1)).alias("_r"))
    share = F.greatest(F.lit(0.0), (F.col("_m") - F.col("_r")) / F.col("_m")) * (1 + alpha)
    return first.join(counts, list(by), "left").withColumn(name, F.least(F.lit(1.0), F.col("_bh") * share)).drop("_bh", "_m", "_r")


def adaptive(df: DataFrame, p: str = "pvalue", by: Sequence[str] = ("contrast",), name: str = "adj_pvalue") -> DataFrame:
    """q-values where the p-values allow an estimate (100 tests, pi0 < 0.999, more mass near 0 than expected), step-up otherwise."""
    r = lambda_counts(df, p).first()
    n = r["n"]
    pi0 = pi0_smooth(pi0_curve([r[f"ge_{i}"] for i in range(len(LAMBDAS))], n))
    reliable = n >= 100 and pi0 < 0.999 and r["low"] / 0.05 > 1.1 * r["high"] / 0.5
    return qvalues(df, p, pi0 if reliable else 1.0, by, name)


def weighted(df: DataFrame, covariate: str, bins: int = 5, p: str = "pvalue", name: str = "adj_pvalue") -> DataFrame:
    """Covariate bins weighted by their share of small p-values (mean weight 1), step-up on p / weight; per contrast."""
    edges = df.where(F.col(covariate).isNotNull()).agg(F.percentile(covariate, [i / bins for i in range(1, bins)]).alias("e")).scalar()
    binned = df.withColumn("_e", edges).withColumn("_bin", F.coalesce(F.size(F.filter("_e", lambda e: e < F.col(covariate))), F.lit(0))).drop("_e")
    per = binned.where(F.col(p).isNotNull()).groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"), (F.count(F.when(F.col(p) <= 0.05, 1)) / F.count(F.lit(1)) + 0.01).alias("_s"))
    mean = per.agg((F.sum(F.col("_n") * F.col("_s")) / F.sum("_n")).alias("m")).scalar()
    weights = per.select("_bin", (F.col("_s") / mean).alias("_w"))
    scaled = binned.join(weights, "_bin", "left").withColumn("_pw", F.least(F.lit(1.0), F.col(p) / F.coalesce("_w", F.lit(1.0))))
    return benjamini_hochberg(scaled, "_pw", name).drop("_pw", "_w", "_bin")


def null_quantile_gate(df: DataFrame, col: str = "log2FC", q: float = 0.95) -> DataFrame:
    """One row ``gate``: the q-quantile of |x - median| over values within 2 scaled MADs (all where fewer than 20 remain); 0.5 for fewer than 50."""
    v = df.where(F.col(col).isNotNull()).select(F.col(col).alias("x"))
    med = v.agg(F.median("x").alias("m")).scalar()
    a = v.select(F.abs(F.col("x") - med).alias("a"))
    mad = a.agg(F.median("a").alias("m")).scalar()
    kept = F.when(F.col("a") <= 2 * 1.4826 * mad, F.col("a"))
    stats = a.agg(F.count(F.lit(1)).alias("n"), F.count(kept).alias("k"), F.percentile(kept, q).alias("qk"), F.percentile("a", q).alias("qa"))
    return stats.select(F.when(F.col("n") < 50, 0.5).when(F.col("k") >= 20, F.col("qk")).otherwise(F.col("qa")).alias("gate"))


def mixture_gate(values: np.ndarray) -> float:
    """First point where the wider of two components of |x - median| becomes the likelier; 0.5 for fewer than 50 values."""
    x = np.asarray(values, float)
    x = x[np.isfinite(x)]
    if len(x) < 50:
        return 0.5
    a = np.abs(x - np.median(x))
    w, mu, sd = two_gaussians(a)
    grid = np.linspace(0, a.max(), 400)
    dens = w * np.exp(-0.5 * ((grid[:, None] - mu) / sd) ** 2) / sd
    above = np.flatnonzero((dens[:, 1] >= dens[:, 0]) & (grid >= mu[0]))
    return float(grid[above[0]]) if len(above) else float(np.quantile(a, 0.95))


def significance(adj: str = "adj_pvalue", lfc: str = "log2FC", fdr: float = 0.05, gate: float | Column = 0.0) -> Column:
    """NotTested, Unchanged, UP or DOWN."""
    g = F.lit(gate) if isinstance(gate, (int, float)) else gate
    hit = (F.col(adj) < fdr) & (F.abs(lfc) > g)
    return F.when(F.col(adj).isNull() | F.col(lfc).isNull(), "NotTested").when(~hit, "Unchanged").when(F.col(lfc) > 0, "UP").otherwise("DOWN")
