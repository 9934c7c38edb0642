"""Tissue atlas: reference-normalised matrices, specificity scores, enrichment classes, markers; QC and evaluation tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions import special
from abundera.functions.values import is_measured
from abundera.operators.windows import average_rank

# ---- atlas (TIS, AGG19, JN6) --------------------------------------------------------------------------------------------


def reference_ratio_matrix(ions: DataFrame) -> DataFrame:
    """Per protein and sample the sum of intensity over the run's mean reference intensity; reference rows dropped.

    ``ions`` has ``protein, run, sample, is_reference, intensity``.
    """
    ref = ions.where("is_reference").groupBy("protein", "run").agg(F.avg("intensity").alias("_r"))
    rows = ions.where("NOT is_reference").join(ref, ["protein", "run"]).where("_r > 0")
    return rows.groupBy("protein", "sample").agg(F.sum(F.col("intensity") / F.col("_r")).alias("value"))


def specificity(long: DataFrame, tissues: DataFrame, mad_floor: float = 0.1) -> DataFrame:
    """``(protein, tissue, ts)``: median over the tissue's samples of (log2 value - median) / max(scaled MAD, floor).

    Proteins with fewer than three values have no score.  Two medians and a
    join, relational throughout.  ``tissues`` is ``(sample, tissue)``.
    """
    v = long.where(is_measured("value")).select("protein", "sample", F.log2("value").alias("y"))
    mu = v.groupBy("protein").agg(F.median("y").alias("mu"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    dev = v.join(mu, "protein").withColumn("d", F.col("y") - F.col("mu"))
    sd = dev.groupBy("protein").agg(F.greatest(F.lit(mad_floor), 1.4826 * F.median(F.abs("d"))).alias("sd"))
    z = dev.join(sd, "protein").withColumn("z", F.col("d") / F.col("sd"))
    return z.join(tissues, "sample").groupBy("protein", "tissue").agg(F.median("z").alias("ts"))


def robust_center(y: np.ndarray, power: float = 0.5, rounds: int = 100) -> tuple[float, float]:
    """Mean and sd by minimum density-power divergence (weights fall with the distance)."""
    mu, sd = float(np.median(y)), max(1.4826 * float(np.median(np.abs(y - np.median(y)))), 1e-6)
    for _ in range(rounds):
        w = np.exp(-0.5 * power * ((y - mu) / sd) ** 2)
        new = float((w * y).sum() / w.sum())
        var = float((w * (y - new) ** 2).sum() / max(w.sum() - len(y) * power * (1 + power) ** -1.5, 1e-9))
        step, mu, sd = abs(new - mu), new, max(math.sqrt(max(var, 1e-12)), 1e-6)
        if step < 1e-9:
            break
    return mu, sd


def specificity_dpd(long: DataFrame, tissues: DataFrame, power: float = 0.5) -> DataFrame:
    """Specificity with centre and scale by minimum density-power divergence; a protein has at most one row a sample."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = np.log2(pdf.sort_values("sample")["value"].to_numpy(float))
        mu, sd = robust_center(y, power) if len(y) >= 3 else (np.nan, np.nan)
        return pd.DataFrame({"protein": [pdf["protein"].iat[0]], "mu": [mu], "sd": [sd]})

    v = long.where(is_measured("value")).select("protein", "sample", "value")
    fits = v.groupBy("protein").applyInPandas(fit, "protein string, mu double, sd double").where("NOT isnan(mu)")
    z = v.join(fits, "protein").withColumn("z", (F.log2("value") - F.col("mu")) / F.col("sd"))
    return z.join(tissues, "sample").groupBy("protein", "tissue").agg(F.median("z").alias("ts"))


def specificity_threshold(scores: np.ndarray, fixed: float | None = None) -> float:
    """A fixed threshold, or where the upper of two components of the scores becomes the likelier."""
    if fixed is not None:
        return fixed
    w, mu, sd = special.two_gaussians(scores)
    grid = np.linspace(mu[0], max(scores.max(), mu[1]), 400)
    dens = w * np.exp(-0.5 * ((grid[:, None] - mu) / sd) ** 2) / sd
    above = np.flatnonzero(dens[:, 1] >= dens[:, 0])
    return float(grid[above[0]]) if len(above) else float(np.quantile(scores, 0.95))


def enrichment(scores: DataFrame, high: float = 4.0, mid: float = 2.5) -> DataFrame:
    """``(protein, class, top_tissue, n_high)``: specific (one tissue high), enhanced (several), shared-mid, or not specific."""
    out = scores.groupBy("protein").agg(
        F.max("ts").alias("max_ts"), F.min_by("tissue", F.struct((-F.col("ts")).alias("t"), "tissue")).alias("top_tissue"),
        F.count(F.when(F.col("ts") >= high, 1)).alias("n_high"), F.count(F.when(F.col("ts") >= mid, 1)).alias("n_mid"),
    )
    cls = F.when(F.col("n_high") == 1, "specific").when(F.col("n_high") > 1, "enhanced").when(F.col("n_mid") > 0, "moderate").otherwise("not specific")
    return out.select("protein", cls.alias("class"), "top_tissue", "n_high")


def markers(long: DataFrame, tissues: DataFrame) -> DataFrame:
    """Rank-sum test of each tissue against all others per protein: ``(protein, tissue, n, u, z)`` (normal approximation, ties averaged)."""
    v = long.where(is_measured("value")).select("protein", "sample", F.col("value").alias("v"))
    ranks = average_rank(v, ["protein"], "v", "r").join(tissues, "sample")
    total = v.groupBy("protein").agg(F.count(F.lit(1)).alias("_n"))
    per = ranks.groupBy("protein", "tissue").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("_s")).join(total, "protein")
    u = F.col("_s") - F.col("n") * (F.col("n") + 1) / 2
    rest = F.col("_n") - F.col("n")
    sd = F.sqrt(F.col("n") * rest * (F.col("_n") + 1) / 12)
    return per.where(rest > 0).select("protein", "tissue", "n", u.alias("u"), ((u - F.col("n") * rest / 2) / sd).alias("z"))


# ---- QC tables (QC1-QC4) --------------------------------------------------------------------------------------------------


def sample_distribution(long: DataFrame) -> DataFrame:
    """Per sample: count, mean, sd and quartiles of log2 values, and the share of missing entities."""
    n = long.agg(F.count_distinct("protein").alias("n")).scalar()
    v = long.where(is_measured("value")).withColumn("y", F.log2("value"))
    q = F.percentile("y", [0.25, 0.5, 0.75])
    return v.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd"), q.alias("_q")).select(
        "sample", "n", "mean", "sd", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), (1 - F.col("n") / n).alias("missing")
    )


def condition_cv(long: DataFrame, samples: DataFrame) -> DataFrame:
    """``(condition, median_cv, n)``: median over proteins of sd / mean within the condition (two values or more)."""
    cv = long.where(is_measured("value")).join(samples, "sample").groupBy("condition", "protein").agg((F.stddev_samp("value") / F.avg("value")).alias("cv")).where("cv IS NOT NULL")
    return cv.groupBy("condition").agg(F.median("cv").alias("median_cv"), F.count(F.lit(1)).alias("n"))


def variance_explained(long: DataFrame, samples: DataFrame) -> DataFrame:
    """``(protein, r2)``: between-condition share of the log2 variance (one-way)."""
    v = long.where(is_measured("value")).join(samples, "sample").select("protein", "condition", F.log2("value").alias("y"))
    g = v.groupBy("protein", "condition").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    t = v.groupBy("protein").agg(F.avg("y").alias("gm"), (F.var_pop("y") * F.count("y")).alias("total"))
    return g.join(t, "protein").groupBy("protein").agg((F.sum(F.col("n") * (F.col("m") - F.col("gm")) ** 2) / F.nullif(F.first("total"), F.lit(0.0))).alias("r2")).where("r2 IS NOT NULL")


def completeness(long: DataFrame) -> DataFrame:
    """``(n_samples, proteins)``: how many proteins were seen in how many samples."""
    return long.where(is_measured("value")).groupBy("protein").agg(F.count_distinct("sample").alias("n_samples")).groupBy("n_samples").agg(F.count(F.lit(1)).alias("proteins"))


def abundance_rank(long: DataFrame) -> DataFrame:
    """``(protein, abundance, rank)`` by falling median log2 value."""
    m = long.where(is_measured("value")).groupBy("protein").agg(F.median(F.log2("value")).alias("abundance"))
    return average_rank(m.withColumn("_neg", -F.col("abundance")).withColumn("_g", F.lit(1)), ["_g"], "_neg", "rank").select("protein", "abundance", "rank")


def concordance(a: DataFrame, b: DataFrame, level: float = 0.05) -> DataFrame:
    """One row comparing two workflows' tests: common proteins, correlation of log2FC, hits of each and of both."""
    j = a.select("protein", F.col("log2FC").alias("fa"), F.col("adj_pvalue").alias("pa")).join(b.select("protein", F.col("log2FC").alias("fb"), F.col("adj_pvalue").alias("pb")), "protein")
    return j.agg(
        F.count(F.lit(1)).alias("common"), F.corr("fa", "fb").alias("r"), F.count(F.when(F.col("pa") < level, 1)).alias("hits_a"),
        F.count(F.when(F.col("pb") < level, 1)).alias("hits_b"), F.count(F.when((F.col("pa") < level) & (F.col("pb") < level), 1)).alias("hits_both"),
    )


def ma_values(tests: DataFrame) -> DataFrame:
    """``(protein, a, m)``: mean and difference of the two group means."""
    return tests.select("protein", ((F.col("mean_a") + F.col("mean_b")) / 2).alias("a"), (F.col("mean_b") - F.col("mean_a")).alias("m"))


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of at most some thousand points."""
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(labels):
        own = (labels == c) & (np.arange(len(labels)) != i)
        if own.any() and len(set(labels)) > 1:
            a, b = d[i, own].mean(), min(d[i, labels == k].mean() for k in set(labels) if k != c)
            out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out)) if out else 0.0


# ---- evaluation (EVL1-EVL3) -----------------------------------------------------------------------------------------------


def confusion(df: DataFrame, predicted: str, truth: str, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and the Matthews correlation per group."""
    p, t = F.col(predicted), F.col(truth)
    c = lambda cond: F.count(F.when(cond, 1)).cast("double")
    out = df.where(p.isNotNull() & t.isNotNull()).groupBy(*by).agg(c(p & t).alias("tp"), c(p & ~t).alias("fp"), c(~p & t).alias("fn"), c(~p & ~t).alias("tn"))
    den = F.sqrt((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) * (F.col("tn") + F.col("fp")) * (F.col("tn") + F.col("fn")))
    return out.withColumn("mcc", F.coalesce(F.try_divide(F.col("tp") * F.col("tn") - F.col("fp") * F.col("fn"), den), F.lit(0.0)))


def roc_auc(df: DataFrame, score: str, truth: str, by: Sequence[str]) -> DataFrame:
    """``(by..., auc)`` by the rank sum, ties averaged; null where a class is absent."""
    r = average_rank(df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(*by, F.col(score).alias("_s"), F.col(truth).cast("int").alias("_t")), by, "_s", "_r")
    g = r.groupBy(*by).agg(F.sum("_t").alias("p"), F.sum(1 - F.col("_t")).alias("n"), F.sum(F.when(F.col("_t") == 1, F.col("_r")).otherwise(0.0)).alias("s"))
    return g.select(*by, F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc"))


def fdr_ladder(df: DataFrame, score: str, truth: str, levels: Sequence[float]) -> DataFrame:
    """Per nominal level: calls, true calls, empirical FDR and recall, in one aggregate."""
    rungs = F.explode(F.array(*[F.lit(float(x)) for x in levels])).alias("level")
    rows = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).select(rungs, F.col(score).alias("s"), F.col(truth).alias("t"))
    hit = F.col("s") <= F.col("level")
    out = rows.groupBy("level").agg(F.count(F.when(hit, 1)).alias("calls"), F.count(F.when(hit & F.col("t"), 1)).alias("true_calls"), F.count(F.when(F.col("t"), 1)).alias("positives"))
    return out.select("level", "calls", "true_calls", F.coalesce(F.try_divide(F.col("calls") - F.col("true_calls"), F.col("calls")), F.lit(0.0)).alias("empirical_fdr"), F.try_divide("true_calls", "positives").alias("recall"))


def mean_rank(df: DataFrame, name: str, metrics: dict[str, bool]) -> DataFrame:
    """``(name, mean_rank)`` over metrics (True: larger is better), ties averaged."""
    parts = None
    for m, larger in metrics.items():
        one = df.select(name, F.lit(m).alias("_m"), (-F.col(m) if larger else F.col(m)).alias("_v")).where("_v IS NOT NULL")
        parts = one if parts is None else parts.unionByName(one)
    return average_rank(parts, ["_m"], "_v", "_r").groupBy(name).agg(F.avg("_r").alias("mean_rank"))


def cumulative_ladder(df: DataFrame, score: str, truth: str, order: str) -> DataFrame:
    """True and false positives down a ranking of the distinct scores."""
    per = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(truth).cast("int")).alias("_t"), F.count(F.lit(1)).alias("_n"))
    down = W.orderBy(F.col(score).asc() if order == "asc" else F.col(score).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    return per.select(score, F.sum("_t").over(down).alias("tp"), F.sum(F.col("_n") - F.col("_t")).over(down).alias("fp"))


def dataset_profile(long: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: samples, proteins, missing share, median within-condition CV."""
    cv = condition_cv(long, samples).agg(F.median("median_cv").alias("m")).scalar()
    out = long.where(is_measured("value")).agg(F.count_distinct("sample").alias("samples"), F.count_distinct("protein").alias("proteins"), F.count(F.lit(1)).alias("cells"))
    return out.select("samples", "proteins", (1 - F.col("cells") / (F.col("samples") * F.col("proteins"))).alias("missing"), cv.alias("median_cv"))
