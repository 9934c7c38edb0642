"""Differential tests between two groups of samples.

Per-protein sums are relational; the prior of the moderated tests needs one
aggregate over all proteins (mean and variance of log variances, a handful of
distinct degrees of freedom), and the p-values one Arrow UDF.  Resampling
methods spread their resamples over tasks against the collapsed matrix.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundera.functions import special
from abundera.functions.special import digamma, inverse_trigamma, trigamma
from abundera.functions.values import is_measured
from abundera.operators import fdr
from abundera.operators.sparse import Cells, measured_cells
from abundera.operators.windows import benjamini_hochberg
from abundera.session import cut_lineage, pandas_bounded

#: Measured values a resampling method sends to its tasks.
MAX_MATRIX = 20_000_000
#: Cells of a block of proteins whose missing cells are summed at once.
MAX_BLOCK = 200_000
#: Distinct peptide counts of proteins.
MAX_COUNTS = 100_000


def group_stats(long: DataFrame, samples: DataFrame, a: str, b: str) -> DataFrame:
    """Per protein: means, counts and variances of log2 values in both groups, and the difference b - a."""
    v = long.where(is_measured("value")).join(samples.where(F.col("condition").isin(a, b)), "sample").withColumn("y", F.log2("value"))
    pick = lambda c: F.when(F.col("condition") == c, F.col("y"))
    out = v.groupBy("protein").agg(
        F.avg(pick(a)).alias("mean_a"), F.avg(pick(b)).alias("mean_b"), F.count(pick(a)).alias("n_a"), F.count(pick(b)).alias("n_b"),
        F.coalesce(F.var_samp(pick(a)), F.lit(0.0)).alias("var_a"), F.coalesce(F.var_samp(pick(b)), F.lit(0.0)).alias("var_b"),
    )
    return out.withColumn("log2FC", F.col("mean_b") - F.col("mean_a"))


def fit_prior(e_mean: float, e_var: float, trig_mean: float, s2_mean: float, mean_df: float) -> tuple[float, float]:
    """Prior degrees of freedom and variance of a scaled inverse chi-square from the moments of log variances."""
    evar = e_var - trig_mean
    if evar > 0 and math.isfinite(evar):
        d0 = 2 * inverse_trigamma(evar)
        return d0, math.exp(e_mean - (math.log(d0 / 2) - float(digamma(d0 / 2)[0])))
    return math.inf, s2_mean


def _of_df(df: str, fn) -> Column:
    """A function of the degrees of freedom, by an Arrow UDF that evaluates it once per distinct value."""

    @F.pandas_udf("double")
    def apply(v: pd.Series) -> pd.Series:
        return v.map({d: float(fn(d)) if d > 0 else np.nan for d in v.dropna().unique()}).astype(float)

    return apply(F.col(df).cast("double"))


def _log_bias(d: float) -> float:
    return math.log(d / 2) - float(digamma(d / 2)[0])


def _trigamma_half(d: float) -> float:
    return float(trigamma(d / 2)[0])


def prior_moments(stats: DataFrame) -> tuple[float, float, float, float, int]:
    """Moments that the prior is fitted from: one aggregate over one row a protein."""
    base = stats.where("df > 0 AND s2 IS NOT NULL")
    floor = base.agg((F.median("s2") * 1e-5).alias("m")).scalar()
    rows = base.withColumn("_s", F.greatest("s2", floor)).where("_s > 0").select((F.log("_s") + _of_df("df", _log_bias)).alias("e"), _of_df("df", _trigamma_half).alias("t"), F.col("_s").alias("s2"))
    r = rows.agg(F.avg("e").alias("em"), F.var_samp("e").alias("ev"), F.avg("t").alias("tm"), F.avg("s2").alias("sm"), F.count(F.lit(1)).alias("n")).first()
    return (r["em"], r["ev"] or 0.0, r["tm"], r["sm"], r["n"]) if r["n"] else (0.0, 0.0, 0.0, 0.0, 0)


def _t_pvalue(t: str, df: str) -> Column:
    """Two-sided p-values of two columns by an Arrow UDF (made here, since a UDF needs a session)."""

    @F.pandas_udf("double")
    def pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
        ok = t.notna() & df.notna()
        out = pd.Series(np.nan, index=t.index)
        if ok.any():
            out[ok] = special.student_t_two_sided(t[ok].to_numpy(float), df[ok].to_numpy(float))
        return out

    return pvalue(t, df)


def _with_df(stats: DataFrame, min_n: int = 2) -> DataFrame:
    ok = stats.where((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    df = F.col("n_a") + F.col("n_b") - 2
    return ok.withColumn("df", df).withColumn("s2", ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / df)


def _moderated(rows: DataFrame, d0: Column, s02: Column, total_df: float) -> DataFrame:
    post = F.when(d0 == float("inf"), s02).otherwise((F.col("df") * F.col("s2") + d0 * s02) / (F.col("df") + d0))
    se = F.sqrt(post * (F.col("unscaled") if "unscaled" in rows.columns else 1 / F.col("n_a") + 1 / F.col("n_b")))
    df = F.least(F.col("df") + d0, F.lit(float(total_df)))
    out = rows.withColumn("s2_post", post).withColumn("t", F.try_divide(F.col("log2FC"), se)).withColumn("df_total", df)
    p = _t_pvalue("t", "df_total")
    return out.withColumn("pvalue", F.when(~F.isnan(p), p))


def limma(long: DataFrame, samples: DataFrame, a: str, b: str) -> DataFrame:
    """Moderated t-test of two groups; proteins with fewer than two values in a group are not tested; no moderation below three."""
    rows = _with_df(group_stats(long, samples, a, b))
    em, ev, tm, sm, n = prior_moments(rows)
    total = rows.agg(F.sum("df").alias("s")).first()["s"] or 0
    d0, s02 = fit_prior(em, ev, tm, sm, 0) if n >= 3 else (0.0, 0.0)
    return finish(_moderated(rows, F.lit(d0), F.lit(s02), total), a, b)


def finish(tests: DataFrame, a: str, b: str, level: float = 0.05, gate: float = 0.0) -> DataFrame:
    """Adjusted p-values, significance and contrast name."""
    named = tests.withColumn("contrast", F.lit(f"{b}-{a}"))
    adjusted = benjamini_hochberg(named)
    return adjusted.withColumn("significance", fdr.significance("adj_pvalue", "log2FC", level, gate))


def quadratic_loess(x: np.ndarray, n: np.ndarray, y: np.ndarray, span: float = 0.75) -> np.ndarray:
    """Local quadratic fit at each distinct x from its number of points and their mean y; exact, since the weights depend on x alone."""
    fit = np.empty(len(x))
    nearest = max(1, min(int(math.floor(span * n.sum())), int(n.sum())))
    for i, at in enumerate(x):
        gap = np.abs(x - at)
        order = np.argsort(gap, kind="stable")
        radius = gap[order][np.searchsorted(np.cumsum(n[order]), nearest)]
        w = n * np.clip(1 - (gap / radius) ** 3, 0, None) ** 3 if radius > 0 else np.where(gap == 0, n, 0.0)
        design = np.sqrt(w)[:, None] * np.stack([np.ones(len(x)), x - at, (x - at) ** 2], axis=1)
        scale = np.maximum(np.linalg.norm(design, axis=0), 1e-300)
        beta = np.linalg.lstsq(design / scale, np.sqrt(w) * y, rcond=100 * np.finfo(float).eps)[0] / scale
        fit[i] = beta[0]
    return fit


def prior_df(target: float) -> float:
    """Prior degrees of freedom on a grid of 0.1 whose trigamma of the half is nearest to ``target``."""
    if target <= 0:
        return math.inf
    steps = max(1.0, math.floor(20 * inverse_trigamma(target)))
    return min(((steps + k) / 10 for k in (0, 1)), key=lambda d: abs(_trigamma_half(d) - target))


def precision_stats(long: DataFrame, samples: DataFrame, precision: DataFrame, a: str, b: str) -> DataFrame:
    """``group_stats`` with each value weighted by its precision: means, pooled variance and unscaled variance of a weighted fit.

    A cell without a precision takes the 5 % quantile of those measured; every
    weight w counts as 1 / (1 / w + t), t the median of 1 / w, so that one well
    measured cell can't outweigh the biological variance.
    """
    v = long.where(is_measured("value")).join(samples.where(F.col("condition").isin(a, b)), "sample").withColumn("y", F.log2("value"))
    v = v.join(precision.select("protein", "sample", F.when(is_measured("precision"), F.col("precision")).alias("w")), ["protein", "sample"], "left")
    typical = v.agg(F.percentile(1 / F.col("w"), 0.5).alias("t"), F.percentile("w", 0.05).alias("low")).first()
    tau, low = typical["t"] or 0.0, typical["low"] or 1.0
    v = v.withColumn("w", 1 / (1 / F.coalesce("w", F.lit(low)) + F.lit(tau)))
    pick = lambda c, x: F.when(F.col("condition") == c, x)
    w, y = F.col("w"), F.col("y")
    cols = {}
    for name, c in (("a", a), ("b", b)):
        cols |= {f"_w{name}": F.sum(pick(c, w)), f"_wy{name}": F.sum(pick(c, w * y)), f"_wyy{name}": F.sum(pick(c, w * y * y)), f"n_{name}": F.count(pick(c, y))}
    out = v.groupBy("protein").agg(*[c.alias(k) for k, c in cols.items()])
    for name in "ab":
        mean = F.try_divide(F.col(f"_wy{name}"), F.col(f"_w{name}"))
        out = out.withColumns({f"mean_{name}": mean, f"_rss{name}": F.greatest(F.lit(0.0), F.col(f"_wyy{name}") - F.col(f"_wy{name}") * mean)})
    ok = out.where("n_a >= 2 AND n_b >= 2").withColumn("df", F.col("n_a") + F.col("n_b") - 2)
    return ok.withColumns({"s2": (F.col("_rssa") + F.col("_rssb")) / F.col("df"), "unscaled": 1 / F.col("_wa") + 1 / F.col("_wb"), "log2FC": F.col("mean_b") - F.col("mean_a")}).drop(*[k for k in cols if k[0] == "_"], "_rssa", "_rssb")


def deqms(long: DataFrame, samples: DataFrame, counts: DataFrame, a: str, b: str, precision: DataFrame | None = None) -> DataFrame:
    """Moderated t-test whose prior variance follows the peptide count: a local quadratic trend of log variance on log2 count.

    ``counts`` is ``(protein, count)``.  The trend needs the proteins of each
    count only as number, sum and sum of squares of their log variances, so what
    comes to the driver is one row a distinct count (checked).  With fewer than
    four points or one count it is the plain moderated test.  ``precision``
    (``protein, sample, precision``) weights the values.
    """
    if precision is None:
        rows = _with_df(group_stats(long, samples, a, b)).withColumn("unscaled", 1 / F.col("n_a") + 1 / F.col("n_b"))
    else:
        rows = precision_stats(long, samples, precision, a, b)
    rows = cut_lineage(rows.join(counts, "protein", "left").withColumn("count", F.coalesce("count", F.lit(1))))  # one row a protein, read by every step
    low = rows.agg(F.min("count").alias("m")).first()["m"]
    rows = rows.withColumn("count", F.col("count") + (1 if low == 0 else 0))
    y = F.log("s2")
    points = rows.where("s2 > 0").groupBy("count").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"), F.sum(y * y).alias("yy"), F.sum(_of_df("df", _trigamma_half)).alias("t"))
    pts = pandas_bounded(points.orderBy("count"), MAX_COUNTS, "distinct peptide counts")
    total = rows.agg(F.sum("df").alias("s")).first()["s"] or 0
    if pts["n"].sum() < 4 or len(pts) < 2:
        return limma(long, samples, a, b)
    n, mean = pts["n"].to_numpy(float), (pts["y"] / pts["n"]).to_numpy(float)
    trend = quadratic_loess(np.log2(pts["count"].to_numpy(float)), n, mean)
    if not np.isfinite(trend).all():
        return limma(long, samples, a, b)
    target = float((pts["yy"] - 2 * trend * pts["y"] + n * trend**2 - pts["t"]).sum() / n.sum())
    d0 = prior_df(target)
    half = -_log_bias(d0) if math.isfinite(d0) else 0.0
    table = long.sparkSession.createDataFrame([(int(c), float(t)) for c, t in zip(pts["count"], trend)], "count bigint, _trend double")
    rows = rows.join(table, "count", "left").withColumn("_s0", F.exp(F.coalesce("_trend", F.lit(float(trend[-1]))) + _of_df("df", _log_bias) + half)).drop("_trend")
    return finish(_moderated(rows, F.lit(d0), F.col("_s0"), total), a, b)


# ---- resampling ---------------------------------------------------------------------------------------------------------


def collapsed(long: DataFrame, samples: DataFrame, a: str, b: str, complete: bool = False) -> tuple[Cells, np.ndarray]:
    """The two groups' measured log2 values and group flags, after a check of their number; proteins with two values a group, or complete ones."""
    v = long.where(is_measured("value")).join(samples.where(F.col("condition").isin(a, b)), "sample").select("protein", "condition", "sample", F.log2("value").alias("y"))
    x = measured_cells(v, MAX_MATRIX, keys=("condition", "sample"))
    flags = np.array([c == b for c, _ in x.columns], bool)
    n = [np.bincount(x.row[flags[x.col] == g], minlength=len(x.names)) for g in (False, True)]
    return x.rows(n[0] + n[1] == len(flags) if complete else (n[0] >= 2) & (n[1] >= 2)), flags


def difference_and_error(x: Cells, flags: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference of means b - a and its pooled standard error; each column counts as often as it was drawn."""
    sums = lambda v: np.bincount(x.row, v, minlength=len(x.names))
    w = weight[x.col].astype(float)
    in_b = flags[x.col]
    wa, wb = np.where(in_b, 0.0, w), np.where(in_b, w, 0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        na, nb = sums(wa), sums(wb)
        ma, mb = sums(wa * x.y) / na, sums(wb * x.y) / nb
        ss = sums(np.where(w > 0, w * (x.y - np.where(in_b, mb[x.row], ma[x.row])) ** 2, 0.0))
        return mb - ma, np.sqrt(ss / (na + nb - 2) * (1 / na + 1 / nb))


# Smoothing constants tried.
SMOOTHING = np.concatenate([np.arange(0, 0.21, 0.01), np.arange(0.22, 1.01, 0.02), np.arange(1.2, 5.01, 0.2)])


def _top_overlap(u: np.ndarray, v: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of common entries among the first k of two rankings, for every k of ``sizes``."""
    ru, rv = np.empty(len(u), int), np.empty(len(v), int)
    ru[np.argsort(-np.abs(u), kind="stable")] = np.arange(len(u))
    rv[np.argsort(-np.abs(v), kind="stable")] = np.arange(len(v))
    last = np.bincount(np.maximum(ru, rv), minlength=len(u)).cumsum()
    return last[sizes - 1] / sizes


def _resample(flags: np.ndarray, seed: int, i: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Flags and weights of columns drawn with replacement within groups (bootstrap) or relabelled (permutation)."""
    n = len(flags)
    u = special.uniforms(seed, i * 2 * n + np.arange(n) + (n if kind == "perm" else 0))
    if kind == "perm":
        return flags[np.argsort(u, kind="stable")], np.ones(n)
    weight = np.zeros(n)
    for g in (False, True):
        own = np.flatnonzero(flags == g)
        weight += np.bincount(own[(u[own] * len(own)).astype(int)], minlength=n)
    return flags, weight


def rots(long: DataFrame, samples: DataFrame, a: str, b: str, resamples: int = 100, seed: int = 42, moderated: bool = False) -> DataFrame:
    """Reproducibility-optimised test: the smoothing whose top lists agree most between bootstraps, against permuted lists.

    Resamples are rows of a range spread over tasks with the measured values
    (their number checked); a resample is a weight and a flag a column, so it
    takes sums over the measured values only; ``moderated`` uses moderated standard errors on complete
    rows.
    """
    spark = long.sparkSession
    x, flags = collapsed(long, samples, a, b, complete=moderated)
    if len(x.names) < 8:
        raise ValueError("too few testable proteins")
    shared = spark.sparkContext.broadcast((x, flags))
    n = len(x.names)
    sizes = np.unique(np.clip(np.geomspace(5, max(6, n // 4), 12).astype(int), 1, n - 1))

    def stat(m: Cells, f: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, s = difference_and_error(m, f, w)
        d, s = np.nan_to_num(d), np.nan_to_num(s, nan=np.inf)
        if moderated:
            fin = np.isfinite(s) & (s > 0)
            s = np.where(fin, np.sqrt((s**2 + np.median(s[fin] ** 2)) / 2), s)
        return d, s

    def scan(batches):
        m, f = shared.value
        for pdf in batches:
            rows = []
            for i in pdf["id"]:
                d1, s1 = stat(m, *_resample(f, seed, 2 * int(i), "boot"))
                d2, s2 = stat(m, *_resample(f, seed, 2 * int(i) + 1, "boot"))
                p1, q1 = stat(m, *_resample(f, seed, 2 * int(i), "perm"))
                p2, q2 = stat(m, *_resample(f, seed, 2 * int(i) + 1, "perm"))
                for j, c in enumerate([*SMOOTHING, None]):
                    t = (lambda d, s: d / np.maximum(c + s, 1e-12)) if c is not None else (lambda d, s: d)
                    real, null = _top_overlap(t(d1, s1), t(d2, s2), sizes), _top_overlap(t(p1, q1), t(p2, q2), sizes)
                    rows += [(j, int(k), float(r), float(z)) for k, r, z in zip(sizes, real, null)]
            yield pd.DataFrame(rows, columns=["c", "k", "real", "null"])

    overlaps = spark.range(resamples, numPartitions=min(resamples, 64)).mapInPandas(scan, "c int, k int, real double, null double")
    best = overlaps.groupBy("c", "k").agg(((F.avg("real") - F.avg("null")) / F.greatest(F.stddev_samp("real"), F.lit(1e-6))).alias("z")).agg(F.max_by("c", F.struct("z", -F.col("c"))).alias("c")).first()["c"]
    d, s = stat(x, flags, np.ones(len(flags)))
    use = lambda d, s: d / np.maximum(SMOOTHING[best] + s, 1e-12) if best < len(SMOOTHING) else d
    t = use(d, s)
    null = np.sort(np.abs(np.concatenate([use(*stat(x, *_resample(flags, seed, i, "perm"))) for i in range(min(resamples, 200))])))
    p = (len(null) - np.searchsorted(null, np.abs(t), side="left") + 1) / (len(null) + 1)
    out = spark.createDataFrame(pd.DataFrame({"protein": x.names, "log2FC": d, "t": t, "pvalue": p}))
    return finish(out, a, b)


def proda(long: DataFrame, samples: DataFrame, a: str, b: str, rounds: int = 20) -> DataFrame:
    """Probabilistic dropout: missing values count by the chance that a value of the fitted size drops out.

    Per sample a sigmoid dropout curve, per protein two means and a variance by
    maximum likelihood under it (grid of means refined by Newton-free
    bisection); curves and proteins in turn.  The sums over missing cells are
    taken on the cluster, a block of proteins at a time; the driver holds the
    measured values and some numbers a protein and sample.  Agreement with the published
    method is at the level of ranks.
    """
    spark = long.sparkSession
    x, flags = collapsed(long, samples, a, b)
    if not x.names:
        return finish(spark.createDataFrame([], "protein string, log2FC double, t double, pvalue double"), a, b)
    n, at = len(x.names), [np.flatnonzero(~flags), np.flatnonzero(flags)]
    counts = np.stack([np.bincount(x.row[flags[x.col] == g], minlength=n) for g in (False, True)], axis=1)
    sums = np.stack([np.bincount(x.row[flags[x.col] == g], x.y[flags[x.col] == g], minlength=n) for g in (False, True)], axis=1)
    n_obs, group = counts.sum(axis=1), flags[x.col].astype(int)
    centre = np.full(len(flags), np.quantile(x.y, 0.1))
    width = np.full(len(flags), -max(np.std(x.y) / 3, 1e-3))
    mean = sums.sum(axis=1) / n_obs
    sd = np.sqrt(np.maximum(np.bincount(x.row, (x.y - mean[x.row]) ** 2, minlength=n) / n_obs, 0.01))
    means = sums / counts
    low, high = x.y.min() - 5, x.y.max() + 5
    by_col = np.lexsort((x.row, x.col))
    ends = np.searchsorted(x.col[by_col], np.arange(len(flags) + 1))
    starts = np.searchsorted(x.row, np.arange(n + 1))
    shared = spark.sparkContext.broadcast((x.col, starts))
    size = max(1, MAX_BLOCK // max(len(flags), 1))
    tasks = min(48, -(-n // size))

    def lost_sums(means: np.ndarray, sd: np.ndarray, centre: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pull and curvature of each protein's missing cells, a block of proteins at a time on the cluster."""

        def scan(batches):
            cols, starts = shared.value
            place = np.empty(len(flags), int)
            for own in at:
                place[own] = np.arange(len(own))
            for pdf in batches:
                for first in pdf["id"] * size:
                    last = min(first + size, n)
                    row, col = np.repeat(np.arange(last - first), np.diff(starts[first : last + 1])), cols[starts[first] : starts[last]]
                    out = np.zeros((2, 2, last - first))
                    for g, own in enumerate(at):
                        mu, s2, hit = means[first:last, g][:, None], sd[first:last, None] ** 2, flags[col] == bool(g)
                        scale, sign = np.sqrt(width[own] ** 2 + s2), np.sign(width[own])
                        arg = (mu - centre[own]) / scale * sign
                        ratio = special.inverse_mills(arg)
                        ratio[row[hit], place[col[hit]]] = 0.0  # measured cells have their own terms
                        out[g] = (ratio * sign / scale).sum(axis=1), (ratio * (arg + ratio) / scale**2).sum(axis=1)
                    yield pd.DataFrame({"first": [int(first)], "s": [out.ravel()]})

        parts = spark.range(-(-n // size), numPartitions=tasks).mapInPandas(scan, "first long, s array<double>").collect()
        got = np.concatenate([np.array(r["s"]).reshape(2, 2, -1) for r in sorted(parts, key=lambda r: r["first"])], axis=2)
        return got[:, 0].T, got[:, 1].T

    for _ in range(rounds):
        pull, curve = lost_sums(means, sd, centre, width)
        s2 = sd[:, None] ** 2
        info = np.maximum(curve + counts / s2, 1e-6)
        means = np.clip(means + np.clip((pull + (sums - counts * means) / s2) / info, -1, 1), low, high)
        rss = np.bincount(x.row, (x.y - means[x.row, group]) ** 2, minlength=n)
        prior = np.median(rss / np.maximum(n_obs - 2, 1))
        sd = np.sqrt((rss + 3 * prior) / (np.maximum(n_obs - 2, 0) + 3))
        for g, own in enumerate(at):
            order = np.argsort(means[:, g], kind="stable")
            rank = np.empty(n, int)
            rank[order] = np.arange(n)
            v = means[order, g] - means[:, g].mean()
            total, squares = v.sum(), (v**2).sum()
            for j in own:
                gone = np.sort(rank[x.row[by_col[ends[j] : ends[j + 1]]]])
                k = n - len(gone)
                if k:
                    mid = np.array([(k - 1) // 2, k // 2])
                    mid = mid + np.searchsorted(gone - np.arange(len(gone)), mid, side="right")  # their places among all
                    m = (total - v[gone].sum()) / k
                    centre[j] = means[order[mid], g].mean()
                    width[j] = -max(math.sqrt(max(0.0, (squares - (v[gone] ** 2).sum()) / k - m * m)), 0.1)
    diff = means[:, 1] - means[:, 0]
    t = diff / np.sqrt(1 / info[:, 0] + 1 / info[:, 1])
    p = special.student_t_two_sided(t, np.maximum(n_obs - 2, 1) + 3.0)
    return finish(spark.createDataFrame(pd.DataFrame({"protein": x.names, "log2FC": diff, "t": t, "pvalue": p})), a, b)


def block_correlation(long: DataFrame, design: pd.DataFrame, blocks: dict[str, str], trim: float = 0.15) -> float:
    """Consensus correlation of samples of one block: trimmed mean of the proteins' intra-class correlations on the z scale."""
    table = {s: row.to_numpy(float) for s, row in design.iterrows() if s in blocks}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["sample"].isin(table)].sort_values("sample")
        names = pdf["sample"].map(blocks)
        x = np.stack([table[s] for s in pdf["sample"]]) if len(pdf) else np.zeros((0, 1))
        k, n = names.nunique(), len(pdf)
        if n - k < 1 or k < 2 or n <= x.shape[1] + 1:
            return pd.DataFrame({"z": pd.Series(dtype=float)})
        y = np.log2(pdf["value"].to_numpy(float))
        r = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        g = pd.Series(r).groupby(names.to_numpy())
        size, mean = g.size(), g.mean()
        between = float((size * (mean - r.mean()) ** 2).sum()) / (k - 1)
        within = float(((r - mean.reindex(names).to_numpy()) ** 2).sum()) / (n - k)
        m0 = (n - (size**2).sum() / n) / (k - 1)
        rho = (between - within) / (between + (m0 - 1) * within) if between + within > 0 else 0.0
        return pd.DataFrame({"z": [float(np.arctanh(np.clip(rho, -0.99, 0.99)))]})

    z = long.where(is_measured("value")).groupBy("protein").applyInPandas(fit, "z double")
    q = z.agg(F.percentile("z", [trim, 1 - trim]).alias("q")).first()["q"]
    if q is None:
        return 0.0
    mean = z.where((F.col("z") >= q[0]) & (F.col("z") <= q[1])).agg(F.avg("z").alias("m")).first()["m"]
    return float(np.tanh(mean or 0.0))


def design_test(long: DataFrame, design: pd.DataFrame, contrast: np.ndarray, blocks: dict[str, str] | None = None, correlation: float = 0.0) -> DataFrame:
    """Moderated test of a contrast in a linear model with covariates: one small least-squares fit per protein.

    ``design`` is indexed by sample, its columns the model's terms; a protein's
    rows are at most the samples.  With ``blocks`` (sample to block) and their
    ``correlation`` the fit is by generalised least squares.
    """
    table = {s: row.to_numpy(float) for s, row in design.iterrows()}

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["sample"].isin(table)].sort_values("sample")
        none = pd.DataFrame({"protein": pd.Series(dtype=object), "log2FC": pd.Series(dtype=float), "s2": pd.Series(dtype=float), "df": pd.Series(dtype="int64"), "unscaled": pd.Series(dtype=float)})
        if pdf.empty:
            return none
        x, y = np.stack([table[s] for s in pdf["sample"]]), np.log2(pdf["value"].to_numpy(float))
        if blocks and correlation:
            names = np.array([blocks.get(s, s) for s in pdf["sample"]], object)
            same = names[:, None] == names[None, :]
            most = int(same.sum(axis=1).max())
            v = np.where(same, max(correlation, 0.01 - 1 / (most - 1)) if most > 1 else 0.0, 0.0)  # as negative as a block this large can be
            np.fill_diagonal(v, 1.0)
            half = np.linalg.inv(np.linalg.cholesky(v))
            x, y = half @ x, half @ y
        df = len(y) - np.linalg.matrix_rank(x)
        if df < 1 or np.linalg.matrix_rank(x) < x.shape[1]:
            return none
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        r = y - x @ beta
        return pd.DataFrame({"protein": [pdf["protein"].iat[0]], "log2FC": [float(contrast @ beta)], "s2": [float(r @ r / df)], "df": [int(df)], "unscaled": [float(contrast @ np.linalg.inv(x.T @ x) @ contrast)]})

    rows = long.where(is_measured("value")).groupBy("protein").applyInPandas(fit, "protein string, log2FC double, s2 double, df long, unscaled double")
    em, ev, tm, sm, n = prior_moments(rows)
    d0, s02 = fit_prior(em, ev, tm, sm, 0) if n >= 3 else (0.0, 0.0)
    post = F.lit(s02) if math.isinf(d0) else (F.col("df") * F.col("s2") + d0 * s02) / (F.col("df") + d0)
    out = rows.withColumn("t", F.col("log2FC") / F.sqrt(post * F.col("unscaled"))).withColumn("_df", F.col("df") + F.lit(d0))
    return finish(out.withColumn("pvalue", _t_pvalue("t", "_df")).drop("_df"), "0", "contrast")


# ---- ensembles ----------------------------------------------------------------------------------------------------------


def ensemble(results: dict[str, DataFrame], min_k: int = 2, level: float = 0.05) -> DataFrame:
    """Consensus of several methods' tests: Cauchy-combined p, median log2FC, and the methods that agree on a direction.

    ``n_up``/``n_down`` count methods with adjusted p below ``level`` in a
    direction; UP or DOWN needs ``min_k`` of them and none against.
    """
    rows = None
    for name, df in sorted(results.items()):
        part = df.select("protein", "log2FC", "pvalue", "adj_pvalue", F.lit(name).alias("method"))
        rows = part if rows is None else rows.unionByName(part)
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col("pvalue")))
    hit = F.col("adj_pvalue") < level
    out = rows.where("pvalue IS NOT NULL").groupBy("protein").agg(
        F.median("log2FC").alias("log2FC"), F.avg(1 / F.tan(p * math.pi)).alias("_c"), F.count(F.lit(1)).alias("n_methods"),
        F.count(F.when(hit & (F.col("log2FC") > 0), 1)).alias("n_up"), F.count(F.when(hit & (F.col("log2FC") < 0), 1)).alias("n_down"),
    )
    out = out.withColumn("pvalue", F.atan2(F.lit(1.0), F.col("_c")) / math.pi).drop("_c")
    call = F.when((F.col("n_up") >= min_k) & (F.col("n_down") == 0), "UP").when((F.col("n_down") >= min_k) & (F.col("n_up") == 0), "DOWN").otherwise("Unchanged")
    return benjamini_hochberg(out.withColumns({"consensus": call, "contrast": F.lit("ensemble")}))


def auto_method(quant: str, complete: bool) -> str:
    """The test taken when none is named: count-aware for aligned roll-ups or missing cells, reproducibility-optimised otherwise."""
    return "deqms" if quant == "directlfq" or not complete else "limrots"


def differential(long: DataFrame, samples: DataFrame, a: str, b: str, method: str = "limma", counts: DataFrame | None = None, precision: DataFrame | None = None) -> DataFrame:
    """Any method by name on ``(protein, sample, value)``."""
    if method == "limma":
        return limma(long, samples, a, b)
    if method == "deqms":
        if counts is None:
            raise ValueError("deqms needs peptide counts")
        return deqms(long, samples, counts, a, b, precision)
    if method in ("rots", "limrots"):
        return rots(long, samples, a, b, moderated=method == "limrots")
    if method == "proda":
        return proda(long, samples, a, b)
    raise ValueError(f"unknown method {method!r}")
