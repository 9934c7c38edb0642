"""Imputation of the protein by sample matrix: log2 in, linear out.

Fills by a constant, a sample statistic or a quantile are relational: the grid
of entities and samples is built from the two sets of names, each cell missing
in it is filled by a join.  Draws come from a counter-based stream indexed by
sample and entity, so any partitioning gives the same numbers.  Methods that
work on whole rows against each other run on the collapsed matrix.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundera.functions import special
from abundera.functions.java import java_object, map_partitions
from abundera.functions.values import log2_positive
from abundera.operators.batch import whole_matrix
from abundera.operators.sparse import measured_cells
from abundera.operators.windows import global_ordinals
from abundera.session import collect_bounded, materialize

#: The grid has one array element per sample, so samples are counted first.
MAX_SAMPLES = 100_000
#: Measured values that the nearest neighbours are found from.
MAX_MEASURED = 20_000_000
#: Cells of a block of entities.
MAX_BLOCK = 4_000_000
#: Cells of a filled matrix up to which it is held in memory; a larger one is in a file.
MAX_HELD = 80_000_000


def grid(long: DataFrame, entity: str = "protein") -> DataFrame:
    """``(entity, sample, v)``: every entity in every sample, log2 value or null; see ``grid_and_cells``."""
    return grid_and_cells(long, entity)[0]


def grid_and_cells(long: DataFrame, entity: str = "protein") -> tuple[DataFrame, DataFrame]:
    """The grid, and the cells with a row of their own, from which statistics of the samples are read.

    Built by exploding the sorted array of all samples per entity, not by a
    cross join; the number of samples is checked.
    """
    values = materialize(long.where(F.col(entity).isNotNull()).groupBy(entity, "sample").agg(F.max(log2_positive("value")).alias("v")), "cells")  # read four times
    names = values.where("sample IS NOT NULL").select("sample").distinct()
    if names.limit(MAX_SAMPLES + 1).count() > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    all_samples = names.agg(F.array_sort(F.collect_list("sample")).alias("s")).scalar()
    cells = values.select(entity).distinct().select(entity, F.explode(all_samples).alias("sample"))
    return cells.join(values, [entity, "sample"], "left"), values


def _linear(v: Column) -> Column:
    return F.pow(F.lit(2.0), v)


def _finish(g: DataFrame, fill: Column, entity: str) -> DataFrame:
    """Linear values with a mark on filled cells; cells without a fill have no row."""
    new = F.coalesce("v", fill)
    return g.select(entity, "sample", _linear(new).alias("value"), F.col("v").isNull().alias("imputed")).where("value IS NOT NULL")


def constant(long: DataFrame, value: float = 0.0, entity: str = "protein") -> DataFrame:
    """The constant on the log2 scale: 0 gives the linear value 1."""
    return _finish(grid(long, entity), F.lit(float(value)), entity)


def by_sample(long: DataFrame, how: str, entity: str = "protein", q: float = 0.01) -> DataFrame:
    """Mean, median, most frequent value, or the q-quantile (``mindet``) of each sample on the log2 scale."""
    g, cells = grid_and_cells(long, entity)
    agg = {"mean": lambda: F.avg("v"), "median": lambda: F.median("v"), "mindet": lambda: F.percentile("v", q)}
    if how == "most_frequent":
        counts = cells.where("v IS NOT NULL").groupBy("sample", "v").agg(F.count(F.lit(1)).alias("n"))
        stat = counts.groupBy("sample").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), "v")).alias("_f"))
    else:
        stat = cells.groupBy("sample").agg(agg[how]().alias("_f"))
    return _finish(g.join(stat, "sample"), F.col("_f"), entity)


def _ordinals(df: DataFrame, col: str, name: str) -> DataFrame:
    """Place of each distinct name in sorted order, the index of the counter-based draws."""
    return global_ordinals(df, col, name)


def min_prob(long: DataFrame, q: float = 0.01, tune: float = 1.0, seed: int = 42, entity: str = "protein") -> DataFrame:
    """Draws from N(q-quantile of the sample, (tune * median entity sd)^2); sd over entities seen in more than half the samples."""
    g, cells = grid_and_cells(long, entity)
    stat = cells.groupBy("sample").agg(F.percentile("v", q).alias("_q"))
    sd = g.groupBy(entity).agg(F.stddev_samp("v").alias("s"), F.count("v").alias("n"), F.count(F.lit(1)).alias("all")).where("n > all / 2 AND s IS NOT NULL").agg(F.coalesce(F.median("s"), F.lit(0.0)).alias("m")).scalar()
    rows = _ordinals(long, entity, "_row")
    indexed = g.join(rows, entity).join(_ordinals(long, "sample", "_col"), "sample").join(stat, "sample")
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()

    @F.pandas_udf("double")
    def draw(index: pd.Series) -> pd.Series:
        return pd.Series(special.normals(seed, index.to_numpy(np.int64)))

    return _finish(indexed, F.col("_q") + tune * sd * draw((F.col("_col") * total + F.col("_row")).cast("bigint")), entity)


def qrilc_fill(v: np.ndarray, u: np.ndarray, tune: float = 1.0, sparse: str = "error") -> np.ndarray:
    """Left-censored draws for the missing values of one sample; see ``qrilc``."""
    lack = ~np.isfinite(v)
    m = lack.mean()
    if m == 0:
        return v
    have = v[~lack]
    if m >= 0.99 or len(have) < 2:
        if sparse == "leave":
            return v
        raise ValueError("too few values for a quantile regression")
    p = 0.001 + np.arange(100) * 0.01
    z = special.normal_quantile(m + 0.001 + (0.99 - m) * np.arange(100) / 99)
    y = np.quantile(have, np.minimum(p, 1.0))
    sd = float(((z - z.mean()) * (y - y.mean())).sum() / ((z - z.mean()) ** 2).sum())
    mean = float(y.mean() - sd * z.mean())
    upper = mean + sd * float(special.normal_quantile(m + 0.001)[0])
    s = tune * sd
    out = v.copy()
    out[lack] = mean + s * special.normal_quantile(u[lack] * special.normal_cdf((upper - mean) / s)) if s > 0 else upper
    return out


def _by_sample_step(long: DataFrame, entity: str, step: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """A fill that needs one sample's whole column (one value an entity) at a time."""
    g = grid(long, entity).join(_ordinals(long, "sample", "_col"), "sample")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(entity)
        v = pdf["v"].to_numpy(float)
        return pd.DataFrame({entity: pdf[entity], "sample": pdf["sample"], "value": np.exp2(step(v, int(pdf["_col"].iat[0]))), "imputed": ~np.isfinite(v)}).dropna(subset=["value"])

    return g.groupBy("sample").applyInPandas(run, f"`{entity}` string, sample string, value double, imputed boolean")


def qrilc(long: DataFrame, tune: float = 1.0, seed: int = 42, entity: str = "protein", sparse: str = "error") -> DataFrame:
    """Quantile regression of left-censored values: the normal the observed quantiles come from, drawn below its censoring point.

    A sample with 99 % missing is an error, or with ``sparse="leave"`` stays as
    it is (its missing cells have no row).
    """
    return _by_sample_step(long, entity, lambda v, col: qrilc_fill(v, special.uniforms(seed, col * len(v) + np.arange(len(v))), tune, sparse))


def gaussian_mixture(long: DataFrame, entity: str = "protein") -> DataFrame:
    """The lower mean of a two-component mixture of the sample; samples with fewer than four values take their minimum."""

    def step(v: np.ndarray, _: int) -> np.ndarray:
        have = v[np.isfinite(v)]
        low = special.two_gaussians(have)[1][0] if len(have) >= 4 and have.std() > 0 else have.min() if len(have) else np.nan
        return np.where(np.isfinite(v), v, low)

    return _by_sample_step(long, entity, step)


# ---- whole-matrix methods -----------------------------------------------------------------------------------------------


def _room(shape: tuple[int, int]) -> np.ndarray:
    """An empty matrix, in a temporary file where it is large."""
    if shape[0] * shape[1] <= MAX_HELD:
        return np.empty(shape)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, float, "w+", shape=shape)


def _distances(x: np.ndarray, rows: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Root of the squared distance over common columns, scaled to all columns; infinite without any."""
    have = np.isfinite(x)
    z = np.where(have, x, 0.0)
    a, b, ha, hb = z[rows], z[donors], have[rows].astype(float), have[donors].astype(float)
    sq = (a**2) @ hb.T + ha @ (b**2).T - 2 * a @ b.T
    n = ha @ hb.T
    return np.where(n > 0, np.sqrt(np.maximum(sq, 0) * x.shape[1] / np.maximum(n, 1)), np.inf)


def knn_fill(x: np.ndarray, k: int = 5) -> np.ndarray:
    """Mean of the k nearest rows that have the column; the column mean where there are none."""
    out, have = x.copy(), np.isfinite(x)
    col = np.array([x[have[:, j], j].mean() if have[:, j].any() else np.nan for j in range(x.shape[1])])
    need = np.flatnonzero(~have.all(axis=1))
    for at in range(0, len(need), 256):
        rows = need[at : at + 256]
        d = _distances(x, rows, np.arange(len(x)))
        d[np.arange(len(rows)), rows] = np.inf
        for r, i in enumerate(rows):
            order = np.argsort(d[r], kind="stable")
            order = order[np.isfinite(d[r][order])]
            for j in np.flatnonzero(~have[i]):
                donors = order[have[order, j]][:k]
                out[i, j] = x[donors, j].mean() if len(donors) else col[j]
    return out


def knn_block(first: int, last: int, starts: np.ndarray, col: np.ndarray, y: np.ndarray, by_col: tuple[np.ndarray, np.ndarray, np.ndarray], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``knn_fill`` of the rows ``first`` to ``last`` from measured cells alone (rows start at ``starts``): values, and which were measured.

    ``by_col`` is where each column starts, the rows that have it, in order, and their values.
    """
    at, donors, values = by_col
    n, m = len(starts) - 1, len(at) - 1
    far = np.full((last - first, n), np.inf)
    out, have = np.empty((last - first, m)), np.zeros((last - first, m), bool)
    for r, i in enumerate(range(first, last)):
        own = col[starts[i] : starts[i + 1]]
        much = at[own + 1] - at[own]
        cells = np.repeat(at[own] - (np.cumsum(much) - much), much) + np.arange(much.sum())
        near, gap = donors[cells], np.repeat(y[starts[i] : starts[i + 1]], much) - values[cells]
        common = np.bincount(near, minlength=n)
        common[i] = 0
        hit = np.flatnonzero(common)
        far[r, hit] = np.sqrt(np.bincount(near, gap * gap, minlength=n)[hit] * m / common[hit])
        have[r, own] = True
    for j in range(m):
        v = values[at[j] : at[j + 1]]
        d = far[:, donors[at[j] : at[j + 1]]]
        pick = np.isfinite(d)
        if len(v) > k:
            pick &= d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k]
        count = pick.sum(axis=1)
        for r in np.flatnonzero(count > k):  # equal distances: the first rows
            order = np.argsort(d[r], kind="stable")[:k]
            pick[r] = False
            pick[r, order] = True
            count[r] = k
        out[:, j] = np.where(count > 0, pick @ v / np.maximum(count, 1), v.mean() if len(v) else np.nan)
    for r, i in enumerate(range(first, last)):
        out[r, col[starts[i] : starts[i + 1]]] = y[starts[i] : starts[i + 1]]
    return out, have


_ROWS = "e string, v array<double>, i array<boolean>"


def _block(names: list[str], v: np.ndarray, have: np.ndarray) -> pa.RecordBatch:
    """Filled rows (log2) and which cells were measured, as ``_ROWS``."""
    offsets = pa.array(np.arange(len(names) + 1) * v.shape[1], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(a.ravel())) for a in (np.exp2(v), ~have)]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *lists], names=["e", "v", "i"])


def _exploded(rows: DataFrame, samples: list[str], entity: str) -> DataFrame:
    """``_ROWS`` as ``(entity, sample, value, imputed)``; cells without a fill have no row."""
    all_samples = rows.sparkSession.createDataFrame([(samples,)], "s array<string>").agg(F.first("s")).scalar()
    cells = rows.select("e", "i", F.posexplode("v").alias("p", "value"))
    return cells.where(~F.isnan("value")).select(F.col("e").alias(entity), F.get(all_samples, F.col("p")).alias("sample"), "value", F.get("i", F.col("p")).alias("imputed"))


def knn(long: DataFrame, entity: str = "protein", k: int = 5) -> DataFrame:
    """Mean of the k nearest entities that have the sample, a block of entities a task; tasks get the measured cells, never the matrix."""
    spark = long.sparkSession
    logs = materialize(long.where(F.col(entity).isNotNull()).select(entity, "sample", log2_positive("value").alias("y")), "logs")
    x = measured_cells(logs, MAX_MEASURED, entity)
    bare = logs.groupBy(entity).agg(F.count("y").alias("_n")).where("_n = 0").select(entity)
    names = x.names + sorted(r[0] for r in collect_bounded(bare, MAX_MEASURED, "entities without a value"))
    samples = [c for (c,) in x.columns]
    order = np.lexsort((x.row, x.col))
    by_col = (np.searchsorted(x.col[order], np.arange(len(samples) + 1)), x.row[order], x.y[order])
    shared = spark.sparkContext.broadcast((names, np.searchsorted(x.row, np.arange(len(names) + 1)), x.col, x.y, by_col))
    size = max(1, min(128, MAX_BLOCK // max(len(names), len(samples), 1)))
    blocks = -(-len(names) // size)

    def fill(batches):
        names, starts, col, y, by_col = shared.value
        for batch in batches:
            for b in batch.column(0).to_pylist():
                first, last = b * size, min((b + 1) * size, len(names))
                v, have = knn_block(first, last, starts, col, y, by_col, k)
                yield _block(names[first:last], v, have)

    return _exploded(spark.range(blocks, numPartitions=max(1, min(blocks, 256))).mapInArrow(fill, _ROWS), samples, entity)


def seqknn_fill(x: np.ndarray, k: int = 10) -> np.ndarray:
    """Rows in order of missing cells, filled from the nearest complete ones by 1/d^2 weights, then donors themselves."""
    out, lack = x.copy(), (~np.isfinite(x)).sum(axis=1)
    pool = list(np.flatnonzero(lack == 0))
    if not pool:
        raise ValueError("no complete row to start from")
    for i in sorted(np.flatnonzero(lack > 0), key=lambda r: (lack[r], r)):
        have = np.isfinite(x[i])
        if have.any():
            d = ((out[pool][:, have] - x[i, have]) ** 2).sum(axis=1)
            near = np.argsort(d, kind="stable")[:k]
            w = 1 / np.maximum(d[near], 1e-12)
            out[i, ~have] = (w / w.sum()) @ out[np.array(pool)[near]][:, ~have]
        else:
            out[i] = out[pool].mean(axis=0)
        pool.append(i)
    return out


def bpca_of_cells(row: np.ndarray, col: np.ndarray, y: np.ndarray, n: int, d: int, size: int = 1024, n_components: int | None = None, rounds: int = 100, tol: float = 1e-4) -> Iterator[np.ndarray]:
    """Variational Bayesian principal components: missing cells are estimated along with the loadings, unneeded components shrink away.

    From the measured cells, by row; blocks of filled rows.  The filled matrix
    is ``mu + t w'`` but at the measured cells, so only the scores ``t``, what
    these cells have besides, and matrices of the columns are held.
    """
    k = min(n_components or d - 1, d - 1, n - 1)
    count = np.bincount(col, minlength=d)
    mu = np.bincount(col, y, minlength=d) / np.maximum(count, 1)
    starts = np.searchsorted(row, np.arange(n + 1))
    order = np.argsort(col, kind="stable")
    by_col = np.split(order, np.cumsum(count)[:-1])
    rest = y - mu[col]
    shown, w_shown, t = mu, np.zeros((d, max(k, 0))), _room((n, max(k, 0)))
    t[:] = 0
    wide = max(1, MAX_BLOCK // max(d, 1))
    blocks = [(i, min(i + wide, n)) for i in range(0, n, wide)]

    def cells(i: int, j: int) -> np.ndarray:
        """Rows ``i`` to ``j`` of ``rest``, zero where nothing is measured."""
        own = slice(starts[i], starts[j])
        out = np.zeros((j - i, d))
        out[row[own] - i, col[own]] = rest[own]
        return out

    if k >= 1:
        gram = np.zeros((d, d))
        for i, j in blocks:
            z = cells(i, j)
            gram += z.T @ z
        s2, v = np.linalg.eigh(gram)
        s2 = np.where(s2 > 1e-13 * d * max(s2[-1], 0), s2, 0.0)[::-1][:k]
        w = v[:, ::-1][:, :k] * np.sqrt(s2 / n)
        total = float(np.trace(gram)) / n
        del gram, v
        tau = 1.0 / max(1e-10, (total - float(s2.sum() / n)) / max(1, d - k))
        tau = min(max(tau, 1e-10), 1e10)
        alpha = (2e-10 + d) / (tau * (w**2).sum(axis=0) + 2e-10)
        last, ww, gap = tau, w.T @ w, np.zeros(d)
        for step in range(rounds):
            m = np.linalg.inv(np.eye(k) + tau * ww)
            b = tau * w @ m
            turn = w_shown.T @ b
            tt, st = np.zeros((k, k)), np.zeros(k)
            for i, j in blocks:
                z = t[i:j] @ turn + gap @ b
                for r in range(i, j):
                    own = slice(starts[r], starts[r + 1])
                    z[r - i] += rest[own] @ b[col[own]]
                t[i:j] = z
                tt += z.T @ z
                st += z.sum(axis=0)
            del b, turn
            shown, w_shown = mu, w
            ct, level = np.zeros((d, k)), np.zeros(len(y))
            for j, own in enumerate(by_col):
                z = t[row[own]]
                level[own] = z @ w[j]
                rest[own] = y[own] - mu[j] - level[own]
                ct[j] = rest[own] @ z
            extra = np.bincount(col, rest, minlength=d)
            mu = shown + extra / n
            gap = shown - mu
            wt = w @ tt
            square = float((wt * w).sum() + 2 * (level @ rest) + rest @ rest + n * (gap @ gap) + 2 * gap @ (w @ st) + 2 * gap @ extra)
            ct += wt + np.outer(gap, st)
            del wt
            m *= n
            m += tt
            m[np.diag_indices(k)] += alpha / tau
            w = np.linalg.solve(m, ct.T).T
            m[np.diag_indices(k)] -= alpha / tau
            ww = w.T @ w
            tau = 1.0 / max((square - 2 * float((ct * w).sum()) + float((m * ww).sum())) / (n * d), 1e-10)
            alpha = (2e-10 + d) / (tau * (w**2).sum(axis=0) + 2e-10)
            del ct, m
            if step > 5 and abs(np.log10(tau) - np.log10(last)) < tol:
                break
            last = tau
    for i in range(0, n, size):
        j = min(i + size, n)
        own = slice(starts[i], starts[j])
        out = shown + t[i:j] @ w_shown.T
        out[row[own] - i, col[own]] = y[own]
        yield out


def bpca_fill(x: np.ndarray, **options) -> np.ndarray:
    """``bpca_of_cells`` of a matrix."""
    row, col = np.nonzero(np.isfinite(x))
    return np.concatenate(list(bpca_of_cells(row, col, x[row, col], *x.shape, **options)))


def impseq_fill(x: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Sequential conditional normal: complete rows give moments, each further row is filled by regression and enters the moments."""
    have = np.isfinite(x)
    lack = (~have).sum(axis=1)
    out, start = x.copy(), np.flatnonzero(lack == 0)
    if len(start) < 2:
        raise ValueError("fewer than two complete rows to start from")
    n, mean = len(start), x[start].mean(axis=0)
    scatter = (x[start] - mean).T @ (x[start] - mean)
    rest = order if order is not None else sorted(np.flatnonzero(lack > 0), key=lambda r: (lack[r], r))
    for i in rest:
        o, m = have[i], ~have[i]
        if o.any():
            cov = scatter / (n - 1)
            gap = cov[np.ix_(o, o)] + 1e-9 * np.trace(cov) / len(cov) * np.eye(int(o.sum()))
            out[i, m] = mean[m] + cov[np.ix_(m, o)] @ np.linalg.solve(gap, x[i, o] - mean[o])
        else:
            out[i] = mean
        delta = out[i] - mean
        n += 1
        mean = mean + delta / n
        scatter = scatter + np.outer(delta, delta) * (n - 1) / n
    return out


def outlyingness(x: np.ndarray, directions: int = 250, seed: int = 42) -> np.ndarray:
    """Largest distance of each row from the median over random directions through pairs of rows, in MADs."""
    u = special.uniforms(seed, np.arange(2 * directions)).reshape(directions, 2)
    a, b = (u * len(x)).astype(int).T
    axes = x[a] - x[b]
    norm = np.linalg.norm(axes, axis=1)
    p = x @ (axes[norm > 0] / norm[norm > 0][:, None]).T
    med = np.median(p, axis=0)
    mad = np.median(np.abs(p - med), axis=0) * 1.4826
    return (np.abs(p - med)[:, mad > 0] / mad[mad > 0]).max(axis=1) if (mad > 0).any() else np.zeros(len(x))


def impseqrob_fill(x: np.ndarray, keep: float = 0.9) -> np.ndarray:
    """Sequential filling whose starting moments leave out the most outlying complete rows."""
    lack = (~np.isfinite(x)).sum(axis=1)
    full = np.flatnonzero(lack == 0)
    if len(full) < 4:
        return impseq_fill(x)
    far = outlyingness(x[full])
    odd = full[far > np.quantile(far, keep)]
    rows = np.array([i for i in range(len(x)) if i not in set(odd.tolist())])
    out = x.copy()
    out[rows] = impseq_fill(x[rows])
    return out


class _Draws:
    """The counter-based stream from its start, some thousands at a time."""

    def __init__(self, seed: int):
        self.seed, self.made, self.at, self.have = seed, 0, 0, np.zeros(0)

    def __call__(self, n: int) -> np.ndarray:
        if self.at + n > len(self.have):
            more = max(n, 65_536)
            self.have = np.concatenate([self.have[self.at :], special.uniforms(self.seed, np.arange(self.made, self.made + more))])
            self.made, self.at = self.made + more, 0
        self.at += n
        return self.have[self.at - n : self.at]


def _quantiles(s: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``np.quantile`` of each sorted row at its own levels."""
    v = q * (s.shape[1] - 1)
    lo = v.astype(np.intp)
    t = v - lo
    at = lo + np.arange(0, s.size, s.shape[1])[:, None]
    flat = s.ravel()
    a, b = flat.take(at), flat.take(np.minimum(at + 1, s.size - 1))
    gap = b - a
    return np.where(t >= 0.5, b - gap * (1 - t), a + gap * t)


def _grow(x: np.ndarray, j: int, rows: np.ndarray, y: np.ndarray, level: int, uniform: _Draws):
    """A regression tree of ``y`` on the columns ``x`` (one a row here) but ``j``: ``(column, cut, left, right)`` or a mean."""
    n, d = len(y), len(x) - 1
    mean = float(np.add.reduce(y) / n)
    if level == 0 or n < 6:
        return mean
    gap = y - mean
    spread = float(gap @ gap)
    if not spread:
        return mean
    pick = np.sort((uniform(max(1, int(np.sqrt(d)))) * d).astype(int))
    first = np.ones(len(pick), bool)
    np.not_equal(pick[1:], pick[:-1], out=first[1:])
    pick = pick[first]
    levels = uniform(4 * len(pick)).reshape(-1, 4) * 0.8 + 0.1
    pick += pick >= j
    a = x[pick].take(rows, axis=1)
    s = np.sort(a, axis=1)
    vary = s[:, 0] < s[:, -1]
    if not vary.all():
        pick, a, s, levels = pick[vary], a[vary], s[vary], levels[vary]
    if not len(pick):
        return mean
    cut = _quantiles(s, levels)
    left = (a[:, None, :] <= cut[:, :, None]).reshape(-1, n)
    share = left.astype(float)
    k = share @ np.ones(n)
    ok = ((k > 2) & (k < n - 2)).nonzero()[0]
    if not len(ok):
        return mean
    k = k[ok]
    gain = (share @ gap)[ok] ** 2 * (1 / k + 1 / (n - k))
    near = ok[gain >= gain.max() - 1e-9 * spread]
    best = near[0]
    if len(near) > 1:  # splits into other sets of rows, equal up to rounding: the first of the least loss
        side = left[near]
        same = side == side[0]
        if not (same.all(axis=1) | ~same.any(axis=1)).all():
            loss = [y[v].var() * v.sum() + y[~v].var() * (~v).sum() for v in side]
            best = near[int(np.argmin(loss))]
    v, (f, c) = left[best], divmod(int(best), 4)
    return int(pick[f]), float(cut[f, c]), _grow(x, j, rows[v], y[v], level - 1, uniform), _grow(x, j, rows[~v], y[~v], level - 1, uniform)


def _leaves(x: np.ndarray, tree, values: list[float], kind: type):
    """Number of the leaf of each row (one number where there is no split); ``values`` gets the leaves' means."""
    if not isinstance(tree, tuple):
        values.append(tree)
        return kind(len(values) - 1)
    a, b = _leaves(x, tree[2], values, kind), _leaves(x, tree[3], values, kind)
    out = (x[tree[0]] <= tree[1]).astype(kind)
    out *= b - a  # b is the larger
    return np.subtract(b, out, out=out)


def forest_of_cells(row: np.ndarray, col: np.ndarray, y: np.ndarray, n: int, d: int, rounds: int = 4, trees: int = 20, depth: int = 6, seed: int = 42) -> np.ndarray:
    """Iterated random-forest regression of each column on the others, columns in order of missing cells.

    From the measured cells, by row; a tree is grown on the rows that have its
    column.  The filled matrix is held by row, where trees are grown from, and
    by column, where they are followed.
    """
    count = np.bincount(col, minlength=d)
    order = np.argsort(col, kind="stable")
    have = np.split(row[order], np.cumsum(count)[:-1])
    out = _room((d, n))
    out[:] = (np.bincount(col, y, minlength=d) / np.maximum(count, 1))[:, None]
    out[col, row] = y
    by_row = _room((n, d))
    by_row[:] = out.T
    uniform, kind = _Draws(seed), np.uint8 if depth <= 8 else np.int64
    for _ in range(rounds):
        moved = 0.0
        for j in np.argsort(n - count, kind="stable"):
            o = have[j]
            if not 0 < len(o) < n or d == 1:
                continue
            x, own, votes = np.ascontiguousarray(by_row[o].T), out[j, o], np.zeros(n)
            for _ in range(trees):
                pick = (uniform(len(o)) * len(o)).astype(int)
                values: list[float] = []
                leaf = _leaves(out, _grow(x, j, pick, own[pick], depth, uniform), values, kind)
                votes += np.array(values).take(leaf)
            votes /= trees
            votes[o] = own
            moved = max(moved, float(np.abs(votes - out[j]).max()))
            out[j] = by_row[:, j] = votes
        if moved < 1e-6:
            break
    return by_row


def forest_fill(x: np.ndarray, **options) -> np.ndarray:
    """``forest_of_cells`` of a matrix."""
    row, col = np.nonzero(np.isfinite(x))
    return forest_of_cells(row, col, x[row, col], *x.shape, **options)


_MATRIX = {"knn": knn_fill, "seqknn": seqknn_fill, "bpca": bpca_fill, "impseq": impseq_fill, "impseqrob": impseqrob_fill, "missforest": forest_fill}


def _forest_rows(spark: SparkSession, names: list[str], row: np.ndarray, col: np.ndarray, y: np.ndarray, d: int, size: int, rounds: int = 4, trees: int = 20, depth: int = 6, seed: int = 42) -> DataFrame:
    """``forest_of_cells`` in the JVM of one task: a tree of some hundred cells takes numpy mostly calls."""
    n = len(names)
    starts = np.searchsorted(row, np.arange(n + 1))
    col, y = col.astype("<i4"), y.astype("<f8")
    packed = [pa.array([v[i:j].tobytes() for i, j in zip(starts[:-1], starts[1:])], pa.binary()) for v in (col, y)]
    cells = spark.createDataFrame(pa.table({"at": pa.array(range(n), pa.int64()), "e": pa.array(names, pa.string()), "c": packed[0], "y": packed[1]}))
    ordered = cells.repartition(1).sortWithinPartitions("at").select("e", "c", "y")
    filled = map_partitions(ordered, java_object(spark, "Forest").setup(d, rounds, trees, depth, seed, MAX_HELD), "e string, c binary, v binary")

    def unpack(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, size):
                names, own, values = (c.to_pylist() for c in batch.slice(first, size).columns)
                have = np.zeros((len(names), d), bool)
                for i, c in enumerate(own):
                    have[i, np.frombuffer(c, "<i4")] = True
                yield _block(names, np.frombuffer(b"".join(values), "<f8").reshape(len(names), d), have)

    return _spread(filled, n * d).mapInArrow(unpack, _ROWS)


def _spread(rows: DataFrame, cells: int) -> DataFrame:
    return rows.repartition(max(1, -(-cells // MAX_BLOCK)))


#: Fills from the measured cells.
_OF_CELLS = ("bpca", "missforest")


def of_cells(long: DataFrame, method: str, entity: str = "protein", **options) -> DataFrame:
    """A method of ``_OF_CELLS`` in one task, which gets the measured cells and gives the filled rows some at a time."""
    spark = long.sparkSession
    logs = materialize(long.where(F.col(entity).isNotNull() & F.col("sample").isNotNull()).select(entity, "sample", log2_positive("value").alias("y")), "logs")
    x = measured_cells(logs, MAX_MEASURED, entity)
    if ((np.diff(x.row) == 0) & (np.diff(x.col) == 0)).any():
        raise ValueError("an entity has two values in a sample")
    bare = logs.groupBy(entity).agg(F.count("y").alias("_n")).where("_n = 0").select(entity)
    names = x.names + sorted(r[0] for r in collect_bounded(bare, MAX_MEASURED, "entities without a value"))
    samples = sorted(r[0] for r in collect_bounded(logs.select("sample").distinct(), MAX_SAMPLES, "samples"))
    place = {s: i for i, s in enumerate(samples)}
    col = np.array([place[c] for (c,) in x.columns], np.int32)[x.col]
    n, d = len(names), len(samples)
    size = max(1, min(128, MAX_BLOCK // max(d, 1)))
    if method == "missforest":
        return _exploded(_forest_rows(spark, names, x.row, col, x.y, d, size, **options), samples, entity)
    shared = spark.sparkContext.broadcast((names, x.row, col, x.y))

    def fill(batches):
        names, row, col, y = shared.value
        starts = np.searchsorted(row, np.arange(n + 1))
        for batch in batches:
            for _ in range(batch.num_rows if n else 0):
                first = 0
                for v in bpca_of_cells(row, col, y, n, d, size=size, **options):
                    own = slice(starts[first], starts[first + len(v)])
                    have = np.zeros(v.shape, bool)
                    have[row[own] - first, col[own]] = True
                    yield _block(names[first : first + len(v)], v, have)
                    first += len(v)

    rows = spark.range(1, numPartitions=1).mapInArrow(fill, _ROWS)
    return _exploded(_spread(rows, n * d), samples, entity)


def on_matrix(long: DataFrame, method: str, entity: str = "protein", **options) -> DataFrame:
    """A whole-matrix method on the collapsed matrix (``knn`` and ``_OF_CELLS`` from its measured cells); marks which cells were filled."""
    if method == "knn":
        return knn(long, entity, **options)
    if method in _OF_CELLS:
        return of_cells(long, method, entity, **options)
    step = lambda x, _e, _s: np.exp2(_MATRIX[method](x, **options))
    logs = long.select(entity, "sample", log2_positive("value").alias("value"))
    filled = whole_matrix(logs, step, entity)
    have = logs.where("value IS NOT NULL").select(entity, "sample", F.lit(False).alias("_no"))
    return filled.join(have, [entity, "sample"], "left").select(entity, "sample", "value", F.coalesce("_no", F.lit(True)).alias("imputed"))


def impute(long: DataFrame, method: str, **options) -> DataFrame:
    """Any method by name."""
    if method in ("zero", "constant"):
        return constant(long, **options)
    if method in ("mean", "median", "most_frequent", "mindet"):
        return by_sample(long, method, **options)
    table = {"minprob": min_prob, "qrilc": qrilc, "gms": gaussian_mixture}
    if method in table:
        return table[method](long, **options)
    if method in _MATRIX:
        return on_matrix(long, method, **options)
    raise ValueError(f"unknown imputation method {method!r}")
