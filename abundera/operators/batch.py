"""Batch detection and correction, principal components, outlier samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abundera.functions.values import is_measured, log2_positive
from abundera.session import collect_bounded, materialize

#: Whole-matrix steps work on the collapsed matrix only; more cells are refused.
MAX_CELLS = 50_000_000
#: Tables of one row a sample may come to the driver up to this length.
MAX_SAMPLES = 100_000
#: Partial sums that come to the driver in one pass.
MAX_PARTS = 64


def sample_prefix(col: Column | str) -> Column:
    """Text before the first ``-``; else letters and digits directly before ``_``; else the whole id."""
    c = F.col(col) if isinstance(col, str) else col
    dash, under = F.regexp_extract(c, "^([^-]*)-", 1), F.regexp_extract(c, "^([A-Za-z]+[0-9]+)_", 1)
    return F.when(F.contains(c, F.lit("-")) & (dash != ""), dash).when(under != "", under).otherwise(c)


def detect_batches(samples: DataFrame, batch: Column) -> DataFrame:
    """``(sample, batch)`` for designs with at least two batches of at least two samples, otherwise no rows."""
    out = samples.select("sample", batch.alias("batch")).where("batch IS NOT NULL").distinct()
    big = out.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    usable = big.agg(F.count(F.lit(1)).alias("k")).scalar() >= 2
    return out.where(usable)


def drop_single_sample_batches(samples: DataFrame) -> DataFrame:
    keep = samples.groupBy("batch").agg(F.count_distinct("sample").alias("n")).where("n >= 2").select("batch")
    return samples.join(keep, "batch", "left_semi")


def match_names(samples: DataFrame, names: DataFrame, max_names: int = 10_000) -> DataFrame:
    """``(sample, <name>)``: of the names that are part of the sample's id the smallest.

    A containment test has no key; instead of a cross join the names, whose
    number is checked, become one array of literals.
    """
    col = names.columns[0]
    found = collect_bounded(names.where(F.col(col).isNotNull()).select(col).distinct(), max_names, "names to match")
    known = F.array(*[F.lit(v) for v in sorted(r[0] for r in found)]) if found else F.array().cast("array<string>")
    hits = F.filter(known, lambda n: F.contains(F.col("sample"), n))
    return samples.select("sample").where("sample IS NOT NULL").distinct().select("sample", F.try_element_at(hits, F.lit(1)).alias(col)).where(F.col(col).isNotNull())


def design_matrix(covariates: pd.DataFrame) -> np.ndarray:
    """Numeric columns as they are, nominal ones one-hot without their first level; constant or dependent ones are errors."""
    cols = []
    for name in covariates:
        c = covariates[name]
        if c.nunique(dropna=False) < 2:
            raise ValueError(f"covariate {name} is constant")
        if pd.api.types.is_numeric_dtype(c):
            cols.append(c.to_numpy(float))
        else:
            cols += [(c == level).to_numpy(float) for level in sorted(c.unique())[1:]]
    x = np.column_stack([np.ones(len(covariates)), *cols]) if cols else np.ones((len(covariates), 1))
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the covariates are linearly dependent")
    return x


def location_scale(long: DataFrame, batches: DataFrame, entity: str = "protein") -> DataFrame:
    """Per entity: batch means and variances moved to the pooled ones (no shrinkage); relational from end to end.

    ``long`` holds log-scale values.  Entities missing in any sample of the
    batches stay as they are.
    """
    v = long.join(batches, "sample")
    n = batches.agg(F.count_distinct("sample").alias("n")).scalar()
    complete = v.where("value IS NOT NULL").groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).select(entity)
    rows = v.join(complete, entity, "left_semi")
    by_batch = rows.groupBy(entity, "batch").agg(F.avg("value").alias("_m"), F.var_samp("value").alias("_v"))
    overall = rows.groupBy(entity).agg(F.avg("value").alias("_gm"))
    pooled = rows.join(by_batch, [entity, "batch"]).groupBy(entity).agg(F.avg((F.col("value") - F.col("_m")) ** 2).alias("_pv"))
    out = rows.join(by_batch, [entity, "batch"]).join(overall, entity).join(pooled, entity)
    scale = F.sqrt(F.when(F.col("_v") > 0, F.col("_pv") / F.col("_v")).otherwise(F.lit(1.0)))
    fixed = out.select(entity, "sample", ((F.col("value") - F.col("_m")) * scale + F.col("_gm")).alias("value"))
    rest = long.join(complete, entity, "left_anti").select(entity, "sample", "value")
    return fixed.unionByName(rest)


def _postmean(g_hat: np.ndarray, g_bar: float, n: np.ndarray, d: np.ndarray, t2: float) -> np.ndarray:
    return (t2 * n * g_hat + d * g_bar) / (t2 * n + d)


def combat(matrix: np.ndarray, batch: np.ndarray, covariates: np.ndarray | None = None, parametric: bool = True, mean_only: bool = False, reference: int | None = None, tol: float = 1e-4, max_iter: int = 1000) -> np.ndarray:
    """Empirical-Bayes batch correction of a complete matrix (entities by samples, log scale).

    The stop rule couples all entities of a batch, so the whole matrix is one
    step; it is the collapsed matrix, never the measurements.
    """
    y, codes = np.asarray(matrix, float), np.unique(batch)
    hot = np.stack([(batch == c).astype(float) for c in codes], axis=1)
    if reference is not None:
        hot[:, codes == reference] = 1.0
    extra = covariates[:, 1:] if covariates is not None and covariates.shape[1] > 1 else np.empty((len(batch), 0))
    design = np.column_stack([hot, extra])
    beta = np.linalg.lstsq(design, y.T, rcond=None)[0]
    sizes = np.array([(batch == c).sum() for c in codes])
    if reference is not None:
        grand = beta[np.flatnonzero(codes == reference)[0]]
        ref = batch == reference
        var = ((y[:, ref] - (design[ref] @ beta).T) ** 2).mean(axis=1)
    else:
        grand = (sizes / sizes.sum()) @ beta[: len(codes)]
        var = ((y - (design @ beta).T) ** 2).mean(axis=1)
    var = np.where(var > 0, var, np.median(var[var > 0]) if (var > 0).any() else 1.0)
    stand = grand[:, None] + (extra @ beta[len(codes) :]).T if extra.size else np.repeat(grand[:, None], y.shape[1], axis=1)
    z = (y - stand) / np.sqrt(var)[:, None]
    out = z.copy()
    for c in codes:
        if reference is not None and c == reference:
            continue
        cols = batch == c
        part, n = z[:, cols], int(cols.sum())
        g_hat = part.mean(axis=1)
        d_hat = np.ones(len(y)) if mean_only or n < 2 else part.var(axis=1, ddof=1)
        g_bar, t2 = g_hat.mean(), g_hat.var(ddof=1)
        if mean_only:
            g, d = (t2 * n * g_hat + g_bar) / (t2 * n + 1), np.ones(len(y))
        elif parametric:
            m, s2 = d_hat.mean(), d_hat.var(ddof=1)
            a, b = ((2 * s2 + m**2) / s2, (m * s2 + m**3) / s2) if s2 > 0 else (2.0, m)
            g, d = g_hat.copy(), d_hat.copy()
            for _ in range(max_iter):
                g_new = _postmean(g_hat, g_bar, np.full(len(y), n), d, t2)
                d_new = (0.5 * ((part - g_new[:, None]) ** 2).sum(axis=1) + b) / (n / 2 + a - 1)
                change = max(np.max(np.abs(g_new - g) / np.where(g == 0, 1, g)), np.max(np.abs(d_new - d) / np.where(d == 0, 1, d)))
                g, d = g_new, d_new
                if change < tol:
                    break
        else:
            g, d = np.empty(len(y)), np.empty(len(y))
            for i in range(len(y)):
                keep = np.arange(len(y)) != i
                sq = ((part[i][None, :] - g_hat[keep][:, None]) ** 2).sum(axis=1)
                like = np.exp(-sq / (2 * d_hat[keep])) / (2 * np.pi * d_hat[keep]) ** (n / 2)
                like = np.where(np.isfinite(like), like, 0)
                w = like.sum()
                g[i], d[i] = (like @ g_hat[keep] / w, like @ d_hat[keep] / w) if w > 0 else (g_hat[i], d_hat[i])
        out[:, cols] = (part - g[:, None]) / np.sqrt(d)[:, None]
    fixed = out * np.sqrt(var)[:, None] + stand
    if reference is not None:
        fixed[:, batch == reference] = y[:, batch == reference]
    return fixed


def whole_matrix(long: DataFrame, step, entity: str = "protein", columns: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Run ``step(values, entities, samples) -> values`` on the collapsed matrix in one task of the cluster.

    For algorithms that are global by nature.  The number of cells is checked
    against ``MAX_CELLS`` first; entities and samples are sorted, so the result
    does not depend on the order of rows.
    """
    cells = long.select(F.col(entity).alias("_e"), F.col("sample").alias("_s"), F.col("value").cast("double").alias("_v"))
    n = cells.agg((F.count_distinct("_e") * F.count_distinct("_s")).alias("n")).first()["n"]
    if n > MAX_CELLS:
        raise ValueError(f"{n} cells: a whole-matrix step takes at most {MAX_CELLS}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="_e", columns="_s", values="_v").sort_index(axis=0).sort_index(axis=1)
        values = step(wide.to_numpy(float), wide.index.to_numpy(), wide.columns.to_numpy())
        rows, cols = np.indices(values.shape)
        out = pd.DataFrame({entity: wide.index.to_numpy()[rows.ravel()], "sample": wide.columns.to_numpy()[cols.ravel()], "value": values.ravel()})
        return out[np.isfinite(out["value"])]

    return cells.groupBy().applyInPandas(run, f"`{entity}` string, sample string, value double")


def combat_long(long: DataFrame, batches: DataFrame, **options) -> DataFrame:
    """ComBat over entities that are complete in all samples; the others come back unchanged."""
    used = long.join(batches.select("sample"), "sample", "left_semi").where("value IS NOT NULL")
    n = batches.agg(F.count_distinct("sample").alias("n")).scalar()
    complete = used.groupBy("protein").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n).select("protein")
    codes = {r["sample"]: r["batch"] for r in collect_bounded(batches.select("sample", "batch").distinct(), MAX_SAMPLES, "samples")}
    levels = {b: i for i, b in enumerate(sorted(set(codes.values())))}

    def step(values: np.ndarray, _: np.ndarray, samples: np.ndarray) -> np.ndarray:
        return combat(values, np.array([levels[codes[s]] for s in samples]), **options)

    fixed = whole_matrix(used.join(complete, "protein", "left_semi"), step)
    return fixed.unionByName(long.join(complete, "protein", "left_anti").select("protein", "sample", "value"))


def pca_scores(long: DataFrame, n_components: int = 2, tol: float = 1e-9) -> DataFrame:
    """``(sample, component, score)``: principal components of the samples over complete entities (log2).

    Block Krylov iteration on the samples' Gram matrix, which is never formed: a
    pass over the entities (one array of all samples each, written once) adds up
    products with a thin block, so a task holds one entity at a time and the
    driver some vectors of one number a sample.  The largest score of a
    component is positive; without a complete entity there is no row.
    """
    spark = long.sparkSession
    v = long.where(is_measured("value")).select("protein", "sample", F.log2("value").alias("y"))
    names = sorted(r["sample"] for r in collect_bounded(v.select("sample").distinct(), MAX_SAMPLES, "samples"))
    n = len(names)
    lists = v.groupBy("protein").agg(F.array_sort(F.collect_list(F.struct("sample", "y"))).alias("l")).where(F.size("l") == n)
    rows = materialize(lists.select(F.transform("l", lambda e: e["y"]).alias("x")), "entities").coalesce(MAX_PARTS)

    def product(q: np.ndarray) -> np.ndarray:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape)
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, n)
                    x = x - x.mean(axis=1, keepdims=True)
                    total += x.T @ (x @ q)
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["t"])

        parts = rows.mapInArrow(scan, "t array<double>").collect()
        return np.sum([np.array(r["t"]) for r in parts], axis=0).reshape(q.shape) if parts else np.zeros(q.shape)

    schema = "sample string, component int, score double"
    if not n or not rows.limit(1).count():
        return spark.createDataFrame([], schema)
    score = _scores(product, n, n_components, tol)
    return spark.createDataFrame([(s, j + 1, float(score[i, j])) for i, s in enumerate(names) for j in range(score.shape[1])], schema)


def _scores(product: Callable[[np.ndarray], np.ndarray], n: int, n_components: int = 2, tol: float = 1e-9) -> np.ndarray:
    """Scores of n samples by block Krylov iteration; ``product`` multiplies the Gram matrix of the centred entities with a thin block."""

    def centred(q: np.ndarray) -> np.ndarray:
        return q - q.mean(axis=0)

    block = min(n, n_components + 8)
    q = np.linalg.qr(centred(np.random.default_rng(0).normal(size=(n, block))))[0]
    basis, images, vectors, values = np.zeros((n, 0)), np.zeros((n, 0)), q, np.zeros(0)
    for _ in range(60):
        size = np.linalg.norm(q, axis=0)
        q, r = np.linalg.qr(centred(q - basis @ (basis.T @ q)))
        q = q[:, np.abs(np.diag(r)) > 1e-10 * size]  # what is left of a column in the basis is rounding
        if not q.shape[1]:
            break
        q = np.linalg.qr(centred(q - basis @ (basis.T @ q)))[0]
        basis, images = np.hstack([basis, q]), np.hstack([images, centred(product(q))])
        inner = basis.T @ images
        values, vectors_in = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(-values)[:block]
        values, vectors_in = values[order], vectors_in[:, order]
        vectors = basis @ vectors_in
        k = min(n_components, len(values))
        gap = images @ vectors_in[:, :k] - vectors[:, :k] * values[:k]
        if np.linalg.norm(gap) <= tol * max(values[0], 1e-300) or basis.shape[1] >= n - 1:
            break
        q = images[:, -q.shape[1] :]
    k = min(n_components, len(values))
    u = vectors[:, :k] * np.sign(vectors[np.abs(vectors[:, :k]).argmax(axis=0), range(k)])
    return u * np.sqrt(np.maximum(values[:k], 0))


class LowFilled:
    """All entities in all samples, gaps filled by the sample's q-quantile (log2), kept as the cells that were measured.

    A filled entity is the row of the samples' quantiles plus its measured
    cells' distances from them, so a pass over the measured cells adds up the
    products with the whole matrix, which is never built; samples can be left
    out of each pass.
    """

    def __init__(self, long: DataFrame, q: float = 0.01, entity: str = "protein") -> None:
        cells = materialize(long.where(F.col(entity).isNotNull()).groupBy(entity, "sample").agg(F.max(log2_positive("value")).alias("v")), "cells")
        low = cells.where("v IS NOT NULL AND sample IS NOT NULL").groupBy("sample").agg(F.percentile("v", q).alias("low"))
        found = sorted((r["sample"], r["low"]) for r in collect_bounded(low, MAX_SAMPLES, "samples"))
        self.names, self.low = [s for s, _ in found], np.array([x for _, x in found])
        self.entities = cells.select(entity).distinct().count()
        codes = cells.sparkSession.createDataFrame([(s, i, float(x)) for i, (s, x) in enumerate(found)], "sample string, _c int, _low double")
        rows = cells.where("v IS NOT NULL").join(F.broadcast(codes), "sample").groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("_c", (F.col("v") - F.col("_low")).alias("d")))).alias("l"))
        self.rows = materialize(rows.select(F.col("l._c").alias("c"), F.col("l.d").alias("d")), "entities").coalesce(MAX_PARTS)

    def scores(self, keep: np.ndarray, n_components: int = 2, tol: float = 1e-9) -> np.ndarray:
        """Principal component scores of the samples in ``keep``, one row each."""
        m, at = int(keep.sum()), np.where(keep, np.cumsum(keep) - 1, -1)
        if not m or not self.entities:
            return np.zeros((m, 0))
        low = self.low[keep] - self.low[keep].mean()

        def product(q: np.ndarray) -> np.ndarray:
            q = q - q.mean(axis=0)
            base = low @ q

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total, sums = np.zeros(q.shape), np.zeros(q.shape[1])
                for batch in batches:
                    ends = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy())
                    codes, gaps = batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()
                    first = 0
                    while first < batch.num_rows:  # about a million cells at a time
                        start = ends[first - 1] if first else 0
                        last = max(first + 1, int(np.searchsorted(ends, start + 1_000_000, side="right")))
                        c, d = at[codes[start : ends[last - 1]]], gaps[start : ends[last - 1]]
                        row = np.repeat(np.arange(last - first), np.diff(ends[first:last], prepend=start))
                        c, d, row, first = c[c >= 0], d[c >= 0], row[c >= 0], last
                        for j in range(q.shape[1]):
                            own = np.bincount(row, d * q[c, j], minlength=1)
                            sums[j] += own.sum()
                            total[:, j] += np.bincount(c, d * (base[j] + own[row]), minlength=m)
                yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([sums], pa.list_(pa.float64()))], names=["t", "s"])

            parts = self.rows.mapInArrow(scan, "t array<double>, s array<double>").collect()
            total = np.sum([np.array(r["t"]) for r in parts], axis=0).reshape(q.shape) if parts else np.zeros(q.shape)
            return total + np.outer(low, self.entities * base + np.sum([np.array(r["s"]) for r in parts], axis=0))

        return _scores(product, m, n_components, tol)


def plane(score: np.ndarray) -> np.ndarray:
    """The first two components as points; a component there is not counts as 0."""
    return np.pad(score[:, :2], ((0, 0), (0, 2 - min(2, score.shape[1]))))


def hdbscan(points: np.ndarray, min_samples: int = 3, min_cluster_size: int = 3) -> np.ndarray:
    """Density clusters (core distances, spanning tree, condensed tree, stability); -1 is noise.

    Distances are taken a block of points, or one point, at a time: memory is in
    proportion to the points, time to their square.
    """
    n = len(points)
    if n < max(min_samples, min_cluster_size):
        return np.full(n, -1)

    def distances(rows: np.ndarray) -> np.ndarray:
        return np.sqrt(sum((rows[:, None, k] - points[None, :, k]) ** 2 for k in range(points.shape[1])))

    kth, step = min(min_samples, n - 1), max(1, 4_000_000 // n)
    core = np.concatenate([np.partition(distances(points[i : i + step]), kth, axis=1)[:, kth] for i in range(0, n, step)])

    def reach(j: int) -> np.ndarray:
        return np.maximum(distances(points[j : j + 1])[0], np.maximum(core[j], core))

    best, near, done, edges = reach(0), np.zeros(n, int), np.zeros(n, bool), []
    done[0] = True
    for _ in range(n - 1):
        j = int(np.where(done, np.inf, best).argmin())
        edges.append((float(best[j]), int(near[j]), j))
        done[j] = True
        row = reach(j)
        closer = ~done & (row < best)
        best[closer], near[closer] = row[closer], j
    parent, size, at, merges = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), n, []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for d, a, b in sorted(edges):
        a, b = find(a), find(b)
        parent[a] = parent[b] = at
        size[at] = size[a] + size[b]
        merges.append((a, b, d))
        at += 1
    kids = {n + i: (a, b, d) for i, (a, b, d) in enumerate(merges)}

    def leaves(i: int) -> list[int]:
        stack, out = [i], []
        while stack:
            j = stack.pop()
            if j < n:
                out.append(j)
            else:
                stack += kids[j][:2]
        return out

    # the condensed tree, parents before children: (top, birth, parent) each
    todo, tops, stability, children = [(2 * n - 2, 0.0, -1)], [], [], []
    while todo:
        node, birth, above = todo.pop()
        name, total = len(tops), 0.0
        tops.append(node)
        children.append([])
        if above >= 0:
            children[above].append(name)
        while node >= n:
            a, b, d = kids[node]
            lam = 1 / d if d > 0 else 1e12
            if size[a] >= min_cluster_size and size[b] >= min_cluster_size:
                total += (lam - birth) * size[node]
                todo += [(b, lam, name), (a, lam, name)]
                break
            small, node = (a, b) if size[a] < min_cluster_size and size[b] >= min_cluster_size else (b, a)
            total += (lam - birth) * size[small]
            if size[node] < min_cluster_size:
                total += (lam - birth) * size[node]
                break
        stability.append(total)
    most, whole = stability.copy(), [True] * len(tops)
    for c in range(len(tops) - 1, -1, -1):
        below = sum(most[k] for k in children[c])
        if children[c] and (below > stability[c] or c == 0):
            most[c], whole[c] = below, False
    chosen, todo = [], [0]
    while todo:
        c = todo.pop()
        if whole[c]:
            chosen.append(leaves(tops[c]))
        else:
            todo += children[c]
    labels = np.full(n, -1)
    for i, members in enumerate(sorted(chosen, key=min)):
        labels[members] = i
    return labels


def outlier_samples(long: DataFrame, rounds: int = 5, min_samples: int = 3, fill: bool = False) -> list[str]:
    """Samples that fall out of every density cluster of the first two components, round after round.

    The components are those of the complete entities, or with ``fill`` of all
    entities, gaps filled as in ``LowFilled``.
    """
    gone: list[str] = []
    filled = LowFilled(long) if fill else None
    for _ in range(rounds):
        if filled:
            keep = ~np.isin(np.array(filled.names, object), gone)
            names, points = np.array(filled.names, object)[keep].tolist(), plane(filled.scores(keep))
        else:
            left = long.where(~F.col("sample").isin(*gone)) if gone else long
            scores = pca_scores(left).groupBy("sample").pivot("component", [1, 2]).agg(F.first("score")).orderBy("sample").collect()  # as many as ``pca_scores`` let through
            names, points = [r["sample"] for r in scores], np.array([[r[1], r[2]] for r in scores], float)
        if len(names) <= min_samples:
            break
        out = [s for s, c in zip(names, hdbscan(points, min_samples)) if c == -1]
        if not out or len(out) == len(names):
            break
        gone += out
    return sorted(gone)
