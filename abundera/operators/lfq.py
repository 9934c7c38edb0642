"""Label-free roll-ups that solve one small problem per protein: MaxLFQ, DirectLFQ, cell precision.

Rows are reduced to one per species and sample before the grouped map, so what
a task gathers for a protein is its measured cells; a protein of
more than ``MAX_CELLS`` of them takes the relational path (pair medians by join
and percentile aggregate) into the same solver, which then sees pairs only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions.values import is_measured
from abundera.operators.normalize import align_profiles
from abundera.operators.windows import global_ordinals
from abundera.session import materialize

#: Measured cells (species and sample) of a protein up to which it is solved from its rows.
MAX_CELLS = 5_000_000
#: Ratios of one protein that are held at a time.
MAX_PAIRS = 500_000
#: Samples up to which a component is solved by elimination.
MAX_DIRECT = 1_500


def species_cells(ions: DataFrame) -> DataFrame:
    """One row per protein, species (peptidoform and charge) and sample: repeated rows summed, others than measured dropped."""
    rows = ions.where(is_measured("intensity"))
    return rows.groupBy("protein", "peptidoform", "charge", "sample").agg(F.sum("intensity").alias("intensity"))


class _Links:
    """Symmetric matrix of linked samples, a bit a pair."""

    def __init__(self, n: int):
        self.n, self.bits = n, np.zeros((n, -(-n // 8)), np.uint8)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in ((a, b), (b, a)):
            i, j = i.astype(np.int64), j.astype(np.int64)
            np.bitwise_or.at(self.bits.reshape(-1), i * self.bits.shape[1] + (j >> 3), np.uint8(128) >> (j & 7).astype(np.uint8))

    def rows(self, at) -> np.ndarray:
        return np.unpackbits(self.bits[at], axis=-1, count=self.n)

    def near(self, at: np.ndarray) -> np.ndarray:
        """Samples linked to any of these."""
        out = np.zeros(self.bits.shape[1], np.uint8)
        for i in range(0, len(at), 256):
            out |= np.bitwise_or.reduce(self.bits[at[i : i + 256]], axis=0)
        return np.unpackbits(out, count=self.n).astype(bool)

    def counts(self) -> np.ndarray:
        return np.bitwise_count(self.bits).sum(axis=1, dtype=float)


def _conjugate(links: _Links, deg: np.ndarray, c: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Mean-free solution on a large component ``c`` by conjugate gradients; the links are multiplied a block of rows at a time."""

    def times(x: np.ndarray) -> np.ndarray:
        full = np.zeros(links.n)
        full[c] = x
        out = np.concatenate([links.rows(slice(i, i + 256)).astype(float) @ full for i in range(0, links.n, 256)])
        return deg[c] * x - out[c]

    x, r = np.zeros(len(c)), b - b.mean()
    z = r / deg[c]
    p, rz, goal = z, float(r @ z), 1e-12 * float(np.linalg.norm(r))
    for _ in range(10 * len(c)):
        if np.linalg.norm(r) <= goal:
            break
        ap = times(p)
        step = rz / float(p @ ap)
        x, r = x + step * p, r - step * ap
        r = r - r.mean()
        z = r / deg[c]
        rz, last = float(r @ z), rz
        p = z + rz / last * p
    return x - x.mean()


def _solve_links(links: _Links, rhs: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """``solve_ratios`` from the symmetric matrix of linked samples and each sample's sum of ratios to it."""
    n = len(rhs)
    deg = links.counts()
    out, seen = np.full(n, np.nan), deg == 0
    for s in range(n):
        if seen[s]:
            continue
        comp, front = np.zeros(n, bool), np.array([s])
        comp[s] = True
        while len(front):
            near = links.near(front) & ~comp
            comp |= near
            front = np.flatnonzero(near)
        seen |= comp
        c = np.flatnonzero(comp)
        if len(c) > MAX_DIRECT:
            x = _conjugate(links, deg, c, rhs[c])
        else:
            lap = np.diag(deg[c]) - links.rows(c)[:, c]
            x = np.linalg.solve(lap + 1.0 / len(c), rhs[c])  # fixes the mean of the component at 0
        top = x.max()
        out[c] = x + np.log2(totals[c].sum()) - (np.log2(np.exp2(x - top).sum()) + top)
    if np.isfinite(out).any():
        top = np.nanmax(out)
        out += np.log2(totals.sum()) - (np.log2(np.nansum(np.exp2(out - top))) + top)
    return out


def solve_ratios(n: int, pairs: list[tuple[int, int, float]], totals: np.ndarray) -> np.ndarray:
    """Log2 profile from pairwise log2 ratios ``(i, j, x_j - x_i)``: least squares on the graph Laplacian per component.

    Each component is anchored to its own observed total; the whole profile is
    scaled to the total intensity; samples without an edge are NaN.
    """
    links, rhs = _Links(n), np.zeros(n)
    links.add(np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int))
    for i, j, d in pairs:
        rhs[j] += d
        rhs[i] -= d
    return _solve_links(links, rhs, totals)


def pair_medians(logs: np.ndarray, min_shared: int = 2, stabilize: bool = False, totals: np.ndarray | None = None) -> list[tuple[int, int, float]]:
    """Median log2 ratio of every pair of samples with enough shared species; optionally blended with the ratio of totals.

    Stabilisation: ``x`` = larger species count over shared ones, weight
    ``clip((x - 2.5) / 2.5, 0, 1)`` for the totals.
    """
    have, out = np.isfinite(logs), []
    counts = have.sum(axis=0)
    need = max(1, min_shared)
    for i in range(logs.shape[1] - 1):
        rows = have[:, i]
        if rows.sum() < need:
            continue
        gaps = np.sort(logs[rows, i + 1 :] - logs[rows, i : i + 1], axis=0)  # missing ones last
        shared = have[rows, i + 1 :].sum(axis=0)
        at = np.flatnonzero(shared >= need)
        n = shared[at]
        d = (gaps[(n - 1) // 2, at] + gaps[n // 2, at]) / 2
        j = at + i + 1
        if stabilize:
            w = np.clip((np.maximum(counts[i], counts[j]) / n - 2.5) / 2.5, 0, 1)
            d = (1 - w) * d + w * np.log2(totals[j] / totals[i])
        out += zip([i] * len(j), j.tolist(), d.tolist())
    return out


def maxlfq_profile(wide: np.ndarray, min_shared: int = 2, stabilize: bool = False) -> np.ndarray:
    """Linear profile of one protein from its species by samples matrix (NaN missing)."""
    totals = np.nansum(wide, axis=0)
    with np.errstate(divide="ignore"):
        logs = np.log2(wide)
    return np.exp2(solve_ratios(wide.shape[1], pair_medians(logs, min_shared, stabilize, np.where(totals > 0, totals, np.nan)), totals))


def profile_of_rows(species: np.ndarray, sample: np.ndarray, intensity: np.ndarray, n: int, min_shared: int = 2, stabilize: bool = False) -> np.ndarray:
    """``maxlfq_profile`` from a protein's measured rows (codes of species and sample, one row each), without their matrix.

    The ratios of some samples to all later ones are made and reduced to medians
    at a time, about ``MAX_PAIRS``; what stays of them is one bit a pair of
    samples and one sum a sample.
    """
    order = np.lexsort((sample, species)).astype(np.int32)
    species, sample, logs = species[order], sample[order].astype(np.int32), np.log2(intensity[order])
    del order
    totals, counts = np.bincount(sample, 2.0**logs, minlength=n), np.bincount(sample, minlength=n)
    edge = np.flatnonzero(np.diff(species, append=species[-1:] + 1)) + 1
    later = np.repeat(edge, np.diff(edge, prepend=0)).astype(np.int32) - 1 - np.arange(len(species), dtype=np.int32)
    rows = np.argsort(sample, kind="stable").astype(np.int32)
    later = later[rows]
    links, rhs = _Links(n), np.zeros(n)
    of_sample = np.concatenate([[0], np.cumsum(counts)])
    made = np.concatenate([[0], np.cumsum(later, dtype=np.int64)])[of_sample]
    i = 0
    while i < n:
        k = max(i + 1, int(np.searchsorted(made, made[i] + MAX_PAIRS, side="right")) - 1)
        own, much = rows[of_sample[i] : of_sample[k]], later[of_sample[i] : of_sample[k]]
        i, base = k, np.cumsum(much, dtype=np.int64) - much
        at = np.repeat(own + 1 - base, much) + np.arange(much.sum())
        pair = np.repeat(sample[own].astype(np.int64) * n, much) + sample[at]
        gaps = logs[at] - np.repeat(logs[own], much)
        both = np.lexsort((gaps, pair))
        pair, gaps = pair[both], gaps[both]
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        shared = np.diff(first, append=len(pair))
        ok = shared >= max(1, min_shared)
        first, shared = first[ok], shared[ok]
        a, b = np.divmod(pair[first], n)
        d = (gaps[first + (shared - 1) // 2] + gaps[first + shared // 2]) / 2
        if stabilize:
            w = np.clip((np.maximum(counts[a], counts[b]) / shared - 2.5) / 2.5, 0, 1)
            d = (1 - w) * d + w * np.log2(totals[b] / totals[a])
        links.add(a, b)
        rhs += np.bincount(b, d, minlength=n) - np.bincount(a, d, minlength=n)
    return np.exp2(_solve_links(links, rhs, totals))


def _profile(protein: str, names: list[str], v: np.ndarray) -> pa.Table:
    keep = np.flatnonzero(np.isfinite(v))
    return pa.table({"protein": pa.array([protein] * len(keep), pa.string()), "sample": pa.array([names[i] for i in keep], pa.string()), "value": pa.array(v[keep], pa.float64())})


def maxlfq(ions: DataFrame, min_shared: int = 2, stabilize: bool = False) -> DataFrame:
    """``(protein, sample, value)`` by pairwise ratios; samples without a ratio have no row.

    A protein's task gets a row a species, with numbers for its samples, so what
    is gathered is twelve bytes a cell.
    """

    def solve(rows: pa.Table) -> pa.Table:
        k, v = rows["k"].combine_chunks(), rows["v"].combine_chunks()
        species = np.repeat(np.arange(len(rows), dtype=np.int32), k.value_lengths().to_numpy())
        found, sample = np.unique(k.flatten().to_numpy(), return_inverse=True)
        out = profile_of_rows(species, sample.astype(np.int32), v.flatten().to_numpy(), len(found), min_shared, stabilize)
        keep = np.flatnonzero(np.isfinite(out))
        return pa.table({"protein": pa.array([rows["protein"][0].as_py()] * len(keep), pa.string()), "k": pa.array(found[keep], pa.int32()), "value": pa.array(out[keep], pa.float64())})

    cells = materialize(species_cells(ions), "species")
    big = cells.groupBy("protein").agg(F.count(F.lit(1)).alias("_r")).where(F.col("_r") > MAX_CELLS).select("protein")
    few = not big.limit(1).count()
    names = materialize(global_ordinals(cells, "sample", "_k").select("sample", F.col("_k").cast("int").alias("_k")), "names")
    coded = (cells if few else cells.join(big, "protein", "left_anti")).join(F.broadcast(names), "sample").select("protein", "peptidoform", "charge", F.struct("_k", "intensity").alias("_c"))
    lists = coded.repartition("protein").groupBy("protein", "peptidoform", "charge").agg(F.collect_list("_c").alias("_l"))
    solved = lists.select("protein", F.col("_l._k").alias("k"), F.col("_l.intensity").alias("v")).groupBy("protein").applyInArrow(solve, "protein string, k int, value double")
    solved = solved.join(F.broadcast(names), F.col("k") == F.col("_k")).select("protein", "sample", "value")
    return solved if few else solved.unionByName(_maxlfq_of_pairs(cells.join(big, "protein", "left_semi"), min_shared, stabilize))


def ratio_pairs(cells: DataFrame) -> DataFrame:
    """``(protein, a, b, d, shared)``: median log2 ratio b over a of samples a < b, as a join of the species with itself."""
    v = cells.select("protein", "peptidoform", "charge", "sample", F.log2("intensity").alias("v"))
    a, b = v.alias("a"), v.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("protein", "peptidoform", "charge")]
    pairs = a.join(b, [*same, F.col("a.sample") < F.col("b.sample")])
    return pairs.groupBy(F.col("a.protein").alias("protein"), F.col("a.sample").alias("a"), F.col("b.sample").alias("b")).agg(F.median(F.col("b.v") - F.col("a.v")).alias("d"), F.count(F.lit(1)).alias("shared"))


def _maxlfq_of_pairs(cells: DataFrame, min_shared: int, stabilize: bool) -> DataFrame:
    """The same with the pair medians by join; a protein's task gets four bytes a pair of samples."""
    totals = materialize(cells.groupBy("protein", "sample").agg(F.sum("intensity").alias("t"), F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(W.partitionBy("protein").orderBy("sample")) - 1), "samples")
    coded = cells.join(totals.select("protein", "sample", "k"), ["protein", "sample"]).select("protein", "peptidoform", "charge", F.col("k").alias("sample"), "intensity")
    d = F.col("d")
    pairs = ratio_pairs(coded).where(F.col("shared") >= max(1, min_shared))
    if stabilize:
        ta, tb = totals.select("protein", F.col("k").alias("a"), F.col("t").alias("ta"), F.col("n").alias("na")), totals.select("protein", F.col("k").alias("b"), F.col("t").alias("tb"), F.col("n").alias("nb"))
        pairs = pairs.join(ta, ["protein", "a"]).join(tb, ["protein", "b"])
        w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.greatest("na", "nb") / F.col("shared") - 2.5) / 2.5))
        d = (1 - w) * d + w * F.log2(F.col("tb") / F.col("ta"))
    pairs = materialize(pairs.select("protein", "a", "b", d.alias("x")), "pairs")
    kinds = [
        totals.select("protein", "k", "sample", F.col("t").alias("x"), F.lit(None).cast("array<int>").alias("others")),
        pairs.groupBy("protein", F.col("a").alias("k")).agg(F.lit(None).cast("string").alias("sample"), (-F.sum("x")).alias("x"), F.collect_list("b").alias("others")),
        pairs.groupBy("protein", F.col("b").alias("k")).agg(F.lit(None).cast("string").alias("sample"), F.sum("x").alias("x"), F.lit(None).cast("array<int>").alias("others")),
    ]

    def solve(rows: pa.Table) -> pa.Table:
        named = np.array(rows["sample"].is_valid())
        k, x = rows["k"].to_numpy(), rows["x"].to_numpy()
        n = int(named.sum())
        names: list[str] = [""] * n
        for i, s in zip(k[named], rows["sample"].filter(pa.array(named)).to_pylist()):
            names[i] = s
        links, totals = _Links(n), np.zeros(n)
        totals[k[named]] = x[named]
        for i, others in zip(k, rows["others"]):
            if others.is_valid:
                j = others.values.to_numpy()
                links.add(np.full(len(j), i), j)
        return _profile(rows["protein"][0].as_py(), names, np.exp2(_solve_links(links, np.bincount(k[~named], x[~named], minlength=n), totals)))

    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("protein").applyInArrow(solve, "protein string, sample string, value double")


MAX_IONS = 100


def top_ions(cells: DataFrame, n: int = MAX_IONS) -> DataFrame:
    """At most ``n`` ions a protein: fewest missing samples, then largest log2 sum, then name; a group limit below the shuffle."""
    rank = cells.groupBy("protein", "peptidoform", "charge").agg(F.count(F.lit(1)).alias("_k"), F.sum(F.log2("intensity")).alias("_s"))
    order = W.partitionBy("protein").orderBy(F.col("_k").desc(), F.col("_s").desc(), "peptidoform", "charge")
    keep = rank.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).select("protein", "peptidoform", "charge")
    return cells.join(keep, ["protein", "peptidoform", "charge"], "left_semi")


def directlfq(ions: DataFrame, min_nonan: int = 1, shifts: DataFrame | None = None) -> DataFrame:
    """Ion profiles aligned within each protein, median over ions per sample, scaled so that linear sums match.

    ``shifts`` (``sample, shift``, log2) are the global sample shifts, applied
    first.  Every protein has at most ``MAX_IONS`` ions here.
    """
    cells = top_ions(species_cells(ions))
    if shifts is not None:
        cells = cells.join(shifts, "sample").withColumn("intensity", F.col("intensity") * F.pow(F.lit(2.0), F.col("shift"))).drop("shift")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=["peptidoform", "charge"], columns="sample", values="intensity").sort_index(axis=0).sort_index(axis=1)
        raw = wide.to_numpy(float)
        logs = np.log2(raw)
        moved = logs + align_profiles(logs)[:, None]
        count = np.isfinite(moved).sum(axis=0)
        prof = np.where(count >= min_nonan, np.nanmedian(np.where(count > 0, moved, 0.0), axis=0), np.nan)
        v = np.exp2(prof - np.nanmax(prof))
        v = v / np.nansum(v) * np.nansum(raw)
        keep = np.isfinite(v)
        return pd.DataFrame({"protein": pdf["protein"].iat[0], "sample": wide.columns.to_numpy()[keep], "value": v[keep]})

    return cells.groupBy("protein").applyInPandas(solve, "protein string, sample string, value double")


def ion_shifts(ions: DataFrame) -> DataFrame:
    """``(protein, peptidoform, charge, shift)``: log2 shifts that align a protein's ion profiles (at most ``MAX_IONS``)."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index=["peptidoform", "charge"], columns="sample", values="intensity").sort_index(axis=0).sort_index(axis=1)
        names = wide.index.to_frame(index=False)
        return pd.DataFrame({"protein": pdf["protein"].iat[0], "peptidoform": names["peptidoform"], "charge": names["charge"], "shift": align_profiles(np.log2(wide.to_numpy(float)))})

    return top_ions(species_cells(ions)).groupBy("protein").applyInPandas(solve, "protein string, peptidoform string, charge int, shift double")


def cell_precision(ions: DataFrame, proteins: DataFrame, prior_df: float = 4.0) -> DataFrame:
    """``(protein, sample, precision)``: ions over the protein's shrunken residual variance.

    Residual of an ion cell: log2 intensity minus the profile, minus the ion's
    median of that.  Variance = RSS / dof shrunk to the median over proteins
    with ``prior_df`` degrees of freedom; relational throughout.
    """
    cells = species_cells(ions).withColumn("v", F.log2("intensity"))
    d = cells.join(proteins.where(is_measured("value")).select("protein", "sample", F.log2("value").alias("p")), ["protein", "sample"]).withColumn("d", F.col("v") - F.col("p"))
    ion = ["protein", "peptidoform", "charge"]
    med = d.groupBy(*ion).agg(F.median("d").alias("m"))
    res = d.join(med, ion).withColumn("r", F.col("d") - F.col("m"))
    rss = res.groupBy("protein").agg(F.sum(F.col("r") ** 2).alias("rss"), F.count(F.lit(1)).alias("n"), F.count_distinct("peptidoform", "charge").alias("k"), F.count_distinct("sample").alias("s"))
    var = rss.withColumn("dof", F.greatest(F.lit(0), F.col("n") - F.col("k") - F.col("s") + 1)).withColumn("var", F.when(F.col("dof") > 0, F.col("rss") / F.col("dof")))
    prior = var.where("var > 0").agg(F.median("var").alias("m")).scalar()
    shrunk = var.select("protein", ((F.col("rss") * (F.col("dof") > 0).cast("int") + prior_df * prior) / (F.col("dof") + prior_df)).alias("s2"))
    n = res.groupBy("protein", "sample").agg(F.count(F.lit(1)).alias("n_ions"))
    return n.join(shrunk, "protein").select("protein", "sample", (F.col("n_ions") / F.col("s2")).alias("precision"))
