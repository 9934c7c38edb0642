"""Ratio solvers, families, imputation, batches, tests and special functions against closed forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundera.functions import special as sp
from abundera.operators import batch, de, fdr, impute, lfq, normalize, pibaq


def test_special_functions():
    assert sp.digamma(1.0)[0] == pytest.approx(-0.5772156649015329, abs=1e-12)
    assert sp.trigamma(1.0)[0] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert sp.inverse_trigamma(float(sp.trigamma(3.7)[0])) == pytest.approx(3.7, rel=1e-9)
    assert sp.incomplete_beta(2.0, 3.0, 0.5)[0] == pytest.approx(0.6875, abs=1e-12)
    assert sp.student_t_two_sided(2.0, 1.0) == pytest.approx(1 - 2 * math.atan(2) / math.pi, abs=1e-10)
    assert sp.student_t_two_sided(1.959963984540054, np.inf) == pytest.approx(0.05, abs=1e-9)
    assert sp.normal_quantile([0.975])[0] == pytest.approx(1.959963984540054, abs=1e-9)
    assert sp.f_sf(4.0, 1, 10)[0] == pytest.approx(float(sp.student_t_two_sided(2.0, 10.0)), abs=1e-10)
    assert sp.log_gamma(5.0) == pytest.approx(math.log(24))


def test_draws_do_not_depend_on_order():
    a = sp.normals(7, np.arange(1000))
    assert np.array_equal(sp.normals(7, np.arange(1000)[::-1])[::-1], a) and abs(a.mean()) < 0.1 and abs(a.std() - 1) < 0.1


def test_lowess_and_huber_on_a_line():
    x = np.linspace(0, 10, 40)
    assert np.allclose(sp.lowess(x, 2 * x + 1), 2 * x + 1)
    y = 3 + 0.5 * x
    y[5] += 100
    a, b = sp.huber_line(x, y)
    assert a == pytest.approx(3, abs=0.05) and b == pytest.approx(0.5, abs=0.02)


def test_maxlfq_cycle_and_components():
    out = lfq.solve_ratios(3, [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 3.0)], np.array([5.0, 5.0, 5.0]))
    assert out - out[0] == pytest.approx([0, 4 / 3, 8 / 3]) and np.exp2(out).sum() == pytest.approx(15)
    two = np.exp2(lfq.solve_ratios(4, [(0, 1, 1.0), (2, 3, 2.0)], np.array([1.0, 2.0, 10.0, 40.0])))
    assert two[1] / two[0] == pytest.approx(2) and two[3] / two[2] == pytest.approx(4) and two[:2].sum() == pytest.approx(3)
    assert np.isnan(lfq.solve_ratios(3, [(0, 1, 0.0)], np.ones(3))[2])


def test_maxlfq_min_shared_and_stabilisation():
    wide = np.array([[1.0, 4.0, 8.0], [1.0, 4.0, np.nan]])
    assert np.isnan(lfq.maxlfq_profile(wide, 2)[2]) and not np.isnan(lfq.maxlfq_profile(wide, 1)[2])
    for n, want in ((5, 10.0), (6, 10**0.8 * 30**0.2), (10, 50.0), (20, 100.0)):
        logs = np.full((n, 2), np.nan)
        logs[:2, 0], logs[:2, 1] = 0.0, np.log2(10)
        logs[2:, 1] = 0.0
        totals = np.array([1.0, {5: 10, 6: 30, 10: 50, 20: 100}[n]])
        assert 2 ** lfq.pair_medians(logs, 2, True, totals)[0][2] == pytest.approx(want)


def test_maxlfq_in_spark_both_paths(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base, ratio = rng.uniform(5, 20, 6), np.array([0, 1, 2.5, -1])
    data = [("P", f"k{i}", 2, f"s{j}", float(2 ** (b + r)), "r") for i, b in enumerate(base) for j, r in enumerate(ratio)]
    d = spark.createDataFrame(data, "protein string, peptidoform string, charge int, sample string, intensity double, run string")
    one = {r["sample"]: r["value"] for r in lfq.maxlfq(d.orderBy("run")).collect()}
    monkeypatch.setattr(lfq, "MAX_CELLS", 1)
    two = {r["sample"]: r["value"] for r in lfq.maxlfq(d).collect()}
    assert math.log2(one["s2"] / one["s0"]) == pytest.approx(2.5) and sum(one.values()) == pytest.approx(sum(x[4] for x in data))
    assert one == pytest.approx(two)
    flat = {r["sample"]: r["value"] for r in lfq.directlfq(d).collect()}
    assert math.log2(flat["s3"] / flat["s0"]) == pytest.approx(-1)


def test_alignment_shift():
    x = np.log2(np.array([[1.0, 2, 4, 8], [20.0, 40, 80, 160]]))
    s = normalize.align_profiles(x)
    assert s[1] - s[0] == pytest.approx(-math.log2(20))


def family(spark):
    edges = spark.createDataFrame([("P5A", "S1"), ("P5A", "S2"), ("P5B", "S1"), ("P5B", "S2"), ("P5A", "UA"), ("P5B", "UB"), ("PX", "X1")], "accession string, peptide string")
    return edges, pibaq.families(edges)


def test_families(spark, rows):
    _, fam = family(spark)
    assert rows(fam) == [("P5A", "P5B", 2), ("P5B", "P5B", 2), ("PX", "PX", 1)]


def test_components_of_a_long_chain(spark):
    n = 60
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)], "a string, b string")
    nodes = spark.createDataFrame([(f"{i:03d}",) for i in range(n + 1)] + [("zzz",)], "node string")
    got = {r["node"]: r["component"] for r in pibaq.connected_components(e, nodes).collect()}
    assert got.pop("zzz") == "zzz" and set(got.values()) == {"000"}


def test_allocation_conserves_signal(spark):
    edges, fam = family(spark)
    obs = spark.createDataFrame([("UA", "s", 300.0), ("UB", "s", 100.0), ("S1", "s", 600.0), ("S2", "s", 200.0), ("X1", "s", 5.0), ("S1", "t", 8.0)], "peptide string, sample string, intensity double")
    got = {(r["accession"], r["sample"]): r["value"] for r in pibaq.allocate(obs, edges, fam).collect()}
    assert got[("P5A", "s")] == pytest.approx(900) and got[("P5B", "s")] == pytest.approx(300)
    assert got[("P5A", "t")] == got[("P5B", "t")] == pytest.approx(4) and sum(got.values()) == pytest.approx(1213)
    uniq = {(r["accession"], r["sample"]): r["value"] for r in pibaq.unique_mode(obs, edges, fam).collect()}
    assert uniq[("P5A", "s")] == 300 and uniq[("P5B", "s")] == 100


def test_digest(spark, rows):
    p = spark.createDataFrame([("A-2", "MKAAAAAAKPRGGGGGGGR"), ("B", None)], "accession string, protein_sequence string")
    assert rows(pibaq.digest(p, min_length=2)) == [("A", "AAAAAAKPR"), ("A", "GGGGGGGR"), ("A", "MK")]


def long(spark, x):
    return spark.createDataFrame([(f"P{i}", f"s{j}", float(v)) for i, r in enumerate(x) for j, v in enumerate(r) if v == v], "protein string, sample string, value double")


def test_imputation_cases(spark):
    nan = float("nan")
    x = [[10.0, 20.0], [40.0, nan]]
    cell = lambda df: {(r["protein"], r["sample"]): r["value"] for r in df.collect()}[("P1", "s1")]
    d = long(spark, x)
    assert cell(impute.impute(d, "zero")) == 1.0 and cell(impute.impute(d, "mean")) == pytest.approx(20) and cell(impute.impute(d, "mindet")) == pytest.approx(20)
    y = np.log2(np.array([[100.0, 100.0, 100], [200, 200, 200], [140, 140, nan]]))
    assert 2 ** impute.knn_fill(y, 2)[2, 2] == pytest.approx(math.sqrt(20000))
    marks = {(r["protein"], r["sample"]): r["imputed"] for r in impute.impute(d, "median").collect()}
    assert marks[("P1", "s1")] and not marks[("P0", "s1")]


@pytest.mark.parametrize("fill", [impute.knn_fill, impute.seqknn_fill, impute.bpca_fill, impute.impseq_fill, impute.impseqrob_fill, impute.forest_fill])
def test_matrix_imputers_recover_low_rank(fill):
    rng = np.random.default_rng(0)
    full = rng.normal(20, 2, (120, 1)) + rng.normal(0, 1, (1, 8)) + rng.normal(0, 0.2, (120, 8))
    x = full.copy()
    x[rng.random(x.shape) < 0.1] = np.nan
    lack = np.isnan(x)
    out = fill(x)
    assert np.isfinite(out).all() and np.array_equal(out[~lack], x[~lack])
    assert np.abs(out[lack] - full[lack]).mean() < 0.8


def test_qrilc_draws_below():
    rng = np.random.default_rng(2)
    v = rng.normal(20, 2, 2000)
    cut = np.where(v < 18.3, np.nan, v)
    out = impute.qrilc_fill(cut, sp.uniforms(1, np.arange(2000)))
    assert out[np.isnan(cut)].mean() == pytest.approx(v[np.isnan(cut)].mean(), abs=0.6)
    with pytest.raises(ValueError):
        impute.qrilc_fill(np.array([1.0, np.nan, np.nan]), np.full(3, 0.5))


def test_combat_removes_batch_shift():
    rng = np.random.default_rng(3)
    y = rng.normal(10, 1, (200, 12))
    b = np.repeat([0, 1], 6)
    shifted = y + np.where(b == 1, rng.normal(3, 0.3, (200, 1)), 0.0)
    for options in ({}, {"mean_only": True}, {"parametric": False}, {"reference": 0}):
        out = batch.combat(shifted, b, **options)
        assert abs((out[:, b == 1].mean(axis=1) - out[:, b == 0].mean(axis=1)).mean()) < 0.2
    assert np.array_equal(batch.combat(shifted, b, reference=0)[:, b == 0], shifted[:, b == 0])
    with pytest.raises(ValueError):
        import pandas as pd

        batch.design_matrix(pd.DataFrame({"a": [1.0, 1.0]}))


def test_clusters_and_noise():
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(0, 0.1, (10, 2)), rng.normal(5, 0.1, (10, 2)), [[50.0, 50.0]]])
    labels = batch.hdbscan(pts)
    assert len(set(labels[:10])) == 1 and len(set(labels[10:20])) == 1 and labels[0] != labels[10] and labels[20] == -1


def test_moderated_test_finds_planted_changes(spark):
    rng = np.random.default_rng(5)
    data = [(f"P{i:03d}", f"{g}{j}", float(2 ** (20 + rng.normal(0, 0.3) + (3 if g == "B" and i < 10 else 0)))) for i in range(100) for g in "AB" for j in range(4)]
    d = spark.createDataFrame(data, "protein string, sample string, value double")
    s = spark.createDataFrame([(f"{g}{j}", g) for g in "AB" for j in range(4)], "sample string, condition string")
    r = {x["protein"]: x for x in de.limma(d, s, "A", "B").collect()}
    assert sum(r[f"P{i:03d}"]["significance"] == "UP" for i in range(10)) == 10 and sum(x["significance"] != "Unchanged" for x in r.values()) <= 13
    counts = spark.createDataFrame([(f"P{i:03d}", 1 + i % 7) for i in range(100)], "protein string, count int")
    for got in (de.deqms(d, s, counts, "A", "B"), de.rots(d, s, "A", "B", resamples=20), de.rots(d, s, "A", "B", resamples=20, moderated=True), de.proda(d, s, "A", "B")):
        top = [x["protein"] for x in got.orderBy("pvalue", "protein").limit(10).collect()]
        assert sum(p < "P010" for p in top) >= 8
    both = de.ensemble({"a": de.limma(d, s, "A", "B"), "b": de.proda(d, s, "A", "B")})
    assert {x["protein"] for x in both.where("consensus = 'UP'").collect()} >= {f"P{i:03d}" for i in range(8)}


def test_null_share():
    assert fdr.pi0_smooth(fdr.pi0_curve([round(1000 * (1 - x)) for x in fdr.LAMBDAS], 1000)) == pytest.approx(1, abs=0.01)
    assert fdr.mixture_gate(np.zeros(10)) == 0.5


def test_nonnegative_solve():
    m = 0.9 * np.eye(3) + 0.1 * np.eye(3, k=1)
    x = np.array([[5.0, 0.0, 2.0]])
    assert normalize.nonnegative_solve(m, x @ m.T) == pytest.approx(x, abs=1e-6)


def test_blocks_sharpen_a_paired_difference(spark):
    import pandas as pd

    rng = np.random.default_rng(9)
    people, data = [f"b{k}" for k in range(6)], []
    for i in range(60):
        level = rng.normal(20, 2, 6)
        data += [(f"P{i:02d}", f"{p}{g}", float(2 ** (level[k] + rng.normal(0, 0.1) + (0.5 if g == "B" and i < 5 else 0)))) for k, p in enumerate(people) for g in "AB"]
    d = spark.createDataFrame(data, "protein string, sample string, value double")
    names = sorted({x[1] for x in data})
    x = pd.DataFrame({"one": 1.0, "b": [float(n[-1] == "B") for n in names]}, index=names)
    blocks = {n: n[:-1] for n in names}
    rho = de.block_correlation(d, x, blocks)
    plain = de.design_test(d, x, np.array([0.0, 1.0])).where("pvalue < 0.01").count()
    top = [r["protein"] for r in de.design_test(d, x, np.array([0.0, 1.0]), blocks, rho).orderBy("pvalue").limit(5).collect()]
    assert rho > 0.9 and plain < 3 and sorted(top) == [f"P{i:02d}" for i in range(5)]


def test_components_without_the_matrix(spark):
    """Scores of the block iteration equal those of a full decomposition; an entity with a gap is left out."""
    rng = np.random.default_rng(3)
    x = np.exp2(rng.normal(10, 1, (60, 25)) + 3 * rng.normal(size=(60, 1)) @ rng.normal(size=(1, 25)))
    data = [(f"p{i:02}", f"s{j:02}", float(x[i, j])) for i in range(60) for j in range(25)] + [("gap", "s00", 5.0)]
    df = spark.createDataFrame(data, "protein string, sample string, value double")
    got = {(r["sample"], r["component"]): r["score"] for r in batch.pca_scores(df, 3).collect()}
    y = np.log2(x).T
    u, sv, _ = np.linalg.svd(y - y.mean(axis=0), full_matrices=False)
    # entities are centred over the samples: the same scores up to sign
    for c in range(3):
        mine = np.array([got[f"s{j:02}", c + 1] for j in range(25)])
        assert mine[np.abs(mine).argmax()] > 0 and np.abs(mine) == pytest.approx(np.abs(u[:, c] * sv[c]), rel=1e-6, abs=1e-6)
    assert batch.pca_scores(df.limit(0)).count() == 0


def test_an_outlier_sample_is_found(spark):
    rng = np.random.default_rng(4)
    level = rng.normal(12, 2, 40)
    data = [(f"p{i}", f"s{j:02}", float(2 ** (level[i] + rng.normal(0, 0.1) + (rng.normal(0, 4) if j == 7 else 0)))) for j in range(16) for i in range(40)]
    assert "s07" in batch.outlier_samples(spark.createDataFrame(data, "protein string, sample string, value double"))


def test_local_quadratic_fit():
    """Exact on a parabola; equal points count as often as they stand."""
    x = np.log2(np.arange(1, 12.0))
    n = np.array([9, 7, 5, 4, 3, 2, 2, 1, 1, 1, 1.0])
    assert de.quadratic_loess(x, n, 1 + 2 * x - x**2) == pytest.approx(1 + 2 * x - x**2)
    once = de.quadratic_loess(x, np.ones(11), np.sin(x))
    assert de.quadratic_loess(x, np.full(11, 3.0), np.sin(x)) == pytest.approx(once, abs=0.2)
    assert de.prior_df(-1.0) == np.inf and abs(de.prior_df(de._trigamma_half(4.0)) - 4.0) < 0.051


def test_equal_precisions_change_nothing(spark):
    rng = np.random.default_rng(6)
    data = [(f"p{i:02}", f"s{j}", float(2 ** (8 + i % 5 + rng.normal(0, 0.3) + (1.0 if i % 3 == 0 and j < 4 else 0)))) for i in range(40) for j in range(8)]
    long = spark.createDataFrame(data, "protein string, sample string, value double")
    design = spark.createDataFrame([(f"s{j}", "A" if j < 4 else "B") for j in range(8)], "sample string, condition string")
    counts = spark.createDataFrame([(f"p{i:02}", 1 + i % 7) for i in range(40)], "protein string, count bigint")
    plain = {r["protein"]: r for r in de.deqms(long, design, counts, "A", "B").collect()}
    same = {r["protein"]: r for r in de.deqms(long, design, counts, "A", "B", long.select("protein", "sample", F.lit(2.0).alias("precision"))).collect()}
    assert len(plain) == 40 and all(same[k]["pvalue"] == pytest.approx(r["pvalue"], rel=1e-6) and same[k]["log2FC"] == pytest.approx(r["log2FC"]) for k, r in plain.items())
    hits = {k for k, r in plain.items() if r["adj_pvalue"] < 0.05}
    assert {f"p{i:02}" for i in range(0, 40, 3)} <= hits


def test_components_of_a_long_chain(spark):
    """Rounds go on until nothing changes, whatever the length of the chain."""
    n = 120
    order = list(range(n))
    np.random.default_rng(1).shuffle(order)
    names = [f"n{i:03}" for i in order]
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a string, b string")
    got = pibaq.connected_components(edges, spark.createDataFrame([(x,) for x in names], "node string")).select("component").distinct().collect()
    assert [r[0] for r in got] == ["n000"]


def test_bounds_are_errors_not_cuts(spark):
    from abundera.session import collect_bounded, pandas_bounded

    assert len(collect_bounded(spark.range(5), 5, "rows")) == 5
    for take in (collect_bounded, pandas_bounded):
        with pytest.raises(ValueError, match="more than 4 rows"):
            take(spark.range(5), 4, "rows")


def test_ordinals_over_partitions(spark):
    from abundera.operators.windows import global_ordinals

    df = spark.createDataFrame([(f"v{i * 7919 % 1000:04}",) for i in range(2000)], "v string").repartition(7)
    assert [tuple(r) for r in global_ordinals(df, "v", "n").orderBy("v").collect()] == [(f"v{i:04}", i) for i in range(1000)]


def test_family_pipeline_in_all_ways(spark):
    """Two members of a family share two peptides, each with one of its own; the closed forms of the three ways."""
    from abundera.plans import pipeline

    digest = spark.createDataFrame([("P5A", "AAAAAAK"), ("P5A", "SHAREDK"), ("P5A", "SHAREDR"), ("P5B", "BBBBBBK"), ("P5B", "SHAREDK"), ("P5B", "SHAREDR")], "accession string, peptide string")
    ions = spark.createDataFrame([(p, p, "s", v) for p, v in (("AAAAAAK", 300.0), ("BBBBBBK", 100.0), ("SHAREDK", 400.0), ("SHAREDR", 200.0))], "peptide string, peptidoform string, sample string, intensity double")
    values = lambda mode: {r["protein"]: r["value"] for r in pipeline.pibaq_values(ions, pipeline.PipelineConfig(quant="pibaq", pibaq_mode=mode), digest).collect()}
    assert values("unique") == {"P5A": 300.0, "P5B": 100.0}
    assert values("proportional") == pytest.approx({"P5A": 250.0, "P5B": 250 / 3}) and values("stable-ratio") == pytest.approx({"P5A": 250.0, "P5B": 250 / 3})
    with pytest.raises(ValueError):
        pipeline.PipelineConfig(quant="pibaq", pibaq_mode="other")


def test_reference_and_plex_rules_in_order(spark):
    from abundera.operators import normalize

    rows = spark.createDataFrame([("a", "pooled", "x", "1", "f1"), ("b", "not pooled", "bridge", "1", "f1"), ("c_plex2", None, "y", "2", "f2"), ("d_plex2", None, None, "2", "f2")], "sample string, pool string, role string, p string, run_key string")
    marked = lambda **o: {r["sample"] for r in normalize.reference_samples(rows, **o).where("is_reference").collect()}
    assert marked(pooled="pool") == {"a"} and marked(explicit=("d_plex2",)) == {"d_plex2"} and marked(column="role", values=("y",)) == {"c_plex2"} and marked(name="role") == {"b"}
    assert {r["sample"]: r["plex"] for r in normalize.plexes(rows, "p").collect()}["c_plex2"] == "2"
    assert {r["plex"] for r in normalize.plexes(rows).collect()} == {"f1", "f2"}
    assert {r["sample"]: r["plex"] for r in normalize.plexes(rows.withColumn("run_key", F.col("sample"))).collect()} == {"a": "1", "b": "1", "c_plex2": "2", "d_plex2": "2"}


def test_components_of_filled_samples_from_measured_cells(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(12, 3, (200, 29))
    x[rng.random(x.shape) < 0.7] = np.nan
    f = batch.LowFilled(spark.createDataFrame([(f"p{i}", f"s{j:02}", float(2 ** x[i, j])) for i, j in zip(*np.nonzero(np.isfinite(x)))], "protein string, sample string, value double"))
    for keep in (np.ones(29, bool), np.arange(29) % 3 > 0):
        y = np.where(np.isfinite(x), x, np.nanquantile(x, 0.01, axis=0))[:, keep]
        u, sv, _ = np.linalg.svd((y - y.mean(axis=1, keepdims=True)).T, full_matrices=False)
        assert f.entities == 200 and np.abs(f.scores(keep)) == pytest.approx(np.abs(u[:, :2] * sv[:2]), rel=1e-6, abs=1e-6)


def test_clusters_in_a_deep_tree():
    """Fours at growing distances nest some thousand clusters; no recursion, no matrix of all distances."""
    pts = np.zeros((4800, 2))
    pts[:, 0] = np.repeat(1.01 ** np.arange(1200), 4) * 100 + np.tile([0, 0.01, 0.03, 0.04], 1200)
    labels = batch.hdbscan(pts)
    assert labels.max() > 0 and (np.bincount(labels[labels >= 0]) >= 3).all()


@pytest.mark.parametrize("stabilize", [False, True])
def test_profile_from_rows_equals_that_of_the_matrix(monkeypatch, stabilize):
    rng = np.random.default_rng(12)
    wide = np.exp2(rng.normal(20, 3, (60, 40)))
    wide[rng.random(wide.shape) < 0.85] = np.nan
    wide[:, 30] = np.nan
    wide = wide[:, np.isfinite(wide).any(axis=0)]
    i, j = np.nonzero(np.isfinite(wide))
    want = lfq.maxlfq_profile(wide, 2, stabilize)
    for pairs, direct in ((10**6, 1500), (30, 1500), (30, 2)):
        monkeypatch.setattr(lfq, "MAX_PAIRS", pairs)
        monkeypatch.setattr(lfq, "MAX_DIRECT", direct)
        assert lfq.profile_of_rows(i, j, wide[i, j], wide.shape[1], 2, stabilize) == pytest.approx(want, rel=1e-9, nan_ok=True)


def test_profile_of_many_samples_in_little_memory():
    """2,000 samples, 2 million pairs: the list of pairs and the matrix of samples took more than a quarter of a GB."""
    import tracemalloc

    rng = np.random.default_rng(13)
    n = 2000
    species, sample = np.repeat(np.arange(40), n), np.tile(np.arange(n), 40)
    level = rng.normal(0, 1, n)
    tracemalloc.start()
    v = lfq.profile_of_rows(species, sample, np.exp2(20 + level[sample] + species / 10), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.log2(v / v[0]) == pytest.approx(level - level[0], abs=1e-8) and peak < 250e6


def test_density_over_distribution_in_the_tails():
    x = np.array([-200.0, -40.0, -36.0, -20.0, -12.3, -8.5, -1.0, 0.0, 0.3333, 5.0, 39.0, 100.0])
    got = sp.inverse_mills(x)
    assert got[7] == pytest.approx(math.sqrt(2 / math.pi), rel=1e-14) and got[-1] == pytest.approx(0, abs=1e-300)
    # between the bounds (sqrt(x^2 + 4) + x) / 2 and (sqrt(x^2 + 8) + 3 x) / 4 of the upper tail
    v = -x[:7]
    assert (got[:7] > v).all() and (got[:7] < (np.sqrt(v**2 + 4) + v) / 2).all() and got[6] == pytest.approx(math.exp(-0.5) / math.sqrt(2 * math.pi) / (0.5 * math.erfc(1 / math.sqrt(2))), rel=1e-12)


@pytest.mark.parametrize("method", ["rots", "proda"])
def test_tests_take_no_matrix_of_all_cells(spark, method):
    """2,000 proteins in 1,000 samples, 1 % measured: the driver holds the measured values, not 16 MB a copy of the matrix."""
    import tracemalloc

    rng = np.random.default_rng(14)
    data = [(f"P{i:04}", f"{'AB'[j % 2]}{j}", float(2 ** (20 + rng.normal(0, 0.3) + (4 if j % 2 and i < 10 else 0)))) for i in range(2000) for j in rng.choice(1000, 10, replace=False)]
    d = spark.createDataFrame(data, "protein string, sample string, value double")
    s = spark.createDataFrame([(f"{'AB'[j % 2]}{j}", "AB"[j % 2]) for j in range(1000)], "sample string, condition string")
    tracemalloc.start()
    out = de.rots(d, s, "A", "B", resamples=5) if method == "rots" else de.proda(d, s, "A", "B", rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(r["protein"] < "P0010" for r in out.orderBy("pvalue", "protein").limit(10).collect()) >= 8 and peak < 12e6


def test_nearest_neighbours_from_measured_cells(spark, monkeypatch):
    """Equal to the fill of the whole matrix, also where that has more cells than a whole-matrix step takes."""
    rng = np.random.default_rng(15)
    x = rng.normal(12, 3, (90, 20))
    x[rng.random(x.shape) < 0.8] = np.nan
    x[5], x[7] = x[3], x[3]
    x = x[np.isfinite(x).any(axis=1)]
    monkeypatch.setattr(batch, "MAX_CELLS", 10)
    monkeypatch.setattr(impute, "MAX_BLOCK", 1000)
    d = spark.createDataFrame([(f"p{i:02}", f"s{j:02}", float(2 ** x[i, j])) for i, j in zip(*np.nonzero(np.isfinite(x)))], "protein string, sample string, value double")
    got = {(r["protein"], r["sample"]): (r["value"], r["imputed"]) for r in impute.impute(d, "knn").collect()}
    want = impute.knn_fill(np.log2(np.exp2(x)))
    assert len(got) == x.size
    for i in range(len(x)):
        for j in range(20):
            assert math.log2(got[f"p{i:02}", f"s{j:02}"][0]) == pytest.approx(want[i, j], rel=1e-9) and got[f"p{i:02}", f"s{j:02}"][1] == (not np.isfinite(x[i, j]))


def _gappy() -> np.ndarray:
    """60 by 8, one row and one column without a value."""
    rng = np.random.default_rng(16)
    x = rng.normal(20, 2, (60, 1)) + rng.normal(0, 1, (1, 8)) + rng.normal(0, 0.2, (60, 8))
    x[rng.random(x.shape) < 0.4] = np.nan
    x[7], x[:, 6] = np.nan, np.nan
    return x


def _fill_of_cells(spark, monkeypatch, x: np.ndarray, method: str, **options) -> np.ndarray:
    """The fill in Spark where a whole-matrix step takes ten cells, blocks are small and the filled matrix is in a file."""
    monkeypatch.setattr(batch, "MAX_CELLS", 10)
    monkeypatch.setattr(impute, "MAX_BLOCK", 100)
    monkeypatch.setattr(impute, "MAX_HELD", 10)
    data = [(f"p{i:02}", f"s{j}", None if np.isnan(x[i, j]) else float(2 ** x[i, j])) for i, j in np.ndindex(x.shape) if np.isfinite(x[i, j]) or i == 7 or j == 6]
    out = np.full(x.shape, np.nan)
    rows = impute.impute(spark.createDataFrame(data, "protein string, sample string, value double"), method, **options).collect()
    for r in rows:
        at = int(r["protein"][1:]), int(r["sample"][1:])
        assert r["imputed"] == np.isnan(x[at]) and np.isnan(out[at])
        out[at] = math.log2(r["value"])
    assert np.isfinite(out).all() and out[np.isfinite(x)] == pytest.approx(x[np.isfinite(x)])
    return out


def test_forest_from_measured_cells(spark, monkeypatch):
    """The values of the forest as it was on the matrix, also where that has more cells than a whole-matrix step takes."""
    x = _gappy()
    for out in (impute.forest_fill(x, rounds=2, trees=4), _fill_of_cells(spark, monkeypatch, x, "missforest", rounds=2, trees=4)):
        filled = out[np.isnan(x)]
        assert len(filled) == 233 and filled.sum() == pytest.approx(3541.3848374039812, rel=1e-9)
        assert filled[[0, 30, 120]] == pytest.approx([17.651071817185013, 20.586749826814412, 19.533304624359737], rel=1e-9)


def test_forest_in_spark_is_that_of_the_matrix_in_less_time(spark, monkeypatch):
    """The same draws and values; the whole forest in less than half the time that numpy takes for it, by two of its trees a column."""
    import time

    rng = np.random.default_rng(18)
    x = rng.normal(20, 2, (300, 1)) + rng.normal(0, 1, (1, 60)) + rng.normal(0, 0.2, (300, 60))
    x[rng.random(x.shape) < 0.5] = np.nan
    row, col = np.nonzero(np.isfinite(x))
    began = time.process_time()
    want = impute.forest_fill(x, rounds=1, trees=2)
    small = time.process_time() - began
    for held in (impute.MAX_HELD, 10):
        monkeypatch.setattr(impute, "MAX_HELD", held)
        for r in impute._forest_rows(spark, [f"p{i:03}" for i in range(300)], row, col, x[row, col], 60, 7, rounds=1, trees=2).collect():
            i = int(r["e"][1:])
            assert r["v"] == pytest.approx(np.exp2(want[i]), rel=1e-12) and r["i"] == np.isnan(x[i]).tolist()
    monkeypatch.undo()
    d = spark.createDataFrame([(f"p{i:03}", f"s{j:02}", float(2 ** x[i, j])) for i, j in zip(row, col)], "protein string, sample string, value double")
    began = time.time()
    assert impute.impute(d, "missforest").count() == x.size
    assert time.time() - began < 40 * small / 2


def test_components_from_measured_cells(spark, monkeypatch):
    """The values of the components as they were on the matrix, also where that has more cells than a whole-matrix step takes."""
    x = _gappy()
    for out in (impute.bpca_fill(x), _fill_of_cells(spark, monkeypatch, x, "bpca")):
        filled = out[np.isnan(x)]
        assert len(filled) == 233 and filled.sum() == pytest.approx(3503.2653724835736, rel=1e-9)
        assert filled[[0, 30, 120]] == pytest.approx([18.843754301403948, 19.738606983063782, 20.102641838644914], rel=1e-9)


def test_profile_of_few_cells_in_many_samples():
    """16,000 samples in groups of 40: the links are held a bit a pair (32 MB), not a byte (256 MB)."""
    import tracemalloc

    n, rng = 16_000, np.random.default_rng(17)
    sample = np.tile(np.arange(n), 2)
    species = np.repeat([0, 400], n) + sample // 40
    level = rng.normal(0, 1, n)
    tracemalloc.start()
    v = lfq.profile_of_rows(species, sample, np.exp2(20 + level[sample] + np.repeat([0.0, 1.0], n)), n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    gap = (np.log2(v) - level).reshape(-1, 40)
    assert gap == pytest.approx(np.repeat(gap[:, :1], 40, axis=1), abs=1e-8) and peak < 120e6
