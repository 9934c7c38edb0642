"""Closed-form cases of predicates, gates, roll-ups, normalisation and reference scaling."""

import math

import pytest
from pyspark.sql import functions as F

from abundera.functions import keys as K
from abundera.operators import filters as X
from abundera.operators import normalize, rollup
from abundera.operators.windows import average_rank, benjamini_hochberg, tech_replicates

ION = "row_id long, protein string, peptide string, peptidoform string, charge int, sample string, condition string, biorep int, run string, techrep int, intensity double"


def ions(spark, data):
    """(protein, peptide, charge, sample, run, intensity[, biorep])"""
    return spark.createDataFrame([(i, d[0], d[1], d[1], d[2], d[3], "c", d[6] if len(d) > 6 else 1, d[4], 1, d[5]) for i, d in enumerate(data)], ION)


def value(df, *key):
    return {tuple(r[k] for k in key): r["value"] for r in df.collect()}


def test_two_level_sum_and_gate(spark):
    data = ions(spark, [("P1", "AAA", 2, "s1", "r1", 100.0), ("P1", "BBB", 2, "s1", "r1", 150.0), ("P1", "BBB", 2, "s1", "r2", 120.0), ("P1", "CCC", 2, "s1", "r1", 100.0), ("P2", "DDD", 2, "s1", "r1", 5.0), ("P4A;P4B", "EEE", 2, "s1", "r1", 10.0), ("P4A;P4B", "FFF", 3, "s1", "r1", 20.0)])
    out = value(rollup.sum_of_peptides(rollup.peptides_from_ions(X.min_unique(data, 2))), "protein", "sample")
    assert out == {("P1", "s1"): 350.0, ("P4A;P4B", "s1"): 30.0}


def test_charges_collapse_and_other_methods(spark):
    p = rollup.peptides_from_ions(ions(spark, [("P", "A", 2, "s", "r1", 100.0), ("P", "A", 2, "s", "r2", 80.0), ("P", "A", 3, "s", "r1", 40.0), ("P", "B", 2, "s", "r1", 30.0)]))
    get = lambda f, **k: value(f(p, **k), "protein", "sample")[("P", "s")]
    assert get(rollup.sum_of_peptides) == 170 and get(rollup.median_of_peptides) == 85 and get(rollup.top_n_mean, n=1) == 140 and get(rollup.top_n_mean, n=2) == 85
    assert get(rollup.log2_abundance) == pytest.approx((math.log2(140) + math.log2(30)) / 2)


def test_bioreplicates_count_as_rows(spark):
    p = rollup.peptides_from_ions(ions(spark, [("P", "A", 2, "s", "r1", 100.0, 1), ("P", "B", 2, "s", "r1", 200.0, 1), ("P", "A", 2, "s", "r2", 300.0, 2), ("P", "B", 2, "s", "r2", 400.0, 2)]))
    get = lambda f: value(f(p), "protein", "sample")[("P", "s")]
    assert (get(rollup.sum_of_peptides), get(rollup.median_of_peptides), get(rollup.top_n_mean), get(rollup.peptide_count), get(rollup.peptide_count_distinct)) == (1000, 250, 300, 4, 2)


def test_ratio_to_plex_reference(spark):
    cols = "protein string, peptide string, charge int, plex string, sample string, is_reference boolean, intensity double"
    d = spark.createDataFrame([("P", "A", 2, "x", "ref", True, 100.0), ("P", "B", 2, "x", "ref", True, 50.0), ("P", "A", 2, "x", "s", False, 200.0), ("P", "B", 2, "x", "s", False, 200.0), ("P", "C", 2, "x", "s", False, 9.0)], cols)
    assert value(rollup.ratio_to_reference(d), "protein", "sample") == {("P", "s"): 1.5}


def test_empty_and_null_rows(spark):
    e = ions(spark, []).limit(0)
    for f in (rollup.peptides_from_ions, lambda d: X.min_unique(d, 2), lambda d: X.cv_at_most(d, 1.0), X.frequent_items, lambda d: X.razor(d, "assign_to_top")):
        assert f(e).count() == 0
    n = ions(spark, [(None, None, None, None, None, None), ("P", "A", 2, "s", "r", 1.0)])
    assert X.usable_rows(n).count() == 1
    assert n.where(X.measured_at_least(0) & X.length_between(1) & X.charge_in([2]) & X.missed_cleavages_at_most(1)).count() == 1


def test_keys(spark):
    d = spark.createDataFrame([("C:\\x/Run_1.RAW", "AC=MS:1;NT=TMT126", "sp|P12345-2|X_HUMAN", "(Ac)AK[+16].PR-K")], "f string, l string, a string, p string")
    r = d.select(K.run_key("f"), K.label_key("l"), K.accession("a"), K.clean_accession("a"), K.canonical_peptide("p"), K.missed_cleavages(F.lit("AKAKPRAAR")), K.factor_label(F.lit("NT=x;QY=5 mg"))).first()
    assert tuple(r) == ("run_1", "tmt126", "P12345-2", "P12345", "AKPRK", 2, "5 mg")


def test_contaminants(spark):
    d = spark.createDataFrame([(1, ["P1", "CONTAM_P2"], False), (2, ["CONTAM_P2"], False), (3, ["P1", "DECOY_P3"], False), (4, ["P1"], True), (5, None, False), (6, [], None)], "feature_id long, accessions array<string>, is_decoy boolean")
    assert [(r[0], r[1]) for r in X.without_contaminants(d).select("feature_id", "accessions").collect()] == [(1, ["P1"])]


def test_run_and_sample_normalisation(spark):
    d = ions(spark, [("P", "A", 2, "s1", "r1", 100.0), ("P", "A", 2, "s1", "r2", 300.0), ("P", "A", 2, "s2", "r3", 50.0)])
    f = {r["run"]: r["factor"] for r in normalize.run_factors(d).collect()}
    assert f == {"r1": 2.0, "r2": pytest.approx(2 / 3), "r3": 1.0}
    m = {r["run"]: r["intensity"] for r in normalize.scale_runs(d, normalize.run_factors(d)).collect()}
    assert m["r1"] == m["r2"] == pytest.approx(200.0)
    long = spark.createDataFrame([(f"P{i}", s, float(v * k)) for s, k in (("a", 1), ("b", 10)) for i, v in enumerate([10, 20, 40])], "protein string, sample string, value double")
    for method in ("quantile", "global-median", "hierarchical", "median-center"):
        got = value(normalize.normalize_matrix(long, method), "protein", "sample")
        assert got[("P1", "a")] == pytest.approx(got[("P1", "b")], rel=1e-6), method


def test_quantile_reference(spark):
    long = spark.createDataFrame([("x", "a", 10.0), ("y", "a", 20.0), ("z", "a", 30.0), ("x", "b", 1000.0), ("y", "b", 100.0), ("z", "b", 9000.0)], "protein string, sample string, value double")
    got = value(normalize.quantile_normalize(long), "protein", "sample")
    assert got[("x", "a")] == pytest.approx(math.sqrt(10 * 100), rel=1e-6) and got[("z", "a")] == got[("z", "b")]


def test_irs(spark):
    long = spark.createDataFrame([("P", "r1", 100.0), ("P", "s1", 400.0), ("P", "r2", 400.0), ("P", "s2", 1600.0)], "protein string, sample string, value double")
    design = spark.createDataFrame([("r1", "1", True), ("s1", "1", False), ("r2", "2", True), ("s2", "2", False)], "sample string, plex string, is_reference boolean")
    got = value(normalize.irs(long, design), "protein", "sample")
    assert got[("P", "s1")] == pytest.approx(800) and got[("P", "s2")] == pytest.approx(800)


def test_channel_irs(spark):
    d = spark.createDataFrame([("a", "A", True, 200.0), ("b", "A", True, 100.0), ("c", "B", True, 400.0)], "run string, mixture string, is_reference boolean, intensity double")
    assert {r["run"]: r["factor"] for r in normalize.channel_irs_factors(d).collect()} == {"a": 1.0, "b": 2.0, "c": 0.5}


def test_step_up_and_ranks(spark):
    d = spark.createDataFrame([("c", "a", 0.01), ("c", "b", 0.02), ("c", "d", 0.03), ("c", "e", 0.5), ("c", "f", None), ("c", "g", 0.03)], "contrast string, id string, pvalue double")
    adj = {r["id"]: r["adj_pvalue"] for r in benjamini_hochberg(d).collect()}
    assert adj["f"] is None and adj["a"] == pytest.approx(0.0375) and adj["d"] == adj["g"] == pytest.approx(0.0375) and adj["e"] == 0.5
    r = {x["id"]: x["r"] for x in average_rank(d.where("pvalue IS NOT NULL"), ["contrast"], "pvalue", "r").collect()}
    assert r == {"a": 1.0, "b": 2.0, "d": 3.5, "g": 3.5, "e": 5.0}


def test_tech_replicates(spark, rows):
    d = spark.createDataFrame([("s", "x_1"), ("s", "x_2"), ("t", "b"), ("t", "a_1")], "sample string, run string")
    assert rows(tech_replicates(d)) == [("s", "x_1", 1), ("s", "x_2", 2), ("t", "a_1", 1), ("t", "b", 2)]


def test_filter_configuration_is_checked():
    with pytest.raises(ValueError, match="unknown filter options"):
        X.pipeline_from_config({"intensity": {"min_intensty": 1}})
    with pytest.raises(ValueError):
        X.FilterPipeline().add("nowhere", "x", lambda d: d)
