"""Queries that must cover every sample and protein of the table, on the smallest test data."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from abundera.queries import base as B
from abundera.queries import numeric

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


def test_mixture_fills_the_samples_themselves(spark):
    cells = B.cells(spark, str(DATA))
    n = cells.agg(F.count_distinct("sample"), F.count_distinct("protein")).first()
    got = numeric.R.queries["imp10_gms"](spark, str(DATA))
    assert got.count() == n[0] * n[1] and not got.select("sample").distinct().join(cells, "sample", "left_anti").count()


def test_pair_medians_cover_single_proteins(spark):
    got = {r["protein"] for r in numeric.R.queries["lfq1_pair_medians_all"](spark, str(DATA)).select("protein").distinct().collect()}
    ions = B.ions(spark, str(DATA)).groupBy("protein", "peptidoform", "charge").agg(F.count_distinct("sample").alias("n")).where("n > 1 AND protein IS NOT NULL")
    assert got == {r["protein"] for r in ions.select("protein").distinct().collect()} and any(";" not in p for p in got)


def test_correlation_of_equal_values_is_nan(spark):
    from abundera.operators import filters

    rows = [(f"p{i}", f, v) for i in range(4) for f, v in (("s1", 8.0), ("s2", 2.0**i), ("s3", 4.0**i))] + [("p0", "t1", 1.0), ("p0", "t2", 1.0)]
    groups = spark.createDataFrame([(s, "A") for s in ("s1", "s2", "s3")] + [(s, "B") for s in ("t1", "t2")], "sample string, condition string")
    got = filters.sample_correlations(spark.createDataFrame(rows, "protein string, sample string, value double"), groups).collect()
    assert {r["sample"]: str(r["mean_correlation"]) for r in got} == dict.fromkeys(("s1", "s2", "s3"), "nan")
    rest = filters.sample_correlations(spark.createDataFrame(rows, "protein string, sample string, value double").where("sample <> 's1'"), groups).collect()
    assert {r["sample"]: round(r["mean_correlation"], 9) for r in rest} == {"s2": 1.0, "s3": 1.0}


def test_outliers_without_the_grid(spark, monkeypatch):
    """The samples that fall out are found from the measured cells: no row for a cell that isn't there."""
    from abundera.operators import impute

    monkeypatch.setattr(impute, "grid_and_cells", None)
    got = {r["sample"] for r in numeric.R.queries["bat7_outliers"](spark, str(DATA)).collect()}
    assert got <= {r["sample"] for r in B.ions(spark, str(DATA)).select("sample").distinct().collect()}


def test_unified_table_has_every_field(spark):
    """No column of the three tables and no field of the raw records is left out, nested lists included."""
    from abundera.queries import problems

    got = problems.R.queries["p1_unified"](spark, str(DATA))
    canon = problems.feature_canon(spark, str(DATA))
    assert set(canon.fields) <= set(got.columns)
    count = lambda df, c: df.where(F.col(c).isNotNull()).count()
    feature = spark.read.parquet(str(DATA / "feature.parquet"))
    own = got.where("source_table = 'feature'")
    for c in ("additional_scores", "modifications", "imputed_labels", "id_run_file_name", "acquired_at", "ingested_at"):
        assert count(own, c) == count(feature, c)
    same = own.alias("g").join(feature.alias("f"), F.col("g.source_id") == F.col("f.feature_id"))
    assert not same.where("NOT (g.acquired_at <=> f.acquired_at AND g.imputed_labels <=> f.imputed_labels AND transform(g.additional_scores, x -> x.score_value) <=> transform(f.additional_scores, x -> x.score_value))").count()
    raw = got.where("source_table = 'feature_drop'").cache()
    text = problems.drift.unified_records(*(lambda c, d, r: (d, r))(*problems._resolved(spark, str(DATA))))
    for c in ("additional_scores", "modifications", "calibrated", "instrument_note"):
        if c in text.columns:
            assert count(raw, c) == count(text, c)
    assert raw.where("exists(modifications, m -> exists(m.positions, p -> exists(p.scores, x -> x.score_value > 0)))").count() > 0
