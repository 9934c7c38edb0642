"""The registered queries of the subpackage on the smallest test data."""

import os
from pathlib import Path

import pytest

from abundera.llm.queries import R

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
COLUMNS = {
    "p2_found": {"sdrf_row_id": "bigint", "field_name": "string", "term_id": "bigint"}, "p3_found": {"peptide_row_id": "bigint"}, "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p10_found": {"doc_id": "bigint"},
}


@pytest.mark.parametrize("name", list(R.queries))
def test_query_runs(spark, name):
    df = R.queries[name](spark, str(DATA))
    assert df.count() > 0
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]


def test_top_three_against_pandas(spark):
    import numpy as np

    from abundera.functions.values import is_missing

    y = spark.read.parquet(f"{DATA}/peptide.parquet").where(~is_missing("SampleID")).where("ProteinName IS NOT NULL").toPandas()
    y = y[np.isfinite(y.NormIntensity) & (y.NormIntensity > 0)].sort_values(["NormIntensity", "peptide_row_id"], ascending=[False, True]).drop_duplicates(["ProteinName", "SampleID", "PeptideCanonical"])
    y = y.sort_values(["NormIntensity", "PeptideCanonical"], ascending=[False, True])
    g = y.groupby(["ProteinName", "SampleID"])
    want = set(y[(g.cumcount() < 3) & (g.PeptideCanonical.transform("size") > 3)].peptide_row_id)
    assert {r[0] for r in R.queries["p3_found"](spark, str(DATA)).collect()} == want
