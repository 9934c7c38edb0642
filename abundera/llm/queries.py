"""Queries of the llm subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions.values import is_measured, is_missing
from abundera.llm import bpe, canonical, mojibake, packing, quantiles, topn
from abundera.queries.base import sql_missing
from abundera.queries.common import Registry, table

R = Registry()

CHARACTERISTICS = ("organism part", "cell type", "disease")
SHARES = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
SHARE_NAMES = ["p05", "p25", "p50", "p75", "p95", "p99"]


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ", ".join(f"'{f}', `characteristics[{f}]`" for f in CHARACTERISTICS)
    return table(spark, sf_dir, "sdrf").selectExpr("sdrf_row_id", f"stack({len(CHARACTERISTICS)}, {fields}) AS (field_name, value)").where(~is_missing("value"))


@R.add("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term that each freely typed characteristic means, or -1."""
    return canonical.map_rows(_typed(spark, sf_dir), table(spark, sf_dir, "term_list")).select("sdrf_row_id", "field_name", "term_id")


@R.add("p2_near_entries")
def p2_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries within the length-dependent distance of every distinct value."""
    return canonical.near_entries(_typed(spark, sf_dir), canonical.load_references(table(spark, sf_dir, "term_list")))


_P3 = f"""WITH r AS (SELECT * FROM peptide WHERE isfinite(NormIntensity) AND NormIntensity > 0 AND ProteinName IS NOT NULL AND NOT {sql_missing('SampleID')} AND PeptideCanonical IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ProteinName, SampleID, PeptideCanonical ORDER BY NormIntensity DESC, peptide_row_id) = 1)
SELECT peptide_row_id FROM r QUALIFY count(*) OVER (PARTITION BY ProteinName, SampleID) > 3 AND row_number() OVER (PARTITION BY ProteinName, SampleID ORDER BY NormIntensity DESC, PeptideCanonical) <= 3"""


@R.add("p3_found", _P3)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best peptides of every protein and sample that has more than three."""
    rows = table(spark, sf_dir, "peptide").where(
        is_measured("NormIntensity") & F.col("ProteinName").isNotNull() & ~is_missing("SampleID") & F.col("PeptideCanonical").isNotNull()
    )
    top = topn.top_items(rows, ["ProteinName", "SampleID"], "PeptideCanonical", "NormIntensity", "peptide_row_id", 4)
    size = F.max("place").over(W.partitionBy(*topn.G))  # at most four rows a group
    return top.withColumn("size", size).where("size > 3 AND place <= 3").select(F.col("id").alias("peptide_row_id"))


@R.add("p3_skipping")
def p3_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups read and skipped for the three best peptides of each protein, file by file."""
    rows = table(spark, sf_dir, "peptide").where(is_measured("NormIntensity") & F.col("ProteinName").isNotNull() & F.col("PeptideCanonical").isNotNull())
    return topn.skipping(spark, topn.cluster(rows, ["ProteinName"], "PeptideCanonical", "NormIntensity", "peptide_row_id"), 3)


def _intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "peptide").where(is_measured("NormIntensity") & ~is_missing("SampleID"))


@R.add("p5_percentiles")
def p5_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the measured NormIntensity of every SampleID, from merged sketches."""
    parts = quantiles.build_sketches(_intensities(spark, sf_dir), "SampleID", "NormIntensity", F.xxhash64("peptide_row_id"))
    return quantiles.percentiles(quantiles.merge_sketches(parts, "SampleID"), "SampleID", SHARES, SHARE_NAMES)


@R.add("p5_sketches")
def p5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sketches themselves, by SampleID: the form in which loads and days are put together."""
    parts = quantiles.build_sketches(_intensities(spark, sf_dir), "SampleID", "NormIntensity", F.xxhash64("peptide_row_id"))
    return quantiles.merge_sketches(parts, "SampleID")


@R.add("p10_found")
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which at least a part was read in the wrong encoding."""
    return mojibake.restore_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id")


@R.add("p10_restored")
def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those documents with their text restored."""
    return mojibake.restore_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@R.add("p8_ids")
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text by byte_bpe_50k."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


CAPACITY = 2048


@R.add("p9_packed")
def p9_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, measured in tokens, in containers of 2,048."""
    return packing.pack(bpe.count_tokens(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)
