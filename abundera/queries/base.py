"""Shared inputs of the operator queries, and the same inputs as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundera.functions import keys as K
from abundera.functions.values import MISSING_WORDS, is_measured, is_missing
from abundera.operators import rollup
from abundera.queries.common import table
from abundera.sources.features import adapt_features, explode_intensities
from abundera.sources.tables import one_per_run_label, sdrf_table

_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in MISSING_WORDS)


def sql_missing(col: str) -> str:
    return f"({col} IS NULL OR trim(lower(regexp_replace({col}, '\\s+', ' ', 'g'))) IN ({_WORDS}))"


def ions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured peptide rows with protein, sample, condition and run, canonical names.

    The charge stands for the peptidoform; a sample has one condition, the
    smallest it is given with, so that designs are well defined.
    """
    return (
        table(spark, sf_dir, "peptide")
        .where(is_measured("NormIntensity") & F.col("ProteinName").isNotNull() & ~is_missing("SampleID") & ~is_missing("Condition") & F.col("Run").isNotNull())
        .select(
            F.col("peptide_row_id").alias("row_id"), F.col("ProteinName").alias("protein"), F.col("PeptideCanonical").alias("peptide"), F.col("PeptideCanonical").alias("peptidoform"),
            F.col("PrecursorCharge").alias("charge"), F.col("SampleID").alias("sample"), F.col("Condition").alias("condition"), F.col("BioReplicate").alias("biorep"),
            F.col("Run").alias("run"), F.col("TechReplicate").alias("techrep"), F.col("NormIntensity").alias("intensity"),
        )
    )


IONS = f"""ions AS (SELECT peptide_row_id AS row_id, ProteinName AS protein, PeptideCanonical AS peptide, PeptideCanonical AS peptidoform, PrecursorCharge AS charge,
  SampleID AS sample, Condition AS condition, BioReplicate AS biorep, Run AS run, TechReplicate AS techrep, NormIntensity AS intensity FROM peptide
  WHERE isfinite(NormIntensity) AND NormIntensity > 0 AND ProteinName IS NOT NULL AND NOT {sql_missing('SampleID')} AND NOT {sql_missing('Condition')} AND Run IS NOT NULL)"""


def peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptide level: maximum per ion, summed."""
    return rollup.peptides_from_ions(ions(spark, sf_dir))


PEPTIDES = f"""{IONS}, top AS (SELECT protein, peptide, peptidoform, charge, sample, condition, biorep, max(intensity) AS intensity FROM ions GROUP BY ALL),
peptides AS (SELECT protein, peptide, sample, biorep, condition, sum(intensity) AS intensity FROM top GROUP BY ALL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Protein by sample: summed peptides, ``(protein, sample, value)``."""
    return rollup.sum_of_peptides(peptides(spark, sf_dir))


CELLS = f"{PEPTIDES}, cells AS (SELECT protein, sample, sum(intensity) AS value FROM peptides GROUP BY ALL)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample, condition)``, one row a sample: its most frequent condition, ties to the smallest name."""
    counted = ions(spark, sf_dir).groupBy("sample", "condition").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("sample").agg(F.min_by("condition", F.struct((-F.col("n")).alias("n"), "condition")).alias("condition"))


SAMPLES = """counted AS (SELECT sample, condition, count(*) AS n FROM ions GROUP BY ALL),
samples AS (SELECT sample, condition FROM counted QUALIFY row_number() OVER (PARTITION BY sample ORDER BY n DESC, condition) = 1)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapt_features(table(spark, sf_dir, "feature"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_intensities(features(spark, sf_dir))


SQL_RUN_KEY = "regexp_replace(regexp_replace(lower(trim({0})), '^.*[/\\\\]', ''), '\\.(raw|mzml|d|wiff)$', '')"


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample metadata, one row per run and label (the row of smallest id)."""
    return one_per_run_label(sdrf_table(table(spark, sf_dir, "sdrf"), "factor value[treatment]"), "sdrf_row_id")


def clean_protein(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).withColumn("protein", K.clean_accession("anchor_protein"))
