"""Queries of whole pipelines and of the event roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundera.functions.values import log2_rounded
from abundera.plans import pipeline
from abundera.queries import base as B
from abundera.queries.common import Registry, table
from abundera.streaming import rollups

R = Registry()

_GATED = f"""WITH {B.IONS}, gated AS (SELECT * FROM ions JOIN (SELECT protein, sample FROM ions WHERE condition <> 'Empty' AND length(peptide) >= 7 GROUP BY ALL HAVING count(DISTINCT peptide) >= 2) USING (protein, sample) WHERE condition <> 'Empty' AND length(peptide) >= 7),
top AS (SELECT protein, peptide, peptidoform, charge, sample, condition, biorep, max(intensity) AS intensity FROM gated GROUP BY ALL), peptides AS (SELECT protein, peptide, sample, biorep, condition, sum(intensity) AS intensity FROM top GROUP BY ALL)"""


@R.add("flow_sum", f"{_GATED} SELECT protein, sample, round(log2(sum(intensity)), 9) AS value FROM peptides GROUP BY protein, sample")
def flow_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: predicates, distinct gate, maximum per ion, two-level sum, protein by sample."""
    config = pipeline.PipelineConfig(quant="sum", sample_normalization="none", min_length=7, min_unique=2)
    return pipeline.features_to_proteins(B.ions(spark, sf_dir), config).withColumn("value", log2_rounded(F.col("value")))


@R.add("flow_top3", f"{_GATED} SELECT protein, sample, round(log2(avg(intensity)), 9) AS value FROM (SELECT * FROM peptides QUALIFY row_number() OVER (PARTITION BY protein, sample ORDER BY intensity DESC, peptide) <= 3) GROUP BY protein, sample")
def flow_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pipeline.PipelineConfig(quant="top3", sample_normalization="none", min_length=7, min_unique=2)
    return pipeline.features_to_proteins(B.ions(spark, sf_dir), config).withColumn("value", log2_rounded(F.col("value")))


@R.add(
    "flow_global_median",
    f"""WITH {B.IONS}, r AS (SELECT * FROM ions WHERE condition <> 'Empty'), m AS (SELECT sample, median(intensity) AS m FROM r GROUP BY sample), n AS (SELECT r.* REPLACE (intensity * (SELECT median(m) FROM m) / m.m AS intensity) FROM r JOIN m USING (sample)),
g AS (SELECT * FROM n JOIN (SELECT protein, sample FROM n GROUP BY ALL HAVING count(DISTINCT peptide) >= 2) USING (protein, sample)),
top AS (SELECT protein, peptide, peptidoform, charge, sample, condition, biorep, max(intensity) AS intensity FROM g GROUP BY ALL), peptides AS (SELECT protein, peptide, sample, biorep, condition, sum(intensity) AS intensity FROM top GROUP BY ALL)
SELECT protein, sample, round(log2(median(intensity)), 8) AS value FROM peptides GROUP BY protein, sample""",
)
def flow_global_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.features_to_proteins(B.ions(spark, sf_dir), pipeline.PipelineConfig(quant="median")).withColumn("value", log2_rounded(F.col("value"), 8))


@R.add("flow_peptides", f"{_GATED} SELECT protein, peptide, sample, biorep, condition, round(log2(intensity), 9) AS intensity FROM peptides")
def flow_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pipeline.PipelineConfig(sample_normalization="none", min_length=7)
    return pipeline.features_to_peptides(B.ions(spark, sf_dir), config).withColumn("intensity", log2_rounded(F.col("intensity")))


@R.add("flow_differential")
def flow_differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abundera.queries.numeric import design

    config = pipeline.PipelineConfig(contrasts=(("A", "B"),), de_method="limma")
    d = design(spark, sf_dir)
    return pipeline.differential_expression(pipeline.features_to_proteins(B.ions(spark, sf_dir).where("TRUE"), config, d), d, config)


@R.add("str1_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS largest FROM events GROUP BY ALL")
def str1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming roll-up's expressions over the batch table (the stream itself is tested in tests)."""
    return rollups.windowed_rollup(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@R.add("str1_sessions", "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def str1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.sessions(table(spark, sf_dir, "events"))
