"""Queries of the relational operators: predicates, group filters, joins, aggregates, windows, sets, reshaping, scalars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions import keys as K
from abundera.functions.values import is_measured, log2_rounded
from abundera.operators import filters as X
from abundera.operators import rollup
from abundera.operators import windows as V
from abundera.queries import base as B
from abundera.queries.common import Registry, table
from abundera.sources import features as SF
from abundera.sources import sinks, tables

R = Registry()
WITH = f"WITH {B.IONS} "


def _rows(name: str, sql: str, fn) -> None:
    """A filter over the ions, compared by the ids of the rows it keeps."""
    R.add(name, sql)(lambda spark, sf_dir: fn(B.ions(spark, sf_dir)).select("row_id"))


# ---- sources ---------------------------------------------------------------------------------------------------------


@R.add("src1_feature_scan", "SELECT feature_id, sequence, CAST(charge AS INTEGER) AS charge, run_file_name AS run, len(intensities) AS n_entries FROM feature")
def src1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.features(spark, sf_dir).select("feature_id", "sequence", "charge", "run", F.when(F.col("intensities").isNotNull(), F.size("intensities")).cast("bigint").alias("n_entries"))


@R.add(
    "src2_layouts",
    """SELECT feature_id, CAST(charge AS INTEGER) AS charge, run_file_name AS run, len(pg_accessions) AS n_members FROM feature
UNION ALL SELECT feature_id, CAST(charge AS INTEGER), run_file_name, len(pg_accessions) FROM feature_interim
UNION ALL SELECT feature_id, precursor_charge, reference_file_name, len(pg_accessions) FROM feature_legacy""",
)
def src2(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = SF.read_features(spark, *(f"{sf_dir}/{n}.parquet" for n in ("feature", "feature_interim", "feature_legacy")))
    return df.select("feature_id", "charge", "run", F.when(F.col("accessions").isNotNull(), F.size("accessions")).cast("bigint").alias("n_members"))


@R.add(
    "src3_expand",
    f"""WITH u AS (SELECT feature_id, run_file_name AS run, imputed_labels, unnest(intensities, max_depth := 1) AS e FROM feature)
SELECT feature_id, {B.SQL_RUN_KEY.format('run')} AS run_key, e.label AS label, CAST(e.intensity AS DOUBLE) AS intensity FROM u
WHERE e IS NOT NULL AND isfinite(e.intensity) AND e.intensity > 0 AND NOT coalesce(list_contains(imputed_labels, e.label), false)""",
)
def src3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.entries(spark, sf_dir).select("feature_id", "run_key", "label", "intensity")


@R.add("src4_psms", "SELECT psm_id, feature_id, sequence, is_decoy, run_file_name AS run FROM psm")
def src4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SF.read_psms(spark, f"{sf_dir}/psm.parquet")


_CLEAN = "(CASE WHEN regexp_replace(upper(trim({a})), '-[0-9]+$', '') = '' THEN nullif(upper(trim({a})), '') ELSE regexp_replace(upper(trim({a})), '-[0-9]+$', '') END)"
_ACC = "(CASE WHEN len(string_split(trim({0}), '|')) = 3 THEN string_split(trim({0}), '|')[2] ELSE trim({0}) END)"
_CA = lambda x: _CLEAN.format(a=_ACC.format(x))
_GROUPS = f"""groups AS (SELECT feature_id, coalesce(nullif(array_to_string(list_sort(list_distinct(list_filter(list_transform(pg_accessions, lambda a: {_CA('a.accession')}), lambda x: x IS NOT NULL))), ';'), ''), {_CA('anchor_protein')}) AS protein FROM feature)"""


@R.add("src5_mapping", f"WITH {_GROUPS} SELECT feature_id, protein FROM groups")
def src5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SF.feature_groups(B.features(spark, sf_dir))


@R.add(
    "src6_msstats",
    f"""{WITH}, u AS (SELECT peptide, count(DISTINCT protein) = 1 AS is_unique FROM ions GROUP BY peptide)
SELECT i.protein, i.peptide AS sequence, i.charge, i.run, count(*) AS n_entries, round(log2(sum(intensity)), 9) AS log2_sum, any_value(is_unique) AS is_unique
FROM ions i JOIN u USING (peptide) GROUP BY i.protein, i.peptide, i.charge, i.run""",
)
def src6(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = B.ions(spark, sf_dir).select(F.col("protein").alias("ProteinName"), F.col("peptide").alias("PeptideSequence"), F.col("charge").alias("PrecursorCharge"), F.col("run").alias("Run"), F.col("intensity").alias("Intensity"))
    f = tables.from_msstats(raw)
    total = F.aggregate("intensities", F.lit(0.0), lambda a, e: a + e["intensity"])
    return f.select("protein", "sequence", "charge", "run", F.size("intensities").cast("bigint").alias("n_entries"), log2_rounded(total).alias("log2_sum"), "is_unique")


@R.add("src7_channels", "SELECT DISTINCT e.label AS label, CASE WHEN regexp_matches(e.label, '^[0-9]+[NC]?$') THEN 'channel' ELSE 'run' END AS kind FROM (SELECT unnest(intensities, max_depth := 1) AS e FROM feature) WHERE e.label IS NOT NULL")
def src7(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "feature").select(F.explode("intensities").alias("e")).select(F.col("e.label").alias("label")).where("label IS NOT NULL").distinct()
    return labels.select("label", F.when(F.col("label").rlike("^[0-9]+[NC]?$"), "channel").otherwise("run").alias("kind"))


_LABEL = "trim(lower({0}))"
_LABEL_KEY = f"""(CASE WHEN (CASE WHEN trim(regexp_extract({_LABEL}, '(?:^|;)\\s*nt=([^;]*)', 1)) <> '' THEN trim(regexp_extract({_LABEL}, '(?:^|;)\\s*nt=([^;]*)', 1)) ELSE {_LABEL} END)
 IN ('raw', 'lfq', 'label-free', 'label free', 'label free sample') THEN 'label free sample' ELSE (CASE WHEN trim(regexp_extract({_LABEL}, '(?:^|;)\\s*nt=([^;]*)', 1)) <> '' THEN trim(regexp_extract({_LABEL}, '(?:^|;)\\s*nt=([^;]*)', 1)) ELSE {_LABEL} END) END)"""
_META = f"""meta AS (SELECT {B.SQL_RUN_KEY.format('"comment[data file]"')} AS run_key, {_LABEL_KEY.format('"comment[label]"')} AS label_key, sdrf_row_id, "source name" AS sample,
  "factor value[treatment]" AS condition, "comment[technical replicate]" AS techrep FROM sdrf WHERE "comment[data file]" IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_key, label_key ORDER BY sdrf_row_id) = 1)"""


@R.add("src8_sdrf", f"WITH {_META} SELECT run_key, label_key, sdrf_row_id, sample, condition, techrep FROM meta")
def src8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.metadata(spark, sf_dir).select("run_key", "label_key", "sdrf_row_id", "sample", "condition", "techrep")


@R.add("src9_sdrf_summary", f"WITH {_META} SELECT count(DISTINCT techrep) AS techreps, bool_or(label_key <> 'label free sample') AS is_isobaric, count(DISTINCT sample) AS samples, count(DISTINCT label_key) AS labels FROM meta")
def src9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sdrf_summary(B.metadata(spark, sf_dir))


@R.add("src10_peptide_table", "SELECT peptide_row_id, ProteinName AS protein, NormIntensity AS intensity FROM peptide WHERE isfinite(NormIntensity) AND NormIntensity > 0")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_peptides(spark, f"{sf_dir}/peptide.parquet").select("peptide_row_id", "protein", "intensity")


@R.add("src13_combine", "SELECT 'a' AS batch, project_accession, count(*) AS n FROM sdrf GROUP BY ALL UNION ALL SELECT 'b', project_accession, count(*) FROM documents GROUP BY ALL")
def src13(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (table(spark, sf_dir, t).groupBy("project_accession").agg(F.count(F.lit(1)).alias("n")) for t in ("sdrf", "documents"))
    return tables.combine_datasets({"a": a, "b": b})


# ---- row predicates ---------------------------------------------------------------------------------------------------

_rows("prd1_where", f"{WITH} SELECT row_id FROM ions WHERE intensity >= 10000 AND length(peptide) >= 7", lambda d: d.where(X.measured_at_least(1e4) & X.length_between(7)))
_rows("prd7_intensity_floor", f"{WITH} SELECT row_id FROM ions WHERE intensity >= 1e-10", lambda d: d.where(X.measured_at_least(1e-10)))
_rows("prd8_length", f"{WITH} SELECT row_id FROM ions WHERE length(peptide) BETWEEN 8 AND 20", lambda d: d.where(X.length_between(8, 20)))
_rows("prd9_charges", f"{WITH} SELECT row_id FROM ions WHERE charge IN (2, 3)", lambda d: d.where(X.charge_in([2, 3])))
_rows(
    "prd10_missed_cleavages",
    f"""{WITH} SELECT row_id FROM ions WHERE len(list_filter(range(1, length(peptide) - 1), lambda i: peptide[i] IN ('K', 'R') AND peptide[i + 1] <> 'P' AND i + 2 <= length(peptide))) <= 0""",
    lambda d: d.where(X.missed_cleavages_at_most(0)),
)
_rows("prd11_patterns", f"{WITH} SELECT row_id FROM ions WHERE NOT regexp_matches(peptide, 'M.*C') AND NOT regexp_matches(peptide, '^N')", lambda d: d.where(X.sequence_without(["M.*C", "^N"])))
_rows("prd14_usable", f"{WITH} SELECT row_id FROM ions WHERE condition <> 'Empty'", X.usable_rows)
_rows("prd18_sql_filter", f"{WITH} SELECT row_id FROM ions WHERE charge > 2 AND intensity < 1e6", lambda d: d.where("charge > 2 AND intensity < 1e6"))

_MARKS = " OR ".join(f"contains(upper({{0}}), '{m}')" for m in K.CONTAMINANT_MARKS)


@R.add(
    "prd2_contaminants",
    f"""SELECT feature_id, len(list_filter(list_transform(pg_accessions, lambda a: a.accession), lambda x: NOT ({_MARKS.format('x')}))) AS n_left FROM feature
WHERE NOT coalesce(is_decoy, false) AND len(pg_accessions) > 0
AND NOT coalesce(len(list_filter(list_transform(pg_accessions, lambda a: a.accession), lambda x: contains(upper(x), 'DECOY'))) > 0, false)
AND NOT (len(list_filter(list_transform(pg_accessions, lambda a: a.accession), lambda x: coalesce({_MARKS.format('x')}, false))) = len(pg_accessions))""",
)
def prd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.without_contaminants(B.features(spark, sf_dir)).select("feature_id", F.size("accessions").cast("bigint").alias("n_left"))


@R.add(
    "prd3_strip_members",
    f"SELECT feature_id, array_to_string(list_filter(list_transform(pg_accessions, lambda a: a.accession), lambda x: NOT ({_MARKS.format('x')})), ';') AS members FROM feature WHERE pg_accessions IS NOT NULL",
)
def prd3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.features(spark, sf_dir).where("accessions IS NOT NULL").select("feature_id", F.array_join(K.strip_contaminants("accessions"), ";").alias("members"))


@R.add(
    "prd4_twins",
    f"""{WITH}, r AS (SELECT CASE WHEN row_id % 7 = 0 THEN 'CONTAM_' || protein ELSE protein END AS protein, peptide FROM ions),
d AS (SELECT DISTINCT protein, peptide FROM r),
t AS (SELECT a.protein, substr(a.protein, 8) AS twin FROM d a LEFT JOIN d b ON b.protein = substr(a.protein, 8) AND b.peptide = a.peptide WHERE starts_with(a.protein, 'CONTAM_') GROUP BY a.protein HAVING count(b.peptide) = count(*))
SELECT coalesce(t.twin, r.protein) AS protein, count(*) AS n FROM r LEFT JOIN t USING (protein) GROUP BY ALL""",
)
def prd4(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = B.ions(spark, sf_dir).withColumn("protein", F.when(F.col("row_id") % 7 == 0, F.concat(F.lit("CONTAM_"), "protein")).otherwise(F.col("protein")))
    return X.rename_contaminant_twins(marked).groupBy("protein").agg(F.count(F.lit(1)).alias("n"))


@R.add(
    "prd5_named_score",
    "SELECT feature_id FROM feature WHERE len(list_filter(additional_scores, lambda s: s.score_name = 'posterior_error' AND coalesce(CASE WHEN s.higher_better THEN s.score_value >= 0.5 ELSE s.score_value <= 0.5 END, false))) > 0",
)
def prd5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feature").where(X.score_passes("posterior_error", 0.5)).select("feature_id")


@R.add(
    "prd6_modifications",
    "SELECT feature_id FROM feature WHERE NOT (coalesce(len(list_filter(modifications, lambda m: lower(m.name) IN ('acetyl') OR lower(m.accession) IN ('acetyl'))) > 0, false) OR coalesce(contains(lower(peptidoform), '[acetyl]'), false))",
)
def prd6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "feature").where(X.without_modifications(["Acetyl"])).select("feature_id")


@R.add("prd12_qvalue", "SELECT feature_id FROM feature WHERE peptide_qvalue <= 0.01")
def prd12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.qvalue_at_most(B.features(spark, sf_dir), 0.01).select("feature_id")


@R.add(
    "prd13_removed_ids",
    f"""{WITH}, ids AS (SELECT DISTINCT string_split(protein, ';')[1] AS accession FROM ions WHERE contains(protein, ';'))
SELECT row_id FROM ions WHERE NOT list_has_any(string_split(protein, ';'), (SELECT list(accession) FROM ids))""",
)
def prd13(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.ions(spark, sf_dir)
    ids = d.where(F.contains("protein", F.lit(";"))).select(F.split("protein", ";")[0].alias("accession"))
    return X.without_ids(d, ids).select("row_id")


@R.add("prd15_transferred", "SELECT feature_id FROM feature WHERE NOT coalesce(lower(identification_type) = 'transferred', id_run_file_name IS DISTINCT FROM run_file_name)")
def prd15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.features(spark, sf_dir).where("NOT is_transferred").select("feature_id")


@R.add("prd16_label_map", "SELECT label, count(*) AS n, CASE label WHEN '126' THEN '1' WHEN '127N' THEN '2' WHEN '127C' THEN '3' ELSE label END AS channel FROM (SELECT e.label AS label FROM (SELECT unnest(intensities, max_depth := 1) AS e FROM feature)) WHERE label IS NOT NULL GROUP BY label")
def prd16(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature").select(F.explode("intensities").alias("e")).select(F.col("e.label").alias("label")).where("label IS NOT NULL")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("channel", tables.lookup({"126": "1", "127N": "2", "127C": "3"}, F.col("label")))


@R.add("prd17_report_columns", f'{WITH} SELECT row_id, protein AS "ProteinName", sample AS "SampleID", intensity AS "NormIntensity" FROM ions')
def prd17(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ions(spark, sf_dir).select("row_id", "protein", "sample", "intensity").withColumnsRenamed({"protein": "ProteinName", "sample": "SampleID", "intensity": "NormIntensity"})


@R.add("prd19_subset", f"{WITH} SELECT row_id FROM ions WHERE sample IN (SELECT sample FROM ions WHERE condition = 'control')")
def prd19(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = B.ions(spark, sf_dir)
    return X.subset(d, d.where("condition = 'control'"), "sample").select("row_id")


PIPELINE = {"intensity": {"min_intensity": 1e4, "cv_threshold": 1.5}, "peptide": {"min_length": 7, "charges": [2, 3, 4]}, "protein": {"min_unique": 2}, "run_qc": {"min_features": 5}}


@R.add(
    "prd20_pipeline",
    f"""{WITH}, s1 AS (SELECT * FROM ions WHERE intensity >= 10000),
s2 AS (SELECT * FROM s1 JOIN (SELECT sample, protein, peptide FROM s1 GROUP BY ALL HAVING stddev_samp(intensity) IS NULL OR stddev_samp(intensity) / avg(intensity) <= 1.5) USING (sample, protein, peptide)),
s3 AS (SELECT * FROM s2 WHERE length(peptide) >= 7), s4 AS (SELECT * FROM s3 WHERE charge IN (2, 3, 4)),
s5 AS (SELECT * FROM s4 JOIN (SELECT protein, sample FROM s4 GROUP BY ALL HAVING count(DISTINCT peptide) >= 2) USING (protein, sample)),
s6 AS (SELECT * FROM s5 JOIN (SELECT run FROM s5 GROUP BY ALL HAVING count(DISTINCT (protein, peptide)) >= 5) USING (run))
SELECT 0 AS step, 'input' AS name, count(*) AS rows FROM ions UNION ALL SELECT 1, 'min_intensity', count(*) FROM s1 UNION ALL SELECT 2, 'cv_threshold', count(*) FROM s2
UNION ALL SELECT 3, 'length', count(*) FROM s3 UNION ALL SELECT 4, 'charges', count(*) FROM s4 UNION ALL SELECT 5, 'min_unique', count(*) FROM s5 UNION ALL SELECT 6, 'min_features', count(*) FROM s6""",
)
def prd20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.pipeline_from_config(PIPELINE).summary(B.ions(spark, sf_dir))


# ---- group filters ----------------------------------------------------------------------------------------------------

_HAVING = "{w} SELECT row_id FROM ions JOIN (SELECT {k} FROM ions GROUP BY ALL HAVING {h}) USING ({k})"
_having = lambda k, h: _HAVING.format(w=WITH, k=k, h=h)

_rows("grp1_min_unique", _having("protein, sample", "count(DISTINCT peptide) >= 2"), lambda d: X.min_unique(d, 2))
_rows("grp2_min_peptides", _having("protein", "count(DISTINCT peptide) >= 3"), lambda d: X.min_unique(d, 3, ["protein"]))
_rows("grp4_razor_remove", _having("peptide", "count(DISTINCT protein) = 1"), lambda d: X.razor(d, "remove"))
_rows(
    "grp4_razor_assign",
    f"""{WITH}, n AS (SELECT protein, count(DISTINCT peptide) AS n FROM ions GROUP BY protein),
o AS (SELECT peptide, protein FROM (SELECT DISTINCT peptide, protein FROM ions) JOIN n USING (protein) QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY n DESC, protein) = 1)
SELECT row_id FROM ions JOIN o USING (peptide, protein)""",
    lambda d: X.razor(d, "assign_to_top"),
)
_rows("grp5_cv", _having("sample, protein, peptide", "stddev_samp(intensity) IS NULL OR avg(intensity) <= 0 OR stddev_samp(intensity) / avg(intensity) <= 0.5"), lambda d: X.cv_at_most(d, 0.5))
_rows("grp6_replicates", _having("condition, protein, peptide", "count(DISTINCT techrep) >= 2"), lambda d: X.replicate_agreement(d, 2))
_rows(
    "grp7_quantile_clip",
    f"{WITH}, q AS (SELECT sample, quantile_cont(intensity, 0.05) AS lo, quantile_cont(intensity, 0.95) AS hi FROM ions GROUP BY sample) SELECT row_id FROM ions JOIN q USING (sample) WHERE intensity BETWEEN lo * (1 - 1e-12) AND hi * (1 + 1e-12)",
    lambda d: X.quantile_clip(d, 0.05, 0.95),
)
_rows("grp8_run_total", _having("run", "sum(intensity) >= 1e9"), lambda d: X.run_total_at_least(d, 1e9))
_rows("grp9_run_features", _having("run", "count(DISTINCT (protein, peptide)) >= 20 AND count(DISTINCT protein) >= 5"), lambda d: X.run_min_features(d, 20, 5))
_rows(
    "grp11_frequent",
    f"{WITH}, t AS (SELECT count(DISTINCT sample) AS t FROM ions) SELECT row_id FROM ions WHERE (protein, peptide) NOT IN (SELECT (protein, peptide) FROM ions, t GROUP BY protein, peptide, t HAVING t > 1 AND count(DISTINCT sample) < 0.02 * t)",
    lambda d: X.frequent_items(d, 0.02),
)


@R.add("grp3_protein_fdr", f"SELECT feature_id FROM (SELECT feature_id, {_CA('anchor_protein')} AS protein FROM feature) WHERE protein IN (SELECT {_CA('anchor_protein')} FROM feature GROUP BY 1 HAVING min(pg_global_qvalue) <= 0.001)")
def grp3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.protein_fdr(B.clean_protein(spark, sf_dir), 0.001).select("feature_id")


@R.add("grp10_missing_rate", f"{WITH}, u AS (SELECT sample, count(DISTINCT (protein, peptide)) AS u FROM ions GROUP BY sample) SELECT sample, run, round(1.0 - count(DISTINCT (protein, peptide)) / any_value(u), 9) AS missing_rate FROM ions JOIN u USING (sample) GROUP BY sample, run")
def grp10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.run_missing_rate(B.ions(spark, sf_dir)).withColumn("missing_rate", F.round("missing_rate", 9))


_WC = f"WITH {B.CELLS}, {B.SAMPLES} "


@R.add(
    "grp13_sample_correlation",
    f"""{_WC}, v AS (SELECT protein, sample, condition, log2(value) AS v FROM cells JOIN samples USING (sample)),
p AS (SELECT a.sample, b.sample AS other, corr(a.v, b.v) AS r, count(*) AS n FROM v a JOIN v b ON a.protein = b.protein AND a.condition = b.condition AND a.sample <> b.sample GROUP BY ALL HAVING count(*) >= 3)
SELECT sample, round(avg(r), 7) AS mean_correlation FROM p GROUP BY sample""",
)
def grp13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sample_correlations(B.cells(spark, sf_dir), B.samples(spark, sf_dir)).select("sample", F.round("mean_correlation", 7).alias("mean_correlation"))


@R.add("grp14_sample_entities", f"{_WC} SELECT sample, count(*) AS n FROM cells WHERE sample IN (SELECT sample FROM cells GROUP BY sample HAVING count(DISTINCT protein) >= 20) GROUP BY sample")
def grp14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sample_min_entities(B.cells(spark, sf_dir), 20).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@R.add("grp14_sample_missing", f"{_WC} SELECT sample, count(*) AS n FROM cells WHERE sample IN (SELECT sample FROM cells GROUP BY sample HAVING 1 - count(DISTINCT protein) / (SELECT count(DISTINCT protein) FROM cells) <= 0.9) GROUP BY sample")
def grp14b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sample_missing_at_most(B.cells(spark, sf_dir), 0.9).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))


@R.add("grp15_common_conditions", f"{_WC} SELECT sample, condition FROM samples WHERE condition IN (SELECT condition FROM samples GROUP BY condition HAVING count(*) >= 2)")
def grp15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.common_conditions(B.samples(spark, sf_dir), 2)


# ---- joins ------------------------------------------------------------------------------------------------------------

_ENTRIES = f"""e0 AS (SELECT feature_id, run_file_name AS run, imputed_labels, intensities, unnest(intensities, max_depth := 1) AS e FROM feature),
entries AS (SELECT feature_id, {B.SQL_RUN_KEY.format('run')} AS run_key,
  CASE WHEN len(intensities) = 1 AND coalesce({B.SQL_RUN_KEY.format('e.label')} = {B.SQL_RUN_KEY.format('run')} OR {_LABEL_KEY.format('e.label')} = 'label free sample', false) THEN 'label free sample' ELSE {_LABEL_KEY.format('e.label')} END AS label_key,
  CAST(e.intensity AS DOUBLE) AS intensity FROM e0 WHERE e IS NOT NULL AND isfinite(e.intensity) AND e.intensity > 0 AND NOT coalesce(list_contains(imputed_labels, e.label), false))"""


@R.add("jn1_metadata", f"WITH {_META}, {_ENTRIES} SELECT feature_id, run_key, label_key, intensity, sample, condition FROM entries LEFT JOIN meta USING (run_key, label_key)")
def jn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SF.attach_metadata(B.entries(spark, sf_dir), B.metadata(spark, sf_dir), strict=False).select("feature_id", "run_key", "label_key", "intensity", "sample", "condition")


@R.add("jn5_psm_groups", f"WITH {_GROUPS} SELECT psm_id, protein FROM psm JOIN groups USING (feature_id) WHERE protein IS NOT NULL")
def jn5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "psm").join(SF.feature_groups(B.features(spark, sf_dir)).where("protein IS NOT NULL"), "feature_id").select("psm_id", "protein")


@R.add("jn7_semi", f"{WITH} SELECT row_id FROM ions WHERE peptide IN (SELECT sequence FROM psm)")
def jn7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ions(spark, sf_dir).join(table(spark, sf_dir, "psm").select(F.col("sequence").alias("peptide")), "peptide", "left_semi").select("row_id")


@R.add("jn8_anti", f"{WITH} SELECT row_id FROM ions WHERE peptide NOT IN (SELECT sequence FROM psm WHERE sequence IS NOT NULL)")
def jn8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.ions(spark, sf_dir).join(table(spark, sf_dir, "psm").select(F.col("sequence").alias("peptide")), "peptide", "left_anti").select("row_id")


@R.add("jn11_outer", f"{_WC} SELECT protein, round(log2(a.v), 9) AS a, b.n AS b FROM (SELECT protein, sum(value) AS v FROM cells WHERE sample <= 'SYN000002' GROUP BY protein) a FULL JOIN (SELECT protein, count(*) AS n FROM cells WHERE sample > 'SYN000002' GROUP BY protein) b USING (protein)")
def jn11(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = B.cells(spark, sf_dir)
    a = c.where("sample <= 'SYN000002'").groupBy("protein").agg(log2_rounded(F.sum("value")).alias("a"))
    b = c.where("sample > 'SYN000002'").groupBy("protein").agg(F.count(F.lit(1)).alias("b"))
    return a.join(b, "protein", "full")


@R.add("jn12_null_safe", "SELECT f.lang, f.n, d.m FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) f JOIN (SELECT lang, max(n_chars) AS m FROM documents GROUP BY lang) d ON f.lang IS NOT DISTINCT FROM d.lang")
def jn12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a, b = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), docs.groupBy("lang").agg(F.max("n_chars").alias("m"))
    return a.join(b, a.lang.eqNullSafe(b.lang)).select(a.lang, "n", "m")


@R.add(
    "jn13_substring",
    """WITH p AS (SELECT DISTINCT project_accession AS project FROM sdrf WHERE project_accession IS NOT NULL), s AS (SELECT DISTINCT "source name" AS sample FROM sdrf)
SELECT sample, min(project) AS project FROM s JOIN p ON contains(sample, project) GROUP BY sample""",
)
def jn13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from abundera.operators.batch import match_names

    sdrf = table(spark, sf_dir, "sdrf")
    return match_names(sdrf.select(F.col("source name").alias("sample")), sdrf.select(F.col("project_accession").alias("project")))


# ---- aggregates -------------------------------------------------------------------------------------------------------

_W = f"WITH {B.PEPTIDES} "


def _cell(name: str, sql: str, fn, log: bool = True) -> None:
    shown = "round(log2(value), 9)" if log else "round(value, 6)"
    R.add(name, f"{_W} SELECT protein, sample, {shown} AS value FROM ({sql})")(
        lambda spark, sf_dir: fn(B.peptides(spark, sf_dir)).select("protein", "sample", (log2_rounded(F.col("value")) if log else F.round(F.col("value").cast("double"), 6)).alias("value"))
    )


_per = lambda agg: f"SELECT protein, sample, {agg} AS value FROM peptides GROUP BY protein, sample"

R.add("agg1_rollup", f"{_W} SELECT protein, peptide, sample, biorep, condition, round(log2(intensity), 9) AS intensity FROM peptides")(lambda spark, sf_dir: B.peptides(spark, sf_dir).withColumn("intensity", log2_rounded(F.col("intensity"))))
R.add("agg2_species", f"{_W} SELECT protein, peptide, peptidoform, charge, sample, biorep, condition, intensity FROM top")(lambda spark, sf_dir: rollup.peptide_species(B.ions(spark, sf_dir)))
_cell("agg3_sum", _per("sum(intensity)"), rollup.sum_of_peptides)
_cell("agg4_median", _per("median(intensity)"), rollup.median_of_peptides)
_cell("agg5_top3", "SELECT protein, sample, avg(intensity) AS value FROM (SELECT * FROM peptides QUALIFY row_number() OVER (PARTITION BY protein, sample ORDER BY intensity DESC, peptide) <= 3) GROUP BY protein, sample", rollup.top_n_mean)
_cell("agg6_log2_abundance", _per("median(log2(intensity))"), rollup.log2_abundance, log=False)
_cell("agg8_peptide_count", _per("CAST(count(*) AS DOUBLE)"), rollup.peptide_count, log=False)
_cell("agg8_peptide_count_distinct", _per("CAST(count(DISTINCT peptide) AS DOUBLE)"), rollup.peptide_count_distinct, log=False)
_cell("agg13_mean", _per("avg(intensity)"), rollup.mean_of_peptides)


@R.add("agg7_reporter_sum", f"WITH {_ENTRIES} SELECT run_key, label_key, round(log2(sum(intensity)), 9) AS value FROM entries GROUP BY run_key, label_key")
def agg7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.sum_of_peptides(B.entries(spark, sf_dir), ("run_key", "label_key")).withColumn("value", log2_rounded(F.col("value")))


@R.add("agg9_spectral_count", f"WITH {_GROUPS} SELECT protein, count(DISTINCT psm_id) AS value FROM psm JOIN groups USING (feature_id) WHERE protein IS NOT NULL AND NOT coalesce(psm.is_decoy, false) GROUP BY protein HAVING count(DISTINCT psm.sequence) >= 2")
def agg9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.spectral_count(table(spark, sf_dir, "psm"), SF.feature_groups(B.features(spark, sf_dir)), min_unique=2)


_REF = f"""{WITH}, r AS (SELECT protein, peptide, charge, sample, split_part(run, '_', 2) AS plex, condition = 'pooled reference' AS is_reference, max(intensity) AS intensity FROM ions GROUP BY ALL),
f AS (SELECT protein, peptide, charge, plex, avg(intensity) AS ref FROM r WHERE is_reference GROUP BY ALL),
p AS (SELECT protein, peptide, sample, median(log2(intensity / ref)) AS r FROM r JOIN f USING (protein, peptide, charge, plex) WHERE NOT is_reference GROUP BY ALL)
SELECT protein, sample, round(median(r), 8) AS value FROM p GROUP BY protein, sample"""


@R.add("agg10_ratio", _REF)
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.ions(spark, sf_dir).withColumns({"plex": F.split_part("run", F.lit("_"), F.lit(2)), "is_reference": F.col("condition") == "pooled reference"})
    return rollup.ratio_to_reference(rows).withColumn("value", F.round("value", 8))


R.add("agg11_fractions", f"{WITH} SELECT protein, peptide, sample, max(intensity) AS intensity FROM ions GROUP BY ALL")(lambda spark, sf_dir: rollup.merge_fractions(B.ions(spark, sf_dir), ["protein", "peptide", "sample"]))
R.add("agg12_run_level", f"{WITH}, t AS (SELECT protein, peptide, peptidoform, charge, sample, condition, biorep, run, techrep, max(intensity) AS intensity FROM ions GROUP BY ALL) SELECT protein, peptide, sample, biorep, condition, run, techrep, round(log2(sum(intensity)), 9) AS intensity FROM t GROUP BY ALL")(
    lambda spark, sf_dir: rollup.peptides_from_ions(B.ions(spark, sf_dir), ("run", "techrep")).withColumn("intensity", log2_rounded(F.col("intensity")))
)
R.add(
    "agg14_summary",
    f"{WITH}, l AS (SELECT sample, log2(intensity) AS v FROM ions) SELECT sample, count(v) AS count, round(avg(v), 8) AS mean, round(stddev_samp(v), 8) AS std, round(min(v), 8) AS min, round(quantile_cont(v, 0.25), 8) AS q25, round(quantile_cont(v, 0.5), 8) AS q50, round(quantile_cont(v, 0.75), 8) AS q75, round(max(v), 8) AS max FROM l GROUP BY sample",
)(lambda spark, sf_dir: (lambda s: s.select("sample", "count", *[F.round(c, 8).alias(c) for c in s.columns if c not in ("sample", "count")]))(rollup.summary_stats(B.ions(spark, sf_dir).withColumn("v", F.log2("intensity")), ["sample"], "v")))
R.add("agg15_distinct", f"{WITH} SELECT DISTINCT sample, condition, run FROM ions")(lambda spark, sf_dir: B.ions(spark, sf_dir).select("sample", "condition", "run").distinct())
R.add("agg16_deqms_count", f"{_W} SELECT protein, min(n) AS count FROM (SELECT protein, sample, count(DISTINCT peptide) AS n FROM peptides GROUP BY ALL) GROUP BY protein")(lambda spark, sf_dir: rollup.deqms_counts(B.peptides(spark, sf_dir)))
R.add("agg17_peptide_map", f"{WITH} SELECT DISTINCT peptide, protein FROM ions")(lambda spark, sf_dir: B.ions(spark, sf_dir).select("peptide", "protein").distinct())
R.add("agg18_bool", f"{WITH} SELECT protein, bool_and(charge >= 2) AS all_multi, bool_or(charge > 3) AS any_high FROM ions GROUP BY protein")(
    lambda spark, sf_dir: B.ions(spark, sf_dir).groupBy("protein").agg(F.bool_and(F.col("charge") >= 2).alias("all_multi"), F.bool_or(F.col("charge") > 3).alias("any_high"))
)
R.add("agg21_cube", f"{WITH} SELECT condition, charge, grouping(condition)::INTEGER AS g_condition, grouping(charge)::INTEGER AS g_charge, count(*) AS n, round(log2(sum(intensity)), 9) AS total FROM ions GROUP BY CUBE (condition, charge)")(
    lambda spark, sf_dir: rollup.cube_counts(B.ions(spark, sf_dir), ["condition", "charge"], "intensity").withColumn("total", log2_rounded(F.col("total")))
)
R.add("agg21_rollup", f"{WITH} SELECT condition, charge, grouping(condition)::INTEGER AS g_condition, grouping(charge)::INTEGER AS g_charge, count(*) AS n, round(log2(sum(intensity)), 9) AS total FROM ions GROUP BY ROLLUP (condition, charge)")(
    lambda spark, sf_dir: rollup.rollup_counts(B.ions(spark, sf_dir), ["condition", "charge"], "intensity").withColumn("total", log2_rounded(F.col("total")))
)
R.add("agg21_approx_distinct")(lambda spark, sf_dir: B.ions(spark, sf_dir).groupBy("sample").agg(F.approx_count_distinct("peptide", 0.02).alias("n_peptides")))


# ---- windows ----------------------------------------------------------------------------------------------------------

R.add("win1_best_ion", f"{WITH} SELECT peptidoform, charge, sample, condition, biorep, protein, run, intensity FROM ions QUALIFY row_number() OVER (PARTITION BY protein, peptide, peptidoform, charge, sample, condition, biorep ORDER BY intensity DESC, run) = 1")(
    lambda spark, sf_dir: rollup.best_ions(B.ions(spark, sf_dir).drop("row_id", "techrep")).drop("peptide")
)
R.add("win2_run_ordinal", f"{WITH} SELECT DISTINCT sample, run, dense_rank() OVER (PARTITION BY sample ORDER BY run) AS ordinal FROM ions")(lambda spark, sf_dir: V.run_ordinals(B.ions(spark, sf_dir)))
R.add("win3_distinct_over", f"{WITH} SELECT row_id, count(DISTINCT peptide) OVER (PARTITION BY protein, sample) AS n FROM ions")(lambda spark, sf_dir: X.distinct_count_over(B.ions(spark, sf_dir), ["protein", "sample"], "peptide", "n").select("row_id", "n"))
R.add("win4_share", f"WITH {B.CELLS} SELECT protein, sample, round(value / sum(value) OVER (PARTITION BY sample), 9) AS share FROM cells")(lambda spark, sf_dir: V.share_of_group(B.cells(spark, sf_dir), ["sample"], "value", "share").select("protein", "sample", F.round("share", 9).alias("share")))
R.add(
    "win5_average_rank",
    f"WITH {B.CELLS} SELECT protein, sample, rank() OVER (PARTITION BY sample ORDER BY value) + (count(*) OVER (PARTITION BY sample, value) - 1) / 2 AS rank FROM cells",
)(lambda spark, sf_dir: V.average_rank(B.cells(spark, sf_dir), ["sample"], "value", "rank").select("protein", "sample", "rank"))
R.add("win8_ntile_lag", f"{WITH}, r AS (SELECT run, sample, count(*) AS n FROM ions GROUP BY ALL) SELECT run, sample, lag(n) OVER (PARTITION BY sample ORDER BY run) AS before, lead(n) OVER (PARTITION BY sample ORDER BY run) AS after, ntile(3) OVER (PARTITION BY sample ORDER BY n, run) AS third FROM r")(
    lambda spark, sf_dir: (lambda w, v: B.ions(spark, sf_dir).groupBy("run", "sample").agg(F.count(F.lit(1)).alias("n")).select("run", "sample", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after"), F.ntile(3).over(v).cast("bigint").alias("third")))(W.partitionBy("sample").orderBy("run"), W.partitionBy("sample").orderBy("n", "run"))
)

# ---- sorting, sets, reshaping -----------------------------------------------------------------------------------------

R.add("srt3_head", f"{WITH} SELECT row_id, intensity FROM ions ORDER BY intensity DESC, row_id LIMIT 100")(lambda spark, sf_dir: B.ions(spark, sf_dir).orderBy(F.col("intensity").desc(), "row_id").limit(100).select("row_id", "intensity"))
R.add("srt4_top_variance", f"WITH {B.CELLS} SELECT protein, round(var_samp(log2(value)), 8) AS variance FROM cells GROUP BY protein HAVING count(*) > 2 ORDER BY variance DESC, protein LIMIT 50")(
    lambda spark, sf_dir: B.cells(spark, sf_dir).groupBy("protein").agg(F.round(F.var_samp(F.log2("value")), 8).alias("variance"), F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.col("variance").desc(), "protein").limit(50).drop("n")
)
R.add("set1_concat", "SELECT 'psm' AS source, sequence FROM psm UNION ALL SELECT 'feature', sequence FROM feature")(
    lambda spark, sf_dir: table(spark, sf_dir, "psm").select(F.lit("psm").alias("source"), "sequence").unionByName(table(spark, sf_dir, "feature").select(F.lit("feature").alias("source"), "sequence"))
)
R.add("set2_drop_duplicates", f"{WITH} SELECT protein, peptide, sample, min(row_id) AS row_id FROM ions GROUP BY ALL")(lambda spark, sf_dir: B.ions(spark, sf_dir).groupBy("protein", "peptide", "sample").agg(F.min("row_id").alias("row_id")))
R.add("set3_intersect", f"{WITH} SELECT peptide FROM ions INTERSECT SELECT sequence FROM feature")(lambda spark, sf_dir: B.ions(spark, sf_dir).select("peptide").intersect(table(spark, sf_dir, "feature").select("sequence")))
R.add("set3_difference", f"{WITH} SELECT peptide FROM ions EXCEPT SELECT sequence FROM feature")(lambda spark, sf_dir: B.ions(spark, sf_dir).select("peptide").subtract(table(spark, sf_dir, "feature").select("sequence")))
R.add("set3_upset", f"{WITH}, m AS (SELECT protein, array_to_string(list_sort(list(DISTINCT condition)), '&') AS members FROM ions GROUP BY protein) SELECT members, count(*) AS n FROM m GROUP BY members")(
    lambda spark, sf_dir: B.ions(spark, sf_dir).groupBy("protein").agg(F.array_join(F.array_sort(F.collect_set("condition")), "&").alias("members")).groupBy("members").agg(F.count(F.lit(1)).alias("n"))
)
CONDITIONS = ("control", "heat shock", "high dose", "knockdown A", "knockdown B", "low dose", "pooled reference", "recovery", "starved", "treated 24h", "treated 2h", "vehicle")
R.add("rsh1_pivot", f"{WITH} SELECT protein, " + ", ".join(f"count(*) FILTER (condition = '{c}') AS \"{c}\"" for c in CONDITIONS) + " FROM ions GROUP BY protein")(
    lambda spark, sf_dir: B.ions(spark, sf_dir).groupBy("protein").pivot("condition", list(CONDITIONS)).agg(F.count(F.lit(1))).fillna(0)
)
R.add("rsh2_unpivot", "SELECT sdrf_row_id, f AS field, v AS value FROM (SELECT sdrf_row_id, unnest(['organism part', 'cell type', 'disease']) AS f, unnest([\"characteristics[organism part]\", \"characteristics[cell type]\", \"characteristics[disease]\"]) AS v FROM sdrf) WHERE v IS NOT NULL")(
    lambda spark, sf_dir: sinks.long_from_wide(table(spark, sf_dir, "sdrf").select("sdrf_row_id", *[F.col(f"`characteristics[{f}]`").alias(f) for f in ("organism part", "cell type", "disease")]), "sdrf_row_id", "field", "value")
)
R.add("rsh3_members", f"{WITH} SELECT row_id, unnest(string_split(protein, ';')) AS member FROM ions")(lambda spark, sf_dir: B.ions(spark, sf_dir).select("row_id", F.explode(F.split("protein", ";")).alias("member")))
R.add("rsh5_factorize", f"{WITH}, f AS (SELECT condition, min(row_id) AS first FROM ions GROUP BY condition) SELECT condition, row_number() OVER (ORDER BY first) - 1 AS code FROM f")(lambda spark, sf_dir: V.factorize(B.ions(spark, sf_dir), "condition", "row_id"))
R.add("snk1_wide", f"WITH {B.CELLS} SELECT protein, sample, coalesce(round(log2(value), 9), 0) AS value FROM cells")(
    lambda spark, sf_dir: sinks.long_from_wide(sinks.wide_matrix(B.cells(spark, sf_dir).withColumn("value", log2_rounded(F.col("value"))), method="median"))
)
R.add("snk6_annotated", f"WITH {B.CELLS} SELECT protein, sample, round(log2(value), 9) AS value FROM cells")(lambda spark, sf_dir: (lambda x: x.select("protein", "sample", log2_rounded(F.col("X")).alias("value")))(sinks.annotated_tables(B.cells(spark, sf_dir))["X"]))

# ---- scalars ----------------------------------------------------------------------------------------------------------

R.add(
    "sc1_strings",
    "SELECT doc_id, length(trim(source)) AS n, upper(source) AS up, replace(source, '_', '-') AS dashed, split_part(source, '_', 1) AS head, strpos(source, '_') AS at, source LIKE 'lab!_%' ESCAPE '!' AS is_lab FROM documents",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select(
        "doc_id", F.length(F.trim("source")).cast("bigint").alias("n"), F.upper("source").alias("up"), F.replace(F.col("source"), F.lit("_"), F.lit("-")).alias("dashed"),
        F.split_part("source", F.lit("_"), F.lit(1)).alias("head"), F.instr("source", "_").cast("bigint").alias("at"), F.expr("source LIKE 'lab!_%' ESCAPE '!'").alias("is_lab"),
    )
)
R.add("sc2_regex", "SELECT doc_id, regexp_extract(text, 'ZX[0-9A-Z]{5}', 0) AS first_accession, len(regexp_extract_all(text, 'ZX[0-9A-Z]{5}')) AS n, regexp_matches(text, 'mM|µM') AS has_unit FROM documents WHERE text IS NOT NULL")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract("text", "ZX[0-9A-Z]{5}", 0).alias("first_accession"), F.regexp_count("text", F.lit("ZX[0-9A-Z]{5}")).cast("bigint").alias("n"), F.col("text").rlike("mM|µM").alias("has_unit"))
)
R.add("sc3_lists", "SELECT feature_id, len(list_filter(intensities, lambda e: e.intensity > 1e6)) AS high, list_contains(list_transform(intensities, lambda e: e.label), '126') AS has_126 FROM feature WHERE intensities IS NOT NULL AND len(list_filter(intensities, lambda e: e.label IS NULL)) = 0")(
    lambda spark, sf_dir: table(spark, sf_dir, "feature").where(F.col("intensities").isNotNull() & (F.size(F.filter("intensities", lambda e: e["label"].isNull())) == 0)).select("feature_id", F.size(F.filter("intensities", lambda e: (e["intensity"] > 1e6) & ~F.isnan(e["intensity"]) | F.isnan(e["intensity"]))).cast("bigint").alias("high"), F.array_contains(F.transform("intensities", lambda e: e["label"]), "126").alias("has_126"))
)
R.add("sc4_casts", "SELECT psm_id, coalesce(is_decoy, false) AS is_decoy, nullif(run_file_name, '') AS run, TRY_CAST(regexp_extract(run_file_name, '_([0-9]+)\\.', 1) AS INTEGER) AS rep, CASE WHEN feature_id IS NULL THEN 'lost' ELSE 'linked' END AS link FROM psm")(
    lambda spark, sf_dir: table(spark, sf_dir, "psm").select("psm_id", F.coalesce("is_decoy", F.lit(False)).alias("is_decoy"), F.nullif(F.col("run_file_name"), F.lit("")).alias("run"), F.regexp_extract("run_file_name", r"_([0-9]+)\.", 1).try_cast("int").alias("rep"), F.when(F.col("feature_id").isNull(), "lost").otherwise("linked").alias("link"))
)
R.add("sc5_math", f"{WITH} SELECT row_id, round(log2(intensity), 9) AS l2, round(ln(intensity), 9) AS l, round(log10(intensity), 9) AS l10, round(sqrt(intensity), 3) AS root, floor(log10(intensity))::BIGINT AS decade FROM ions WHERE intensity BETWEEN 1 AND 1e12")(
    lambda spark, sf_dir: B.ions(spark, sf_dir).where("intensity BETWEEN 1 AND 1e12").select("row_id", F.round(F.log2("intensity"), 9).alias("l2"), F.round(F.log("intensity"), 9).alias("l"), F.round(F.log10("intensity"), 9).alias("l10"), F.round(F.sqrt("intensity"), 3).alias("root"), F.floor(F.log10("intensity")).alias("decade"))
)
R.add("sc6_quantiles", f"{WITH} SELECT sample, round(quantile_cont(log2(intensity), 0.1), 8) AS q10, round(median(log2(intensity)), 8) AS med, round(stddev_pop(log2(intensity)), 8) AS sd FROM ions GROUP BY sample")(
    lambda spark, sf_dir: B.ions(spark, sf_dir).withColumn("v", F.log2("intensity")).groupBy("sample").agg(F.round(F.percentile("v", 0.1), 8).alias("q10"), F.round(F.median("v"), 8).alias("med"), F.round(F.stddev_pop("v"), 8).alias("sd"))
)
R.add(
    "sc8_keys",
    f"SELECT feature_id, {B.SQL_RUN_KEY.format('run_file_name')} AS run_key, {_CA('anchor_protein')} AS protein, regexp_replace(regexp_replace(peptidoform, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '[.\\-]', '', 'g') AS peptide FROM feature",
)(lambda spark, sf_dir: table(spark, sf_dir, "feature").select("feature_id", K.run_key("run_file_name").alias("run_key"), K.clean_accession("anchor_protein").alias("protein"), K.canonical_peptide("peptidoform").alias("peptide")))
R.add("sc12_json", "SELECT record_id, json_extract_string(payload, '$.sequence') AS sequence, json_extract_string(payload, '$.charge') AS charge FROM feature_drop WHERE json_valid(payload)")(
    lambda spark, sf_dir: table(spark, sf_dir, "feature_drop").withColumn("v", F.try_parse_json("payload")).where("v IS NOT NULL").select("record_id", F.get_json_object("payload", "$.sequence").alias("sequence"), F.get_json_object("payload", "$.charge").alias("charge"))
)
R.add("sc13_dates", "SELECT feature_id, date_trunc('month', acquired_at)::DATE AS month, date_diff('second', acquired_at, ingested_at) AS delay FROM feature WHERE acquired_at IS NOT NULL AND ingested_at IS NOT NULL")(
    lambda spark, sf_dir: table(spark, sf_dir, "feature").where("acquired_at IS NOT NULL AND ingested_at IS NOT NULL").select("feature_id", F.to_date(F.date_trunc("month", "acquired_at")).alias("month"), F.expr("timestampdiff(SECOND, date_trunc('second', acquired_at), date_trunc('second', ingested_at))").alias("delay"))
)
R.add("sc11_factor_label", "SELECT sdrf_row_id, coalesce(nullif(trim(regexp_extract(\"comment[label]\", '(?i)(?:^|;)\\s*QY=([^;]*)', 1)), ''), nullif(trim(regexp_extract(\"comment[label]\", '(?i)(?:^|;)\\s*CN=([^;]*)', 1)), ''), nullif(trim(regexp_extract(\"comment[label]\", '(?i)(?:^|;)\\s*NT=([^;]*)', 1)), ''), trim(\"comment[label]\")) AS label FROM sdrf")(
    lambda spark, sf_dir: table(spark, sf_dir, "sdrf").select("sdrf_row_id", K.factor_label(F.col("`comment[label]`")).alias("label"))
)
