"""Queries of the remaining sources, sinks, joins, sorts, scalars and workflows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundera.functions import keys as K
from abundera.functions import special
from abundera.functions.values import log2_rounded
from abundera.operators import atlas, batch, de, fdr, lfq, normalize, pibaq, rollup
from abundera.plans import pipeline, registry
from abundera.queries import base as B
from abundera.queries import numeric as N
from abundera.queries import relational as REL
from abundera.queries.common import Registry, table
from abundera.session import pandas_bounded, scratch_path
from abundera.sources import features as SF
from abundera.sources import sinks, tables

R = Registry()
WI = f"WITH {B.IONS} "
WC = f"WITH {B.CELLS} "

# ---- sources and sinks: written below the shared folder and read back ------------------------------------------------------


@R.add("src11_fasta", f"WITH {N.EDGES} SELECT accession, max(peptide) AS protein_sequence FROM edges GROUP BY accession")
def src11(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    p = N.edges(spark, sf_dir).groupBy("accession").agg(F.max("peptide").alias("s"))
    p.select(F.concat(F.lit(">sp|"), "accession", F.lit("|X some protein\n"), "s").alias("value")).write.text(path)
    return tables.read_fasta(spark, path)


@R.add("src12_result_folder", f"{WC} SELECT protein, sample, round(log2(value), 6) AS value FROM cells")
def src12(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "long")
    sinks.write_long_tsv(B.cells(spark, sf_dir).withColumn("value", log2_rounded(F.col("value"), 6)), path)
    return tables.read_result_folder(spark, path).select("protein", "sample", F.col("value").cast("double").alias("value"))


@R.add("src15_dataset", f"{WC} SELECT protein, sample, round(log2(value), 9) AS value FROM cells")
def src15(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "dataset")
    tables.save_dataset({"proteins": B.cells(spark, sf_dir)}, path, ["rolled up"])
    return N.l2(tables.load_dataset(spark, path)["proteins"], digits=9)


@R.add("src16_sql_relation", "SELECT lang, count(*) AS n FROM documents GROUP BY lang")
def src16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("SELECT lang, count(*) AS n FROM {docs} GROUP BY lang", docs=table(spark, sf_dir, "documents"))


@R.add("src17_csv_to_parquet", f"{WI} SELECT row_id, sample, run, charge, round(log2(intensity), 9) AS intensity FROM ions")
def src17(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = scratch_path(spark, "csv"), scratch_path(spark, "from-csv")
    B.ions(spark, sf_dir).select("row_id", "sample", "run", "charge", "intensity").write.csv(a, header=True)
    tables.csv_to_parquet(spark, a, b)
    return spark.read.parquet(b).select(F.col("row_id").cast("bigint").alias("row_id"), "sample", "run", F.col("charge").cast("int").alias("charge"), log2_rounded(F.col("intensity").cast("double")).alias("intensity"))


R.add("src14_aliases", "WITH a AS (SELECT term AS canonical, unnest(synonyms) AS label FROM term_list WHERE synonyms IS NOT NULL) SELECT DISTINCT term AS label, term AS canonical FROM term_list UNION ALL SELECT label, min(canonical) FROM a WHERE label NOT IN (SELECT term FROM term_list) GROUP BY label")(
    lambda spark, sf_dir: (lambda t: tables.with_aliases(t.select(F.col("term").alias("label")), t.select(F.col("term").alias("canonical"), F.col("synonyms").alias("aliases"))))(table(spark, sf_dir, "term_list"))
)
R.add("snk3_cell_precision", N.PRECISION)(lambda spark, sf_dir: (lambda path: (sinks.write_peptides(lfq.cell_precision(B.ions(spark, sf_dir), B.cells(spark, sf_dir)), path), N.l2(spark.read.parquet(path), "precision", 6))[1])(scratch_path(spark, "precision")))
R.add("src18_sample_batches", f"{WI}, s AS (SELECT sample, (row_number() OVER (ORDER BY sample) - 1) // 10 AS batch FROM (SELECT DISTINCT sample FROM ions)) SELECT batch, count(*) AS n FROM ions JOIN s USING (sample) GROUP BY batch")(
    lambda spark, sf_dir: (lambda d: d.join(d.select("sample").distinct().withColumn("batch", F.expr("cast((row_number() over (order by sample) - 1) div 10 as bigint)")), "sample").groupBy("batch").agg(F.count(F.lit(1)).alias("n")))(B.ions(spark, sf_dir))
)


@R.add("snk2_peptides", f"WITH {B.PEPTIDES} SELECT protein, peptide, sample, biorep, condition, round(log2(intensity), 9) AS intensity FROM peptides")
def snk2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "peptides")
    sinks.write_peptides(B.peptides(spark, sf_dir), path)
    return N.l2(spark.read.parquet(path).select("protein", "peptide", "sample", "biorep", "condition", "intensity"), "intensity", 9)


@R.add("snk4_tests", f"{N._TESTS}, {N._BH.format(t='tests')} SELECT protein, 'B-A' AS contrast, n_a, n_b, round(pvalue, 6) AS pvalue, round(adj, 7) AS adj_pvalue FROM bh")
def snk4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tests")
    sinks.write_tests(fdr.benjamini_hochberg(N._tests(spark, sf_dir)), path)
    read = spark.read.csv(path, header=True)
    return N._r(read.select("protein", "contrast", *[F.col(c).cast(t).alias(c) for c, t in (("n_a", "bigint"), ("n_b", "bigint"), ("pvalue", "double"), ("adj_pvalue", "double"))]), pvalue=6, adj_pvalue=7)


# ---- joins -------------------------------------------------------------------------------------------------------------------

R.add("jn2_scale_map", f"{WI}, m AS (SELECT sample, run, 2.0::DOUBLE AS factor FROM ions WHERE techrep = 1 GROUP BY ALL) SELECT row_id, intensity * coalesce(factor, 1) AS intensity FROM ions LEFT JOIN m USING (sample, run)")(
    lambda spark, sf_dir: (lambda d: normalize.scale_runs(d, d.where("techrep = 1").select("sample", "run", F.lit(2.0).alias("factor")).distinct()).select("row_id", "intensity"))(B.ions(spark, sf_dir))
)
R.add("jn3_chain", f"{WI}, m AS (SELECT sample, run, median(intensity) AS m FROM ions GROUP BY ALL), a AS (SELECT sample, avg(m) AS a FROM m GROUP BY sample), r AS (SELECT DISTINCT sample, run, techrep FROM ions) SELECT sample, run, techrep, round(a / m, 8) AS ratio FROM m JOIN a USING (sample) JOIN r USING (sample, run)")(
    lambda spark, sf_dir: (lambda d: (lambda m: m.join(m.groupBy("sample").agg(F.avg("m").alias("a")), "sample").join(d.select("sample", "run", "techrep").distinct(), ["sample", "run"]).select("sample", "run", "techrep", F.round(F.col("a") / F.col("m"), 8).alias("ratio")))(d.groupBy("sample", "run").agg(F.median("intensity").alias("m"))))(B.ions(spark, sf_dir))
)
R.add("jn4_reference", f"{WI}, r AS (SELECT protein, peptide, charge, condition, avg(intensity) AS ref FROM ions WHERE techrep = 1 GROUP BY ALL) SELECT row_id, round(log2(intensity) - log2(ref), 8) AS ratio FROM ions LEFT JOIN r USING (protein, peptide, charge, condition) WHERE techrep <> 1 AND ref IS NOT NULL")(
    lambda spark, sf_dir: (lambda d: d.where("techrep <> 1").join(d.where("techrep = 1").groupBy("protein", "peptide", "charge", "condition").agg(F.avg("intensity").alias("ref")), ["protein", "peptide", "charge", "condition"], "left").where("ref IS NOT NULL").select("row_id", F.round(F.log2("intensity") - F.log2("ref"), 8).alias("ratio")))(B.ions(spark, sf_dir))
)
R.add("jn6_reference_mean", f"{WI}, r AS (SELECT protein, run, avg(intensity) AS r FROM ions WHERE charge = 2 GROUP BY ALL) SELECT protein, run, count(*) AS n FROM ions JOIN r USING (protein, run) WHERE charge <> 2 GROUP BY ALL")(
    lambda spark, sf_dir: (lambda d: d.where("charge <> 2").join(d.where("charge = 2").groupBy("protein", "run").agg(F.avg("intensity").alias("r")), ["protein", "run"]).groupBy("protein", "run").agg(F.count(F.lit(1)).alias("n")))(B.ions(spark, sf_dir))
)
R.add(
    "jn9_members",
    f"{WI}, e AS (SELECT row_id, unnest(string_split(protein, ';')) AS member, sample, intensity FROM ions WHERE contains(protein, ';')), a AS (SELECT protein AS member, sample, sum(intensity) AS anchor FROM ions WHERE NOT contains(protein, ';') GROUP BY ALL) SELECT row_id, member, round(log2(coalesce(anchor, 1)), 8) AS anchor FROM e LEFT JOIN a USING (member, sample)",
)(
    lambda spark, sf_dir: (lambda d: d.where("contains(protein, ';')").select("row_id", F.explode(F.split("protein", ";")).alias("member"), "sample").join(d.where("NOT contains(protein, ';')").groupBy(F.col("protein").alias("member"), "sample").agg(F.sum("intensity").alias("a")), ["member", "sample"], "left").select("row_id", "member", F.round(F.log2(F.coalesce("a", F.lit(1.0))), 8).alias("anchor")))(B.ions(spark, sf_dir))
)

# ---- aggregates, sorts, sets, reshaping ------------------------------------------------------------------------------------------

R.add("agg20_partial_final", f"{WI} SELECT protein, count(*) AS n, round(log2(sum(intensity)), 9) AS total FROM ions GROUP BY protein")(
    lambda spark, sf_dir: B.ions(spark, sf_dir).groupBy("protein", "run").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("t")).groupBy("protein").agg(F.sum("n").alias("n"), log2_rounded(F.sum("t")).alias("total"))
)
R.add("srt1_sorted_tests", f"{N._TESTS}, {N._BH.format(t='tests')} SELECT protein, round(adj, 8) AS adj_pvalue FROM bh ORDER BY adj, pvalue, protein")(
    lambda spark, sf_dir: fdr.benjamini_hochberg(N._tests(spark, sf_dir)).orderBy("adj_pvalue", "pvalue", "protein").select("protein", F.round("adj_pvalue", 8).alias("adj_pvalue"))
)
R.add("srt6_top_ions", f"{WI}, c AS (SELECT protein, peptidoform, charge, sample, sum(intensity) AS i FROM ions GROUP BY ALL), r AS (SELECT protein, peptidoform, charge, count(*) AS k, round(sum(log2(i)), 6) AS s FROM c GROUP BY ALL) SELECT protein, count(*) AS n FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY protein ORDER BY k DESC, s DESC, peptidoform, charge) <= 100) GROUP BY protein")(
    lambda spark, sf_dir: lfq.top_ions(lfq.species_cells(B.ions(spark, sf_dir))).select("protein", "peptidoform", "charge").distinct().groupBy("protein").agg(F.count(F.lit(1)).alias("n"))
)
R.add("set4_sql_sets", "(SELECT sequence FROM feature UNION SELECT sequence FROM psm) EXCEPT SELECT sequence FROM feature_legacy")(
    lambda spark, sf_dir: spark.sql("(SELECT sequence FROM {f} UNION SELECT sequence FROM {p}) EXCEPT SELECT sequence FROM {l}", f=table(spark, sf_dir, "feature"), p=table(spark, sf_dir, "psm"), l=table(spark, sf_dir, "feature_legacy"))
)
R.add("rsh4_transpose", f"{WI} SELECT charge, condition, count(*) AS n FROM ions GROUP BY ALL")(
    lambda spark, sf_dir: sinks.long_from_wide(B.ions(spark, sf_dir).groupBy("charge").pivot("condition").agg(F.count(F.lit(1))), "charge", "condition", "n")
)
R.add("win6_reverse_minimum", f"{N._TESTS} SELECT protein, pvalue, min(pvalue * n_a) OVER (ORDER BY pvalue DESC, protein ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low FROM tests")(
    lambda spark, sf_dir: N._tests(spark, sf_dir).selectExpr("protein", "pvalue", "min(pvalue * n_a) OVER (PARTITION BY contrast ORDER BY pvalue DESC, protein ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS low")
)

# ---- scalars ---------------------------------------------------------------------------------------------------------------------

R.add("sc14_maps", "SELECT sdrf_row_id, trim(regexp_extract(\"comment[label]\", '(?:^|;)NT=([^;]*)', 1)) AS nt FROM sdrf WHERE contains(\"comment[label]\", 'NT=')")(
    lambda spark, sf_dir: table(spark, sf_dir, "sdrf").where(F.contains(F.col("`comment[label]`"), F.lit("NT="))).select("sdrf_row_id", F.coalesce(F.trim(F.try_element_at(F.str_to_map(F.col("`comment[label]`"), F.lit(";"), F.lit("=")), F.lit("NT"))), F.lit("")).alias("nt"))
)
R.add("sc15_evidence", f"WITH {N.EDGES}, u AS (SELECT min(accession) AS accession FROM edges GROUP BY peptide HAVING count(*) = 1), n AS (SELECT accession, count(*) AS n FROM u GROUP BY accession) SELECT DISTINCT e.accession, CASE WHEN coalesce(n, 0) >= 2 THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'family_only' END AS evidence FROM edges e LEFT JOIN n ON n.accession = e.accession")(
    lambda spark, sf_dir: (lambda e: pibaq.per_theoretical(e.select("accession", F.lit("s").alias("sample"), F.lit(1.0).alias("value")).distinct(), e, N._plain_families(e), e).select("accession", "evidence"))(N.edges(spark, sf_dir))
)


@R.add("sc7_distributions")
def sc7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided p-values of every tested protein by the Arrow UDF over the incomplete beta function."""
    s = de._with_df(de.group_stats(B.cells(spark, sf_dir), N.groups(spark, sf_dir), "A", "B")).where("s2 > 0")
    t = s.withColumns({"t": F.col("log2FC") / F.sqrt(F.col("s2") * (1 / F.col("n_a") + 1 / F.col("n_b"))), "df": F.col("df").cast("double")})
    return t.select("protein", "t", "df", de._t_pvalue("t", "df").alias("pvalue"))


@R.add("sc16_draws")
def sc16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counter-based draws of every peptide row: the same for any partitioning."""

    @F.pandas_udf("double")
    def draw(i: pd.Series) -> pd.Series:
        return pd.Series(special.uniforms(42, i.to_numpy("int64")))

    return B.ions(spark, sf_dir).select("row_id", draw("row_id").alias("u"))


# ---- workflows -----------------------------------------------------------------------------------------------------------------------


R.add(
    "nrm16_defaults",
    f"""{WI}, r AS (SELECT * FROM ions WHERE condition <> 'Empty'), m AS (SELECT sample, median(intensity) AS m FROM r GROUP BY sample), n AS (SELECT r.* REPLACE (intensity * (SELECT median(m) FROM m) / m.m AS intensity) FROM r JOIN m USING (sample)),
top AS (SELECT protein, peptide, peptidoform, charge, sample, condition, biorep, max(intensity) AS intensity FROM n GROUP BY ALL), q AS (SELECT protein, peptide, sample, biorep, condition, sum(intensity) AS intensity FROM top GROUP BY ALL)
SELECT protein, sample, round(log2(sum(intensity)), 8) AS value FROM q GROUP BY protein, sample""",
)(lambda spark, sf_dir: N.l2(pipeline.features_to_proteins(B.ions(spark, sf_dir), pipeline.PipelineConfig(quant="sum", min_unique=0))))

R.add("pib3_overrides", f"WITH RECURSIVE {N._FAMILIES} SELECT accession, CASE WHEN accession < 'ZX1' THEN 'pinned' ELSE family END AS family FROM families WHERE accession < 'ZX1' OR family_size = 1")(
    lambda spark, sf_dir: (lambda e: (lambda pins: (lambda fam, free: fam.join(free, "accession", "left_semi").select("accession", "family"))(pibaq.families(e, overrides=pins), pins.select("accession").union(pibaq.families(e).where("family_size = 1").select("accession"))))(e.where("accession < 'ZX1'").select("accession", F.lit("pinned").alias("family")).distinct()))(N.edges(spark, sf_dir))
)
R.add("pib9_digest_misses", f"WITH {N.EDGES}, {N.OBSERVED} SELECT count(DISTINCT peptide) AS observed, count(DISTINCT peptide) FILTER (peptide NOT IN (SELECT peptide FROM edges)) AS missed FROM observed")(
    lambda spark, sf_dir: N.observed(spark, sf_dir).select("peptide").distinct().join(N.edges(spark, sf_dir).select("peptide", F.lit(1).alias("hit")).distinct(), "peptide", "left").agg(F.count(F.lit(1)).alias("observed"), F.count(F.when(F.col("hit").isNull(), 1)).alias("missed"))
)


@R.add("pib14_workflow", f"{N._SHARED}, {N._THEORY} SELECT accession, sample, evidence, round(pibaq / sum(pibaq) OVER (PARTITION BY sample), 9) AS norm FROM theory")
def pib14(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = N.edges(spark, sf_dir)
    obs, fam = N.observed(spark, sf_dir), pibaq.families(e)
    return N._r(pibaq.derived_values(pibaq.per_theoretical(pibaq.allocate(obs, e, fam), e, fam, obs), ("sample",)).select("accession", "sample", "evidence", "norm"), norm=9)


R.add("irs6_conditions", f"SELECT \"source name\" AS sample, min(coalesce(nullif(trim(regexp_extract(\"factor value[treatment]\", '(?i)(?:^|;)\\s*NT=([^;]*)', 1)), ''), trim(\"factor value[treatment]\"))) AS condition FROM sdrf WHERE NOT {B.sql_missing('\"factor value[treatment]\"')} GROUP BY 1")(
    lambda spark, sf_dir: table(spark, sf_dir, "sdrf").where(~B.is_missing(F.col("`factor value[treatment]`"))).groupBy(F.col("`source name`").alias("sample")).agg(F.min(K.factor_label(F.col("`factor value[treatment]`"))).alias("condition"))
)


@R.add("bat2_design")
def bat2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The design matrix of condition and plex, one row a sample."""
    d = pandas_bounded(N.design(spark, sf_dir).orderBy("sample"), batch.MAX_SAMPLES, "samples")
    x = batch.design_matrix(d[["condition", "plex"]])
    return spark.createDataFrame([(s, [float(v) for v in row]) for s, row in zip(d["sample"], x)], "sample string, terms array<double>")


@R.add("bat4_workflow")
def bat4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected batches, single ones dropped, ComBat over the complete entities."""
    b = batch.drop_single_sample_batches(batch.detect_batches(B.ions(spark, sf_dir).select("sample"), batch.sample_prefix("sample")))
    logs = N._logs(spark, sf_dir).join(b.select("sample"), "sample", "left_semi")
    return batch.combat_long(logs, b)


@R.add("de4_covariates")
def de4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group difference with the plex as covariate, one small fit per protein."""
    d = pandas_bounded(N.design(spark, sf_dir).orderBy("sample"), batch.MAX_SAMPLES, "samples").set_index("sample")
    x = pd.DataFrame(batch.design_matrix(d[["condition", "plex"]]), index=d.index)
    c = [0.0, 1.0] + [0.0] * (x.shape[1] - 2)
    return de.design_test(B.cells(spark, sf_dir), x, pd.Series(c).to_numpy())


@R.add("de4_blocks")
def de4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group difference with the plex as random block."""
    d = pandas_bounded(N.design(spark, sf_dir).orderBy("sample"), batch.MAX_SAMPLES, "samples").set_index("sample")
    x = pd.DataFrame(batch.design_matrix(d[["condition"]]), index=d.index)
    blocks = d["plex"].to_dict()
    rho = de.block_correlation(B.cells(spark, sf_dir), x, blocks)
    return de.design_test(B.cells(spark, sf_dir), x, pd.Series([0.0, 1.0]).to_numpy(), blocks, rho)


@R.add("de1_contrasts")
def de1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several contrasts under one another."""
    config = pipeline.PipelineConfig(contrasts=(("A", "B"), ("B", "A")), de_method="limma")
    return pipeline.differential_expression(B.cells(spark, sf_dir), N.groups(spark, sf_dir), config)


R.add("de15_auto_method", f"{WC}, f AS (SELECT count(*) = count(DISTINCT protein) * count(DISTINCT sample) AS complete FROM cells) SELECT quant, complete, CASE WHEN quant = 'directlfq' OR NOT complete THEN 'deqms' ELSE 'limrots' END AS method FROM f, (VALUES ('directlfq'), ('sum')) t(quant)")(
    lambda spark, sf_dir: (lambda complete: spark.createDataFrame([(q, complete, de.auto_method(q, complete)) for q in ("directlfq", "sum")], "quant string, complete boolean, method string"))(
        B.cells(spark, sf_dir).agg((F.count(F.lit(1)) == F.count_distinct("protein") * F.count_distinct("sample")).alias("c")).first()["c"]
    )
)
R.add("tis1_matrix", f"WITH {N._shared_entries()} SELECT protein, run_key AS sample, label_key AS label, round(log2(sum(intensity)), 8) AS value FROM labelled WHERE protein IS NOT NULL GROUP BY ALL")(
    lambda spark, sf_dir: B.entries(spark, sf_dir).withColumn("protein", K.clean_accession("anchor_protein")).where("protein IS NOT NULL").groupBy("protein", F.col("run_key").alias("sample"), F.col("label_key").alias("label")).agg(log2_rounded(F.sum("intensity"), 8).alias("value"))
)


@R.add("tis3_threshold")
def tis3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specificity scores with the mixture threshold fitted on their quantiles (at most 2,000 numbers on the driver)."""
    ts = atlas.specificity(B.cells(spark, sf_dir), N._tissues(spark, sf_dir))
    q = ts.agg(F.percentile("ts", [i / 1999 for i in range(2000)]).alias("q")).first()["q"] or [0.0, 1.0]
    cut = atlas.specificity_threshold(pd.Series(q).to_numpy())
    return ts.withColumn("specific", F.col("ts") >= cut)


R.add("udf1_registry", f"{WC} SELECT protein, sample, round(log2(value) - median(log2(value)) OVER (PARTITION BY sample), 7) AS value FROM cells")(
    lambda spark, sf_dir: N.l2(registry.REGISTRY.get("normalization.sample", "median-center")(B.cells(spark, sf_dir)), digits=7)
)
R.add("lfq7_entry")(lambda spark, sf_dir: pipeline.features_to_proteins(B.ions(spark, sf_dir), pipeline.PipelineConfig(quant="directlfq")))
R.add("agg10_run_ratio", f"{WI}, m AS (SELECT protein, peptide, charge, condition AS plex, sample, biorep = 1 AS is_reference, max(intensity) AS intensity FROM ions WHERE biorep IS NOT NULL GROUP BY ALL), f AS (SELECT protein, peptide, charge, plex, avg(intensity) AS ref FROM m WHERE is_reference GROUP BY ALL), p AS (SELECT protein, peptide, sample, median(log2(intensity) - log2(ref)) AS r FROM m JOIN f USING (protein, peptide, charge, plex) WHERE NOT is_reference GROUP BY ALL) SELECT protein, sample, round(median(r), 8) + 0.0::DOUBLE AS value FROM p GROUP BY protein, sample")(
    lambda spark, sf_dir: N._r(rollup.ratio_to_reference(B.ions(spark, sf_dir).where("biorep IS NOT NULL").withColumns({"plex": F.col("condition"), "is_reference": F.col("biorep") == 1})), value=8)
)


# ---- entry points --------------------------------------------------------------------------------------------------------------------


@R.add("snk5_long_tsv", f"{WC} SELECT protein, sample, round(log2(value), 6) AS value FROM cells")
def snk5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    sinks.write_long_tsv(B.cells(spark, sf_dir).withColumn("value", log2_rounded(F.col("value"), 6)), path)
    return spark.read.csv(path, header=True, sep="\t", schema="protein string, sample string, value double")


@R.add("snk7_wide_csv", f"{WC} SELECT protein, sample, round(log2(value), 6) AS value FROM cells")
def snk7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "wide")
    sinks.write_matrix_csv(sinks.wide_matrix(B.cells(spark, sf_dir).withColumn("value", log2_rounded(F.col("value"), 6)), method="median"), path)
    wide = spark.read.csv(path, header=True)
    return sinks.long_from_wide(wide.select("protein", *[F.col(f"`{c}`").cast("double").alias(c) for c in wide.columns[1:]]))


@R.add("snk8_saved_levels", f"WITH {B.PEPTIDES} SELECT 'peptides' AS level, protein, peptide, sample, round(log2(intensity), 9) AS intensity FROM peptides")
def snk8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "levels")
    tables.save_dataset({"peptides": B.peptides(spark, sf_dir)}, path, ["rolled up", "saved"])
    level, df = next(iter(tables.load_dataset(spark, path).items()))
    return N.l2(df.select(F.lit(level).alias("level"), "protein", "peptide", "sample", "intensity"), "intensity", 9)


R.add("srt2_top_rows", f"{WI} SELECT row_id FROM ions QUALIFY row_number() OVER (PARTITION BY protein, sample ORDER BY intensity DESC, row_id) <= 2")(
    lambda spark, sf_dir: B.ions(spark, sf_dir).selectExpr("row_id", "row_number() OVER (PARTITION BY protein, sample ORDER BY intensity DESC, row_id) AS rn").where("rn <= 2").select("row_id")
)
R.add("srt5_name_order", f"{WI} SELECT protein, row_number() OVER (ORDER BY protein) - 1 AS ordinal FROM (SELECT DISTINCT protein FROM ions)")(
    lambda spark, sf_dir: N.impute._ordinals(B.ions(spark, sf_dir), "protein", "ordinal").select("protein", F.col("ordinal").cast("bigint").alias("ordinal"))
)
R.add("nrm13_ion_alignment")(lambda spark, sf_dir: lfq.ion_shifts(B.ions(spark, sf_dir)))
R.add("imp14_dispatch", f"{N._GRID}, s AS (SELECT sample, median(v) AS f FROM g GROUP BY sample) SELECT protein, sample, round(coalesce(v, f), 7) AS value, v IS NULL AS imputed FROM g JOIN s USING (sample)")(
    lambda spark, sf_dir: N.l2(registry.REGISTRY.get("imputation", "median")(B.cells(spark, sf_dir)), digits=7)
)
R.add("de16_matrix")(lambda spark, sf_dir: (lambda c: de.differential(c, N.groups(spark, sf_dir), "A", "B", "deqms", rollup.deqms_counts(B.peptides(spark, sf_dir)), lfq.cell_precision(B.ions(spark, sf_dir), c)))(B.cells(spark, sf_dir)))
R.add("udf7_method_names", f"WITH {B.PEPTIDES} SELECT protein, sample, round(log2(avg(intensity)), 9) AS value FROM (SELECT * FROM peptides QUALIFY row_number() OVER (PARTITION BY protein, sample ORDER BY intensity DESC, peptide) <= 5) GROUP BY protein, sample")(
    lambda spark, sf_dir: N.l2(registry.quantifier("Top-5")[0](B.peptides(spark, sf_dir)), digits=9)
)
R.add("udf4_spectral_count", f"WITH {REL._GROUPS} SELECT protein, psm.run_file_name AS sample, count(DISTINCT psm_id) AS value FROM psm JOIN groups USING (feature_id) WHERE protein IS NOT NULL AND NOT coalesce(psm.is_decoy, false) GROUP BY ALL HAVING count(DISTINCT psm.sequence) >= 2")(
    lambda spark, sf_dir: pipeline.spectral_counts(table(spark, sf_dir, "psm"), SF.feature_groups(B.features(spark, sf_dir)), pipeline.PipelineConfig(quant="spectral_count"))
)
_OF_IONS = f"{B.IONS}, edges AS (SELECT DISTINCT accession, peptide FROM (SELECT unnest(string_split(protein, ';')) AS accession, peptide FROM ions WHERE condition <> 'Empty') WHERE accession <> '' AND peptide IS NOT NULL)"
_IBAQ = f"{N._SHARED}, {N._THEORY}".replace(N.EDGES, _OF_IONS).replace(N.OBSERVED, "observed AS (SELECT peptide, sample, intensity FROM ions WHERE condition <> 'Empty' AND peptide IS NOT NULL)")
R.add("udf4_pibaq", f"{_IBAQ} SELECT accession AS protein, sample, round(log2(nullif(pibaq, 0)), 7) AS value FROM theory")(
    lambda spark, sf_dir: N.l2(pipeline.features_to_proteins(B.ions(spark, sf_dir), pipeline.PipelineConfig(quant="pibaq", sample_normalization="none")), digits=7)
)


@R.add("bat6_clusters")
def bat6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the samples in the plane of the first two components."""
    filled = batch.LowFilled(B.cells(spark, sf_dir))
    labels = batch.hdbscan(batch.plane(filled.scores(np.ones(len(filled.names), bool))))
    return spark.createDataFrame([(s, int(c)) for s, c in zip(filled.names, labels)], "sample string, cluster int")
