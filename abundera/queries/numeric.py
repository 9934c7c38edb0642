"""Queries of normalisation, reference scaling, roll-up solvers, families, imputation, batches, tests, atlas, QC and evaluation.

The two-group design A/B and the batches/plexes come from the number at the end
of a sample's name, so that every group holds many samples at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abundera.functions import keys as K
from abundera.functions.values import log2_rounded
from abundera.operators import atlas, batch, de, fdr, impute, lfq, normalize, pibaq, rollup
from abundera.queries import base as B
from abundera.queries.common import Registry, table

R = Registry()
_NUM = "TRY_CAST(regexp_extract(sample, '([0-9]+)$', 1) AS INTEGER)"
DESIGN = f"design AS (SELECT DISTINCT sample, CASE WHEN {_NUM} % 2 = 0 THEN 'A' ELSE 'B' END AS condition, CAST({_NUM} % 3 AS VARCHAR) AS plex, {_NUM} % 5 = 0 AS is_reference FROM ions)"
WC = f"WITH {B.CELLS}, {DESIGN} "
WI = f"WITH {B.IONS}, {DESIGN} "


def design(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.regexp_extract("sample", "([0-9]+)$", 1).try_cast("int")
    out = B.ions(spark, sf_dir).select("sample").distinct()
    return out.select("sample", F.when(n % 2 == 0, "A").otherwise("B").alias("condition"), (n % 3).cast("string").alias("plex"), (n % 5 == 0).alias("is_reference"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design(spark, sf_dir).select("sample", "condition")


def l2(df: DataFrame, col: str = "value", digits: int = 8) -> DataFrame:
    return df.withColumn(col, log2_rounded(F.col(col), digits))


def _r(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})  # no negative zero


# ---- normalisation ------------------------------------------------------------------------------------------------------

_METRIC = {"median": "median(intensity)", "mean": "avg(intensity)", "max": "max(intensity)", "global": "sum(intensity)", "iqr": "quantile_cont(intensity, 0.75) - quantile_cont(intensity, 0.25)"}
_RUN = "{w}, m AS (SELECT sample, run, {a} AS m FROM ions GROUP BY ALL), s AS (SELECT sample, avg(m) AS a, count(*) AS n FROM m GROUP BY sample) SELECT sample, run, round(CASE WHEN n > 1 AND m <> 0 THEN a / m ELSE 1 END, 7) AS factor FROM m JOIN s USING (sample)"
for _m, _a in _METRIC.items():
    R.add(f"nrm{2 if _m == 'iqr' else 1}_run_{_m}", _RUN.format(w=WI, a=_a))(lambda spark, sf_dir, m=_m: _r(normalize.run_factors(B.ions(spark, sf_dir), m), factor=7))

R.add(
    "nrm3_run_max_min",
    f"""{WI}, r AS (SELECT sample, run, min(intensity) AS lo, max(intensity) AS hi FROM ions GROUP BY ALL), s AS (SELECT sample, avg(lo) AS slo, avg(hi) AS shi, count(*) AS n FROM r GROUP BY sample)
SELECT row_id, round(log2(CASE WHEN n > 1 AND hi > lo THEN (intensity - lo) * (shi - slo) / (hi - lo) + slo ELSE intensity END), 6) AS intensity FROM ions JOIN r USING (sample, run) JOIN s USING (sample)""",
)(lambda spark, sf_dir: l2(normalize.run_max_min(B.ions(spark, sf_dir)), "intensity", 6).select("row_id", "intensity"))
R.add(
    "nrm4_scaled_runs",
    f"""{WI}, m AS (SELECT sample, run, median(intensity) AS m FROM ions GROUP BY ALL), s AS (SELECT sample, avg(m) AS a, count(*) AS n FROM m GROUP BY sample)
SELECT row_id, round(log2(intensity * CASE WHEN n > 1 THEN a / m ELSE 1 END), 8) AS intensity FROM ions JOIN m USING (sample, run) JOIN s USING (sample)""",
)(lambda spark, sf_dir: l2(normalize.scale_runs(B.ions(spark, sf_dir), normalize.run_factors(B.ions(spark, sf_dir))), "intensity").select("row_id", "intensity"))
R.add("nrm5_global_median", f"{WI}, m AS (SELECT sample, median(intensity) AS m FROM ions GROUP BY sample) SELECT sample, round((SELECT median(m) FROM m) / m, 8) AS factor FROM m")(lambda spark, sf_dir: _r(normalize.global_median_factors(B.ions(spark, sf_dir)), factor=8))
R.add("nrm6_condition_median", f"{WI}, m AS (SELECT sample, condition, median(intensity) AS m FROM ions i JOIN design d USING (sample) GROUP BY sample, d.condition) SELECT sample, round(avg(m) OVER (PARTITION BY condition) / m, 8) AS factor FROM m".replace("SELECT sample, condition, median", "SELECT sample, d.condition AS condition, median"))(
    lambda spark, sf_dir: _r(normalize.condition_median_factors(B.ions(spark, sf_dir).drop("condition"), groups(spark, sf_dir)), factor=8)
)
R.add("nrm7_quantile")(lambda spark, sf_dir: normalize.quantile_normalize(B.cells(spark, sf_dir)))
for _h, _f in (("median", "median"), ("mean", "avg")):
    R.add(f"nrm8_{_h}_center", f"{WC} SELECT protein, sample, round(log2(value) - {_f}(log2(value)) OVER (PARTITION BY sample), 7) AS value FROM cells")(lambda spark, sf_dir, h=_h: l2(normalize.center(B.cells(spark, sf_dir), h), digits=7))
R.add("nrm9_rlr")(lambda spark, sf_dir: normalize.robust_regression(B.cells(spark, sf_dir)))
R.add("nrm10_loess")(lambda spark, sf_dir: normalize.loess_normalize(B.cells(spark, sf_dir)))
R.add(
    "nrm11_tmm",
    f"""{WC}, lib AS (SELECT sample, sum(value) AS n, quantile_cont(value, 0.75) / sum(value) AS f FROM cells GROUP BY sample),
ref AS (SELECT sample AS rs, n AS rn FROM lib ORDER BY round(abs(f - (SELECT avg(f) FROM lib)), 15), sample LIMIT 1),
m AS (SELECT c.sample, log2((c.value / l.n) / (r.value / ref.rn)) AS m, log2((c.value / l.n) * (r.value / ref.rn)) / 2 AS a, (l.n - c.value) / l.n / c.value + (ref.rn - r.value) / ref.rn / r.value AS w
  FROM cells c JOIN lib l USING (sample) JOIN cells r ON r.protein = c.protein JOIN ref ON r.sample = ref.rs),
k AS (SELECT *, rank() OVER (PARTITION BY sample ORDER BY m) AS rm, rank() OVER (PARTITION BY sample ORDER BY a) AS ra, count(*) OVER (PARTITION BY sample) AS c FROM m),
f AS (SELECT sample, sum(m / w) / sum(1 / w) AS l FROM k WHERE w > 0 AND rm BETWEEN floor(c * 0.3) + 1 AND c - floor(c * 0.3) AND ra BETWEEN floor(c * 0.05) + 1 AND c - floor(c * 0.05) GROUP BY sample),
g AS (SELECT sample, coalesce(l, 0) AS l FROM lib LEFT JOIN f USING (sample)) SELECT sample, round(l - (SELECT avg(l) FROM g), 6) AS log2_factor FROM g""",
)(lambda spark, sf_dir: normalize.tmm_factors(B.cells(spark, sf_dir)).select("sample", F.round(F.log2("factor"), 6).alias("log2_factor")))
R.add("nrm12_hierarchical")(lambda spark, sf_dir: normalize.hierarchical_shifts(B.cells(spark, sf_dir)))
R.add("nrm14_total", f"{WC}, t AS (SELECT sample, sum(value) AS t FROM cells GROUP BY sample) SELECT protein, sample, round(log2(value * (SELECT avg(t) FROM t) / t), 7) AS value FROM cells JOIN t USING (sample)")(lambda spark, sf_dir: l2(normalize.total_intensity(B.cells(spark, sf_dir)), digits=7))
R.add("nrm15_matrix", f"{WC}, m AS (SELECT sample, median(value) AS m FROM cells GROUP BY sample) SELECT protein, sample, round(log2(value * (SELECT median(m) FROM m) / m), 7) AS value FROM cells JOIN m USING (sample)")(lambda spark, sf_dir: l2(normalize.normalize_matrix(B.cells(spark, sf_dir), "global-median"), digits=7))

# ---- reference scaling ----------------------------------------------------------------------------------------------------

_IRS = f"""{WC}, r AS (SELECT protein, plex, median(value) AS r FROM cells JOIN design USING (sample) WHERE is_reference GROUP BY ALL),
g AS (SELECT protein, exp(avg(ln(r))) AS g FROM r GROUP BY protein), f AS (SELECT protein, plex, g / r AS factor FROM r JOIN g USING (protein)),
need AS (SELECT DISTINCT protein, plex FROM cells JOIN design USING (sample))"""
R.add("irs1_matrix", f"{_IRS} SELECT protein, plex, round(coalesce(factor, 1), 7) AS factor FROM need LEFT JOIN f USING (protein, plex)")(lambda spark, sf_dir: _r(normalize.irs_factors(B.cells(spark, sf_dir), design(spark, sf_dir).drop("condition")), factor=7))
R.add("irs2_plex_median", f"{_IRS}, t AS (SELECT plex, median(factor) AS t FROM f GROUP BY plex) SELECT protein, plex, round(coalesce(factor, t, 1), 7) AS factor FROM need LEFT JOIN f USING (protein, plex) LEFT JOIN t USING (plex)")(
    lambda spark, sf_dir: _r(normalize.irs_factors(B.cells(spark, sf_dir), design(spark, sf_dir).drop("condition"), missing="plex_median"), factor=7)
)
R.add("irs3_reference_names", "SELECT sdrf_row_id, coalesce(regexp_matches(lower(\"factor value[treatment]\"), 'pool|powder|ref|reference|bridge'), false) AS is_reference FROM sdrf")(lambda spark, sf_dir: table(spark, sf_dir, "sdrf").select("sdrf_row_id", normalize.is_reference_name(F.col("`factor value[treatment]`")).alias("is_reference")))
R.add("irs4_plexes", f"{WI}, f AS (SELECT sample, list_sort(list(DISTINCT run)) AS s FROM ions GROUP BY sample) SELECT sample, s[1] AS plex, array_to_string(s, ';') AS files FROM f")(lambda spark, sf_dir: normalize.plex_by_files(B.ions(spark, sf_dir).select("sample", F.col("run").alias("run_key"))))
_CH = f"{WI}, r AS (SELECT run, split_part(run, '_', 2) AS mixture, median(intensity) AS r FROM ions WHERE charge = 2 GROUP BY ALL), m AS (SELECT mixture, median(r) AS c FROM r GROUP BY mixture)"
for _s, _e in (("global", "(SELECT median(r) FROM r) / r"), ("by-mixture", "c / r"), ("two-stage", "c / r * (SELECT median(c) FROM m) / c")):
    R.add(f"irs5_channel_{_s.replace('-', '_')}", f"{_CH} SELECT run, round({_e}, 8) AS factor FROM r JOIN m USING (mixture)")(
        lambda spark, sf_dir, s=_s: _r(normalize.channel_irs_factors(B.ions(spark, sf_dir).withColumns({"mixture": F.split_part("run", F.lit("_"), F.lit(2)), "is_reference": F.col("charge") == 2}), scope=s), factor=8)
    )


def reporter_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isobaric features as ``(row_id, peptidoform, charge, plex, channel, intensity)``."""
    e = B.entries(spark, sf_dir).where("NOT is_label_free AND label RLIKE '^[0-9]+[NC]?$'")
    return e.select(F.col("feature_id").alias("row_id"), "peptidoform", "charge", F.split("run_key", "_")[0].alias("plex"), F.col("label").alias("channel"), "intensity")


REPORTERS = f"""e0 AS (SELECT feature_id AS row_id, peptidoform, charge, split_part({B.SQL_RUN_KEY.format('run_file_name')}, '_', 1) AS plex, imputed_labels, unnest(intensities, max_depth := 1) AS e FROM feature),
reporters AS (SELECT row_id, peptidoform, CAST(charge AS INTEGER) AS charge, plex, e.label AS channel, CAST(e.intensity AS DOUBLE) AS intensity FROM e0 WHERE e IS NOT NULL AND regexp_matches(e.label, '^[0-9]+[NC]?$') AND isfinite(e.intensity) AND e.intensity > 0 AND NOT coalesce(list_contains(imputed_labels, e.label), false))"""
R.add(
    "tmt2_floor",
    f"""WITH {REPORTERS}, l AS (SELECT plex, channel, avg(intensity) AS l FROM reporters GROUP BY ALL), p AS (SELECT plex, avg(l) AS ml FROM l GROUP BY plex), m AS (SELECT row_id, avg(intensity) AS m FROM reporters GROUP BY row_id)
SELECT row_id, channel, round(greatest((intensity - 0.1 * m * l / ml) / 0.9, 0.01 * m * l / ml), 2) AS intensity FROM reporters JOIN l USING (plex, channel) JOIN p USING (plex) JOIN m USING (row_id)""",
)(lambda spark, sf_dir: _r(normalize.interference_floor(reporter_rows(spark, sf_dir), 0.1).select("row_id", "channel", "intensity"), intensity=2))
R.add("tmt3_merge_max", f"WITH {REPORTERS} SELECT peptidoform, charge, plex, channel, max(intensity) AS intensity FROM reporters GROUP BY ALL")(lambda spark, sf_dir: normalize.merge_rows(reporter_rows(spark, sf_dir)))
R.add(
    "tmt3_merge_best_row",
    f"""WITH {REPORTERS}, s AS (SELECT row_id, peptidoform, charge, plex, sum(intensity) AS s FROM reporters GROUP BY ALL), t AS (SELECT peptidoform, charge, plex, max(s) AS s FROM s GROUP BY ALL)
SELECT peptidoform, charge, plex, channel, max(intensity) AS intensity FROM reporters WHERE row_id IN (SELECT row_id FROM s JOIN t USING (peptidoform, charge, plex, s)) GROUP BY ALL""",
)(lambda spark, sf_dir: normalize.merge_rows(reporter_rows(spark, sf_dir), "best-row"))


@R.add("tmt1_impurity")
def tmt1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    channels = ["126", "127N", "127C", "128N", "128C", "129N", "129C", "130N"]
    pick = lambda c: F.max(F.when(F.col("channel") == c, F.col("intensity")))
    rows = reporter_rows(spark, sf_dir).groupBy("row_id").agg(F.array(*[pick(c) for c in channels]).alias("channels"))
    n = len(channels)
    impurity = 0.95 * np.eye(n) + 0.03 * np.eye(n, k=1) + 0.02 * np.eye(n, k=-1)
    return normalize.correct_impurities(rows, channels, impurity)


# ---- solvers --------------------------------------------------------------------------------------------------------------

R.add("lfq1_maxlfq")(lambda spark, sf_dir: lfq.maxlfq(B.ions(spark, sf_dir)))
R.add("lfq2_stabilized")(lambda spark, sf_dir: lfq.maxlfq(B.ions(spark, sf_dir), stabilize=True))
R.add("lfq3_species", f"{WI} SELECT protein, peptidoform, charge, sample, round(log2(sum(intensity)), 9) AS intensity FROM ions GROUP BY ALL")(lambda spark, sf_dir: l2(lfq.species_cells(B.ions(spark, sf_dir)), "intensity", 9))
R.add(
    "lfq1_pair_medians_all",
    f"""{WI}, c AS (SELECT protein, peptidoform, charge, sample, log2(sum(intensity)) AS v FROM ions GROUP BY ALL)
SELECT a.protein, a.sample AS a, b.sample AS b, round(median(b.v - a.v), 8) AS d, count(*) AS shared FROM c a JOIN c b ON a.protein = b.protein AND a.peptidoform = b.peptidoform AND a.charge = b.charge AND a.sample < b.sample GROUP BY ALL""",
)(lambda spark, sf_dir: _r(lfq.ratio_pairs(lfq.species_cells(B.ions(spark, sf_dir))), d=8))
R.add("lfq4_directlfq")(lambda spark, sf_dir: lfq.directlfq(B.ions(spark, sf_dir)))
PRECISION = f"""{WC}, sp AS (SELECT protein, peptidoform, charge, sample, log2(sum(intensity)) AS v FROM ions GROUP BY ALL),
dd AS (SELECT sp.*, v - log2(value) AS d FROM sp JOIN cells USING (protein, sample)), mm AS (SELECT protein, peptidoform, charge, median(d) AS m FROM dd GROUP BY ALL),
rr AS (SELECT dd.*, d - m AS r FROM dd JOIN mm USING (protein, peptidoform, charge)),
ss AS (SELECT protein, sum(r * r) AS rss, greatest(0, count(*) - count(DISTINCT (peptidoform, charge)) - count(DISTINCT sample) + 1) AS dof FROM rr GROUP BY protein),
pp AS (SELECT median(rss / dof) AS prior FROM ss WHERE dof > 0 AND rss / dof > 0), s2 AS (SELECT protein, (CASE WHEN dof > 0 THEN rss ELSE 0 END + 4.0 * (SELECT prior FROM pp)) / (dof + 4.0) AS s2 FROM ss)
SELECT protein, sample, round(log2(count(*) / any_value(s2)), 6) AS precision FROM rr JOIN s2 USING (protein) GROUP BY protein, sample"""
R.add("lfq6_precision", PRECISION)(lambda spark, sf_dir: l2(lfq.cell_precision(B.ions(spark, sf_dir), B.cells(spark, sf_dir)), "precision", 6))

# ---- families and piBAQ ------------------------------------------------------------------------------------------------------


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(accession, peptide)`` of the feature table's groups."""
    rows = B.features(spark, sf_dir).select(F.explode("accessions").alias("a"), F.col("sequence").alias("peptide"))
    return rows.select(K.clean_accession("a").alias("accession"), "peptide").where("accession IS NOT NULL AND peptide IS NOT NULL").distinct()


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peptide intensities by run: ``(peptide, sample, intensity)``."""
    return B.entries(spark, sf_dir).select(F.col("sequence").alias("peptide"), F.col("run_key").alias("sample"), "intensity").where("peptide IS NOT NULL")


_A = "upper(trim(CASE WHEN len(string_split(trim(a), '|')) = 3 THEN string_split(trim(a), '|')[2] ELSE trim(a) END))"
EDGES = f"""edges AS (SELECT DISTINCT CASE WHEN regexp_replace({_A}, '-[0-9]+$', '') = '' THEN nullif({_A}, '') ELSE regexp_replace({_A}, '-[0-9]+$', '') END AS accession, peptide
  FROM (SELECT unnest(list_transform(pg_accessions, lambda x: x.accession)) AS a, sequence AS peptide FROM feature) WHERE a IS NOT NULL AND peptide IS NOT NULL AND accession IS NOT NULL)"""
OBSERVED = f"""o0 AS (SELECT sequence AS peptide, {B.SQL_RUN_KEY.format('run_file_name')} AS sample, imputed_labels, unnest(intensities, max_depth := 1) AS e FROM feature WHERE sequence IS NOT NULL),
observed AS (SELECT peptide, sample, CAST(e.intensity AS DOUBLE) AS intensity FROM o0 WHERE e IS NOT NULL AND isfinite(e.intensity) AND e.intensity > 0 AND NOT coalesce(list_contains(imputed_labels, e.label), false))"""
_PAIRS = f"{EDGES}, pairs AS (SELECT a.accession AS a, b.accession AS b FROM edges a JOIN edges b ON a.peptide = b.peptide AND a.accession < b.accession GROUP BY ALL HAVING count(*) >= 2)"
_FAMILIES = f"""{_PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT accession, accession AS other FROM edges UNION SELECT r.accession, p.b FROM reach r JOIN both_ways p ON r.other = p.a),
comp AS (SELECT accession, min(other) AS component FROM reach GROUP BY accession), n AS (SELECT accession, count(*) AS n FROM edges GROUP BY accession),
named AS (SELECT component, arg_max(accession, (n, accession)) AS family, count(*) AS family_size FROM comp JOIN n USING (accession) GROUP BY component),
families AS (SELECT accession, family, family_size FROM comp JOIN named USING (component))"""

R.add("jn10_shared_pairs", f"WITH {EDGES} SELECT a.accession AS a, b.accession AS b, count(*) AS shared FROM edges a JOIN edges b ON a.peptide = b.peptide AND a.accession < b.accession GROUP BY ALL HAVING count(*) >= 2")(
    lambda spark, sf_dir: pibaq.sharing_pairs(edges(spark, sf_dir), 2, "accession", "peptide")
)
R.add("pib1_index", f"WITH {EDGES} SELECT accession, count(*) AS peptides, count(*) FILTER (n = 1) AS unique_peptides FROM edges JOIN (SELECT peptide, count(*) AS n FROM edges GROUP BY peptide) USING (peptide) GROUP BY accession")(
    lambda spark, sf_dir: (lambda e: e.join(e.groupBy("peptide").agg(F.count(F.lit(1)).alias("n")), "peptide").groupBy("accession").agg(F.count(F.lit(1)).alias("peptides"), F.count(F.when(F.col("n") == 1, 1)).alias("unique_peptides")))(edges(spark, sf_dir))
)
R.add("pib2_families", f"WITH RECURSIVE {_FAMILIES} SELECT accession, family, family_size FROM families")(lambda spark, sf_dir: pibaq.families(edges(spark, sf_dir)))
R.add("pib10_no_contaminants", f"WITH {EDGES} SELECT accession, peptide FROM edges WHERE NOT contains(accession, 'CONTAM') AND NOT contains(accession, 'DECOY') AND NOT contains(accession, 'ENTRAP')")(lambda spark, sf_dir: edges(spark, sf_dir).where(~K.is_contaminant(F.col("accession"))))

_UNIQ = f"""WITH {EDGES}, {OBSERVED}, owners AS (SELECT peptide, count(*) AS m, min(accession) AS sole FROM edges GROUP BY peptide),
top AS (SELECT peptide, sample, max(intensity) AS i FROM observed GROUP BY ALL)"""


def _plain_families(e: DataFrame) -> DataFrame:
    """Every accession its own family: the allocation without sharing between families."""
    return e.select("accession").distinct().select("accession", F.col("accession").alias("family"), F.lit(1).cast("bigint").alias("family_size"))


R.add(
    "pib6_unique_mode",
    f"{_UNIQ}, d AS (SELECT sole AS accession, count(*) AS d FROM owners WHERE m = 1 GROUP BY sole) SELECT sole AS accession, sample, round(log2(sum(i) / any_value(d)), 8) AS value FROM top JOIN owners USING (peptide) JOIN d ON d.accession = sole WHERE m = 1 GROUP BY sole, sample",
)(lambda spark, sf_dir: (lambda e: l2(pibaq.unique_mode(observed(spark, sf_dir), e, _plain_families(e)).where("level = 'unique'").drop("level")))(edges(spark, sf_dir)))
R.add(
    "pib4_anchors",
    f"WITH {EDGES}, {OBSERVED}, seen AS (SELECT * FROM edges WHERE peptide IN (SELECT peptide FROM observed)), one AS (SELECT peptide FROM seen GROUP BY peptide HAVING count(*) = 1), a AS (SELECT accession, count(*) AS a FROM seen WHERE peptide IN (SELECT peptide FROM one) GROUP BY accession) SELECT peptide, arg_min(accession, (-coalesce(a, 0), accession)) AS family FROM seen LEFT JOIN a USING (accession) GROUP BY peptide",
)(lambda spark, sf_dir: (lambda e: pibaq.peptide_owner(observed(spark, sf_dir), e, _plain_families(e)))(edges(spark, sf_dir)))


_SHARED = f"""WITH RECURSIVE {_FAMILIES}, {OBSERVED}, top AS (SELECT peptide, sample, max(intensity) AS i FROM observed GROUP BY ALL),
seen AS (SELECT * FROM edges WHERE peptide IN (SELECT peptide FROM observed)), one AS (SELECT peptide FROM seen GROUP BY peptide HAVING count(DISTINCT accession) = 1),
anch AS (SELECT accession, count(*) AS a FROM seen WHERE peptide IN (SELECT peptide FROM one) GROUP BY accession), strength AS (SELECT family, sum(coalesce(a, 0)) AS s FROM families LEFT JOIN anch USING (accession) GROUP BY family),
owner AS (SELECT peptide, arg_min(family, (-s, family)) AS family FROM (SELECT DISTINCT peptide, family FROM seen JOIN families USING (accession)) JOIN strength USING (family) GROUP BY peptide),
members AS (SELECT e.peptide, e.accession FROM edges e JOIN families f USING (accession) JOIN owner o ON o.peptide = e.peptide AND o.family = f.family), nm AS (SELECT peptide, count(*) AS m FROM members GROUP BY peptide),
r AS (SELECT t.peptide, t.sample, t.i, n.m, b.accession FROM top t JOIN nm n USING (peptide) JOIN members b USING (peptide)),
own AS (SELECT accession, sample, sum(i) AS anchor FROM r WHERE m = 1 GROUP BY ALL), sh AS (SELECT r.*, coalesce(anchor, 0) AS w FROM r LEFT JOIN own USING (accession, sample) WHERE m > 1),
st AS (SELECT *, sum(w) OVER (PARTITION BY peptide, sample) AS t FROM sh), giv AS (SELECT accession, sample, sum(CASE WHEN t > 0 THEN i * w / t ELSE i / m END) AS shared FROM st GROUP BY ALL),
alloc AS (SELECT accession, sample, coalesce(anchor, 0) AS anchor, coalesce(shared, 0) AS shared, coalesce(anchor, 0) + coalesce(shared, 0) AS value FROM own FULL JOIN giv USING (accession, sample))"""
_THEORY = """den AS (SELECT accession, count(*) AS d FROM edges GROUP BY accession), uq AS (SELECT min(accession) AS accession, peptide FROM edges GROUP BY peptide HAVING count(*) = 1),
nu AS (SELECT accession, count(*) AS n_unique FROM uq WHERE peptide IN (SELECT peptide FROM observed) GROUP BY accession),
theory AS (SELECT accession, sample, value / d AS pibaq, family, family_size, CASE WHEN coalesce(n_unique, 0) >= 2 THEN 'high' WHEN n_unique = 1 THEN 'medium' ELSE 'family_only' END AS evidence
  FROM alloc JOIN den USING (accession) JOIN families USING (accession) LEFT JOIN nu USING (accession))"""


@R.add("pib5_proportional", f"{_SHARED} SELECT accession, sample, round(anchor, 2) AS anchor, round(log2(nullif(value, 0)), 7) AS value FROM alloc")
def pib5(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return l2(pibaq.allocate(observed(spark, sf_dir), e, pibaq.families(e)).select("accession", "sample", F.round("anchor", 2).alias("anchor"), "value"), digits=7)


_STABLE = f"""{_SHARED}, fa AS (SELECT * FROM alloc JOIN families USING (accession)), tot AS (SELECT family, sample, sum(anchor) AS ta, sum(shared) AS ts FROM fa GROUP BY ALL),
q AS (SELECT fa.*, ta, ts FROM fa JOIN tot USING (family, sample)), shr AS (SELECT accession, median(anchor / ta) AS s FROM q WHERE anchor > 0 AND ta > 0 GROUP BY accession),
lv AS (SELECT q.*, s FROM q JOIN shr USING (accession) WHERE anchor > 0), nn AS (SELECT family, sample, sum(s) AS n FROM lv GROUP BY ALL)
SELECT accession, sample, round(log2(anchor + ts * s / n), 7) AS value FROM lv JOIN nn USING (family, sample)"""


@R.add("pib7_stable_ratio", _STABLE)
def pib7(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    return l2(pibaq.stable_ratio(observed(spark, sf_dir), e, pibaq.families(e)), digits=7)


@R.add("pib8_pibaq", f"{_SHARED}, {_THEORY} SELECT accession, sample, round(log2(nullif(pibaq, 0)), 7) AS pibaq, family, family_size, evidence FROM theory")
def pib8(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    fam, obs = pibaq.families(e), observed(spark, sf_dir)
    return l2(pibaq.per_theoretical(pibaq.allocate(obs, e, fam), e, fam, obs).select("accession", "sample", "pibaq", "family", "family_size", "evidence"), "pibaq", 7)


R.add("pib11_derived", f"{WC} SELECT protein, sample, round(value / sum(value) OVER (PARTITION BY sample), 9) AS norm, round(10 + log10(value / sum(value) OVER (PARTITION BY sample)), 7) AS log FROM cells")(
    lambda spark, sf_dir: _r(pibaq.derived_values(B.cells(spark, sf_dir).withColumnRenamed("value", "pibaq"), ("sample",)).select("protein", "sample", "norm", "log"), norm=9, log=7)
)
R.add("pib12_tpa", f"{WC}, w AS (SELECT protein, CAST(count(DISTINCT sample) AS DOUBLE) AS weight FROM cells GROUP BY protein) SELECT protein, sample, round(log2(value / weight), 8) AS tpa FROM cells JOIN w USING (protein)")(
    lambda spark, sf_dir: (lambda c: l2(pibaq.total_protein_approach(c.withColumnRenamed("protein", "accession"), c.groupBy(F.col("protein").alias("accession")).agg(F.count_distinct("sample").cast("double").alias("weight"))), "tpa").select(F.col("accession").alias("protein"), "sample", "tpa"))(B.cells(spark, sf_dir))
)
R.add(
    "pib13_ruler",
    f"{WC}, v AS (SELECT protein, condition, sum(value) AS value FROM cells JOIN design USING (sample) GROUP BY ALL), h AS (SELECT condition, greatest(1.0, sum(value)) AS h FROM v WHERE protein < 'ZX3' GROUP BY condition) SELECT protein, condition, round(log2(value * 3.2e9 * 2 * 617.96 / (50000.0 * h)), 7) AS copies FROM v JOIN h USING (condition)",
)(lambda spark, sf_dir: (lambda v: l2(pibaq.proteomic_ruler(v, v.select("accession", F.lit(50000.0).alias("weight")).distinct(), v.where("accession < 'ZX3'").select("accession").distinct(), 3.2e9), "copies", 7).select(F.col("accession").alias("protein"), "condition", "copies"))(B.cells(spark, sf_dir).join(groups(spark, sf_dir), "sample").groupBy(F.col("protein").alias("accession"), "condition").agg(F.sum("value").alias("value"))))
R.add("sc10_weight", "SELECT feature_id, round(18.0105650638::DOUBLE + list_sum(list_transform(string_split(sequence, ''), lambda c: coalesce(map_extract(MAP {" + ", ".join(f"'{k}': {v}::DOUBLE" for k, v in pibaq.RESIDUE_MASS.items()) + "}, c)[1], 0.0::DOUBLE))), 5) AS mass FROM feature WHERE sequence IS NOT NULL")(
    lambda spark, sf_dir: table(spark, sf_dir, "feature").where("sequence IS NOT NULL").select("feature_id", F.round(pibaq.molecular_weight("sequence"), 5).alias("mass"))
)
R.add("sc9_digest")(lambda spark, sf_dir: pibaq.digest(table(spark, sf_dir, "feature").groupBy(K.clean_accession("anchor_protein").alias("accession")).agg(F.array_join(F.array_sort(F.collect_set("sequence")), "").alias("protein_sequence")).where("accession IS NOT NULL"), missed=1))

# ---- imputation ------------------------------------------------------------------------------------------------------------

_GRID = f"{WC}, g AS (SELECT protein, sample, log2(value) AS v FROM (SELECT p.protein, s.sample FROM (SELECT DISTINCT protein FROM cells) p, (SELECT DISTINCT sample FROM cells) s) LEFT JOIN cells USING (protein, sample))"
for _n, _f in (("mean", "avg(v)"), ("median", "median(v)"), ("mindet", "quantile_cont(v, 0.01)")):
    R.add(f"imp{4 if _n == 'mindet' else 2}_{_n}", f"{_GRID}, s AS (SELECT sample, {_f} AS f FROM g GROUP BY sample) SELECT protein, sample, round(coalesce(v, f), 7) AS value, v IS NULL AS imputed FROM g JOIN s USING (sample)")(lambda spark, sf_dir, n=_n: l2(impute.by_sample(B.cells(spark, sf_dir), n), digits=7))
R.add("imp1_zero", f"{_GRID} SELECT protein, sample, round(coalesce(v, 0), 7) AS value, v IS NULL AS imputed FROM g")(lambda spark, sf_dir: l2(impute.constant(B.cells(spark, sf_dir)), digits=7))
R.add(
    "imp3_most_frequent",
    f"{_GRID}, s AS (SELECT sample, round(v) AS v, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY sample, round(v) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY count(*) DESC, round(v)) = 1) SELECT protein, g.sample, coalesce(round(g.v), s.v) AS value, g.v IS NULL AS imputed FROM g JOIN s USING (sample)",
)(lambda spark, sf_dir: (lambda d: l2(impute.by_sample(d, "most_frequent"), digits=0))(B.cells(spark, sf_dir).withColumn("value", F.pow(F.lit(2.0), F.round(F.log2("value"))))))
R.add("imp5_minprob")(lambda spark, sf_dir: impute.min_prob(B.cells(spark, sf_dir)))
R.add("imp6_qrilc")(lambda spark, sf_dir: impute.qrilc(B.cells(spark, sf_dir), sparse="leave"))
R.add("imp10_gms")(lambda spark, sf_dir: impute.gaussian_mixture(B.cells(spark, sf_dir)))


for _i, _n in ((7, "knn"), (8, "seqknn"), (9, "bpca"), (11, "impseq"), (12, "impseqrob"), (13, "missforest")):
    if _n in ("knn", "bpca", "missforest"):
        R.add(f"imp{_i}_{_n}")(lambda spark, sf_dir, n=_n: impute.on_matrix(B.cells(spark, sf_dir), n))
    else:  # these start from complete rows: the samples are pooled first
        R.add(f"imp{_i}_{_n}")(lambda spark, sf_dir, n=_n: impute.on_matrix(_pooled(spark, sf_dir, 4), n))


def _pooled(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Mean per protein and pool of samples: few columns, many complete rows."""
    pool = F.concat(F.lit("pool-"), (F.regexp_extract("sample", "([0-9]+)$", 1).try_cast("int") % n).cast("string"))
    return B.cells(spark, sf_dir).groupBy("protein", pool.alias("sample")).agg(F.avg("value").alias("value"))


# ---- batches ---------------------------------------------------------------------------------------------------------------

R.add("bat1_prefix", f"{WI} SELECT DISTINCT sample, CASE WHEN contains(sample, '-') AND regexp_extract(sample, '^([^-]*)-', 1) <> '' THEN regexp_extract(sample, '^([^-]*)-', 1) ELSE sample END AS batch FROM ions")(lambda spark, sf_dir: B.ions(spark, sf_dir).select("sample", batch.sample_prefix("sample").alias("batch")).distinct())
R.add("bat1_detect", f"{WI}, b AS (SELECT DISTINCT sample, regexp_extract(sample, '^([^-]*)-', 1) AS batch FROM ions) SELECT sample, batch FROM b WHERE (SELECT count(*) FROM (SELECT batch FROM b GROUP BY batch HAVING count(*) >= 2)) >= 2")(lambda spark, sf_dir: batch.detect_batches(B.ions(spark, sf_dir).select("sample"), batch.sample_prefix("sample")))
R.add("bat8_single", f"{WI}, b AS (SELECT DISTINCT sample, plex AS batch FROM design) SELECT sample, batch FROM b WHERE batch IN (SELECT batch FROM b GROUP BY batch HAVING count(*) >= 2)")(lambda spark, sf_dir: batch.drop_single_sample_batches(design(spark, sf_dir).select("sample", F.col("plex").alias("batch"))))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.cells(spark, sf_dir).withColumn("value", F.log2("value"))


R.add("bat3_combat")(lambda spark, sf_dir: batch.combat_long(_logs(spark, sf_dir), design(spark, sf_dir).select("sample", F.col("plex").alias("batch"))))
_SCALED = f"""{WC}, lg AS (SELECT protein, sample, log2(value) AS v, plex AS batch FROM cells JOIN design USING (sample) WHERE is_reference),
ok AS (SELECT protein FROM lg GROUP BY protein HAVING count(*) = (SELECT count(DISTINCT sample) FROM lg)), l AS (SELECT * FROM lg WHERE protein IN (SELECT protein FROM ok)),
bm AS (SELECT protein, batch, avg(v) AS m, var_samp(v) AS s FROM l GROUP BY ALL), gm AS (SELECT protein, avg(v) AS g FROM l GROUP BY protein),
pv AS (SELECT protein, avg((v - m) * (v - m)) AS p FROM l JOIN bm USING (protein, batch) GROUP BY protein)
SELECT protein, sample, round((v - m) * sqrt(CASE WHEN s > 0 THEN p / s ELSE 1 END) + g, 6) AS value FROM l JOIN bm USING (protein, batch) JOIN gm USING (protein) JOIN pv USING (protein)
UNION ALL SELECT protein, sample, round(v, 6) FROM lg WHERE protein NOT IN (SELECT protein FROM ok)"""


@R.add("bat3_location_scale", _SCALED)
def bat3_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the reference samples, of which several have all of a protein's values."""
    chosen = design(spark, sf_dir).where("is_reference").select("sample", F.col("plex").alias("batch"))
    return _r(batch.location_scale(_logs(spark, sf_dir).join(chosen.select("sample"), "sample", "left_semi"), chosen), value=6)


def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All proteins in all samples, gaps filled by the sample's low quantile: what components and clusters of samples are taken from."""
    return impute.by_sample(B.cells(spark, sf_dir), "mindet").select("protein", "sample", "value")


R.add("bat5_pca")(lambda spark, sf_dir: batch.pca_scores(filled(spark, sf_dir)))


@R.add("bat7_outliers")
def bat7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that fall out of every cluster, round after round."""
    return spark.createDataFrame([(s,) for s in batch.outlier_samples(B.cells(spark, sf_dir), fill=True)], "sample string")


# ---- tests -----------------------------------------------------------------------------------------------------------------

_STATS = f"""{WC}, y AS (SELECT protein, condition, log2(value) AS y FROM cells JOIN design USING (sample)),
stats AS (SELECT protein, avg(y) FILTER (condition = 'A') AS mean_a, avg(y) FILTER (condition = 'B') AS mean_b, count(y) FILTER (condition = 'A') AS n_a, count(y) FILTER (condition = 'B') AS n_b,
  coalesce(var_samp(y) FILTER (condition = 'A'), 0) AS var_a, coalesce(var_samp(y) FILTER (condition = 'B'), 0) AS var_b FROM y GROUP BY protein)"""
R.add("de2_group_stats", f"{_STATS} SELECT protein, round(mean_a, 8) AS mean_a, round(mean_b, 8) AS mean_b, n_a, n_b, round(var_a, 7) AS var_a, round(var_b, 7) AS var_b, round(mean_b - mean_a, 8) AS \"log2FC\" FROM stats")(
    lambda spark, sf_dir: _r(de.group_stats(B.cells(spark, sf_dir), groups(spark, sf_dir), "A", "B"), mean_a=8, mean_b=8, var_a=7, var_b=7, log2FC=8)
)
R.add("de3_limma")(lambda spark, sf_dir: de.limma(B.cells(spark, sf_dir), groups(spark, sf_dir), "A", "B"))
R.add("de5_deqms")(lambda spark, sf_dir: de.deqms(B.cells(spark, sf_dir), groups(spark, sf_dir), rollup.deqms_counts(B.peptides(spark, sf_dir)), "A", "B"))
R.add("de6_rots")(lambda spark, sf_dir: de.rots(B.cells(spark, sf_dir), groups(spark, sf_dir), "A", "B"))
R.add("de7_limrots")(lambda spark, sf_dir: de.rots(_by_half(spark, sf_dir), _halves(spark, sf_dir), "A", "B", moderated=True))
R.add("de8_proda")(lambda spark, sf_dir: de.proda(B.cells(spark, sf_dir), groups(spark, sf_dir), "A", "B"))


def _halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_half(spark, sf_dir).select("sample").distinct().select("sample", F.substring("sample", 1, 1).alias("condition"))


def _by_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples pooled to two per group, so that many proteins are complete."""
    n = F.regexp_extract("sample", "([0-9]+)$", 1).try_cast("int")
    pool = F.concat(F.when(n % 2 == 0, "A").otherwise("B"), ((n / 2).cast("int") % 2).cast("string"))
    return B.cells(spark, sf_dir).groupBy("protein", pool.alias("sample")).agg(F.avg("value").alias("value"))


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of p-values that SQL can rebuild: the normal tail of a scaled difference, by a rational bound."""
    s = de.group_stats(B.cells(spark, sf_dir), groups(spark, sf_dir), "A", "B").where("n_a >= 2 AND n_b >= 2 AND var_a + var_b > 0")
    t = F.abs("log2FC") / F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    return s.select("protein", "log2FC", "n_a", "n_b", F.round(1 / (1 + t * t), 6).alias("pvalue"), F.lit("B-A").alias("contrast"))


_TESTS = f"{_STATS}, tests AS (SELECT protein, mean_b - mean_a AS lfc, n_a, n_b, round(1 / (1 + (mean_b - mean_a) * (mean_b - mean_a) / (var_a / n_a + var_b / n_b)), 6) AS pvalue FROM stats WHERE n_a >= 2 AND n_b >= 2 AND var_a + var_b > 0)"
_BH = "r AS (SELECT *, pvalue * count(*) OVER () / (rank() OVER (ORDER BY pvalue) + count(*) OVER (PARTITION BY pvalue) - 1) AS x FROM {t}), bh AS (SELECT *, least(1, min(x) OVER (ORDER BY pvalue DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj FROM r)"
R.add("de10_bh", f"{_TESTS}, {_BH.format(t='tests')} SELECT protein, pvalue, round(adj, 8) AS adj_pvalue FROM bh")(lambda spark, sf_dir: _r(fdr.benjamini_hochberg(_tests(spark, sf_dir)).select("protein", "pvalue", "adj_pvalue"), adj_pvalue=8))
R.add("de11_two_stage", f"{_TESTS}, {_BH.format(t='tests')} SELECT protein, round(least(1, adj * greatest(0, 1 - (SELECT count(*) FILTER (adj <= 0.05 / 1.05) / count(*) FROM bh)) * 1.05), 8) AS adj_pvalue FROM bh")(lambda spark, sf_dir: _r(fdr.two_stage(_tests(spark, sf_dir)).select("protein", "adj_pvalue"), adj_pvalue=8))
R.add("de11_lambda_counts", f"{_TESTS} SELECT count(*) AS n, count(*) FILTER (pvalue < 0.05) AS low, count(*) FILTER (pvalue >= 0.5) AS high, " + ", ".join(f"count(*) FILTER (pvalue >= {x}) AS ge_{i}" for i, x in enumerate(fdr.LAMBDAS)) + " FROM tests")(lambda spark, sf_dir: fdr.lambda_counts(_tests(spark, sf_dir)))
R.add("de11_qvalues")(lambda spark, sf_dir: fdr.qvalues(_tests(spark, sf_dir)))
R.add("de12_weighted")(lambda spark, sf_dir: fdr.weighted(_tests(spark, sf_dir).withColumn("n", F.col("n_a") + F.col("n_b")), "n"))
R.add("de13_null_gate", f"{_TESTS}, a AS (SELECT abs(lfc - (SELECT median(lfc) FROM tests)) AS a FROM tests), k AS (SELECT a FROM a WHERE a <= 2 * 1.4826 * (SELECT median(a) FROM a)) SELECT round(CASE WHEN (SELECT count(*) FROM a) < 50 THEN 0.5 WHEN (SELECT count(*) FROM k) >= 20 THEN (SELECT quantile_cont(a, 0.95) FROM k) ELSE (SELECT quantile_cont(a, 0.95) FROM a) END, 7) AS gate")(
    lambda spark, sf_dir: _r(fdr.null_quantile_gate(_tests(spark, sf_dir)), gate=7)
)
R.add("de14_significance", f"{_TESTS}, {_BH.format(t='tests')} SELECT protein, CASE WHEN NOT (adj < 0.5 AND abs(lfc) > 0.5) THEN 'Unchanged' WHEN lfc > 0 THEN 'UP' ELSE 'DOWN' END AS significance FROM bh")(
    lambda spark, sf_dir: fdr.benjamini_hochberg(_tests(spark, sf_dir)).select("protein", fdr.significance(fdr=0.5, gate=0.5).alias("significance"))
)
_ENS = f"""{_TESTS}, m AS (SELECT protein, lfc, pvalue, 1 AS k FROM tests UNION ALL SELECT protein, lfc * 0.9, round(least(1, pvalue * 1.2), 6), 2 FROM tests)
SELECT protein, round(median(lfc), 7) AS "log2FC", round(atan2(1, avg(1 / tan(greatest(1e-15, least(1 - 1e-15, pvalue)) * 3.141592653589793))) / 3.141592653589793, 6) AS pvalue, count(*) AS n_methods FROM m GROUP BY protein"""
R.add("de9_ensemble", _ENS)(
    lambda spark, sf_dir: (lambda t: _r(de.ensemble({"one": fdr.benjamini_hochberg(t), "two": fdr.benjamini_hochberg(t.withColumns({"log2FC": F.col("log2FC") * 0.9, "pvalue": F.round(F.least(F.lit(1.0), F.col("pvalue") * 1.2), 6)}))}).select("protein", "log2FC", "pvalue", "n_methods"), log2FC=7, pvalue=6))(_tests(spark, sf_dir))
)

# ---- coverage and testability with the two-group design ----------------------------------------------------------------------

from abundera.operators import filters as X  # noqa: E402

R.add("grp12_coverage", f"{WC}, z AS (SELECT condition, count(*) AS size FROM design GROUP BY condition), k AS (SELECT protein, condition, count(*) AS n FROM cells JOIN design USING (sample) GROUP BY ALL) SELECT protein, count(*) AS n FROM cells WHERE protein IN (SELECT protein FROM k JOIN z USING (condition) GROUP BY protein HAVING count(*) = 2 AND min(n / size) >= 0.1) GROUP BY protein")(
    lambda spark, sf_dir: X.coverage(B.cells(spark, sf_dir), groups(spark, sf_dir), 0.1).groupBy("protein").agg(F.count(F.lit(1)).alias("n"))
)
R.add("grp16_testable", f"{WC} SELECT protein FROM cells JOIN design USING (sample) GROUP BY protein HAVING count(*) FILTER (condition = 'A') >= 2 AND count(*) FILTER (condition = 'B') >= 2")(lambda spark, sf_dir: X.testable(B.cells(spark, sf_dir), groups(spark, sf_dir), "A", "B").select("protein").distinct())

# ---- atlas, QC, evaluation -----------------------------------------------------------------------------------------------------

R.add("agg19_reference_ratio", f"{WI}, r AS (SELECT protein, run, avg(intensity) AS r FROM ions WHERE charge = 2 GROUP BY ALL) SELECT protein, sample, round(log2(sum(intensity / r)), 8) AS value FROM ions JOIN r USING (protein, run) WHERE charge <> 2 GROUP BY protein, sample")(lambda spark, sf_dir: l2(atlas.reference_ratio_matrix(B.ions(spark, sf_dir).withColumn("is_reference", F.col("charge") == 2))))
_TS = f"""{WC}, v AS (SELECT protein, sample, log2(value) AS y FROM cells), mu AS (SELECT protein, median(y) AS mu FROM v GROUP BY protein HAVING count(*) >= 3),
d AS (SELECT protein, sample, y - mu AS d FROM v JOIN mu USING (protein)), s AS (SELECT protein, greatest(0.1, 1.4826 * median(abs(d))) AS sd FROM d GROUP BY protein),
ts AS (SELECT protein, plex AS tissue, median(d / sd) AS ts FROM d JOIN s USING (protein) JOIN design USING (sample) GROUP BY ALL)"""


def _tissues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return design(spark, sf_dir).select("sample", F.col("plex").alias("tissue"))


R.add("tis2_specificity", f"{_TS} SELECT protein, tissue, round(ts, 7) + 0.0::DOUBLE AS ts FROM ts")(lambda spark, sf_dir: _r(atlas.specificity(B.cells(spark, sf_dir), _tissues(spark, sf_dir)), ts=7))
R.add("tis2_dpd")(lambda spark, sf_dir: atlas.specificity_dpd(B.cells(spark, sf_dir), _tissues(spark, sf_dir)))
R.add("tis4_enrichment", f"{_TS} SELECT protein, CASE WHEN count(*) FILTER (ts >= 1.0) = 1 THEN 'specific' WHEN count(*) FILTER (ts >= 1.0) > 1 THEN 'enhanced' WHEN count(*) FILTER (ts >= 0.5) > 0 THEN 'moderate' ELSE 'not specific' END AS class, arg_min(tissue, (-ts, tissue)) AS top_tissue, count(*) FILTER (ts >= 1.0) AS n_high FROM ts GROUP BY protein")(
    lambda spark, sf_dir: atlas.enrichment(atlas.specificity(B.cells(spark, sf_dir), _tissues(spark, sf_dir)), 1.0, 0.5)
)
R.add(
    "tis5_markers",
    f"""{WC}, r AS (SELECT protein, plex AS tissue, rank() OVER (PARTITION BY protein ORDER BY value) + (count(*) OVER (PARTITION BY protein, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY protein) AS t FROM cells JOIN design USING (sample)),
g AS (SELECT protein, tissue, count(*) AS n, sum(r) - count(*) * (count(*) + 1) / 2 AS u, any_value(t) AS t FROM r GROUP BY ALL)
SELECT protein, tissue, n, u, round((u - n * (t - n) / 2) / sqrt(n * (t - n) * (t + 1) / 12), 8) AS z FROM g WHERE t > n""",
)(lambda spark, sf_dir: _r(atlas.markers(B.cells(spark, sf_dir), _tissues(spark, sf_dir)), z=8))
R.add("qc1_distribution", f"{WC}, v AS (SELECT sample, log2(value) AS y FROM cells) SELECT sample, count(*) AS n, round(avg(y), 8) AS mean, round(stddev_samp(y), 8) AS sd, round(quantile_cont(y, 0.25), 8) AS q25, round(quantile_cont(y, 0.5), 8) AS q50, round(quantile_cont(y, 0.75), 8) AS q75, round(1 - count(*) / (SELECT count(DISTINCT protein) FROM cells), 8) AS missing FROM v GROUP BY sample")(
    lambda spark, sf_dir: _r(atlas.sample_distribution(B.cells(spark, sf_dir)), mean=8, sd=8, q25=8, q50=8, q75=8, missing=8)
)
R.add("qc1_condition_cv", f"{WC}, c AS (SELECT condition, protein, stddev_samp(value) / avg(value) AS cv FROM cells JOIN design USING (sample) GROUP BY ALL) SELECT condition, round(median(cv), 7) AS median_cv, count(cv) AS n FROM c WHERE cv IS NOT NULL GROUP BY condition")(lambda spark, sf_dir: _r(atlas.condition_cv(B.cells(spark, sf_dir), groups(spark, sf_dir)), median_cv=7))
R.add("qc1_variance", f"{WC}, y AS (SELECT protein, condition, log2(value) AS y FROM cells JOIN design USING (sample)), g AS (SELECT protein, condition, avg(y) AS m, count(*) AS n FROM y GROUP BY ALL), t AS (SELECT protein, avg(y) AS gm, var_pop(y) * count(*) AS total FROM y GROUP BY protein HAVING var_pop(y) * count(*) > 1e-9) SELECT protein, round(sum(n * (m - gm) * (m - gm)) / any_value(total), 6) AS r2 FROM g JOIN t USING (protein) GROUP BY protein")(
    lambda spark, sf_dir: (lambda c: _r(atlas.variance_explained(c, groups(spark, sf_dir)).join(c.groupBy("protein").agg((F.var_pop(F.log2("value")) * F.count("value")).alias("t")).where("t > 1e-9").select("protein"), "protein", "left_semi"), r2=6))(B.cells(spark, sf_dir))
)
R.add("qc2_completeness", f"{WC}, n AS (SELECT protein, count(*) AS n_samples FROM cells GROUP BY protein) SELECT n_samples, count(*) AS proteins FROM n GROUP BY n_samples")(lambda spark, sf_dir: atlas.completeness(B.cells(spark, sf_dir)))
R.add("qc2_abundance_rank", f"{WC}, m AS (SELECT protein, median(log2(value)) AS a FROM cells GROUP BY protein) SELECT protein, round(a, 8) AS abundance, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS rank FROM m")(lambda spark, sf_dir: _r(atlas.abundance_rank(B.cells(spark, sf_dir)), abundance=8))
R.add("qc3_concordance", f"{_TESTS}, {_BH.format(t='tests')}, two AS (SELECT protein, lfc, adj, least(1, adj * greatest(0, 1 - (SELECT count(*) FILTER (adj <= 0.05 / 1.05) / count(*) FROM bh)) * 1.05) AS adj2 FROM bh) SELECT count(*) AS common, 1.0::DOUBLE AS r, count(*) FILTER (adj < 0.05) AS hits_a, count(*) FILTER (adj2 < 0.05) AS hits_b, count(*) FILTER (adj < 0.05 AND adj2 < 0.05) AS hits_both FROM two")(lambda spark, sf_dir: (lambda t: _r(atlas.concordance(fdr.benjamini_hochberg(t), fdr.two_stage(t)), r=9))(_tests(spark, sf_dir)))
R.add("qc4_ma", f"{_STATS} SELECT protein, round((mean_a + mean_b) / 2, 8) AS a, round(mean_b - mean_a, 8) AS m FROM stats")(lambda spark, sf_dir: _r(atlas.ma_values(de.group_stats(B.cells(spark, sf_dir), groups(spark, sf_dir), "A", "B")), a=8, m=8))
R.add("evl1_confusion", "SELECT charge, CAST(count(*) FILTER (p AND t) AS DOUBLE) AS tp, CAST(count(*) FILTER (p AND NOT t) AS DOUBLE) AS fp, CAST(count(*) FILTER (NOT p AND t) AS DOUBLE) AS fn, CAST(count(*) FILTER (NOT p AND NOT t) AS DOUBLE) AS tn FROM (SELECT charge, peptide_qvalue > 0.01 AS p, is_decoy AS t FROM feature) WHERE p IS NOT NULL AND t IS NOT NULL GROUP BY charge")(
    lambda spark, sf_dir: atlas.confusion(table(spark, sf_dir, "feature").select("charge", (F.col("peptide_qvalue") > 0.01).alias("p"), F.col("is_decoy").alias("t")), "p", "t", ["charge"]).drop("mcc")
)
R.add("evl1_auc", "WITH f AS (SELECT charge, peptide_qvalue AS s, is_decoy::INT AS t FROM feature WHERE peptide_qvalue IS NOT NULL AND is_decoy IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY charge ORDER BY s) + (count(*) OVER (PARTITION BY charge, s) - 1) / 2 AS r FROM f) SELECT charge, round((sum(r) FILTER (t = 1) - sum(t) * (sum(t) + 1) / 2) / nullif(sum(t) * sum(1 - t), 0), 8) AS auc FROM r GROUP BY charge")(
    lambda spark, sf_dir: _r(atlas.roc_auc(table(spark, sf_dir, "feature"), "peptide_qvalue", "is_decoy", ["charge"]), auc=8)
)
R.add("evl1_ladder", "SELECT level, count(*) FILTER (s <= level) AS calls, count(*) FILTER (s <= level AND t) AS true_calls, round(coalesce((count(*) FILTER (s <= level) - count(*) FILTER (s <= level AND t)) / nullif(count(*) FILTER (s <= level), 0), 0), 8) AS empirical_fdr, round(count(*) FILTER (s <= level AND t) / nullif(count(*) FILTER (t), 0), 8) AS recall FROM (SELECT peptide_qvalue AS s, NOT is_decoy AS t, unnest([0.001::DOUBLE, 0.01::DOUBLE, 0.05::DOUBLE, 0.1::DOUBLE]) AS level FROM feature WHERE peptide_qvalue IS NOT NULL AND is_decoy IS NOT NULL) GROUP BY level")(
    lambda spark, sf_dir: _r(atlas.fdr_ladder(table(spark, sf_dir, "feature").withColumn("ok", ~F.col("is_decoy")), "peptide_qvalue", "ok", [0.001, 0.01, 0.05, 0.1]), empirical_fdr=8, recall=8)
)
R.add("win7_ladder", "WITH s AS (SELECT peptide_qvalue AS q, count(*) FILTER (is_decoy) AS t, count(*) AS n FROM feature WHERE peptide_qvalue IS NOT NULL AND is_decoy IS NOT NULL GROUP BY q) SELECT q AS peptide_qvalue, CAST(sum(t) OVER (ORDER BY q) AS BIGINT) AS tp, CAST(sum(n - t) OVER (ORDER BY q) AS BIGINT) AS fp FROM s")(
    lambda spark, sf_dir: atlas.cumulative_ladder(table(spark, sf_dir, "feature").where("is_decoy IS NOT NULL"), "peptide_qvalue", "is_decoy", "asc")
)
R.add("evl2_mean_rank", f"{WC}, m AS (SELECT sample, count(*) AS n, median(log2(value)) AS v FROM cells GROUP BY sample), r AS (SELECT sample, rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS a, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS b FROM m) SELECT sample, (a + b) / 2 AS mean_rank FROM r")(
    lambda spark, sf_dir: atlas.mean_rank(B.cells(spark, sf_dir).groupBy("sample").agg(F.count(F.lit(1)).cast("double").alias("n"), F.median(F.log2("value")).alias("v")), "sample", {"n": True, "v": False})
)
R.add("evl3_profile", f"{WC}, c AS (SELECT condition, protein, stddev_samp(value) / avg(value) AS cv FROM cells JOIN design USING (sample) GROUP BY ALL), k AS (SELECT condition, median(cv) AS m FROM c WHERE cv IS NOT NULL GROUP BY condition) SELECT count(DISTINCT sample) AS samples, count(DISTINCT protein) AS proteins, round(1 - count(*) / (count(DISTINCT sample) * count(DISTINCT protein)), 8) AS missing, round((SELECT median(m) FROM k), 7) AS median_cv FROM cells")(
    lambda spark, sf_dir: _r(atlas.dataset_profile(B.cells(spark, sf_dir), groups(spark, sf_dir)), missing=8, median_cv=7)
)


def _shared_entries() -> str:
    """Measured entries with run, label and anchor protein, as SQL."""
    from abundera.queries.relational import _CA, _LABEL_KEY

    rk = B.SQL_RUN_KEY
    return f"""l0 AS (SELECT run_file_name AS run, anchor_protein, imputed_labels, intensities, unnest(intensities, max_depth := 1) AS e FROM feature),
labelled AS (SELECT {rk.format('run')} AS run_key, {_CA('anchor_protein')} AS protein,
  CASE WHEN len(intensities) = 1 AND coalesce({rk.format('e.label')} = {rk.format('run')} OR {_LABEL_KEY.format('e.label')} = 'label free sample', false) THEN 'label free sample' ELSE {_LABEL_KEY.format('e.label')} END AS label_key,
  CAST(e.intensity AS DOUBLE) AS intensity FROM l0 WHERE e IS NOT NULL AND isfinite(e.intensity) AND e.intensity > 0 AND NOT coalesce(list_contains(imputed_labels, e.label), false))"""
