"""Row predicates and group-level filters over the long form.

Row predicates are Column expressions or ``DataFrame -> DataFrame`` steps; they
are composed, never formatted into SQL text.  A group filter is an aggregate of
the group's keys and a semi join back: the aggregate combines before it is
shuffled, so a group of any size is no single task's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions import keys as K
from abundera.functions.values import is_measured

Step = Callable[[DataFrame], DataFrame]

# ---- row predicates (PRD) --------------------------------------------------------------------------------------------


def measured_at_least(floor: float = 0.0, col: str = "intensity") -> Column:
    """Finite, above 0, and at least ``floor``."""
    return is_measured(col) & (F.col(col) >= floor)


def length_between(low: int, high: int = 10_000, col: str = "peptide") -> Column:
    return F.coalesce(F.length(K.canonical_peptide(col)).between(low, high), F.lit(False))


def charge_in(charges: Sequence[int], col: str = "charge") -> Column:
    return F.coalesce(F.col(col).isin(*charges), F.lit(False))


def missed_cleavages_at_most(n: int, col: str = "peptide") -> Column:
    return F.coalesce(K.missed_cleavages(col) <= n, F.lit(False))


def sequence_without(patterns: Sequence[str], col: str = "peptide") -> Column:
    """No pattern occurs in the sequence."""
    out = F.lit(True)
    for p in patterns:
        out = out & ~F.coalesce(F.col(col).rlike(p), F.lit(False))
    return out


def score_passes(name: str, threshold: float, scores: str = "additional_scores") -> Column:
    """A score of this name passes in the direction its entry states."""
    good = lambda s: F.when(s["higher_better"], s["score_value"] >= threshold).otherwise(s["score_value"] <= threshold)
    return F.coalesce(F.exists(scores, lambda s: (s["score_name"] == name) & F.coalesce(good(s), F.lit(False))), F.lit(False))


def without_modifications(names: Sequence[str], modifications: str = "modifications", peptidoform: str | None = "peptidoform") -> Column:
    """No modification of these names or accessions (any case), in the list or in brackets of the peptidoform."""
    low = [n.lower() for n in names]
    listed = F.coalesce(F.exists(modifications, lambda m: F.lower(m["name"]).isin(*low) | F.lower(m["accession"]).isin(*low)), F.lit(False))
    if peptidoform is None:
        return ~listed
    inside = F.lit(False)
    for n in low:
        inside = inside | F.coalesce(F.contains(F.lower(F.col(peptidoform)), F.lit(f"[{n}]")), F.lit(False))
    return ~(listed | inside)


def qvalue_at_most(df: DataFrame, threshold: float, col: str = "peptide_qvalue") -> DataFrame:
    """Rows with q-value up to the threshold; a column without any value is an error, not an empty result."""
    if df.where(F.col(col).isNotNull()).limit(1).count() == 0:
        raise ValueError(f"{col} holds no value: a q-value filter would drop everything")
    return df.where(F.col(col) <= threshold)


def without_contaminants(features: DataFrame, accessions: str = "accessions", is_decoy: str | None = "is_decoy") -> DataFrame:
    """Decoys and pure contaminant groups dropped, contaminant members stripped from mixed groups."""
    ok = ~F.coalesce(K.drops_group(accessions), F.lit(False)) & (F.size(accessions) > 0)
    if is_decoy:
        ok = ok & ~F.coalesce(F.col(is_decoy).cast("boolean"), F.lit(False))
    return features.where(ok).withColumn(accessions, K.strip_contaminants(accessions))


def rename_contaminant_twins(df: DataFrame, mark: str = "CONTAM_", protein: str = "protein", peptide: str = "peptide") -> DataFrame:
    """``CONTAM_X`` becomes ``X`` where X itself covers every peptide of CONTAM_X."""
    pairs = df.select(protein, peptide).distinct()
    marked = pairs.where(F.col(protein).startswith(mark)).withColumn("_twin", F.substring(F.col(protein), len(mark) + 1, 1000))
    covered = pairs.select(F.col(protein).alias("_twin"), peptide, F.lit(1).alias("_hit"))
    twins = marked.join(covered, ["_twin", peptide], "left").groupBy(protein, "_twin").agg(F.min(F.coalesce("_hit", F.lit(0))).alias("_all")).where("_all = 1").select(protein, "_twin")
    return df.join(twins, protein, "left").withColumn(protein, F.coalesce("_twin", protein)).drop("_twin")


def without_ids(df: DataFrame, ids: DataFrame, protein: str = "protein") -> DataFrame:
    """Rows whose group holds none of the accessions in ``ids`` (column ``accession``), by exact match."""
    members = df.select(protein).distinct().withColumn("accession", F.explode(F.split(protein, ";")))
    hit = members.join(ids.select("accession").distinct(), "accession", "left_semi").select(protein).distinct()
    return df.join(hit, protein, "left_anti")


def usable_rows(df: DataFrame) -> DataFrame:
    """Rows with run, group and a condition other than ``Empty``."""
    return df.where(F.col("run").isNotNull() & F.col("protein").isNotNull() & (F.coalesce("condition", F.lit("")) != "Empty"))


def subset(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key stands in ``keys`` (samples or proteins), as a semi join."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


# ---- group filters (GRP, JN7, JN8) ------------------------------------------------------------------------------------


def keep_groups(df: DataFrame, by: Sequence[str], having: Column, **aggs: Column) -> DataFrame:
    """Rows of the groups that satisfy ``having``, an expression over the named aggregates."""
    passed = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()]).where(having).select(*by)
    return df.join(passed, list(by), "left_semi")


def min_unique(df: DataFrame, n: int = 2, by: Sequence[str] = ("protein", "sample"), item: str = "peptide") -> DataFrame:
    """Groups with at least ``n`` distinct items."""
    return keep_groups(df, by, F.col("_n") >= n, _n=F.count_distinct(item)) if n > 0 else df


def distinct_count_over(df: DataFrame, by: Sequence[str], item: str, name: str) -> DataFrame:
    """``count(distinct item) over (partition by ...)`` as aggregate and join."""
    return df.join(df.groupBy(*by).agg(F.count_distinct(item).alias(name)), list(by))


def protein_fdr(df: DataFrame, threshold: float, protein: str = "protein", qvalue: str = "protein_qvalue") -> DataFrame:
    return keep_groups(df, [protein], F.col("_q") <= threshold, _q=F.min(qvalue))


def razor(df: DataFrame, mode: str = "keep") -> DataFrame:
    """Peptides of several proteins: kept, removed, or given to the protein with most distinct peptides (ties: smallest name)."""
    if mode == "keep":
        return df
    if mode == "remove":
        return keep_groups(df, ["peptide"], F.col("_n") == 1, _n=F.count_distinct("protein"))
    if mode != "assign_to_top":
        raise ValueError(f"unknown razor mode {mode!r}")
    sizes = df.groupBy("protein").agg(F.count_distinct("peptide").alias("_n"))
    owner = df.select("peptide", "protein").distinct().join(sizes, "protein").groupBy("peptide").agg(F.min_by("protein", F.struct((-F.col("_n")).alias("n"), "protein")).alias("protein"))
    return df.join(owner, ["peptide", "protein"], "left_semi")


def cv_at_most(df: DataFrame, threshold: float, by: Sequence[str] = ("sample", "protein", "peptide")) -> DataFrame:
    """Groups whose sd/mean is at most the threshold; one value or a mean not above 0 passes."""
    cv = F.try_divide(F.stddev_samp("intensity"), F.avg("intensity"))
    return keep_groups(df, by, F.col("_cv").isNull() | (F.col("_mean") <= 0) | (F.col("_cv") <= threshold), _cv=cv, _mean=F.avg("intensity"))


def replicate_agreement(df: DataFrame, n: int) -> DataFrame:
    """(condition, protein, peptide) seen in at least ``n`` technical replicates."""
    return keep_groups(df, ["condition", "protein", "peptide"], F.col("_n") >= n, _n=F.count_distinct("techrep"))


def quantile_clip(df: DataFrame, low: float, high: float, by: str = "sample") -> DataFrame:
    """Rows between two quantiles of their sample (linear interpolation, bounds included)."""
    bounds = df.groupBy(by).agg(F.percentile("intensity", [low, high]).alias("_q"))
    return df.join(bounds, by).where((F.col("intensity") >= F.col("_q")[0]) & (F.col("intensity") <= F.col("_q")[1])).drop("_q")


def run_total_at_least(df: DataFrame, floor: float) -> DataFrame:
    return keep_groups(df, ["run"], F.col("_s") >= floor, _s=F.sum("intensity"))


def run_min_features(df: DataFrame, features: int = 0, proteins: int = 0) -> DataFrame:
    return keep_groups(df, ["run"], (F.col("_f") >= features) & (F.col("_p") >= proteins), _f=F.count_distinct("protein", "peptide"), _p=F.count_distinct("protein"))


def run_missing_rate(df: DataFrame) -> DataFrame:
    """``(sample, run, missing_rate)``: 1 - detected / distinct (protein, peptide) of all the sample's runs."""
    universe = df.groupBy("sample").agg(F.count_distinct("protein", "peptide").alias("_u"))
    seen = df.groupBy("sample", "run").agg(F.count_distinct("protein", "peptide").alias("_d"))
    return seen.join(universe, "sample").select("sample", "run", (F.lit(1.0) - F.col("_d") / F.col("_u")).alias("missing_rate"))


def run_missing_at_most(df: DataFrame, rate: float) -> DataFrame:
    return df.join(run_missing_rate(df).where(F.col("missing_rate") <= rate), ["sample", "run"], "left_semi")


def frequent_items(df: DataFrame, share: float = 0.2) -> DataFrame:
    """(protein, peptide) seen in at least a share of all samples; with one sample nothing is dropped."""
    total = df.agg(F.count_distinct("sample").alias("_t")).scalar()
    rare = df.groupBy("protein", "peptide").agg(F.count_distinct("sample").alias("_n")).where((total > 1) & (F.col("_n") < share * total))
    return df.join(rare, ["protein", "peptide"], "left_anti")


def coverage(long: DataFrame, samples: DataFrame, threshold: float, exclude: Sequence[str] = (), entity: str = "protein") -> DataFrame:
    """Entities measured in at least a share of the samples of every condition.

    ``samples`` is ``(sample, condition)``; conditions in ``exclude`` do not
    count.  A condition without any cell of the entity counts as 0, which shows
    as fewer conditions than there are.
    """
    used = samples.where(~F.col("condition").isin(*exclude)) if exclude else samples
    sizes = used.groupBy("condition").agg(F.count_distinct("sample").alias("_size"))
    n = sizes.agg(F.count(F.lit(1)).alias("_c")).scalar()
    cells = long.where(F.col("value").isNotNull() & (F.col("value") != 0)).join(used, "sample").groupBy(entity, "condition").agg(F.count_distinct("sample").alias("_n"))
    shares = cells.join(sizes, "condition").groupBy(entity).agg(F.min(F.col("_n") / F.col("_size")).alias("_min"), F.count(F.lit(1)).alias("_k"))
    passed = shares.where(((F.col("_k") == n) | (F.lit(threshold) <= 0)) & (F.col("_min") >= threshold))
    return long.join(passed, entity, "left_semi")


def sample_correlations(long: DataFrame, samples: DataFrame, entity: str = "protein", min_overlap: int = 3) -> DataFrame:
    """``(sample, condition, mean_correlation)``: mean Pearson correlation (log2, common entities) with the condition's other samples.

    The correlation of equal values is NaN, as in SQL, and so is a mean with it.
    """
    v = long.where(is_measured("value")).join(samples, "sample").select(entity, "sample", "condition", F.log2("value").alias("v"))
    a, b = v.alias("a"), v.alias("b")
    pairs = a.join(b, [F.col(f"a.{entity}") == F.col(f"b.{entity}"), F.col("a.condition").eqNullSafe(F.col("b.condition")), F.col("a.sample") != F.col("b.sample")])
    by_pair = pairs.groupBy(F.col("a.sample").alias("sample"), F.col("a.condition").alias("condition"), F.col("b.sample").alias("other")).agg(F.covar_pop("a.v", "b.v").alias("c"), (F.stddev_pop("a.v") * F.stddev_pop("b.v")).alias("s"), F.count(F.lit(1)).alias("n"))
    by_pair = by_pair.withColumn("r", F.when(F.col("s") > 0, F.try_divide("c", "s")).otherwise(F.lit(float("nan"))))
    return by_pair.where(F.col("n") >= min_overlap).groupBy("sample", "condition").agg(F.avg("r").alias("mean_correlation"))


def sample_min_entities(long: DataFrame, n: int, entity: str = "protein") -> DataFrame:
    return keep_groups(long, ["sample"], F.col("_n") >= n, _n=F.count_distinct(entity))


def sample_missing_at_most(long: DataFrame, share: float, entity: str = "protein") -> DataFrame:
    """Samples that lack at most a share of all entities."""
    universe = long.agg(F.count_distinct(entity).alias("_u")).scalar()
    passed = long.groupBy("sample").agg(F.count_distinct(entity).alias("_n")).where(1 - F.col("_n") / universe <= share)
    return long.join(passed, "sample", "left_semi")


def common_conditions(samples: DataFrame, n: int) -> DataFrame:
    """Samples of conditions (tissues) with at least ``n`` samples."""
    return keep_groups(samples, ["condition"], F.col("_n") >= n, _n=F.count_distinct("sample"))


def testable(long: DataFrame, samples: DataFrame, a: str, b: str, n: int = 2, entity: str = "protein") -> DataFrame:
    """Entities with at least ``n`` values in both groups."""
    v = long.where(F.col("value").isNotNull()).join(samples.where(F.col("condition").isin(a, b)), "sample")
    ok = v.groupBy(entity).agg(F.count(F.when(F.col("condition") == a, 1)).alias("_a"), F.count(F.when(F.col("condition") == b, 1)).alias("_b")).where((F.col("_a") >= n) & (F.col("_b") >= n))
    return long.join(ok, entity, "left_semi")


# ---- the filter pipeline (PRD20) --------------------------------------------------------------------------------------


@dataclass
class FilterPipeline:
    """Named steps in fixed order: intensity, peptide, protein, run; with counts before and after each."""

    steps: list[tuple[str, str, Step]] = field(default_factory=list)
    ORDER = ("intensity", "peptide", "protein", "run")

    def add(self, stage: str, name: str, step: Step) -> "FilterPipeline":
        if stage not in self.ORDER:
            raise ValueError(f"unknown stage {stage!r}")
        self.steps.append((stage, name, step))
        return self

    def ordered(self) -> list[tuple[str, str, Step]]:
        return sorted(self.steps, key=lambda s: self.ORDER.index(s[0]))

    def apply(self, df: DataFrame) -> DataFrame:
        for _, _, step in self.ordered():
            df = df.transform(step)
        return df

    def summary(self, df: DataFrame) -> DataFrame:
        """``(step, name, rows)`` after each step, step 0 being the input; one lazy union, counted in parallel."""
        parts, at = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(0).alias("step"), F.lit("input").alias("name"), "rows")], df
        for i, (_, name, step) in enumerate(self.ordered(), 1):
            at = at.transform(step)
            parts.append(at.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "rows"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def pipeline_from_config(config: dict) -> FilterPipeline:
    """A pipeline from a filter configuration (sections intensity, peptide, protein, run_qc)."""
    p, get = FilterPipeline(), lambda s, k: (config.get(s) or {}).get(k)
    known = {"intensity": {"min_intensity", "cv_threshold", "quantile", "replicate_agreement"}, "peptide": {"min_length", "max_length", "charges", "max_missed_cleavages", "exclude_patterns"}, "protein": {"min_unique", "razor", "fdr"}, "run_qc": {"min_total", "min_features", "min_proteins", "max_missing_rate"}}
    for section, content in config.items():
        odd = set(content or {}) - known.get(section, set())
        if section not in known or odd:
            raise ValueError(f"unknown filter options {section}: {sorted(odd)}")
    if get("intensity", "min_intensity") is not None:
        p.add("intensity", "min_intensity", lambda d, f=float(get("intensity", "min_intensity")): d.where(measured_at_least(f)))
    if get("intensity", "cv_threshold") is not None:
        p.add("intensity", "cv_threshold", lambda d, t=float(get("intensity", "cv_threshold")): cv_at_most(d, t))
    if get("intensity", "replicate_agreement"):
        p.add("intensity", "replicate_agreement", lambda d, n=int(get("intensity", "replicate_agreement")): replicate_agreement(d, n))
    if get("intensity", "quantile"):
        p.add("intensity", "quantile", lambda d, q=get("intensity", "quantile"): quantile_clip(d, float(q[0]), float(q[1])))
    if get("peptide", "min_length") or get("peptide", "max_length"):
        p.add("peptide", "length", lambda d, a=int(get("peptide", "min_length") or 0), b=int(get("peptide", "max_length") or 10_000): d.where(length_between(a, b)))
    if get("peptide", "charges"):
        p.add("peptide", "charges", lambda d, c=tuple(get("peptide", "charges")): d.where(charge_in(c)))
    if get("peptide", "max_missed_cleavages") is not None:
        p.add("peptide", "missed_cleavages", lambda d, n=int(get("peptide", "max_missed_cleavages")): d.where(missed_cleavages_at_most(n)))
    if get("peptide", "exclude_patterns"):
        p.add("peptide", "patterns", lambda d, x=tuple(get("peptide", "exclude_patterns")): d.where(sequence_without(x)))
    if get("protein", "min_unique"):
        p.add("protein", "min_unique", lambda d, n=int(get("protein", "min_unique")): min_unique(d, n))
    if get("protein", "fdr") is not None:
        p.add("protein", "fdr", lambda d, t=float(get("protein", "fdr")): protein_fdr(d, t))
    if get("protein", "razor"):
        p.add("protein", "razor", lambda d, m=get("protein", "razor"): razor(d, m))
    if get("run_qc", "min_total") is not None:
        p.add("run", "min_total", lambda d, t=float(get("run_qc", "min_total")): run_total_at_least(d, t))
    if get("run_qc", "min_features") or get("run_qc", "min_proteins"):
        p.add("run", "min_features", lambda d, f=int(get("run_qc", "min_features") or 0), n=int(get("run_qc", "min_proteins") or 0): run_min_features(d, f, n))
    if get("run_qc", "max_missing_rate") is not None:
        p.add("run", "missing_rate", lambda d, r=float(get("run_qc", "max_missing_rate")): run_missing_at_most(d, r))
    return p


def window_distinct(by: Sequence[str], item: str) -> Column:
    """Distinct items of a partition as a window expression, for groups known to be small."""
    return F.size(F.collect_set(item).over(W.partitionBy(*by)))
