"""Declarative pipelines: a validated configuration becomes one lazy plan from ions to protein tables and tests."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundera.operators import batch, de, filters, lfq, normalize, pibaq, rollup
from abundera.plans.registry import REGISTRY, parse_quant, quantifier
from abundera.schema import require


PIBAQ_MODES = ("proportional", "unique", "stable-ratio")


@dataclass(frozen=True)
class PipelineConfig:
    """Options of features-to-proteins; unknown names and impossible combinations fail when it is made."""

    quant: str = "sum"
    pibaq_mode: str = "proportional"
    directlfq_shifts: bool = False
    run_normalization: str = "none"
    sample_normalization: str | None = None
    min_intensity: float = 0.0
    min_length: int = 0
    min_unique: int = 2
    filters: dict = field(default_factory=dict)
    irs: bool = False
    irs_stat: str = "median"
    irs_missing: str = "keep"
    coverage: float = 0.0
    coverage_exclude: tuple[str, ...] = ()
    min_correlation: float | None = None
    imputation: str | None = None
    batch_correction: bool = False
    contrasts: tuple[tuple[str, str], ...] = ()
    de_method: str = "auto"
    fdr: float = 0.05
    log2fc: float = 0.0

    def __post_init__(self) -> None:
        method, _ = parse_quant(self.quant)
        quantifier(self.quant)
        REGISTRY.get("normalization.run", self.run_normalization)
        if self.sample_normalization is not None:
            REGISTRY.get("normalization.sample", self.sample_normalization)
            if method == "ratio" and self.sample_normalization != "none":
                raise ValueError("ratios are relative already: they take no sample normalisation")
        if self.imputation:
            REGISTRY.get("imputation", self.imputation)
        if not 0 <= self.coverage <= 1:
            raise ValueError("coverage is a share between 0 and 1")
        if self.min_unique < 0 or self.min_length < 0:
            raise ValueError("counts are not negative")
        if self.irs and method == "ratio":
            raise ValueError("ratios are scaled to the reference already: irs does not apply")
        if self.pibaq_mode not in PIBAQ_MODES:
            raise ValueError(f"unknown way to share signal {self.pibaq_mode!r}; known are {', '.join(PIBAQ_MODES)}")
        if self.directlfq_shifts and method != "directlfq":
            raise ValueError("sample shifts of ions belong to directlfq")
        if method == "spectral_count" and self.sample_normalization not in (None, "none"):
            raise ValueError("counts take no sample normalisation")
        if self.irs_missing not in ("keep", "drop", "plex_median"):
            raise ValueError(f"unknown irs policy {self.irs_missing!r}")
        if self.de_method not in ("auto", "limma", "deqms", "rots", "limrots", "proda"):
            raise ValueError(f"unknown test {self.de_method!r}")
        filters.pipeline_from_config(self.filters)

    @classmethod
    def from_dict(cls, options: dict) -> "PipelineConfig":
        odd = set(options) - {f.name for f in fields(cls)}
        if odd:
            raise ValueError(f"unknown options {sorted(odd)}")
        return cls(**{k: tuple(map(tuple, v)) if k == "contrasts" else tuple(v) if k == "coverage_exclude" else v for k, v in options.items()})

    @property
    def normalization(self) -> str:
        return self.sample_normalization or normalize.default_method(parse_quant(self.quant)[0])


def features_to_peptides(ions: DataFrame, config: PipelineConfig) -> DataFrame:
    """Filtered, run-normalised ions as peptide rows (sample medians equalised where the method asks for it)."""
    return gated_peptides(ions, config)


def gated_peptides(ions: DataFrame, config: PipelineConfig) -> DataFrame:
    """Peptide rows of the cells that pass the unique gate.

    A cell has the same distinct peptides before and after the roll-up, so the
    gate counts the rolled-up rows: the scan and its shuffle are shared, and the
    count runs over far fewer rows.
    """
    return filters.min_unique(rollup.peptides_from_ions(clean_ions(ions, config, gate=False)), config.min_unique)


def clean_ions(ions: DataFrame, config: PipelineConfig, gate: bool = True) -> DataFrame:
    """Ions after predicates, the filter pipeline, run normalisation, factor-based sample normalisation and the unique gate."""
    rows = filters.usable_rows(require(ions, "ions")).where(filters.measured_at_least(config.min_intensity))
    if config.min_length:
        rows = rows.where(filters.length_between(config.min_length))
    rows = filters.pipeline_from_config(config.filters).apply(rows)
    rows = REGISTRY.get("normalization.run", config.run_normalization)(rows)
    if config.normalization == "global-median":
        rows = normalize.scale_samples(rows, normalize.global_median_factors(rows))
    return filters.min_unique(rows, config.min_unique) if gate else rows


def peptides_to_proteins(rows: DataFrame, config: PipelineConfig, level: str = "peptides") -> DataFrame:
    """The protein level of already clean rows."""
    fn, _ = quantifier(config.quant)
    return fn(rows)


def group_edges(ions: DataFrame) -> DataFrame:
    """``(accession, peptide)`` of the protein groups themselves, where no digest is given."""
    return ions.select(F.explode(F.split("protein", ";")).alias("accession"), "peptide").where("accession <> '' AND peptide IS NOT NULL").distinct()


def pibaq_values(ions: DataFrame, config: PipelineConfig, edges: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """``(protein, sample, value, ...)``: signal shared within families over theoretical peptides, in the configured way.

    ``unique`` gives families without unique evidence one row under the family's
    name; the two others come with evidence level, family and denominator.
    """
    e = group_edges(ions) if edges is None else edges.select("accession", "peptide").distinct()
    observed = ions.select("peptide", "sample", "intensity").where("peptide IS NOT NULL")
    fam = pibaq.families(e, overrides=overrides)
    if config.pibaq_mode == "unique":
        return pibaq.unique_mode(observed, e, fam).withColumnRenamed("accession", "protein")
    shared = pibaq.allocate(observed, e, fam) if config.pibaq_mode == "proportional" else pibaq.stable_ratio(observed, e, fam)
    out = pibaq.per_theoretical(shared, e, fam, observed)
    return out.select(F.col("accession").alias("protein"), "sample", F.col("pibaq").alias("value"), "evidence", "family", "family_size", "denominator")


def spectral_counts(psms: DataFrame, groups: DataFrame, config: PipelineConfig) -> DataFrame:
    """``(protein, sample, value)``: distinct PSMs of each protein group and run; a repeated PSM id is an error."""
    if rollup.repeated_ids(psms).limit(1).count():
        raise ValueError("a PSM id stands in more than one row")
    named = psms.withColumnRenamed("run_file_name", "sample")
    return rollup.spectral_count(named, groups, ("protein", "sample"), config.min_unique)


def features_to_proteins(ions: DataFrame, config: PipelineConfig, design: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """``(protein, sample, value)`` after the fixed order: roll-up, normalisation, reference scaling, correlation, coverage, imputation, batches.

    ``design`` is ``(sample, condition[, plex, is_reference, batch])``, needed by
    the steps that compare samples; ``edges`` is a digest (``accession,
    peptide``) for piBAQ, the protein groups stand in for it.
    """
    fn, level = quantifier(config.quant)
    method = parse_quant(config.quant)[0]
    if method == "spectral_count":
        raise ValueError("spectral counts come from PSMs: use spectral_counts")
    if method == "pibaq":
        out = pibaq_values(clean_ions(ions, config, gate=False), config, edges).select("protein", "sample", "value")
    elif config.directlfq_shifts:
        rows = clean_ions(ions, config)
        cells = lfq.species_cells(rows).select(F.concat_ws("|", "protein", "peptidoform", "charge").alias("protein"), "sample", F.col("intensity").alias("value"))
        out = lfq.directlfq(rows, shifts=normalize.hierarchical_shifts(cells))
    else:
        out = fn(clean_ions(ions, config) if level == "ions" else gated_peptides(ions, config))
    if config.normalization not in ("none", "global-median"):
        out = REGISTRY.get("normalization.sample", config.normalization)(out)
    need = config.irs or config.coverage or config.min_correlation is not None or config.batch_correction
    if need and design is None:
        raise ValueError("these options need a design of the samples")
    if config.irs:
        out = normalize.irs(out, design.select("sample", "plex", "is_reference"), config.irs_stat, config.irs_missing)
    if config.min_correlation is not None:
        ok = filters.sample_correlations(out, design.select("sample", "condition")).where((F.col("mean_correlation") >= config.min_correlation) & ~F.isnan("mean_correlation"))
        out = filters.subset(out, ok, "sample")
    if config.coverage:
        out = filters.coverage(out, design.select("sample", "condition"), config.coverage, config.coverage_exclude)
    if config.imputation:
        out = REGISTRY.get("imputation", config.imputation)(out)
    if config.batch_correction:
        logs = out.select("protein", "sample", F.log2("value").alias("value"))
        out = batch.combat_long(logs, design.select("sample", "batch")).withColumn("value", F.pow(F.lit(2.0), "value"))
    return out


def differential_expression(proteins: DataFrame, design: DataFrame, config: PipelineConfig, counts: DataFrame | None = None) -> DataFrame:
    """Tests of every contrast under one another, classified by the configured levels."""
    method = config.de_method
    if method == "auto":
        method = de.auto_method(parse_quant(config.quant)[0], complete=bool(config.imputation))
        if method == "deqms" and counts is None:
            method = "limma"
    out = None
    for a, b in config.contrasts:
        one = de.differential(proteins, design.select("sample", "condition"), a, b, method, counts)
        one = one.select("contrast", "protein", "log2FC", "pvalue", "adj_pvalue", de.fdr.significance("adj_pvalue", "log2FC", config.fdr, config.log2fc).alias("significance"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no contrast is configured")
    return out


def config_schema() -> list[dict]:
    """Options with types and defaults, for tools that build configurations."""
    c = PipelineConfig()
    return [{"name": f.name, "type": str(f.type), "default": getattr(c, f.name)} for f in fields(PipelineConfig)]
