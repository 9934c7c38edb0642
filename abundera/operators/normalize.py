"""Normalisation: of runs within a sample, of samples against each other, to reference channels; isobaric row corrections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions.special import huber_line, lowess
from abundera.functions.values import is_measured, log2_positive

# ---- runs (NRM1-NRM4) -------------------------------------------------------------------------------------------------


def run_metric(method: str, iqr_mode: str = "difference", col: str = "intensity") -> Column:
    """Aggregate that stands for a run: median, mean, max, global (sum) or iqr (difference or midpoint of the quartiles)."""
    q = F.percentile(col, [0.25, 0.75])
    table = {
        "median": lambda: F.median(col), "mean": lambda: F.avg(col), "max": lambda: F.max(col), "global": lambda: F.sum(col),
        "iqr": lambda: q[1] - q[0] if iqr_mode == "difference" else (q[0] + q[1]) / 2,
    }
    if method not in table:
        raise ValueError(f"unknown run method {method!r}; known are {', '.join(table)}")
    return table[method]()


def run_factors(ions: DataFrame, method: str = "median", iqr_mode: str = "difference") -> DataFrame:
    """``(sample, run, factor)``: mean metric of the sample's runs over the run's own; 1 for samples with one run."""
    per_run = ions.groupBy("sample", "run").agg(run_metric(method, iqr_mode).alias("_m"))
    per_sample = per_run.groupBy("sample").agg(F.avg("_m").alias("_a"), F.count(F.lit(1)).alias("_n"))
    factor = F.when(F.col("_n") > 1, F.coalesce(F.try_divide(F.col("_a"), F.col("_m")), F.lit(1.0))).otherwise(F.lit(1.0))
    return per_run.join(per_sample, "sample").select("sample", "run", factor.alias("factor"))


def scale_runs(ions: DataFrame, factors: DataFrame) -> DataFrame:
    """Intensities times their run's factor; runs without one stay."""
    return ions.join(factors, ["sample", "run"], "left").withColumn("intensity", F.col("intensity") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def run_max_min(ions: DataFrame) -> DataFrame:
    """Affine map of each run's range onto the mean range of its sample's runs; runs without a range stay."""
    r = ions.groupBy("sample", "run").agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
    s = r.groupBy("sample").agg(F.avg("_lo").alias("_slo"), F.avg("_hi").alias("_shi"), F.count(F.lit(1)).alias("_n"))
    out = ions.join(r.join(s, "sample"), ["sample", "run"])
    moved = (F.col("intensity") - F.col("_lo")) * (F.col("_shi") - F.col("_slo")) / (F.col("_hi") - F.col("_lo")) + F.col("_slo")
    return out.withColumn("intensity", F.when((F.col("_n") > 1) & (F.col("_hi") > F.col("_lo")), moved).otherwise(F.col("intensity"))).drop("_lo", "_hi", "_slo", "_shi", "_n")


# ---- samples (NRM5-NRM15) ---------------------------------------------------------------------------------------------


def global_median_factors(rows: DataFrame, col: str = "intensity", proteins: DataFrame | None = None) -> DataFrame:
    """``(sample, factor)``: median of the sample medians over the sample's own; a protein subset counts for the factor only."""
    used = rows if proteins is None else rows.join(proteins.select("protein").distinct(), "protein", "left_semi")
    per = used.groupBy("sample").agg(F.median(col).alias("_m"))
    centre = per.agg(F.median("_m").alias("c")).scalar()
    return per.select("sample", F.try_divide(centre, F.col("_m")).alias("factor"))


def condition_median_factors(rows: DataFrame, samples: DataFrame, col: str = "intensity") -> DataFrame:
    """``(sample, factor)``: mean of the condition's sample medians over the sample's own."""
    per = rows.groupBy("sample").agg(F.median(col).alias("_m")).join(samples, "sample")
    centre = per.groupBy("condition").agg(F.avg("_m").alias("_c"))
    return per.join(centre, "condition").select("sample", F.try_divide(F.col("_c"), F.col("_m")).alias("factor"))


def scale_samples(rows: DataFrame, factors: DataFrame, col: str = "intensity") -> DataFrame:
    return rows.join(factors, "sample", "left").withColumn(col, F.col(col) * F.coalesce("factor", F.lit(1.0))).drop("factor")


def center(long: DataFrame, how: str = "median") -> DataFrame:
    """log2 value minus the sample's median or mean, back to linear."""
    v = long.withColumn("_l", log2_positive("value"))
    agg = {"median": F.median, "mean": F.avg}[how]
    c = v.groupBy("sample").agg(agg("_l").alias("_c"))
    return v.join(c, "sample").withColumn("value", F.pow(F.lit(2.0), F.col("_l") - F.col("_c"))).drop("_l", "_c")


def total_intensity(long: DataFrame) -> DataFrame:
    """Values over their sample's total, times the mean total."""
    t = long.groupBy("sample").agg(F.sum("value").alias("_t"))
    mean = t.agg(F.avg("_t").alias("m")).scalar()
    return long.join(t.select("sample", "_t", mean.alias("_m")), "sample").withColumn("value", F.col("value") * F.col("_m") / F.col("_t")).drop("_t", "_m")


def quantile_normalize(long: DataFrame, grid: int = 1001, entity: str = "protein") -> DataFrame:
    """Quantile normalisation on log2 values; missing cells stay missing.

    Every sample's quantile function is read on one uniform grid (an exact
    percentile aggregate, so only ``grid`` numbers a sample are kept), the mean
    function is the reference, and each value maps through it by its average-rank
    fraction.  No sample is gathered in one row.
    """
    v = long.where(is_measured("value")).select(entity, "sample", F.log2("value").alias("_l"))
    points = [i / (grid - 1) for i in range(grid)]
    curves = v.groupBy("sample").agg(F.percentile("_l", points).alias("_q")).select(F.posexplode("_q").alias("_i", "_v"))
    ref = curves.groupBy("_i").agg(F.avg("_v").alias("_v")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda s: s["_v"]).alias("r"))  # grid numbers
    counts = v.groupBy("sample", "_l").agg(F.count(F.lit(1)).alias("_n"))
    up = W.partitionBy("sample").orderBy("_l")
    ranked = counts.withColumns({"_b": F.coalesce(F.sum("_n").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), "_m": F.sum("_n").over(W.partitionBy("sample"))})
    share = F.when(F.col("_m") > 1, (F.col("_b") + (F.col("_n") - 1) / 2.0) / (F.col("_m") - 1)).otherwise(F.lit(0.5))
    at = F.col("_f") * (grid - 1)
    mapped = ranked.withColumn("_f", share).withColumn("_r", ref.scalar()).withColumn("_k", F.least(F.floor(at).cast("int"), F.lit(grid - 2)))
    new = F.col("_r")[F.col("_k")] + (at - F.col("_k")) * (F.col("_r")[F.col("_k") + 1] - F.col("_r")[F.col("_k")])
    return v.join(mapped.select("sample", "_l", F.pow(F.lit(2.0), new).alias("value")), ["sample", "_l"]).select(entity, "sample", "value")


def _against_reference(long: DataFrame, entity: str) -> DataFrame:
    """log2 values beside the entity's median over the samples."""
    v = long.where(is_measured("value")).select(entity, "sample", F.log2("value").alias("y"))
    ref = v.groupBy(entity).agg(F.median("y").alias("x"))
    return v.join(ref, entity)


def robust_regression(long: DataFrame, entity: str = "protein") -> DataFrame:
    """Per sample Huber line y = a + b * reference; values become (y - a) / b.  A sample has at most as many rows as there are entities."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(entity)
        a, b = huber_line(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({entity: pdf[entity], "sample": pdf["sample"], "value": 2.0 ** ((pdf["y"] - a) / b)})

    return _against_reference(long, entity).groupBy("sample").applyInPandas(fit, f"`{entity}` string, sample string, value double")


def loess_normalize(long: DataFrame, entity: str = "protein", span: float = 0.7) -> DataFrame:
    """Per sample LOWESS of M = y - ref on A = (y + ref) / 2, subtracted; fewer than ten points stay."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(entity)
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        new = y - lowess((x + y) / 2, y - x, span) if len(y) >= 10 else y
        return pd.DataFrame({entity: pdf[entity], "sample": pdf["sample"], "value": 2.0**new})

    return _against_reference(long, entity).groupBy("sample").applyInPandas(fit, f"`{entity}` string, sample string, value double")


def tmm_factors(long: DataFrame, trim_m: float = 0.3, trim_a: float = 0.05, entity: str = "protein") -> DataFrame:
    """``(sample, factor)``: weighted trimmed mean of M against a reference sample, geometric mean 1.

    Reference: the sample whose upper quartile (over the library size) is
    closest to the mean; ties to the smallest name.  Ranks trim M and A as in
    the published method; relational from end to end.
    """
    v = long.where(is_measured("value")).select(entity, "sample", "value")
    lib = v.groupBy("sample").agg(F.sum("value").alias("_n"), F.percentile("value", 0.75).alias("_u")).withColumn("_f", F.col("_u") / F.col("_n"))
    mean = lib.agg(F.avg("_f").alias("m")).scalar()
    ref = lib.select("sample", "_n", F.abs(F.col("_f") - mean).alias("_d")).agg(F.min_by(F.struct("sample", "_n"), F.struct("_d", "sample")).alias("r")).select("r.*")
    obs = v.join(lib.select("sample", "_n"), "sample")
    base = v.join(F.broadcast(ref), "sample").select(entity, F.col("value").alias("_rv"), F.col("_n").alias("_rn"))
    m = obs.join(base, entity).withColumns({"_p": F.col("value") / F.col("_n"), "_q": F.col("_rv") / F.col("_rn")})
    m = m.withColumns({"_M": F.log2(F.col("_p") / F.col("_q")), "_A": F.log2(F.col("_p") * F.col("_q")) / 2, "_w": (F.col("_n") - F.col("value")) / F.col("_n") / F.col("value") + (F.col("_rn") - F.col("_rv")) / F.col("_rn") / F.col("_rv")})
    by = W.partitionBy("sample")
    ranked = m.withColumns({"_rm": F.rank().over(by.orderBy("_M")), "_ra": F.rank().over(by.orderBy("_A")), "_c": F.count(F.lit(1)).over(by)})
    lo_m, lo_a = F.floor(F.col("_c") * trim_m) + 1, F.floor(F.col("_c") * trim_a) + 1
    kept = ranked.where((F.col("_rm") >= lo_m) & (F.col("_rm") <= F.col("_c") + 1 - lo_m) & (F.col("_ra") >= lo_a) & (F.col("_ra") <= F.col("_c") + 1 - lo_a) & (F.col("_w") > 0))
    f = kept.groupBy("sample").agg((F.sum(F.col("_M") / F.col("_w")) / F.sum(1 / F.col("_w"))).alias("_l"))
    all_ = lib.select("sample").join(f, "sample", "left").withColumn("_l", F.coalesce("_l", F.lit(0.0)))
    return all_.select("sample", F.pow(F.lit(2.0), F.col("_l") - all_.agg(F.avg("_l").alias("m")).scalar()).alias("factor"))


def tmm(long: DataFrame, **options) -> DataFrame:
    return long.join(tmm_factors(long, **options), "sample").withColumn("value", F.col("value") / F.col("factor")).drop("factor")


def align_profiles(x: np.ndarray) -> np.ndarray:
    """Shifts (one a row, log2) that align profiles pair by pair, closest pair first.

    Distance of two profiles: the variance of their differences over common
    columns (infinite without two of them).  The pair is joined by the median
    difference; the merged profile is the mean of both where both are there.
    """
    n = len(x)
    shift, groups, prof, weight = np.zeros(n), {i: [i] for i in range(n)}, {i: x[i].astype(float) for i in range(n)}, {i: np.isfinite(x[i]).astype(float) for i in range(n)}

    def distance(a: int, b: int) -> float:
        d = prof[a] - prof[b]
        d = d[np.isfinite(d)]
        return float(d.var()) if len(d) >= 2 else np.inf

    dist = {(a, b): distance(a, b) for a in range(n) for b in range(a + 1, n)}
    while len(groups) > 1 and dist:
        (a, b), best = min(dist.items(), key=lambda kv: (kv[1], kv[0]))
        if not np.isfinite(best):
            break
        if len(groups[a]) < len(groups[b]):
            a, b = b, a  # the smaller group moves
        d = prof[a] - prof[b]
        move = float(np.median(d[np.isfinite(d)]))
        for i in groups[b]:
            shift[i] += move
        pa, pb, wa, wb = prof[a], prof[b] + move, weight[a], weight[b]
        total = wa + wb
        prof[a] = np.where(total > 0, (np.nan_to_num(pa) * wa + np.nan_to_num(pb) * wb) / np.where(total > 0, total, 1), np.nan)
        weight[a] = total
        groups[a] += groups.pop(b)
        prof.pop(b), weight.pop(b)
        dist = {k: v for k, v in dist.items() if a not in k and b not in k}
        for c in groups:
            if c != a:
                dist[min(a, c), max(a, c)] = distance(min(a, c), max(a, c))
    return shift


def hierarchical_shifts(long: DataFrame, max_quadratic: int = 50, entity: str = "protein") -> DataFrame:
    """``(sample, shift)`` in log2: quadratic alignment of up to ``max_quadratic`` samples, the rest moved onto their median.

    The first samples by number of entities (ties by name) take part in the
    pairwise alignment, one whole-matrix step whose size is bounded; the others
    get the median difference to the aligned samples' median profile, which is
    relational.
    """
    v = long.where(is_measured("value")).select(entity, "sample", F.log2("value").alias("y"))
    sizes = v.groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    core = sizes.orderBy(F.col("n").desc(), "sample").limit(max_quadratic).select("sample")

    def align(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="sample", columns=entity, values="y").sort_index(axis=0).sort_index(axis=1)
        return pd.DataFrame({"sample": wide.index.to_numpy(), "shift": align_profiles(wide.to_numpy(float))})

    first = v.join(core, "sample", "left_semi").groupBy().applyInPandas(align, "sample string, shift double")
    ref = v.join(first, "sample").groupBy(entity).agg(F.median(F.col("y") + F.col("shift")).alias("_r"))
    rest = v.join(core, "sample", "left_anti").join(ref, entity).groupBy("sample").agg(F.median(F.col("_r") - F.col("y")).alias("shift"))
    return first.unionByName(rest)


def hierarchical(long: DataFrame, **options) -> DataFrame:
    s = hierarchical_shifts(long, **options)
    return long.join(s, "sample").withColumn("value", F.col("value") * F.pow(F.lit(2.0), F.col("shift"))).drop("shift")


SAMPLE_METHODS = {
    "none": lambda d: d, "median-center": lambda d: center(d, "median"), "mean-center": lambda d: center(d, "mean"), "quantile": quantile_normalize, "rlr": robust_regression,
    "loess": loess_normalize, "tmm": tmm, "hierarchical": hierarchical, "total": total_intensity,
    "global-median": lambda d: scale_samples(d, global_median_factors(d, "value"), "value"),
}


def normalize_matrix(long: DataFrame, method: str) -> DataFrame:
    """Any sample-level method on ``(protein, sample, value)``."""
    if method not in SAMPLE_METHODS:
        raise ValueError(f"unknown method {method!r}; known are {', '.join(SAMPLE_METHODS)}")
    return SAMPLE_METHODS[method](long.select("protein", "sample", "value"))


def default_method(quant: str) -> str:
    """The sample normalisation a roll-up takes when none is named."""
    return {"maxlfq": "hierarchical", "directlfq": "none", "ratio": "none", "peptide_count": "none", "spectral_count": "none"}.get(quant, "global-median")


# ---- reference scaling (IRS) ------------------------------------------------------------------------------------------


def irs_factors(long: DataFrame, design: DataFrame, stat: str = "median", missing: str = "keep") -> DataFrame:
    """``(protein, plex, factor)``: geometric mean over plexes of the reference over the plex's own.

    ``design`` is ``(sample, plex, is_reference)``.  Without a reference value in
    a plex: ``keep`` gives factor 1, ``drop`` no row, ``plex_median`` the plex's
    median factor.
    """
    agg = {"median": F.median, "mean": F.avg}[stat]
    ref = long.where(is_measured("value")).join(design.where("is_reference"), "sample").groupBy("protein", "plex").agg(agg("value").alias("_r"))
    centre = ref.groupBy("protein").agg(F.exp(F.avg(F.log("_r"))).alias("_g"))
    have = ref.join(centre, "protein").select("protein", "plex", (F.col("_g") / F.col("_r")).alias("factor"))
    if missing == "drop":
        return have
    need = long.select("protein", "sample").join(design, "sample").select("protein", "plex").distinct()
    if missing == "keep":
        return need.join(have, ["protein", "plex"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    if missing != "plex_median":
        raise ValueError(f"unknown policy {missing!r}")
    typical = have.groupBy("plex").agg(F.median("factor").alias("_t"))
    return need.join(have, ["protein", "plex"], "left").join(typical, "plex", "left").select("protein", "plex", F.coalesce("factor", "_t", F.lit(1.0)).alias("factor"))


def irs(long: DataFrame, design: DataFrame, stat: str = "median", missing: str = "keep") -> DataFrame:
    f = irs_factors(long, design, stat, missing)
    return long.join(design.select("sample", "plex"), "sample").join(f, ["protein", "plex"]).select("protein", "sample", (F.col("value") * F.col("factor")).alias("value"))


def is_reference_name(col: Column | str) -> Column:
    """Whether a name marks a reference channel."""
    c = F.col(col) if isinstance(col, str) else col
    # Fixed value: pattern of reference names.
    return F.coalesce(F.lower(c).rlike("pool|powder|ref|reference|bridge"), F.lit(False))


def reference_samples(sdrf: DataFrame, pooled: str | None = None, column: str | None = None, values: tuple[str, ...] = (), explicit: tuple[str, ...] = (), name: str = "sample") -> DataFrame:
    """``(sample, is_reference)`` by the first rule that marks a sample: the pooled column, named samples, a column's values, the name itself."""
    marks = []
    if pooled:
        marks.append(F.lower(F.trim(F.col(f"`{pooled}`"))).isin("pooled", "yes", "true", "1"))
    if explicit:
        marks.append(F.col("sample").isin(*explicit))
    if column and values:
        marks.append(F.col(f"`{column}`").isin(*values))
    marks.append(is_reference_name(F.col(f"`{name}`")))
    flags = sdrf.groupBy("sample").agg(*[F.max(F.coalesce(m, F.lit(False)).cast("int")).alias(f"_m{i}") for i, m in enumerate(marks)])
    found = flags.agg(*[F.max(f"_m{i}").alias(f"_m{i}") for i in range(len(marks))]).first()
    rule = next((i for i in range(len(marks)) if found[f"_m{i}"]), None)
    return flags.select("sample", (F.col(f"_m{rule}") == 1 if rule is not None else F.lit(False)).alias("is_reference"))


def plexes(sdrf: DataFrame, column: str | None = None, pattern: str = "(?i)(plex|tmt|set|mixture|batch)[_ -]?([0-9]+)") -> DataFrame:
    """``(sample, plex)`` by the first rule that gives at least two plexes or covers all samples: a column, equal sets of data files, the name."""
    if column:
        named = sdrf.where(F.col(f"`{column}`").isNotNull()).groupBy("sample").agg(F.min(F.col(f"`{column}`").cast("string")).alias("plex"))
        if named.limit(1).count():
            return named
    files = plex_by_files(sdrf)
    sizes = files.groupBy("plex").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if sizes and sizes > 1:  # samples measured together
        return files.select("sample", "plex")
    hit = F.regexp_extract("sample", pattern, 2)
    return sdrf.select("sample").distinct().select("sample", F.when(hit != "", hit).otherwise(F.lit("1")).alias("plex"))


def plex_by_files(sdrf: DataFrame) -> DataFrame:
    """``(sample, plex)``: samples measured in the same set of data files share a plex, named after its first file."""
    sets = sdrf.where("run_key IS NOT NULL").groupBy("sample").agg(F.array_sort(F.collect_set("run_key")).alias("_s"))
    return sets.select("sample", F.col("_s")[0].alias("plex"), F.array_join("_s", ";").alias("files"))


def channel_irs_factors(ions: DataFrame, stat: str = "median", scope: str = "global") -> DataFrame:
    """``(run, factor)`` from the reference channel of each run: global centre, by mixture, or both in turn.

    ``ions`` has ``run, mixture, is_reference, intensity``.
    """
    agg = {"median": F.median, "mean": F.avg}[stat]
    ref = ions.where(F.col("is_reference") & is_measured("intensity")).groupBy("run", "mixture").agg(agg("intensity").alias("_r"))
    if scope == "global":
        centre = ref.agg(agg("_r").alias("c")).scalar()
        return ref.select("run", (centre / F.col("_r")).alias("factor"))
    mix = ref.groupBy("mixture").agg(agg("_r").alias("_c"))
    both = ref.join(mix, "mixture")
    if scope == "by-mixture":
        return both.select("run", (F.col("_c") / F.col("_r")).alias("factor"))
    if scope == "two-stage":
        top = mix.agg(agg("_c").alias("c")).scalar()
        return both.select("run", "_c", "_r").select("run", (F.col("_c") / F.col("_r") * top / F.col("_c")).alias("factor"))
    raise ValueError(f"unknown scope {scope!r}")


# ---- isobaric rows (TMT) ----------------------------------------------------------------------------------------------


def nonnegative_solve(matrix: np.ndarray, rows: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> np.ndarray:
    """Non-negative least squares of many rows at once by coordinate descent: ``rows ~ x @ matrix.T``."""
    gram, target = matrix.T @ matrix, rows @ matrix
    x = np.maximum(rows, 0.0).copy()
    for _ in range(rounds):
        moved = 0.0
        for j in range(matrix.shape[1]):
            step = (target[:, j] - x @ gram[:, j]) / gram[j, j]
            new = np.maximum(x[:, j] + step, 0.0)
            moved = max(moved, float(np.abs(new - x[:, j]).max(initial=0.0)))
            x[:, j] = new
        if moved <= tol * max(1.0, float(np.abs(x).max(initial=0.0))):
            break
    return x


def correct_impurities(features: DataFrame, channels: list[str], impurity: np.ndarray, column: str = "channels") -> DataFrame:
    """Isotope-impurity correction of an array column with one number per channel (null counts as 0)."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            i = batch.schema.get_field_index(column)
            rows = np.array([[0.0 if v is None else v for v in r] for r in batch.column(i).to_pylist()], float).reshape(-1, len(channels))
            yield batch.set_column(i, column, pa.array(nonnegative_solve(impurity, rows).tolist(), pa.list_(pa.float64())))

    return features.mapInArrow(scan, features.schema)


def interference_floor(ions: DataFrame, share: float) -> DataFrame:
    """``(I - f m L) / (1 - f)`` per channel, at least ``0.01 m L``: L is the channel's loading over the mean loading, m the row's mean.

    ``ions`` has ``row_id, plex, channel, intensity``.
    """
    load = ions.groupBy("plex", "channel").agg(F.avg("intensity").alias("_l"))
    mean = load.groupBy("plex").agg(F.avg("_l").alias("_ml"))
    rows = ions.groupBy("row_id").agg(F.avg("intensity").alias("_m"))
    out = ions.join(load.join(mean, "plex").select("plex", "channel", (F.col("_l") / F.col("_ml")).alias("_L")), ["plex", "channel"]).join(rows, "row_id")
    base = F.col("_m") * F.col("_L")
    return out.withColumn("intensity", F.greatest((F.col("intensity") - share * base) / (1 - share), 0.01 * base)).drop("_L", "_m")


def merge_rows(ions: DataFrame, how: str = "max", key: tuple[str, ...] = ("peptidoform", "charge", "plex")) -> DataFrame:
    """One value per channel: the maximum over rows, or over the rows with the highest reporter sum (ties all kept)."""
    if how == "best-row":
        sums = ions.groupBy("row_id", *key).agg(F.sum("intensity").alias("_s"))
        top = sums.groupBy(*key).agg(F.max("_s").alias("_t"))
        ions = ions.join(sums.join(top, list(key)).where("_s = _t").select("row_id"), "row_id", "left_semi")
    elif how != "max":
        raise ValueError(f"unknown way {how!r}")
    return ions.groupBy(*key, "channel").agg(F.max("intensity").alias("intensity"))
