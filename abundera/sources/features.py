"""Feature tables in their layouts, expanded to the long form.

An adapter inspects the schema (metadata only) and projects any layout to the
canonical one; column pruning and nested pruning reach the scan.  Element
predicates are applied inside the arrays before they are expanded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundera.functions import keys as K
from abundera.functions.values import is_measured
from abundera.schema import FEATURE

# Names a canonical column has in the known layouts, in order of preference.
LAYOUT_NAMES: dict[str, tuple[str, ...]] = {
    "feature_id": ("feature_id",), "sequence": ("sequence",), "peptidoform": ("peptidoform",), "charge": ("charge", "precursor_charge"),
    "run": ("run_file_name", "reference_file_name"), "is_decoy": ("is_decoy",), "is_unique": ("unique",), "intensities": ("intensities",), "accessions": ("pg_accessions",),
    "anchor_protein": ("anchor_protein",), "peptide_qvalue": ("peptide_qvalue",), "protein_qvalue": ("pg_global_qvalue", "protein_qvalue"), "imputed_labels": ("imputed_labels",),
}
REQUIRED = ("sequence", "peptidoform", "charge", "run", "intensities", "accessions")


def _intensities(col: str, element: T.StructType) -> Column:
    names = set(element.fieldNames())
    label = "label" if "label" in names else "channel"
    sample = (lambda e: e["sample_accession"]) if "sample_accession" in names else (lambda e: F.lit(None).cast("string"))
    build = lambda e: F.when(e.isNotNull(), F.struct(e[label].alias("label"), e["intensity"].cast("double").alias("intensity"), sample(e).alias("sample_accession")))
    return F.transform(F.col(col), build)


def adapt_features(df: DataFrame) -> DataFrame:
    """Any known layout as the canonical feature table; a missing required column is an error."""
    have = {f.name: f.dataType for f in df.schema.fields}
    cols = []
    for f in FEATURE.fields:
        if f.name == "is_transferred":
            if "identification_type" in have:
                other = ~F.col("id_run_file_name").eqNullSafe(F.col("run_file_name")) if "id_run_file_name" in have else F.lit(False)
                cols.append(F.coalesce(F.lower("identification_type") == "transferred", other).alias(f.name))
            else:
                cols.append(F.lit(False).alias(f.name))
            continue
        found = next((n for n in LAYOUT_NAMES[f.name] if n in have), None)
        if found is None:
            if f.name in REQUIRED:
                raise ValueError(f"no column for {f.name!r}; tried {', '.join(LAYOUT_NAMES[f.name])}")
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif f.name == "intensities":
            cols.append(_intensities(found, have[found].elementType).alias(f.name))
        elif f.name == "accessions":
            plain = isinstance(have[found].elementType, T.StringType)
            cols.append((F.col(found) if plain else F.transform(found, lambda a: a["accession"])).alias(f.name))
        else:
            cols.append(F.col(found).cast(f.dataType).alias(f.name))
    return df.select(*cols)


def read_features(spark: SparkSession, *paths: str) -> DataFrame:
    """Feature files of one or several layouts as one canonical table."""
    parts = [adapt_features(spark.read.parquet(p)) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def measured_entries(intensities: Column | str = "intensities", imputed: Column | str | None = "imputed_labels") -> Column:
    """List entries that were measured: finite and above 0, and not among the imputed labels."""
    c = F.col(intensities) if isinstance(intensities, str) else intensities
    ok = lambda e: is_measured(e["intensity"])
    if imputed is None:
        return F.filter(c, ok)
    labels = F.col(imputed) if isinstance(imputed, str) else imputed
    return F.filter(c, lambda e: ok(e) & ~F.coalesce(F.array_contains(labels, e["label"]), F.lit(False)))


def is_label_free(run: Column | str = "run", intensities: Column | str = "intensities") -> Column:
    """Whether a feature has one entry labelled by its run (or by a label-free term)."""
    r = F.col(run) if isinstance(run, str) else run
    c = F.col(intensities) if isinstance(intensities, str) else intensities
    by_run = lambda e: (K.run_key(e["label"]) == K.run_key(r)) | (K.label_key(e["label"]) == K.LABEL_FREE_TERM)
    return (F.size(c) == 1) & F.coalesce(F.exists(c, by_run), F.lit(False))


def explode_intensities(features: DataFrame) -> DataFrame:
    """One row per feature and measured entry, with ``run_key``, ``label_key`` and ``is_label_free``.

    Null and empty lists, null entries and entries not measured give no row.
    """
    flat = features.withColumns({"is_label_free": is_label_free(), "_entries": measured_entries()}).drop("intensities")
    out = flat.select("*", F.inline("_entries")).drop("_entries")
    return out.withColumns({"run_key": K.run_key("run"), "label_key": F.when(F.col("is_label_free"), F.lit(K.LABEL_FREE_TERM)).otherwise(K.label_key("label"))})


def read_psms(spark: SparkSession, path: str) -> DataFrame:
    """``(psm_id, feature_id, sequence, is_decoy, run)`` of a PSM file."""
    return spark.read.parquet(path).select("psm_id", "feature_id", "sequence", "is_decoy", F.col("run_file_name").alias("run"))


def feature_groups(features: DataFrame) -> DataFrame:
    """``(feature_id, protein)``: members joined by ``;`` in order, the anchor protein where there are none."""
    members = F.filter(F.transform("accessions", K.clean_accession), lambda a: a.isNotNull())
    joined = F.array_join(F.array_sort(F.array_distinct(members)), ";")
    return features.select("feature_id", F.coalesce(F.nullif(joined, F.lit("")), K.clean_accession("anchor_protein")).alias("protein"))


def attach_metadata(long: DataFrame, sdrf: DataFrame, strict: bool = True) -> DataFrame:
    """Left join on run and label key with the sample metadata; with ``strict`` problems are errors.

    ``sdrf`` has one row per run and label (``run_key, label_key, sample,
    condition, ...``).  Duplicate keys and rows without metadata raise when
    ``strict``.  The metadata side grows with the runs, so its broadcast is left
    to the size the optimiser sees.
    """
    if strict:
        twice = sdrf.groupBy("run_key", "label_key").count().where("count > 1").limit(3).collect()
        if twice:
            raise ValueError(f"metadata has more than one row for {[(r[0], r[1]) for r in twice]}")
        lost = long.join(sdrf, ["run_key", "label_key"], "left_anti").select("run_key", "label_key").limit(3).collect()
        if lost:
            raise ValueError(f"no metadata for {[(r[0], r[1]) for r in lost]}")
    return long.join(sdrf, ["run_key", "label_key"], "left")
