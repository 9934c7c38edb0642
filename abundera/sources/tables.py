"""Text and folder sources: MSstats tables, sample metadata, peptide tables, FASTA, result folders, data sets, configuration."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abundera.functions import keys as K
from abundera.functions.values import is_measured
from abundera.schema import LEVELS, schema_errors

# MSstats column names and what they are called here.
MSSTATS_NAMES = {"ProteinName": "protein", "PeptideSequence": "peptidoform", "PrecursorCharge": "charge", "Charge": "charge", "Run": "run", "Reference": "run", "Channel": "channel", "Intensity": "intensity"}
# Sample metadata columns and what they are called here.
SDRF_NAMES = {
    "source name": "sample", "assay name": "assay", "comment[data file]": "data_file", "comment[label]": "label", "comment[technical replicate]": "techrep",
    "comment[fraction identifier]": "fraction", "characteristics[biological replicate]": "biorep", "characteristics[pooled sample]": "pooled",
}
# Labels of the isobaric kits by number of channels.
ISOBARIC_LABELS = {
    "TMT6plex": ("126", "127", "128", "129", "130", "131"),
    "TMT10plex": ("126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131"),
    "TMT11plex": ("126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131N", "131C"),
    "TMT16plex": ("126", "127N", "127C", "128N", "128C", "129N", "129C", "130N", "130C", "131N", "131C", "132N", "132C", "133N", "133C", "134N"),
    "iTRAQ4plex": ("114", "115", "116", "117"),
    "iTRAQ8plex": ("113", "114", "115", "116", "117", "118", "119", "121"),
}


def from_msstats(df: DataFrame) -> DataFrame:
    """MSstats rows as features: one per peptidoform, charge and run, with an intensity list.

    Uniqueness (one protein per peptidoform over the whole input) is computed
    by aggregate and join; rows not measured are dropped.
    """
    have = {MSSTATS_NAMES[c]: c for c in df.columns if c in MSSTATS_NAMES}
    need = {"protein", "peptidoform", "charge", "run", "intensity"} - set(have)
    if need:
        raise ValueError(f"MSstats columns are missing for {sorted(need)}")
    rows = df.select(*[F.col(f"`{c}`").alias(n) for n, c in have.items()])
    if "channel" not in have:
        rows = rows.withColumn("channel", F.lit(None).cast("string"))
    rows = rows.withColumns({"intensity": F.col("intensity").try_cast("double"), "charge": F.col("charge").try_cast("int"), "channel": F.col("channel").cast("string")}).where(is_measured("intensity"))
    rows = rows.withColumn("sequence", K.canonical_peptide("peptidoform"))
    unique = rows.groupBy("sequence").agg((F.count_distinct("protein") == 1).alias("is_unique"))
    lists = rows.groupBy("protein", "peptidoform", "sequence", "charge", "run").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("channel", "run").alias("label"), F.col("intensity")))).alias("intensities")
    )
    return lists.join(unique, "sequence").withColumn("accessions", F.split("protein", ";"))


def channel_map(labels: list[str], kit: str) -> dict[str, str]:
    """Numeric channel positions (from 1) to reporter labels of a kit; labels that are names stay."""
    names = ISOBARIC_LABELS[kit]
    return {v: names[int(v) - 1] if v.isdigit() and 1 <= int(v) <= len(names) else v for v in labels}


def infer_kit(labels: set[str]) -> str | None:
    """The smallest kit that has all labels, None for label-free."""
    plain = {v.upper().removeprefix("TMT").removeprefix("ITRAQ") for v in labels}
    fits = [(len(names), kit) for kit, names in ISOBARIC_LABELS.items() if plain <= set(names)]
    return min(fits)[1] if fits and plain else None


def sdrf_table(df: DataFrame, condition: str | None = None) -> DataFrame:
    """Sample metadata with canonical names, run and label keys, one row per run and label (the earliest row id or name wins)."""
    low = {c.lower(): c for c in df.columns}
    cols = [F.col(f"`{low[k]}`").alias(n) for k, n in SDRF_NAMES.items() if k in low]
    factor = condition or next((c for c in sorted(low) if c.startswith("factor value[")), None)
    if factor:
        cols.append(F.col(f"`{low[factor.lower()]}`").alias("condition"))
    keep = [F.col(f"`{c}`") for k, c in low.items() if k not in SDRF_NAMES and (not factor or k != factor.lower())]
    out = df.select(*cols, *keep).withColumns({"run_key": K.run_key("data_file"), "label_key": K.label_key("label")})
    return out


def one_per_run_label(sdrf: DataFrame, order: str) -> DataFrame:
    """The first row of each run and label by ``order``, for metadata that repeats rows."""
    rest = [c for c in sdrf.columns if c not in ("run_key", "label_key")]
    best = sdrf.where("run_key IS NOT NULL").groupBy("run_key", "label_key").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(f"`{order}`")).alias("_r"))
    return best.select("run_key", "label_key", "_r.*")


def sdrf_summary(sdrf: DataFrame) -> DataFrame:
    """One row: technical replicates, whether labels are isobaric, samples, labels."""
    return sdrf.agg(
        F.count_distinct("techrep").alias("techreps"), F.max((F.col("label_key") != K.LABEL_FREE_TERM).cast("int")).cast("boolean").alias("is_isobaric"),
        F.count_distinct("sample").alias("samples"), F.count_distinct("label_key").alias("labels"),
    )


def peptide_table(df: DataFrame) -> DataFrame:
    """A peptide table with canonical names, numbers cast leniently, rows not measured dropped."""
    names = {"ProteinName": "protein", "PeptideCanonical": "peptide", "PeptideSequence": "peptidoform", "PrecursorCharge": "charge", "SampleID": "sample", "BioReplicate": "biorep", "Condition": "condition", "Run": "run", "TechReplicate": "techrep", "NormIntensity": "intensity"}
    have = [c for c in df.columns if c in names]
    rest = [c for c in df.columns if c not in names and c not in names.values()]
    out = df.select(*[F.col(c).alias(names[c]) for c in have], *rest).withColumn("intensity", F.col("intensity").try_cast("double"))
    return out.where(is_measured("intensity"))


def read_peptides(spark: SparkSession, path: str) -> DataFrame:
    """A peptide table from Parquet, or from text with a header (comma, or tab for ``.tsv``)."""
    if path.rstrip("/").endswith((".csv", ".tsv", ".txt")):
        return peptide_table(spark.read.csv(path, header=True, sep="," if path.endswith(".csv") else "\t"))
    return peptide_table(spark.read.parquet(path))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(accession, protein_sequence)``: ids of the headers, residues outside the 20 standard ones removed."""
    raw = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    header = F.regexp_replace(F.split("value", "\n")[0], "^>", "")
    body = F.regexp_replace(F.regexp_replace("value", "^[^\n]*", ""), "[^ACDEFGHIKLMNPQRSTVWY]", "")
    return raw.select(K.accession(F.split(F.trim(header), r"\s+")[0]).alias("accession"), body.alias("protein_sequence")).where("protein_sequence <> ''")


def read_result_folder(spark: SparkSession, pattern: str, comment: str = "#") -> DataFrame:
    """All long result tables (TSV) of a folder as one."""
    return spark.read.csv(pattern, sep="\t", header=True, comment=comment, inferSchema=False).withColumn("source_file", F.input_file_name())


def combine_datasets(parts: dict[str, DataFrame], extra: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """Data sets under one another with their name as ``batch`` and constant extra columns."""
    tagged = [df.withColumns({"batch": F.lit(n), **{k: F.lit(v) for k, v in (extra or {}).get(n, {}).items()}}) for n, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def save_dataset(tables: dict[str, DataFrame], folder: str, provenance: list[str] | None = None) -> None:
    """One Parquet table per level, and the provenance as JSON lines."""
    spark = None
    for level, df in tables.items():
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{folder}/{level}.parquet")
    if spark is not None:
        lines = [json.dumps({"step": i, "what": w}) for i, w in enumerate(provenance or [])]
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/provenance")


def load_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The levels of a saved data set, lazily."""
    out = {}
    for level in LEVELS:
        try:
            df = spark.read.parquet(f"{folder}/{level}.parquet")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        if not schema_errors(df, level):
            out[level] = df
    return out


def csv_to_parquet(spark: SparkSession, source: str, target: str, sep: str = ",") -> None:
    spark.read.csv(source, header=True, sep=sep, inferSchema=True).write.mode("overwrite").parquet(target)


def read_config(path: str) -> dict:
    """A configuration from JSON, or from YAML where a reader is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("reading YAML needs the yaml package; JSON always works") from e
        return yaml.safe_load(text) or {}
    return json.loads(text)


def read_contrasts(path: str) -> list[tuple[str, str]]:
    """Pairs of conditions from a two-column TSV."""
    rows = [line.split("\t") for line in Path(path).read_text().splitlines() if line.strip() and not line.startswith("#")]
    return [(r[0].strip(), r[1].strip()) for r in rows if len(r) >= 2]


def with_aliases(labels: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(label, canonical)``: known labels as themselves, and every alias that is no label of its own.

    ``aliases`` is ``(canonical, aliases array)``; an alias of several labels
    goes to the smallest of them.
    """
    own = labels.select("label").where("label IS NOT NULL").distinct().select("label", F.col("label").alias("canonical"))
    other = aliases.select("canonical", F.explode("aliases").alias("label")).where("label IS NOT NULL").groupBy("label").agg(F.min("canonical").alias("canonical"))
    return own.unionByName(other.join(own.select("label"), "label", "left_anti"))


def lookup(mapping: dict[str, str], col: Column) -> Column:
    """A small constant mapping as an expression; values without an entry stay."""
    if not mapping:
        return col
    table = F.create_map(*[F.lit(x) for pair in sorted(mapping.items()) for x in pair])
    return F.coalesce(F.try_element_at(table, col), col)
