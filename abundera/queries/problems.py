"""Queries of the general problems: drifting schemas, heavy keys, nested records, missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abundera.functions import keys as K
from abundera.functions.values import is_measured, log2_rounded
from abundera.operators import drift, fill, heavy, shred
from abundera.queries.base import sql_missing
from abundera.queries.common import Registry, table

R = Registry()

# Fields of raw records that the current feature table has no column for.
EXTRA_FIELDS = ("retention_time", "ion_mobility", "missed_cleavages", "scan", "calibrated", "instrument_note")
EXTRA_INNER = ("intensities.sample_accession", "intensities.imputed", "pg_accessions.score")
INNER_OF = ("intensities", "pg_accessions")
REPEATED = {"intensities": {}, "pg_accessions": {}, "additional_scores": {}, "modifications": {"positions": {"scores": {}}}}
MAX_ALIASES = 100_000


def feature_canon(spark: SparkSession, sf_dir: str) -> drift.Canon:
    """Canonical fields: the columns of feature, the extra ones, and the known aliases (a list of the schema's size)."""
    schema = table(spark, sf_dir, "feature").schema
    inner = [f"{p}.{g.name}" for p in INNER_OF for g in schema[p].dataType.elementType.fields]
    rows = table(spark, sf_dir, "field_alias").select("field_name", "alias").limit(MAX_ALIASES + 1).collect()
    if len(rows) > MAX_ALIASES:
        raise ValueError("the alias list is too long for a schema")
    aliases = tuple(sorted((r[0], r[1]) for r in rows if r[0] and r[1]))
    return drift.Canon((*schema.names, *EXTRA_FIELDS), (*inner, *EXTRA_INNER), aliases)


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[drift.Canon, DataFrame, drift.Resolved]:
    canon, drop = feature_canon(spark, sf_dir), table(spark, sf_dir, "feature_drop")
    return canon, drop, drift.resolve_files(drop, canon)


@R.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every field between a file and the one before it, and between the three tables."""
    canon, _, resolved = _resolved(spark, sf_dir)
    layouts = [(n, table(spark, sf_dir, n).schema) for n in ("feature_legacy", "feature_interim", "feature")]
    steps = [(new, f, kind) for (_, a), (new, b) in zip(layouts, layouts[1:]) for f, kind in drift.table_changes(a, b, canon)]
    of_tables = spark.createDataFrame(steps, "file_name string, field_name string, change_kind string")
    return drift.file_changes(resolved, INNER_OF).unionByName(of_tables)


@R.add("p1_scripts")
def p1_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum-cost edit scripts between consecutive files, with their costs and moves."""
    return drift.file_scripts(_resolved(spark, sf_dir)[2], INNER_OF)


@R.add("p1_unified")
def p1_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent feature table from the three tables and the raw records."""
    canon, drop, resolved = _resolved(spark, sf_dir)
    known, known_inner = canon.known(), canon.known_inner()
    kinds = {
        "feature_id": "bigint", "sequence": "string", "peptidoform": "string", "charge": "int", "run_file_name": "string", "is_decoy": "boolean", "unique": "boolean", "anchor_protein": "string",
        "peptide_qvalue": "double", "pg_global_qvalue": "double", "identification_type": "string", "retention_time": "double", "ion_mobility": "double", "missed_cleavages": "int", "scan": "bigint",
        "id_run_file_name": "string", "acquired_at": "timestamp", "ingested_at": "timestamp", "calibrated": "boolean", "instrument_note": "string", "imputed_labels": ["string"],
        "intensities": [{"label": "string", "intensity": "double", "sample_accession": "string", "imputed": "boolean"}], "pg_accessions": [{"accession": "string", "start": "int", "end": "int", "pre": "string", "post": "string", "score": "double"}],
        "additional_scores": [{"score_name": "string", "score_value": "double", "higher_better": "boolean"}],
        "modifications": [{"name": "string", "accession": "string", "positions": [{"position": "string", "scores": [{"score_name": "string", "score_value": "double"}]}]}],
    }
    left_out = {*canon.fields, "intensities", "pg_accessions"} - set(kinds)
    if left_out:
        raise ValueError(f"no column for {sorted(left_out)}")

    def lenient(col, kind: str):
        c = F.trim(col.cast("string"))
        if kind == "boolean":
            return F.lower(c).try_cast("boolean")
        return c.try_cast("double").try_cast(kind) if kind in ("int", "bigint") else col.cast("string").try_cast(kind)

    def ddl(kind, leaf: str | None = None) -> str:
        if isinstance(kind, list):
            return f"array<{ddl(kind[0], leaf)}>"
        return "struct<" + ", ".join(f"`{f}`: {ddl(k, leaf)}" for f, k in kind.items()) + ">" if isinstance(kind, dict) else leaf or kind

    def typed(col, dtype: T.DataType, kind, name: str):
        """The column in the canonical type; a list that came as text is read as JSON first, other text as a list of one."""
        if isinstance(kind, list):
            if isinstance(dtype, T.StringType):
                text = ddl(kind, "string")
                one = F.when(~F.trim(col).rlike("^[\\[{]") & (F.trim(col) != ""), F.array(col)) if kind == ["string"] else F.lit(None)
                return typed(F.coalesce(F.from_json(col, text), one.cast(text)), T._parse_datatype_string(text), kind, name)
            return F.transform(col, lambda x: typed(x, dtype.elementType, kind[0], name))
        if isinstance(kind, dict):
            fields = {known_inner.get((name, drift.S.norm(g.name)), g.name): g for g in dtype.fields} if isinstance(dtype, T.StructType) else {"accession": None}
            part = lambda f, k: F.lit(None).cast(ddl(k)) if f not in fields else typed(col, dtype, k, name) if fields[f] is None else typed(col[fields[f].name], fields[f].dataType, k, name)
            return F.when(col.isNotNull(), F.struct(*[part(f, k).alias(f) for f, k in kind.items()]))
        return lenient(col, kind)

    def adapt(df: DataFrame, name: str, row_id: str) -> DataFrame:
        have = {known.get(drift.S.norm(f.name), f.name): f for f in df.schema.fields}
        cols = [F.lit(name).alias("source_table"), F.col(row_id).alias("source_id")]
        return df.select(*cols, *[(typed(F.col(f"`{have[c].name}`"), have[c].dataType, k, c) if c in have else F.lit(None).cast(ddl(k))).alias(c) for c, k in kinds.items()])

    out = adapt(drift.unified_records(drop, resolved), "feature_drop", "record_id")
    for n in ("feature_legacy", "feature_interim", "feature"):
        out = out.unionByName(adapt(table(spark, sf_dir, n), n, "feature_id"))
    return out


def _feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate(
        F.filter("intensities", lambda e: is_measured(e["intensity"])), F.lit(0.0), lambda a, e: a + e["intensity"].cast("double")
    )
    return table(spark, sf_dir, "feature").select(
        K.clean_accession("anchor_protein").alias("protein"), K.canonical_peptide("sequence").alias("peptide"), F.nullif(total, F.lit(0.0)).alias("value")
    )


def _peptide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "peptide").select(
        F.col("ProteinName").alias("protein"), F.col("PeptideCanonical").alias("peptide"), F.when(is_measured("NormIntensity"), F.col("NormIntensity")).alias("value")
    )


HEAVY_SHARE = 0.02


def _heavy_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda name, rows: heavy.spread_over_keys(rows, "protein", "peptide", "value", HEAVY_SHARE).withColumn("table_name", F.lit(name))
    return of("peptide", _peptide_rows(spark, sf_dir)).unionByName(of("feature", _feature_rows(spark, sf_dir)))


_CLEAN = "upper(trim(CASE WHEN len(string_split(trim(anchor_protein), '|')) = 3 THEN string_split(trim(anchor_protein), '|')[2] ELSE trim(anchor_protein) END))"
_MEASURED = "isfinite({0}) AND {0} > 0"
_P4 = f"""
WITH rows AS (
  SELECT 'peptide' AS table_name, ProteinName AS protein, PeptideCanonical AS peptide,
         CASE WHEN {_MEASURED.format('NormIntensity')} THEN NormIntensity END AS value FROM peptide
  UNION ALL
  SELECT 'feature', CASE WHEN regexp_replace(c, '-[0-9]+$', '') = '' THEN nullif(c, '') ELSE regexp_replace(c, '-[0-9]+$', '') END,
         regexp_replace(regexp_replace(sequence, '\\([^)]*\\)|\\[[^\\]]*\\]', '', 'g'), '[.\\-]', '', 'g'),
         nullif(list_sum(list_transform(list_filter(intensities, lambda e: isfinite(e.intensity) AND e.intensity > 0), lambda e: CAST(e.intensity AS DOUBLE))), 0)
  FROM (SELECT *, {_CLEAN} AS c FROM feature)
), totals AS (SELECT table_name, count(*) AS total FROM rows GROUP BY table_name)
SELECT r.table_name, protein, count(*) AS n_rows, round(log2(sum(value)), 9) AS log2_sum_intensity,
       count(DISTINCT peptide) AS n_peptides, protein IS NOT NULL AND count(*) >= 0.02 * max(total) AS is_heavy
FROM rows r JOIN totals t ON r.table_name = t.table_name GROUP BY r.table_name, protein"""


@R.add("p4_found", f"SELECT table_name, protein FROM ({_P4}) WHERE is_heavy")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins with at least 2 % of all rows of peptide and of feature."""
    return _heavy_results(spark, sf_dir).where("is_heavy").select("table_name", "protein")


@R.add("p4_results", _P4)
def p4_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, summed measured intensity and distinct peptides of every protein of peptide and feature."""
    return _heavy_results(spark, sf_dir).select("table_name", "protein", "n_rows", log2_rounded(F.col("sum_value")).alias("log2_sum_intensity"), F.col("n_items").alias("n_peptides"), "is_heavy")


@R.add("p6_found")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each child of each readable raw record."""
    _, drop, resolved = _resolved(spark, sf_dir)
    return shred.shred_payloads(drop, REPEATED, resolved)


@R.add("p6_children")
def p6_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaves of the raw records and of all their children, each with its own and its parent's place."""
    _, drop, resolved = _resolved(spark, sf_dir)
    rows = shred.shred_leaves(drop, REPEATED, resolved)
    return rows.withColumn("parent_pos", F.when(F.instr("pos", ".") > 0, F.regexp_replace("pos", r"\.[^.]*$", "")))


_PARENTS = "feature_id, sequence, peptidoform, charge, run_file_name, is_decoy, \"unique\", anchor_protein, peptide_qvalue, pg_global_qvalue, identification_type, id_run_file_name, acquired_at, ingested_at"


@R.add("p6_feature_parents", f"SELECT {_PARENTS} FROM feature")
def p6_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents of the feature table's children."""
    return shred.parent_table(table(spark, sf_dir, "feature"))


def _p6_sql(column: str, fields: str) -> str:
    return f"""SELECT feature_id, CAST(i - 1 AS INTEGER) AS pos, {fields} FROM (
  SELECT feature_id, unnest(range(1, len({column}) + 1)) AS i, {column} AS l FROM feature) WHERE l[i] IS NOT NULL"""


def _p6_feature(column: str, fields: str):
    @R.add(f"p6_feature_{column}", _p6_sql(column, fields))
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return shred.child_table(table(spark, sf_dir, "feature"), "feature_id", column)

    return query


_p6_feature("intensities", "l[i].label AS label, CASE WHEN NOT isnan(l[i].intensity) THEN l[i].intensity END AS intensity")
_p6_feature("pg_accessions", 'l[i].accession AS accession, l[i].start AS start, l[i]."end" AS "end", l[i].pre AS pre, l[i].post AS post')
_p6_feature("additional_scores", "l[i].score_name AS score_name, CASE WHEN NOT isnan(l[i].score_value) THEN l[i].score_value END AS score_value, l[i].higher_better AS higher_better")
_p6_feature("modifications", "l[i].name AS name, l[i].accession AS accession")


_P7 = f"""WITH b AS (SELECT peptide_row_id, ProteinName AS p, Run AS run, CASE WHEN NOT {sql_missing('SampleID')} THEN SampleID END AS s, CASE WHEN NOT {sql_missing('Condition')} THEN Condition END AS c,
  coalesce(isfinite(NormIntensity) AND NormIntensity > 0, false) AS m FROM peptide),
best AS (SELECT run, s AS bs FROM (SELECT run, s, count(*) AS n FROM b WHERE run IS NOT NULL AND s IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY run ORDER BY n DESC, s) = 1),
f AS (SELECT b.*, coalesce(s, bs) AS s2 FROM b LEFT JOIN best USING (run))
SELECT peptide_row_id, 'SampleID' AS field_name FROM f WHERE s IS NULL AND s2 IS NOT NULL
UNION ALL SELECT peptide_row_id, 'Condition' FROM f WHERE c IS NULL AND s2 IN (SELECT s2 FROM f WHERE c IS NOT NULL AND s2 IS NOT NULL)
UNION ALL SELECT peptide_row_id, 'NormIntensity' FROM f SEMI JOIN (SELECT p, s2 FROM f WHERE m AND p IS NOT NULL AND s2 IS NOT NULL) g USING (p, s2) WHERE NOT m"""


@R.add("p7_found", _P7)
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of SampleID, Condition and NormIntensity that can be filled."""
    return fill.fills(table(spark, sf_dir, "peptide")).select("peptide_row_id", "field_name")


@R.add("p7_fills")
def p7_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filled cells with their values and donors."""
    return fill.fills(table(spark, sf_dir, "peptide"))


@R.add("p7_filled")
def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The peptide table with its gaps filled, each filled cell marked."""
    return fill.filled(table(spark, sf_dir, "peptide"))
