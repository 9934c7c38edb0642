"""Canonical columns of the data levels and their validation.

Long form everywhere: one row per measurement, a missing cell has no row or a
null.  Operators take and give these column names; adapters map sources to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Required columns of each level, canonical names.
LEVELS: dict[str, tuple[str, ...]] = {
    "features": ("sequence", "peptidoform", "charge", "run", "intensities", "accessions"),
    "ions": ("protein", "peptide", "peptidoform", "charge", "sample", "condition", "run", "biorep", "techrep", "intensity"),
    "peptides": ("protein", "peptide", "sample", "biorep", "condition", "intensity"),
    "proteins": ("protein", "sample", "value"),
    "psms": ("psm_id", "feature_id", "sequence"),
}

FEATURE = T.StructType(
    [
        T.StructField("feature_id", T.LongType()), T.StructField("sequence", T.StringType()), T.StructField("peptidoform", T.StringType()), T.StructField("charge", T.IntegerType()),
        T.StructField("run", T.StringType()), T.StructField("is_decoy", T.BooleanType()), T.StructField("is_unique", T.BooleanType()),
        T.StructField("intensities", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("intensity", T.DoubleType()), T.StructField("sample_accession", T.StringType())]))),
        T.StructField("accessions", T.ArrayType(T.StringType())), T.StructField("anchor_protein", T.StringType()), T.StructField("peptide_qvalue", T.DoubleType()), T.StructField("protein_qvalue", T.DoubleType()),
        T.StructField("imputed_labels", T.ArrayType(T.StringType())), T.StructField("is_transferred", T.BooleanType()),
    ]
)


def schema_errors(df: DataFrame, level: str) -> list[str]:
    """What a table lacks for a level; an empty list if it fits."""
    if level not in LEVELS:
        return [f"unknown level {level!r}; known are {', '.join(LEVELS)}"]
    have = set(df.columns)
    return [f"{level}: column {c!r} is missing" for c in LEVELS[level] if c not in have]


def require(df: DataFrame, level: str) -> DataFrame:
    """``df`` itself, or a ValueError that names everything missing."""
    errors = schema_errors(df, level)
    if errors:
        raise ValueError("; ".join(errors))
    return df


def available_levels(tables: dict[str, DataFrame]) -> list[str]:
    """Levels whose table is given and fits."""
    return [level for level in LEVELS if level in tables and not schema_errors(tables[level], level)]
