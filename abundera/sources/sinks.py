"""Sinks: wide and long matrices, peptide exports, test tables, the three tables of an annotated matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Methods whose absent cells are 0 in a wide matrix.
ADDITIVE = ("sum", "intensity", "peptide_count", "spectral_count", "directlfq")
MAX_COLUMNS = 20_000


def wide_matrix(long: DataFrame, samples: list[str] | None = None, method: str = "sum", normalized: bool = False, entity: str = "protein", sample: str = "sample", value: str = "value") -> DataFrame:
    """Entities by samples, rows sorted; absent cells 0 for additive methods, empty otherwise or after normalisation."""
    if samples is None:
        found = long.select(sample).distinct().orderBy(sample).limit(MAX_COLUMNS + 1).collect()
        if len(found) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} samples: keep the long form")
        samples = [r[0] for r in found if r[0] is not None]
    wide = long.groupBy(entity).pivot(sample, samples).agg(F.first(value))
    if method in ADDITIVE and not normalized:
        wide = wide.fillna(0.0, subset=samples)
    return wide.orderBy(entity)


def long_from_wide(wide: DataFrame, entity: str = "protein", sample: str = "sample", value: str = "value") -> DataFrame:
    """The long form of a wide matrix; empty cells give no row."""
    cells = [c for c in wide.columns if c != entity]
    return wide.unpivot([entity], cells, sample, value).where(F.col(value).isNotNull())


def write_matrix_csv(wide: DataFrame, path: str) -> None:
    wide.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")


def write_long_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, sep="\t", emptyValue="", nullValue="")


def write_peptides(df: DataFrame, path: str, by: str | None = None) -> None:
    """Peptide rows as Parquet (dictionary-encoded strings), partitioned by sample or run if asked."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_tests(df: DataFrame, path: str) -> None:
    """One folder of test results per contrast."""
    df.write.mode("overwrite").partitionBy("contrast").csv(path, header=True)


def annotated_tables(long: DataFrame, sample_info: DataFrame | None = None, layers: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The parts of an annotated matrix as tables: X (long, one column a layer), obs (samples), var (entities).

    No h5ad file is written: the three tables hold the same content in a form
    that is written and read in parallel.
    """
    x = long.select("sample", "protein", F.col("value").alias("X"))
    for name, layer in (layers or {}).items():
        x = x.join(layer.select("sample", "protein", F.col("value").alias(name)), ["sample", "protein"], "full")
    obs = long.groupBy("sample").agg(F.count("value").alias("n_proteins"))
    if sample_info is not None:
        obs = obs.join(sample_info, "sample", "left")
    var = long.groupBy("protein").agg(F.count("value").alias("n_samples"))
    return {"X": x, "obs": obs, "var": var}


def write_annotated(parts: dict[str, DataFrame], folder: str) -> None:
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
