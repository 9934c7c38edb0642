"""Filling missing categories and numbers from records of the same group.

Categories come from the most frequent value of the group (run, then sample);
numbers by predictive mean matching: a group-aware additive predictor is fitted
on all measured rows, donors are range-searched among the predictions of the
same group, and the donor's observed value is copied together with its id.

No step gathers a group: sums and counts combine before they are shuffled, keys
that hold many rows are joined by broadcast, and the range search runs over
prediction bins, of which a group has at most ``2 * BINS_PER_LOG2 * 2100``
however many rows it holds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions.values import is_measured, is_missing
from abundera.operators.heavy import hot_hashes, join_hot
from abundera.session import materialize

#: The donor search runs over bins of 1/64 of a doubling; within and between them the nearest prediction counts.
BINS_PER_LOG2 = 64


@dataclass(frozen=True)
class FillColumns:
    """Names of the columns the operator works on."""

    row_id: str = "peptide_row_id"
    entity: str = "ProteinName"
    item: str = "PeptideCanonical"
    charge: str = "PrecursorCharge"
    run: str = "Run"
    sample: str = "SampleID"
    condition: str = "Condition"
    value: str = "NormIntensity"


#: Flat 96-bit keys of a group (entity and sample) and of an item (with its charge): far narrower to shuffle than the strings.
G, K = ["ga", "gb"], ["ka", "kb"]


def _key(names: list[str], *cols: Column) -> list[Column]:
    return [F.xxhash64(*cols).alias(names[0]), F.hash(*cols).alias(names[1])]


def majority(df: DataFrame, group: str, value: str, row_id: str) -> DataFrame:
    """The most frequent ``value`` of each group with the smallest row id that has it.

    Ties go to the smallest value.  Rows whose group or value is null are not
    counted.  Returns ``(group, _fill, _donor)``.
    """
    counted = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(row_id).alias("d"))
    best = counted.groupBy(group).agg(F.min_by(F.struct(F.col(value).alias("v"), "d"), F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("best"))
    return best.select(group, F.col("best.v").alias("_fill"), F.col("best.d").alias("_donor"))


def _base(df: DataFrame, c: FillColumns) -> DataFrame:
    return df.select(
        F.col(c.row_id).alias("_id"), F.col(c.entity).alias("_entity"), F.col(c.item).alias("_item"), F.col(c.charge).alias("_charge"),
        F.col(c.run).alias("_run"), F.when(~is_missing(c.sample), F.col(c.sample)).alias("_sample"),
        F.when(~is_missing(c.condition), F.col(c.condition)).alias("_condition"), F.col(c.value).cast("double").alias("_value"),
    )


def with_filled_samples(base: DataFrame) -> DataFrame:
    """Rows with ``_sample2`` (the sample, filled from the run where missing) and ``_sample_donor``."""
    by_run = majority(base, "_run", "_sample", "_id").withColumnsRenamed({"_fill": "_sample2", "_donor": "_sample_donor"})
    has = base.where(F.col("_sample").isNotNull()).withColumns({"_sample2": F.col("_sample"), "_sample_donor": F.lit(None).cast("bigint")})
    lacks = base.where(F.col("_sample").isNull()).join(by_run, "_run", "left")
    return has.unionByName(lacks)


def _keyed(rows: DataFrame) -> DataFrame:
    """What the fills need: hashed keys of entity and sample (null without either) and of item and charge instead of strings."""
    has = F.col("_entity").isNotNull() & F.col("_sample2").isNotNull()
    group = [F.when(has, c).alias(n) for n, c in zip(G, _key(G, F.col("_entity"), F.col("_sample2")))]
    return rows.select("_id", "_sample2", "_sample_donor", "_condition", *group, *_key(K, F.col("_item"), F.col("_charge")), "_value")


def condition_fills(rows: DataFrame) -> DataFrame:
    """``(_id, _fill, _donor)`` of each missing condition whose (filled) sample has one in another row."""
    by_sample = majority(rows.select("_id", "_sample2", "_condition"), "_sample2", "_condition", "_id")
    return rows.where(F.col("_condition").isNull() & F.col("_sample2").isNotNull()).select("_id", "_sample2").join(by_sample, "_sample2").select("_id", "_fill", "_donor")


def value_fills(rows: DataFrame, hot: dict[str, list[int]] | None = None) -> DataFrame:
    """Predictive mean matching; ``(_id, _fill, _donor, _distance)`` of each value that can be filled.

    The prediction of a row is the mean log2 value of its entity and sample plus
    the shrunken mean deviation of its item and charge over all samples (0 where
    the item was never measured).  The donor is the measured row of the same
    entity and sample whose prediction is nearest; among those of the same
    prediction, and between one below and one above at the same distance, the
    one of smallest id.

    The nearest donor is searched in the row's own prediction bin, and from the
    outermost donors of the next bins that hold one, so no window holds a whole
    group's rows.  ``hot`` routes the keys that hold many rows (see
    ``heavy.join_hot``); of a group and item that does, one row stands for all.
    """
    hot = hot or {}
    ok, g_hot, k_hot, gk = is_measured("_value"), hot.get("g", []), hot.get("k", []), F.struct(*G, *K)
    g_by, k_by = F.struct(*G), F.struct(*K)
    usable = rows.where(F.col("ga").isNotNull()).select("_id", *G, *K, "_value")
    groups = usable.groupBy(*G).agg(F.avg(F.when(ok, F.log2("_value"))).alias("mean"), F.bool_or(~ok).alias("lacks")).where("mean IS NOT NULL")
    donors = join_hot(usable.where(ok), groups, G, g_by, g_hot)
    effects = donors.groupBy(*K).agg((F.sum(F.log2("_value") - F.col("mean")) / (F.count(F.lit(1)) + 1)).alias("effect"))
    asking, same = usable.where(~ok).select("_id", *G, *K), hot.get("gk", [])
    donors, asks = donors.where("lacks").drop("lacks"), asking
    if same:
        many = F.xxhash64(gk).isin(*same)
        one = donors.where(many).groupBy(*G, *K, "mean").agg(F.min("_id").alias("_id"), F.min_by("_value", "_id").alias("_value"))
        donors = donors.where(~many).unionByName(one)
        asks = asks.where(~many).unionByName(asks.where(many).groupBy(*G, *K).agg(F.min("_id").alias("_id")))
    asks = join_hot(asks, groups.where("lacks").select(*G, "mean"), G, g_by, g_hot).withColumn("_value", F.lit(None).cast("double"))
    p, d, v = F.col("p"), F.col("d"), F.col("v")
    points = join_hot(donors.unionByName(asks), effects, K, k_by, k_hot, "left").select(*G, (F.col("mean") + F.coalesce("effect", F.lit(0.0))).alias("p"), F.col("_id").alias("d"), F.col("_value").alias("v"))
    points = points.withColumn("bin", F.floor(p * BINS_PER_LOG2).cast("int"))
    under, over = F.when(v.isNotNull(), F.struct(p.alias("p"), (-d).alias("d"), v.alias("v"))), F.when(v.isNotNull(), F.struct(p.alias("p"), d.alias("d"), v.alias("v")))
    cell = W.partitionBy(*G, "bin")
    near = points.select(
        *G, "p", "bin", "d", "v", F.max(under).over(cell.orderBy("p")).alias("lo"), F.min(over).over(cell.orderBy(p.desc())).alias("hi"), F.row_number().over(cell.orderBy(p.desc())).alias("nth"),
        F.max(under).over(cell).alias("top"), F.min(over).over(cell).alias("bottom"),
    )
    line = W.partitionBy(*G)
    before = lambda order: line.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    beside = near.where("nth = 1").select(  # one row a bin, at most 2 * BINS_PER_LOG2 * 2100 a group
        *G, "bin", F.max("top").over(before(F.col("bin").asc())).alias("under"), F.min("bottom").over(before(F.col("bin").desc())).alias("over")
    )
    found = near.where("v IS NULL").select(*G, "p", "bin", "d", "lo", "hi").join(beside, [*G, "bin"]).select("d", "p", F.coalesce("lo", "under").alias("lo"), F.coalesce("hi", "over").alias("hi"))
    gap_lo, gap_hi = p - F.col("lo.p"), F.col("hi.p") - p
    take_lo = F.col("hi").isNull() | (F.col("lo").isNotNull() & ((gap_lo < gap_hi) | ((gap_lo == gap_hi) & (-F.col("lo.d") <= F.col("hi.d")))))
    lo = F.struct(F.col("lo.p").alias("p"), (-F.col("lo.d")).alias("d"), F.col("lo.v").alias("v"))
    chosen = found.select(F.col("d").alias("_id"), F.when(take_lo, lo).otherwise(F.col("hi")).alias("donor"), "p")
    out = chosen.select("_id", F.col("donor.v").alias("_fill"), F.col("donor.d").alias("_donor"), F.abs(F.col("donor.p") - p).alias("_distance"))
    if not same:
        return out
    sole = asking.where(F.xxhash64(gk).isin(*same))  # the rows that one asked for, as few groups as there are hot keys
    of_many = sole.groupBy(*G, *K).agg(F.min("_id").alias("_first")).join(out.withColumnRenamed("_id", "_first"), "_first").drop("_first")
    return out.join(sole.select("_id"), "_id", "left_anti").unionByName(sole.join(F.broadcast(of_many), [*G, *K]).select(*out.columns))


def fills(df: DataFrame, columns: FillColumns = FillColumns()) -> DataFrame:
    """Every cell that can be filled, with its value and donor.

    Returns ``(row id, field_name, filled_value, donor_id, distance)``:
    a missing sample whose run (not null) has a sample in another row; a missing
    condition whose sample, filled if need be, has a condition in another row; a
    value that is not finite and above 0, with an entity, for whose entity and
    (filled) sample another row is measured.  ``distance`` is that of the
    predictions, in log2 units, for values only.  An empty table gives no row;
    cells without a donor are left out and stay missing.
    """
    c = columns
    rows = materialize(_keyed(with_filled_samples(_base(df, c))), "filled-samples")  # read by every branch below
    hot = hot_hashes(rows.where("ga IS NOT NULL"), {"g": F.struct(*G), "k": F.struct(*K), "gk": F.struct(*G, *K)})
    none = F.lit(None).cast("double")
    of_sample = rows.where("_sample_donor IS NOT NULL").select(
        F.col("_id").alias(c.row_id), F.lit(c.sample).alias("field_name"), F.col("_sample2").alias("filled_value"), F.col("_sample_donor").alias("donor_id"), none.alias("distance")
    )
    of_condition = condition_fills(rows).select(F.col("_id").alias(c.row_id), F.lit(c.condition).alias("field_name"), F.col("_fill").alias("filled_value"), F.col("_donor").alias("donor_id"), none.alias("distance"))
    of_value = value_fills(rows, hot).select(F.col("_id").alias(c.row_id), F.lit(c.value).alias("field_name"), F.col("_fill").cast("string").alias("filled_value"), F.col("_donor").alias("donor_id"), F.col("_distance").alias("distance"))
    return of_sample.unionByName(of_condition).unionByName(of_value)


def filled(df: DataFrame, columns: FillColumns = FillColumns()) -> DataFrame:
    """``df`` with its gaps filled, plus ``<field>_filled`` marks and ``<field>_donor`` ids."""
    c = columns
    found = fills(df, c)
    names = (c.sample, c.condition, c.value)
    pick = lambda f, col: F.max(F.when(F.col("field_name") == f, F.col(col)))
    wide = found.groupBy(c.row_id).agg(*[pick(f, "filled_value").alias(f"_v_{f}") for f in names], *[pick(f, "donor_id").alias(f"{f}_donor") for f in names])
    out = df.join(wide, c.row_id, "left")
    for f in names:
        new = F.col(f"_v_{f}").cast(df.schema[f].dataType)
        out = out.withColumn(f"{f}_filled", F.col(f"_v_{f}").isNotNull()).withColumn(f, F.coalesce(new, F.col(f))).drop(f"_v_{f}")
    return out
