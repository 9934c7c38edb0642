"""Protein families from shared peptides, shared-signal allocation, and the values derived from it.

Everything up to the families is edges: ``(accession, peptide)`` pairs of a
digest or an observation.  Components come from label propagation with pointer
jumping over edge tables, cut by a reliable checkpoint each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from abundera.functions.keys import canonical_isoform
from abundera.session import cut_lineage, materialize

# Where each protease cuts (pattern of the cut position).
PROTEASES = {
    "Trypsin": r"(?<=[KR])(?!P)", "Trypsin/P": r"(?<=[KR])", "Lys-C": r"(?<=K)(?!P)", "Arg-C": r"(?<=R)(?!P)", "Glu-C": r"(?<=[DE])(?!P)", "Asp-N": r"(?=[D])",
    "Chymotrypsin": r"(?<=[FYWL])(?!P)", "CNBr": r"(?<=M)",
}
# Monoisotopic residue masses, and that of water.
RESIDUE_MASS = {
    "A": 71.03711, "C": 103.00919, "D": 115.02694, "E": 129.04259, "F": 147.06841, "G": 57.02146, "H": 137.05891, "I": 113.08406, "K": 128.09496, "L": 113.08406,
    "M": 131.04049, "N": 114.04293, "P": 97.05276, "Q": 128.05858, "R": 156.10111, "S": 87.03203, "T": 101.04768, "V": 99.06841, "W": 186.07931, "Y": 163.06333,
}
WATER = 18.0105650638


def digest(proteins: DataFrame, enzyme: str = "Trypsin", missed: int = 0, min_length: int = 7, max_length: int = 30) -> DataFrame:
    """``(accession, peptide)``: distinct peptides of a theoretical digest, isoforms collapsed to their canonical accession."""
    import re

    cut = re.compile(PROTEASES[enzyme])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            acc, pep = [], []
            for a, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = [p for p in cut.split(seq or "") if p]
                found = {"".join(parts[i : i + k + 1]) for k in range(missed + 1) for i in range(len(parts) - k)}
                keep = [p for p in found if min_length <= len(p) <= max_length]
                acc += [a] * len(keep)
                pep += keep
            yield pa.RecordBatch.from_arrays([pa.array(acc, pa.string()), pa.array(pep, pa.string())], names=["accession", "peptide"])

    return proteins.select(canonical_isoform("accession").alias("accession"), "protein_sequence").mapInArrow(scan, "accession string, peptide string").distinct()


def molecular_weight(sequence: str = "protein_sequence"):
    """Monoisotopic mass of a sequence; residues without a mass add nothing."""
    table = F.create_map(*[F.lit(x) for pair in RESIDUE_MASS.items() for x in pair])
    return F.aggregate(F.split(F.col(sequence), ""), F.lit(WATER), lambda a, c: a + F.coalesce(F.try_element_at(table, c), F.lit(0.0)))


def sharing_pairs(edges: DataFrame, min_shared: int = 2, protein: str = "protein", peptide: str = "peptide") -> DataFrame:
    """``(a, b, shared)``: pairs of proteins (a < b) with at least ``min_shared`` peptides in common.

    Joined on the peptide; peptides of one protein cannot make a pair and are
    left out before the join.
    """
    e = edges.select(F.col(protein).alias("p"), F.col(peptide).alias("k")).where("p IS NOT NULL AND k IS NOT NULL").distinct()
    shared = e.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    e = e.join(shared, "k", "left_semi")
    a, b = e.alias("a"), e.alias("b")
    pairs = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.p") < F.col("b.p"))).select(F.col("a.p").alias("a"), F.col("b.p").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= min_shared)


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node each node is connected with.

    ``edges`` is ``(a, b)``, ``nodes`` is ``(node)``.  Each round takes the
    smallest label among the neighbours and then jumps to that label's label;
    rounds go on until no label changes, each label can only fall, so they end.
    Nothing is collected but the number of changed labels.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct().toDF("x", "y"), "links")
    labels = materialize(nodes.select("node").distinct().withColumn("label", F.col("node")), "labels")
    while True:  # tables instead of checkpoints: a checkpoint keeps its plan's estimated size, which multiplies from round to round
        near = both.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("low"))
        low = labels.join(near.withColumnRenamed("x", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("low"))
        hop = low.select(F.col("node").alias("low"), F.col("low").alias("far"))
        new = materialize(low.join(hop, "low", "left").select("node", "label", F.least("low", F.coalesce("far", "low")).alias("new")), "labels")
        labels = new.select("node", F.col("new").alias("label"))
        if not new.where("label <> new").limit(1).count():
            break
    return labels.select("node", F.col("label").alias("component"))


def families(edges: DataFrame, min_shared: int = 2, overrides: DataFrame | None = None) -> DataFrame:
    """``(accession, family, family_size)``: components of accessions that share peptides.

    The family is named after the member with most peptides (ties: the largest
    name).  ``overrides`` (``accession, family``) pins members; the rest of a
    broken family keeps its own name.
    """
    e = edges.select("accession", "peptide").distinct()
    pairs = sharing_pairs(e, min_shared, "accession", "peptide")
    comp = connected_components(pairs, e.select(F.col("accession").alias("node"))).withColumnRenamed("node", "accession")
    if overrides is not None:
        comp = comp.join(overrides.select("accession"), "accession", "left_anti")
    sizes = e.groupBy("accession").agg(F.count(F.lit(1)).alias("_n"))
    named = comp.join(sizes, "accession").groupBy("component").agg(F.max_by("accession", F.struct("_n", "accession")).alias("family"))
    out = comp.join(named, "component").select("accession", "family")
    if overrides is not None:
        out = out.unionByName(overrides.select("accession", "family"))
    size = out.groupBy("family").agg(F.count(F.lit(1)).alias("family_size"))
    return cut_lineage(out.join(size, "family").select("accession", "family", "family_size"))


def peptide_owner(observed: DataFrame, edges: DataFrame, fam: DataFrame) -> DataFrame:
    """``(peptide, family)``: the family with most observed proteotypic peptides among those that hold it (ties: smallest name)."""
    seen = edges.join(observed.select("peptide").distinct(), "peptide", "left_semi")
    single = seen.groupBy("peptide").agg(F.count_distinct("accession").alias("_n")).where("_n = 1").select("peptide")
    anchors = seen.join(single, "peptide", "left_semi").groupBy("accession").agg(F.count(F.lit(1)).alias("_a"))
    strength = fam.join(anchors, "accession", "left").groupBy("family").agg(F.sum(F.coalesce("_a", F.lit(0))).alias("_s"))
    held = seen.join(fam.select("accession", "family"), "accession").select("peptide", "family").distinct().join(strength, "family")
    return held.groupBy("peptide").agg(F.min_by("family", F.struct((-F.col("_s")).alias("s"), "family")).alias("family"))


def allocate(peptides: DataFrame, edges: DataFrame, fam: DataFrame, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Proportional allocation: ``(accession, by..., anchor, shared, value)``.

    The maximum per peptide and group goes whole to the only member it belongs
    to; a shared one is split in proportion to the members' anchor intensity in
    the same group, equally where they have none.
    """
    top = peptides.groupBy("peptide", *by).agg(F.max("intensity").alias("_i"))
    owner = peptide_owner(peptides, edges, fam)
    members = edges.join(fam.select("accession", "family"), "accession").join(owner, ["peptide", "family"], "left_semi").select("peptide", "accession")
    n = members.groupBy("peptide").agg(F.count(F.lit(1)).alias("_m"))
    rows = top.join(n, "peptide").join(members, "peptide")
    anchor = rows.where("_m = 1").groupBy("accession", *by).agg(F.sum("_i").alias("anchor"))
    shared = rows.where("_m > 1").join(anchor, ["accession", *by], "left").withColumn("_w", F.coalesce("anchor", F.lit(0.0)))
    group = W.partitionBy("peptide", *by)  # the members of one peptide in one sample: a handful
    split = shared.withColumn("_t", F.sum("_w").over(group)).withColumn("_s", F.when(F.col("_t") > 0, F.col("_i") * F.col("_w") / F.col("_t")).otherwise(F.col("_i") / F.col("_m")))
    given = split.groupBy("accession", *by).agg(F.sum("_s").alias("shared"))
    both = anchor.join(given, ["accession", *by], "full")
    return both.select("accession", *by, F.coalesce("anchor", F.lit(0.0)).alias("anchor"), F.coalesce("shared", F.lit(0.0)).alias("shared")).withColumn("value", F.col("anchor") + F.col("shared"))


def unique_mode(peptides: DataFrame, edges: DataFrame, fam: DataFrame, by: tuple[str, ...] = ("sample",)) -> DataFrame:
    """Unique signal over the count of unique theoretical peptides; families without unique evidence get one row of their own.

    ``(accession, by..., value, level)``, level ``unique`` or ``family``; the
    family row carries the family's name, the signal of its shared peptides over
    their number.
    """
    owners = edges.groupBy("peptide").agg(F.count(F.lit(1)).alias("_m"), F.first("accession").alias("_only"))
    top = peptides.groupBy("peptide", *by).agg(F.max("intensity").alias("_i")).join(owners, "peptide")
    theory = owners.where("_m = 1").groupBy(F.col("_only").alias("accession")).agg(F.count(F.lit(1)).alias("_d"))
    uniq = top.where("_m = 1").groupBy(F.col("_only").alias("accession"), *by).agg(F.sum("_i").alias("_s")).join(theory, "accession").select("accession", *by, (F.col("_s") / F.col("_d")).alias("value"), F.lit("unique").alias("level"))
    with_evidence = fam.join(uniq.select("accession").distinct(), "accession", "left_semi").select("family").distinct()
    silent = fam.join(with_evidence, "family", "left_anti").select("accession", "family")
    of_family = edges.join(silent, "accession").select("peptide", "family").distinct()
    size = of_family.groupBy("family").agg(F.count(F.lit(1)).alias("_d"))
    rest = top.join(of_family, "peptide").groupBy("family", *by).agg(F.sum("_i").alias("_s")).join(size, "family").select(F.col("family").alias("accession"), *by, (F.col("_s") / F.col("_d")).alias("value"), F.lit("family").alias("level"))
    return uniq.unionByName(rest)


def stable_ratio(peptides: DataFrame, edges: DataFrame, fam: DataFrame) -> DataFrame:
    """Shared signal split by each member's median share over the samples, credited only where the member has unique evidence."""
    parts = cut_lineage(allocate(peptides, edges, fam))  # read three times
    total = parts.join(fam.select("accession", "family"), "accession").groupBy("family", "sample").agg(F.sum("anchor").alias("_ta"), F.sum("shared").alias("_ts"))
    rows = parts.join(fam.select("accession", "family"), "accession").join(total, ["family", "sample"])
    share = rows.where("anchor > 0 AND _ta > 0").groupBy("accession").agg(F.median(F.col("anchor") / F.col("_ta")).alias("_share"))
    live = rows.join(share, "accession").where("anchor > 0")
    norm = live.groupBy("family", "sample").agg(F.sum("_share").alias("_n"))
    return live.join(norm, ["family", "sample"]).select("accession", "sample", (F.col("anchor") + F.col("_ts") * F.col("_share") / F.col("_n")).alias("value"))


def per_theoretical(values: DataFrame, edges: DataFrame, fam: DataFrame, peptides: DataFrame) -> DataFrame:
    """Value over the owned theoretical peptides, with evidence level and family: the piBAQ table.

    Evidence: ``high`` with at least two unique peptides observed, ``medium``
    with one, ``family_only`` without.
    """
    owners = edges.groupBy("peptide").agg(F.count(F.lit(1)).alias("_m"), F.first("accession").alias("_only"))
    denominators = edges.groupBy("accession").agg(F.count(F.lit(1)).alias("denominator"))
    seen = owners.where("_m = 1").join(peptides.select("peptide").distinct(), "peptide", "left_semi").groupBy(F.col("_only").alias("accession")).agg(F.count(F.lit(1)).alias("n_unique"))
    out = values.join(denominators, "accession").join(fam, "accession").join(seen, "accession", "left")
    n = F.coalesce("n_unique", F.lit(0))
    level = F.when(n >= 2, "high").when(n == 1, "medium").otherwise("family_only")
    return out.withColumns({"pibaq": F.col("value") / F.col("denominator"), "evidence": level, "n_unique": n})


def derived_values(pibaq: DataFrame, by: tuple[str, ...] = ("sample", "condition")) -> DataFrame:
    """Share of the group's total, its log form (10 + log10) and parts per billion (x 1e8)."""
    total = pibaq.groupBy(*by).agg(F.sum("pibaq").alias("_t"))
    out = pibaq.join(total, list(by)).withColumn("norm", F.try_divide(F.col("pibaq"), F.col("_t"))).drop("_t")
    return out.withColumns({"log": F.when(F.col("norm") > 0, F.log10("norm") + 10), "ppb": F.col("norm") * 1e8})


def total_protein_approach(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Intensity over molecular weight (a weight of 0 counts as 1)."""
    w = F.when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.col("weight"))
    return values.join(weights, "accession", "left").withColumn("tpa", F.col("value") / w)


def proteomic_ruler(values: DataFrame, weights: DataFrame, histones: DataFrame, genome_size: float, ploidy: int = 2, cell_volume: float = 1e-12, by: str = "condition") -> DataFrame:
    """Copies, moles, weight and concentration per condition, scaled by the histones' signal (at least 1).

    DNA mass of a cell = genome size * ploidy * 617.96 / Avogadro; histones weigh
    as much as the DNA.
    """
    avogadro = 6.02214129e23
    dna = genome_size * ploidy * 617.96 / avogadro
    hist = values.join(histones, "accession", "left_semi").groupBy(by).agg(F.greatest(F.lit(1.0), F.sum("value")).alias("_h"))
    out = values.join(weights, "accession").join(hist, by, "left").withColumn("_h", F.coalesce("_h", F.lit(1.0)))
    copies = F.col("value") * F.lit(avogadro * dna) / (F.col("weight") * F.col("_h"))
    out = out.withColumn("copies", copies)
    return out.withColumns({"moles": F.col("copies") / avogadro, "mass": F.col("copies") / avogadro * F.col("weight"), "concentration": F.col("copies") / avogadro / F.lit(cell_volume)}).drop("_h")
