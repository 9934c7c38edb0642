"""Normalisation of runs, labels, accessions, peptides and replicates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Raw-file endings that do not belong to a run's name.
RUN_ENDINGS = ("raw", "mzml", "d", "wiff")
# Name parts that mark contaminants, entrapment entries and decoys.
CONTAMINANT_MARKS = ("CONTAMINANT", "CONTAM_", "ENTRAP", "DECOY")
DECOY_MARK = "DECOY"
# Labels that all mean "no label".
LABEL_FREE = ("raw", "lfq", "label-free", "label free", "label free sample")
LABEL_FREE_TERM = "label free sample"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def run_key(col: Column | str) -> Column:
    """Base name of a data file, lower case, without a raw-file ending."""
    base = F.regexp_replace(F.lower(F.trim(_c(col))), r"^.*[/\\]", "")
    return F.regexp_replace(base, r"\.(" + "|".join(RUN_ENDINGS) + ")$", "")


def label_key(col: Column | str) -> Column:
    """Trimmed lower-case label; the NT= part of a controlled-vocabulary value; one term for label-free."""
    low = F.lower(F.trim(_c(col)))
    term = F.trim(F.regexp_extract(low, r"(?:^|;)\s*nt=([^;]*)", 1))
    plain = F.when(term != "", term).otherwise(low)
    return F.when(plain.isin(*LABEL_FREE), F.lit(LABEL_FREE_TERM)).otherwise(plain)


def accession(col: Column | str) -> Column:
    """The middle of a three-part ``db|ACC|NAME`` form, other texts unchanged."""
    c = _c(col)
    return F.when(F.size(F.split(c, r"\|")) == 3, F.split(c, r"\|")[1]).otherwise(c)


def clean_accession(col: Column | str) -> Column:
    """Accession without blanks, isoform suffix and case; an empty result is null."""
    c = F.upper(F.trim(accession(F.trim(_c(col)))))
    bare = F.regexp_replace(c, "-[0-9]+$", "")
    return F.nullif(F.when(bare == "", c).otherwise(bare), F.lit(""))


def canonical_isoform(col: Column | str) -> Column:
    """Accession without a trailing ``-<digits>``, unless nothing would be left."""
    c = _c(col)
    bare = F.regexp_replace(c, "-[0-9]+$", "")
    return F.when(bare == "", c).otherwise(bare)


def protein_group(accessions: Column | str) -> Column:
    """Members' accessions joined by ``;`` in their order."""
    return F.array_join(F.transform(_c(accessions), accession), ";")


def canonical_peptide(col: Column | str) -> Column:
    """Sequence without bracketed modifications, dots and dashes."""
    return F.regexp_replace(F.regexp_replace(_c(col), r"\([^)]*\)|\[[^\]]*\]", ""), r"[.\-]", "")


def tech_replicate(run: Column | str) -> Column:
    """Number after the last ``_`` of a run, else the run as a number, else null."""
    parts = F.split(_c(run), "_")
    return F.coalesce(F.element_at(parts, -1).try_cast("int"), _c(run).try_cast("int"))


def mixture(run: Column | str) -> Column:
    """First ``_``-separated part of a run."""
    return F.split(_c(run), "_")[0]


def missed_cleavages(seq: Column | str) -> Column:
    """K or R inside the peptide that a trypsin digest would have cut (not before P, not at the end)."""
    return F.regexp_count(F.upper(_c(seq)), F.lit("[KR](?!P)(?=..)"))


def unique_row(unique: Column | str, accessions: Column | str) -> Column:
    """The unique flag; where it is null, whether the group has one accession."""
    u = _c(unique).cast("boolean")
    return F.coalesce(u, F.size(_c(accessions)) == 1)


def is_contaminant(acc: Column) -> Column:
    """Whether an accession carries a contaminant mark."""
    up = F.upper(acc)
    out = F.lit(False)
    for mark in CONTAMINANT_MARKS:
        out = out | up.contains(mark)
    return out


def drops_group(accessions: Column | str) -> Column:
    """A decoy among the members, or contaminants only."""
    c = _c(accessions)
    return F.exists(c, lambda a: F.upper(a).contains(DECOY_MARK)) | F.forall(c, is_contaminant)


def strip_contaminants(accessions: Column | str) -> Column:
    """Members without contaminant marks."""
    return F.filter(_c(accessions), lambda a: ~is_contaminant(a))


def factor_label(col: Column | str) -> Column:
    """Short form of a controlled-vocabulary value: QY, then CN, then NT, then the text itself."""
    c = _c(col)
    part = lambda k: F.nullif(F.trim(F.regexp_extract(c, rf"(?i)(?:^|;)\s*{k}=([^;]*)", 1)), F.lit(""))
    return F.coalesce(part("QY"), part("CN"), part("NT"), F.trim(c))
