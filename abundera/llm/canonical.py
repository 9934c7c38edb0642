"""Mapping free-entered values to a reference list.

Distinct values are matched once each, against a trie of the reference terms
with their synonyms and codes as alias paths.  A value is tried, in this order,
as a code, as an exact path after normalisation (case, accents, width,
separators, plural, word order, lost blanks: all of them paths of the trie), as
exact paths inside a longer text, and by the Levenshtein automaton within a
distance that grows with the entry's length.  Two different targets at the same rank mean none: the value is
reported as unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abundera.llm.trie import Trie, edits

#: The reference list is held by every task; a longer one is refused.
MAX_ENTRIES = 1_000_000
#: Words that turn a term in a text into its opposite.
NEGATIONS = frozenset({"no", "not", "non", "without", "never", "negative", "excluded", "except"})
UNMATCHED = -1


def plain(text: str) -> str:
    """Compatibility form, no accents, case folded, separators and quotes as single blanks."""
    text = unicodedata.normalize("NFKD", text)
    text = "".join(c for c in text if not unicodedata.combining(c)).casefold()
    return re.sub(r"[\W_]+", " ", text).strip()


def term_distance(key: str) -> int:
    """Edits allowed for a term of this length."""
    return 0 if len(key) <= 3 else 1 if len(key) <= 6 else 2


def alias_distance(key: str) -> int:
    """Edits allowed for a synonym, which lies nearer to other words than a term does."""
    return 0 if len(key) <= 5 else 1 if len(key) <= 13 else 2


SORTED, GLUED, PLURAL, CODE = "sorted", "glued", "plural", "code"


class Reference:
    """The entries of one field: one trie of terms and synonyms, with alias paths for other orders of words, lost blanks, plurals and codes."""

    def __init__(self, rows: list[tuple[int, str, str | None, list[str] | None]]) -> None:
        self.limit: dict[str, int] = {}
        paths: list[tuple[str, int, str]] = []
        codes: dict[str, int] = {}
        for target, term, code, synonyms in sorted(rows, key=lambda r: r[0]):
            for text, limit in [(term, term_distance), *((s, alias_distance) for s in synonyms or () if s)]:
                key = plain(text)
                if key:
                    paths += [(key, target, Trie.ENTRY), (" ".join(sorted(key.split())), target, SORTED), (key.replace(" ", ""), target, GLUED), (f"{key}s", target, PLURAL)]
                    self.limit[key] = max(self.limit.get(key, 0), limit(key))
            if code:
                codes[plain(code)] = target
        self.trie = Trie(paths + [(k, t, CODE) for k, t in codes.items() if k])
        self.most = max(self.limit.values(), default=0)

    def _one(self, targets: set[int]) -> int | None:
        return next(iter(targets)) if len(targets) == 1 else None

    def _by_code(self, words: list[str]) -> set[int]:
        return {t for n in (1, 2) for i in range(len(words) - n + 1) for t in self.trie.find(" ".join(words[i : i + n]), CODE)}

    def _whole(self, key: str) -> set[int]:
        paths = ((key, Trie.ENTRY), (" ".join(sorted(key.split())), SORTED), (key.replace(" ", ""), GLUED), (key, PLURAL))
        return next((found for k, kind in paths if (found := self.trie.find(k, kind))), set())

    def _inside(self, words: list[str]) -> set[int]:
        """Targets of the exact entries inside a longer text, longest first, without overlap."""
        if NEGATIONS & set(words):
            return set()
        text, starts = " ".join(words), [0]
        for w in words:
            starts.append(starts[-1] + len(w) + 1)
        place = {at: i for i, at in enumerate(starts)}
        hits = []
        for i, start in enumerate(starts[:-1]):
            found: dict[int, set[int]] = {}
            for kind in (PLURAL, Trie.ENTRY):  # an entry goes before the plural of another
                found.update(self.trie.prefixes(text, start, kind))
            hits += [(place[end + 1] - i, i, targets) for end, targets in found.items() if end + 1 in place and end - start > 2]
        free, out = [True] * len(words), set()
        for n, i, targets in sorted(hits, key=lambda h: (-h[0], h[1])):
            if all(free[i : i + n]):
                out |= targets
                free[i : i + n] = [False] * n
        return out

    def candidates(self, text: str) -> list[tuple[int, str, int]]:
        """All ``(distance, entry, target)`` within the distance that the entry's length allows, nearest first."""
        wider = self.trie.within(text, self.most + 1, lambda k: self.limit[k] + 1)  # a letter between two swapped ones takes the automaton one edit more
        return sorted(w for w in ((edits(text, k), k, t) for _, k, t in wider) if w[0] <= self.limit[w[1]])

    def match(self, value: str) -> int:
        """The target the value means, or ``UNMATCHED``."""
        key = plain(value)
        words = key.split()
        if not words:
            return UNMATCHED
        named = re.search(r"(?i)(?:^|;)\s*nt\s*=\s*([^;]*)", value)
        for found in (self._by_code(words), self._whole(key), self._whole(plain(named.group(1))) if named else set(), self._inside(words)):
            if found:
                return self._one(found) or UNMATCHED
        text = plain(named.group(1)) if named else key
        near = self.trie.within(text, self.most, self.limit.__getitem__) or self.candidates(text)
        if near:
            best = {t for d, _, t in near if d == near[0][0]}
            return self._one(best) or UNMATCHED
        return UNMATCHED


def load_references(terms: DataFrame) -> dict[str, Reference]:
    """References by field from ``(term_id, field_name, term, code, synonyms)``; rows without term or id are left out."""
    rows = terms.select("term_id", "field_name", "term", "code", "synonyms").limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    by: dict[str, list] = {}
    for r in rows:
        if r["term_id"] is not None and r["term"]:
            by.setdefault(r["field_name"], []).append((r["term_id"], r["term"], r["code"], r["synonyms"]))
    return {f: Reference(entries) for f, entries in by.items()}


def match_values(values: DataFrame, references: dict[str, Reference], target: str = "term_id") -> DataFrame:
    """``(field_name, value)`` with the id each distinct value means, -1 where none does.

    Null values give no row; a field without a reference gives -1.  The input
    is reduced to its distinct pairs first, whatever the number of rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, texts = batch.column(0), batch.column(1)
            ids = [references[f].match(v) if f in references else UNMATCHED for f, v in zip(fields.to_pylist(), texts.to_pylist())]
            yield pa.RecordBatch.from_arrays([fields, texts, pa.array(ids, pa.int64())], names=["field_name", "value", target])

    pairs = values.where(F.col("value").isNotNull()).select("field_name", "value").distinct()
    return pairs.mapInArrow(scan, f"field_name string, value string, {target} long")


def near_entries(values: DataFrame, references: dict[str, Reference], target: str = "term_id") -> DataFrame:
    """``(field_name, value, entry, distance)`` and the id of all entries within the length-dependent distance of each distinct value."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (f, v, entry, d, t) for f, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if f in references
                for d, entry, t in references[f].candidates(plain(v))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["field_name", "value", "entry", "distance", target])

    pairs = values.where(F.col("value").isNotNull()).select("field_name", "value").distinct()
    return pairs.mapInArrow(scan, f"field_name string, value string, entry string, distance int, {target} long")


def map_rows(rows: DataFrame, terms: DataFrame, references: dict[str, Reference] | None = None) -> DataFrame:
    """``rows`` of ``(row id.., field_name, value)`` with the ``term_id`` of each value that is no term letter for letter."""
    references = references or load_references(terms)
    known = terms.select(F.col("field_name"), F.col("term").alias("value")).where("value IS NOT NULL").distinct()
    odd = rows.where(F.col("value").isNotNull()).join(known, ["field_name", "value"], "left_anti")
    return odd.join(match_values(odd, references), ["field_name", "value"])
