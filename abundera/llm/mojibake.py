"""Garbled text from wrong character encodings: noisy-channel detection and restoration.

Two passes over the texts.  The first counts, over all distinct texts, in how many
each word with a character outside ASCII stands, and the pairs of neighbouring
characters; the counts go into a frequency sketch of fixed size (three rows of
``word_cells`` counters, one of ``PAIR_CELLS``), the only thing collected and
sent to the tasks, of bounded size whatever the corpus.  The second pass decodes:
for every word, each channel (true encoding, encoding it was read in) gives a
lattice of bytes; characters that stand for lost bytes are wildcards.  A beam
Viterbi search fills the lattice under the pair counts, and the corpus counts
of whole words decide between the word as it stands and its restorations.

A word counts as damaged if its restoration is much more frequent in the corpus
than the word itself, or reads without a gap as UTF-8 made of characters that
are typical where they stand, or gains far commoner letter pairs.  So a text that merely quotes damage (the quoted
sign restores to something nobody writes alone), escapes, and rare but right
characters are no cases.
"""

from __future__ import annotations

import itertools
import math
import re
import string
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a row of the word sketch: four for each text of the corpus, rounded up to a power of two between these bounds.
LEAST_CELLS, MOST_CELLS = 1 << 19, 1 << 22
WORD_ROWS = 3
PAIR_CELLS = 1 << 18
#: A restoration must be in this many times as many documents as the word it replaces.
GAIN = 4.0
#: The same for a single sign that a single-byte channel turns into another.
RARE_GAIN = 500.0
#: A word of foreign letters whose pairs become e to this power as frequent was read wrongly.
SPELLING_GAIN = 2.0
#: A word in less than this share of the texts is rare, in fewer than ``GAIN`` texts in any case.
RARE_SHARE = 4e-4
#: Hypotheses kept in the lattice search.
BEAM = 24
LOST = "�"

# Encodings a text may have been read in by mistake.
READ_AS = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8-r", "iso8859-2", "iso8859-15", "gb18030", "big5", "cp932", "euc_kr")
# Encodings it may really have had.
TRUE_ENCODINGS = ("utf-8", "cp1252", "cp1251", "koi8-r", "mac_roman", "cp1250", "cp850", "cp866", "iso8859-5", "gb18030", "cp932", "euc_jp", "big5", "euc_kr")
# Encodings a text is read in twice.
TWICE = frozenset({"cp1252", "latin-1"})
MULTIBYTE = frozenset({"utf-8", "gb18030", "cp932", "euc_jp", "big5", "euc_kr"})

_DIGITS = re.compile(r"[0-9]+")
_BLANKS = re.compile("([ \t\r\n]+)")
_LETTERS = re.compile(r"[^\W\d_]+")
_NO_LETTER = re.compile(r"[^\w\x00-\x7f]")
_CONTROL = re.compile("[\x80-\x9f]")
_EDGE = string.punctuation
_WIDE = re.compile("[⺀-鿿가-힯豈-﫿]")
_RUN = re.compile("[\x80-ÿŒœŠšŽžŸƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]{6}")
_MIXED = re.compile(r"[^\W\d_⺀-\uffff][⺀-\ufffc]|[⺀-\ufffc][^\W\d_⺀-\uffff]")
_WIDE_BREAK = re.compile("[\x00-\x7f　-〄〈-〿＀-／：-＠°]+")


def words_of(text: str) -> list[str]:
    """Runs without ASCII white space that hold a character outside ASCII."""
    return [w for w in _BLANKS.split(text) if not w.isascii()]


def replace_words(text: str, fix) -> str:
    """The text with each such run replaced by what ``fix`` makes of it."""
    return "".join([w if w.isascii() else fix(w) for w in _BLANKS.split(text)])


def pieces(word: str) -> list[str]:
    """What a word is looked up by: itself with digits levelled, or the runs between breaks of a text without blanks."""
    if _WIDE.search(word):
        return [p for p in _WIDE_BREAK.split(word) if p] or [word]
    bare = word.strip(_EDGE) or word
    return [_DIGITS.sub("0", bare)]


def _cells(piece: str, size: int) -> list[int]:
    """Counters of a word in a sketch of ``size`` counters a row, behind those of the pairs."""
    h = xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"))
    return [PAIR_CELLS + row * size + ((h >> (21 * row)) & (size - 1)) for row in range(WORD_ROWS)]


def _pair_cell(a: str, b: str) -> int:
    return ((ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B) >> 7) % PAIR_CELLS


def word_cells(texts: int) -> int:
    """Counters of a row for a corpus of so many texts."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (4 * texts - 1).bit_length() if texts else 0))


def corpus_counts(df: DataFrame, text: str) -> np.ndarray:
    """The frequency sketch of all distinct texts: texts per word piece and per pair of characters, at the end the number of texts."""
    size = word_cells(df.count())
    last = WORD_ROWS * size + PAIR_CELLS

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        memo: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(counts.keys(), dtype=np.int32, count=len(counts))
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))], names=["cell", "n"])
            counts.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t:
                    continue
                counts[last] += 1
                for word in set(words_of(t)):
                    cells = memo.get(word)
                    if cells is None:
                        cells = [c for p in set(pieces(word)) for c in _cells(p, size)]
                        level = "".join(pieces(word))
                        cells += [_pair_cell(a, b) for a, b in zip(f"\x02{level}", f"{level}\x03") if a > "\x7f" or b > "\x7f"]
                        cells += [_pair_cell(c, "\x00") for c in set(level) if c > "\x7f"]
                        if _WIDE.search(word):  # the signs between the runs, with their neighbours
                            whole = _DIGITS.sub("0", word)
                            signs = {c for c in whole if c > "\x7f" and _WIDE_BREAK.match(c)}
                            cells += [_pair_cell(a, b) for a, b in zip(f"\x02{whole}", f"{whole}\x03") if a in signs or b in signs] if signs else []
                            cells += [_pair_cell(c, "\x00") for c in signs]
                        if len(memo) > 50_000:
                            memo.clear()
                        memo[word] = cells
                    for c in cells:
                        counts[c] += 1
            if len(counts) > 500_000:
                yield flush()
        if counts:
            yield flush()

    texts = df.where(F.col(text).rlike(r"[^\x00-\x7f]")).select(text).distinct()  # a text counts once, however often it was copied
    found = texts.mapInArrow(scan, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(last + 1, dtype=np.int64)
    table[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(table, np.iinfo(np.int32).max).astype(np.int32)


def _byte_maps() -> dict[str, dict[str, int]]:
    """For each single-byte encoding, the byte of every character, undefined bytes as control characters."""
    out = {}
    for enc in READ_AS:
        if enc in MULTIBYTE:
            continue
        table = {}
        for b in range(0x80, 0x100):
            try:
                ch = bytes([b]).decode(enc)
            except UnicodeDecodeError:
                ch = chr(b)
            table[ch] = b
        for b in range(0x80, 0xA0):  # a control character that came through as it is
            table.setdefault(chr(b), b)
        out[enc] = table
    return out


def _undefined(b: int, enc: str) -> bool:
    try:
        bytes([b]).decode(enc)
    except UnicodeDecodeError:
        return True
    return False


def _high_letters(enc: str) -> list[str]:
    out = []
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(enc)
        except UnicodeDecodeError:
            continue
        if ch.isprintable() and not ch.isspace():
            out.append(ch)
    return out


def _cut_ends(data: bytes) -> str | None:
    """UTF-8 cut through at its ends, where a byte became a blank: the whole characters between, LOST for the rest."""
    start = 0
    while start < min(3, len(data)) and 0x80 <= data[start] < 0xC0:
        start += 1
    for end in range(len(data), max(start, len(data) - 3) - 1, -1):
        if end < len(data) and data[end] < 0xC0:
            continue
        try:
            text = data[start:end].decode("utf-8")
        except UnicodeDecodeError:
            continue
        return LOST * (start > 0) + text + LOST * (end < len(data)) if len(_WIDE.findall(text)) >= 3 else None
    return None


def _latin(text: str) -> bool:
    """Whether all letters are Latin: other scripts beside ASCII must be typical of the corpus."""
    return all(unicodedata.name(c, "").startswith("LATIN") for c in text if c > "\x7f" and c.isalpha())


@lru_cache(maxsize=65_536)
def _script(ch: str) -> str:
    return unicodedata.name(ch, "").split(" ")[0]


def _word_like(text: str) -> bool:
    """Whether a text of a single-byte encoding is spelled as words are: beside ASCII only letters, each run in one script and one case."""
    if _NO_LETTER.search(text):
        return False
    runs = _LETTERS.findall(text)
    return bool(runs) and all((r.islower() or r.isupper() or r[0].isupper() and r[1:].islower()) and len({_script(c) for c in r}) == 1 for r in runs)


def _text_of(link: tuple) -> str:
    """The characters of a chain of links, the last one first in it."""
    out = []
    while link:
        link, ch = link
        out.append(ch)
    return "".join(reversed(out))


class Decoder:
    """The noisy channel: counts of the corpus, channels, and the lattice search."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.size = (len(counts) - 1 - PAIR_CELLS) // WORD_ROWS
        self.rare = max(GAIN, RARE_SHARE * int(counts[-1]))
        self.maps = _byte_maps()
        self.silent = {enc: sorted(b for ch, b in table.items() if ord(ch) == b and 0x80 <= b < 0xC0 and _undefined(b, enc)) for enc, table in self.maps.items()}
        self.latin = _high_letters("cp1252")
        self.high = {enc: _high_letters(enc) for enc in TRUE_ENCODINGS if enc not in MULTIBYTE}
        self.rows: dict[tuple[str, int], np.ndarray] = {}
        self.memo: dict[str, tuple[str, str]] = {}
        self.sound: set[str] = set()

    # -- corpus frequencies ------------------------------------------------------------------------------------------

    def frequency(self, word: str) -> float:
        """Geometric mean of the document counts of a word's pieces."""
        parts = pieces(word)
        return math.exp(sum(math.log(min(int(self.counts[c]) for c in _cells(p, self.size)) + 0.05) for p in parts) / len(parts))

    def _pair(self, a: str, b: str) -> float:
        if a <= "\x7f" and b <= "\x7f":
            return 0.0
        return math.log(int(self.counts[_pair_cell(a, b)]) + 0.02)

    @cached_property
    def known(self) -> dict[bytes, list[str]]:
        """Characters of the corpus by their UTF-8 bytes without the first, and by the first alone: what may stand where bytes were lost."""
        out: dict[bytes, list[str]] = {}
        for block in ((0x80, 0xD800), (0xE000, 0x10000), (0x1F000, 0x1FB00)):
            codes = np.arange(*block, dtype=np.uint64)
            cells = ((codes * 0x9E3779B1) >> 7) % PAIR_CELLS
            for code in codes[self.counts[cells] > 0].tolist():
                data = chr(code).encode("utf-8")
                out.setdefault(data[1:], []).append(chr(code))
                out.setdefault(data[:1], []).append(chr(code))
        return out

    # -- lattices ----------------------------------------------------------------------------------------------------

    def _bytes(self, word: str, read_as: str) -> list[int | None] | None:
        """Bytes under the wrongly read word, None where a byte was lost; None if the word is not of that encoding."""
        table = self.maps.get(read_as)
        out: list[int | None] = []
        for ch in word:
            if ch == LOST:
                out.append(None)
            elif ch < "\x80":
                out.append(ord(ch))
            elif table is not None:
                b = table.get(ch)
                if b is None:
                    return None
                out.append(b)
            else:
                try:
                    out += ch.encode(read_as)
                except UnicodeEncodeError:
                    return None
        return out

    def _utf8(self, data: list[int | None], read_as: str) -> str | None:
        """Best reading of a byte lattice as UTF-8; lost or dropped continuation bytes are searched for."""
        most = sum(b is not None and b >= 0x80 for b in data) // 2  # a lost byte needs two that were kept
        if not most or not self._gaps_at_most(data, most):
            return None
        best = self._search(data, self.silent.get(read_as, []))
        return max(best, key=lambda d: (self.frequency(d[1]), d[0]))[1] if best else None

    def _search(self, data: list[int | None], silent: list[int]) -> list[tuple[float, str]]:
        """The ``BEAM`` best readings of a lattice with their scores; ``silent`` are the bytes the reader has no sign for.

        Hypotheses that end at one place in one character are one, and each
        holds a link to the one before it, so time and memory grow with the
        length of the word, however long it is.
        """
        waiting: dict[int, dict[str, tuple[float, tuple]]] = {0: {"\x02": (0.0, ())}}
        for i in range(len(data)):
            here = waiting.pop(i, None)
            if not here:
                continue
            found = list(self._next(data, i, silent))
            if len(found) > 1:
                found = [o for o in found if int(self.counts[_pair_cell(o[0], "\x00")])] or found
            kept = sorted(here.items(), key=lambda kv: -kv[1][0])[:BEAM]
            for ch, j, used in found:
                score, link = max(((s + self._pair(last, ch), n) for last, (s, n) in kept), key=lambda x: x[0])
                at = waiting.setdefault(j, {})
                score -= 6.0 * used
                if ch not in at or score > at[ch][0]:
                    at[ch] = (score, (link, ch))
        ends = sorted(((s + self._pair(last, "\x03"), n) for last, (s, n) in waiting.get(len(data), {}).items()), key=lambda x: -x[0])[:BEAM]
        return [(score, _text_of(link)) for score, link in ends]

    @staticmethod
    def _gaps_at_most(data: list[int | None], most: int) -> bool:
        """Whether the bytes have the shape of UTF-8 but for so many lost ones: one quick pass before the search."""
        gaps = need = free = 0
        for b in data:
            if b is None:
                if need:
                    need -= 1
                else:  # a first byte: up to three more may follow
                    free = 3
                gaps += 1
            elif 0x80 <= b < 0xC0:
                if need:
                    need -= 1
                elif free:
                    free -= 1
                else:
                    return False
            else:
                gaps, need, free = gaps + need, 0, 0
                if b >= 0xC0:
                    if not 0xC2 <= b <= 0xF4:
                        return False
                    need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
            if gaps > most:
                return False
        return gaps + need <= most

    def _next(self, data: list[int | None], i: int, silent: list[int]) -> Iterator[tuple[str, int, int]]:
        b = data[i]
        if b is not None and b < 0x80:
            yield chr(b), i + 1, 0
            return
        if b is None:  # a lost first byte: characters of the corpus whose other bytes stand here
            tail: list[int] = []
            for t in data[i + 1 : i + 4]:
                if t is None or not 0x80 <= t < 0xC0:
                    break
                tail.append(t)
                for ch in self.known.get(bytes(tail), ()):
                    yield ch, i + 1 + len(tail), 1
            return
        if not 0xC2 <= b <= 0xF4:
            return
        need = 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        tail, j = [], i + 1
        while len(tail) < need and j < len(data) and (data[j] is None or 0x80 <= data[j] < 0xC0):
            tail.append(data[j])
            j += 1
        dropped = need - len(tail)
        holes = dropped + tail.count(None)
        if not holes:
            fills = [()]
        elif holes == 1:
            fills = [(f,) for f in range(0x80, 0xC0)]
        else:  # several bytes of one character: those the reader has no sign for
            fills = list(itertools.product(silent, repeat=holes)) if dropped else []
        seen = set()
        if holes > 1 and not dropped:  # or, where signs stand for them, any character of the corpus that fits
            for ch in self.known.get(bytes([b]), ()):
                code = ch.encode("utf-8")
                if len(code) == need + 1 and all(t is None or t == c for t, c in zip(tail, code[1:])):
                    yield ch, j, holes
        for at in itertools.combinations(range(need), dropped):  # a byte dropped without a sign may have stood at any place
            rest = iter(tail)
            slots = [None if k in at else next(rest) for k in range(need)]
            for fill in fills:
                f = iter(fill)
                try:
                    ch = bytes([b, *(next(f) if t is None else t for t in slots)]).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                if ch not in seen:
                    seen.add(ch)
                    yield ch, j, holes

    def _lost_letters(self, word: str, high: list[str] | None = None) -> str | None:
        """Single-byte text read as UTF-8, or with ``high`` in another multibyte encoding: each replacement sign stands for one letter."""
        high = high or self.latin
        scores, last, steps = np.zeros(1), np.array(["\x02"]), []
        width = 4 * BEAM
        for ch in f"{word}\x03":
            options = high if ch == LOST else [ch]
            names, inverse = np.unique(last, return_inverse=True)
            grown = scores[:, None] + np.stack([self._row(n, options) for n in names.tolist()])[inverse]
            flat = grown.ravel()
            if len(flat) > width:
                top = np.argpartition(-flat, width - 1)[:width]
                top = top[np.argsort(-flat[top], kind="stable")]
            else:
                top = np.argsort(-flat, kind="stable")
            parents, letters = np.divmod(top, len(options))
            scores, last = flat[top], np.array(options)[letters]
            steps.append((parents, last))
        texts = []
        for k in range(min(BEAM, len(scores))):
            out, at = [], k
            for parents, letters in reversed(steps):
                out.append(str(letters[at]))
                at = parents[at]
            texts.append(("".join(reversed(out))[:-1], float(scores[k])))
        return max(texts, key=lambda t: (self.frequency(t[0]), t[1]))[0]

    def _row(self, last: str, options: list[str]) -> np.ndarray:
        """Log counts of the pairs of a character and each option."""
        if len(options) == 1:
            return np.array([self._pair(last, options[0])])
        row = self.rows.get((last, id(options)))
        if row is None:
            row = self.rows[last, id(options)] = np.array([self._pair(last, c) for c in options])
        return row

    def _fill(self, data: list[int | None], true: str) -> str:
        """Single-byte text whose last or undefined bytes a multibyte reader lost, each filled with a letter."""
        return self._lost_letters("".join(LOST if b is None else bytes([b]).decode(true) for b in data), self.high[true])

    # -- channels ----------------------------------------------------------------------------------------------------

    def candidates(self, word: str, depth: int = 0, only: set[str] | None = None) -> Iterator[tuple[str, str, bool]]:
        """``(channel, restoration, strict)`` of every channel that can have produced the word.

        ``strict`` marks UTF-8 read byte by byte without a lost one.  A text
        damaged twice went through the same reader twice.
        """
        if LOST in word and depth == 0 and (only is None or "cp1252>utf-8" in only):
            fixed = self._lost_letters(word)
            if fixed:
                yield "cp1252>utf-8", fixed, False
        readers = None if only is None else {c.rpartition(">")[2] for c in only}
        for read_as in READ_AS:
            if readers is not None and read_as not in readers:
                continue
            data = self._bytes(word, read_as)
            if data is None:
                continue
            raw = None if None in data else bytes(data)
            kept = raw is not None or sum(b is not None and b >= 0x80 for b in data) >= 2 * data.count(None)
            for true in TRUE_ENCODINGS:
                narrow = read_as in MULTIBYTE and true not in MULTIBYTE
                if true == read_as or true != "utf-8" and (depth or raw is None and not (narrow and kept)):
                    continue
                strict = False
                try:
                    text = raw.decode(true) if raw is not None else self._fill(data, true) if narrow else None
                    strict = true == "utf-8" and text is not None
                except UnicodeDecodeError:
                    text = None
                if text is None and true == "utf-8" and not depth:
                    text = self._utf8(data, read_as)
                    if text is None and raw is not None and (cut := _cut_ends(raw)) is not None:
                        text, strict = cut, True
                if not text or text == word:
                    continue
                if not _CONTROL.search(text) and not (true in MULTIBYTE and true != "utf-8" and len(_WIDE.findall(text)) < 2):
                    yield f"{true}>{read_as}", text, strict
                if strict and depth < 2 and read_as in TWICE:
                    for more, deeper, sure in self.candidates(text, depth + 1):
                        if more.split(">")[-1] in TWICE:
                            yield f"{more}+{true}>{read_as}", deeper, sure

    def _typical(self, word: str) -> float:
        """Mean log count of the pairs around a word's characters outside ASCII; very low if one is unknown."""
        level = "".join(pieces(word))
        chars = {c for c in level if c > "\x7f"}
        if not chars or any(not self.counts[_pair_cell(c, "\x00")] for c in chars):
            return -9.0
        pairs = [self._pair(a, b) for a, b in zip(f"\x02{level}", f"{level}\x03") if a > "\x7f" or b > "\x7f"]
        return sum(pairs) / len(pairs)

    def restore(self, word: str) -> tuple[str, str] | None:
        """``(channel, restoration)`` of a damaged word, None for one that stands as it was written.

        Damaged is a word whose restoration stands in ``GAIN`` times as many
        documents; one with letters or digits that reads strictly as UTF-8 into
        characters typical of the corpus; and one with lost signs beside letters
        or digits.
        """
        if word in self.memo:
            return self.memo[word]
        level = _DIGITS.sub("0", word)  # what is sound with one number is sound with another
        if level in self.sound:
            return None
        own, lexical = self.frequency(word), any(c.isascii() and c.isalnum() for c in word)
        lost = LOST in word and any(c.isalnum() for c in word)
        best, found = (False, 0.0, -99.0), None
        seen: dict[str, float] = {}
        for channel, text, strict in self.candidates(word):
            if text not in seen:
                seen[text] = self.frequency(text)
            ratio = seen[text] / max(own, 0.5)
            ok = ratio > GAIN and (ratio > RARE_GAIN or not self._trivial(word, text, channel))
            if not ok and channel.split(">")[-1] not in MULTIBYTE:
                foreign = sum(c > "\x7f" for c in text)
                if strict:
                    ok = foreign > 3 or (lexical or foreign > 2) and self._typical(text) > (-9.0 if _latin(text) else -3.0)
                elif channel.split(">")[0] not in MULTIBYTE and text.count("\ufffd") == 0:
                    letters = sum(c.isalpha() and c > "\x7f" for c in text)
                    if letters >= 6 or _latin(text) and sum(c.isalpha() for c in text) >= 3:
                        floor = max(0.0, self._typical(word)) if letters >= 6 else max(-1.0, self._typical(word) + 1.0)
                        ok = self._typical(text) > floor + SPELLING_GAIN
                elif channel.split(">")[-1] in TWICE and _RUN.search(word) and len(_WIDE.findall(text)) >= 4:
                    # a long run of Latin signs that reads as a script of wide characters
                    ok = own < self.rare or self._typical(text) > self._typical(word)
            elif not ok and self._narrow(channel):  # letters that a multibyte reader joined to wide characters
                ok = self._spelled(word, text)
            if ok or lost and LOST not in text and not self._narrow(channel):
                rank = (strict, seen[text], self._typical(text))  # a reading without a gap before a mere likeness
                if rank > best:
                    best, found = rank, (channel, text)
        if found is None and lost:
            found = ("cp1252>utf-8", word)
        if found is None:
            if len(self.sound) > 200_000:
                self.sound.clear()
            self.sound.add(level)
        else:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[word] = found
        return found

    @staticmethod
    def _narrow(channel: str) -> bool:
        """Single-byte text read in a multibyte encoding of wide characters."""
        true, _, read_as = channel.rpartition(">")
        return read_as in MULTIBYTE and read_as != "utf-8" and true not in MULTIBYTE

    def _spelled(self, word: str, text: str) -> bool:
        """Whether wide characters stand for letters: alone for six or more, beside letters for any, by commoner pairs."""
        if not _word_like(text):
            return False
        letters = sum(c.isalpha() and c > "\x7f" for c in text)
        if letters < 6 and not (_MIXED.search(word) and sum(c.isalpha() for c in text) >= 3):
            return False
        return self._typical(text) > max(-1.0, self._typical(word)) + SPELLING_GAIN

    @staticmethod
    def _trivial(word: str, text: str, channel: str) -> bool:
        """One sign for another in a single-byte channel is no evidence: any sign maps to some sign."""
        if channel.split(">")[0] in MULTIBYTE or LOST in word:
            return False
        return sum(c.isalpha() for c in text) < 3


    def restore_text(self, text: str) -> tuple[str, list[str]]:
        """The text with its damaged words restored, and the channels met."""
        channels: list[str] = []

        def fix(word: str) -> str:
            found = self.restore(word)
            if found is None:
                return word
            channels.append(found[0])
            return found[1]

        fixed = replace_words(text, fix)
        if channels:  # words that were no evidence alone follow the channels proven in this text
            proven = set(channels)

            def follow(word: str) -> str:
                own, options = self.frequency(word), []
                for channel, t, strict in self.candidates(word, only=proven):
                    if channel in proven and LOST not in t and (strict or self.frequency(t) > own or self._narrow(channel) and _MIXED.search(word) and _word_like(t)):
                        options.append((self.frequency(t), self._typical(t), t))
                return max(options)[2] if options else word

            fixed = replace_words(fixed, follow)
        return fixed, channels


def restore_documents(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """``(row id, n_spans, channels, restored)`` of the documents read in a wrong encoding, wholly or in part.

    Null, empty and blank texts are no cases, nor are texts of plain ASCII.
    ``channels`` lists ``true>read`` encodings, ``restored`` is the whole text
    with every damaged word restored as far as it can be.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(corpus_counts(df, text))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            rows = []
            for rid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and not t.isascii():
                    fixed, channels = decoder.restore_text(t)
                    if channels:
                        rows.append((rid, len(channels), sorted(set(channels)), fixed))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.string()))], names=[row_id, "n_spans", "channels", "restored"]
                )

    return df.select(row_id, text).mapInArrow(scan, f"`{row_id}` bigint, n_spans int, channels array<string>, restored string")
