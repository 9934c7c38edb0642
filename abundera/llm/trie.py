"""A trie of reference entries with alias paths, searched by a Levenshtein automaton."""

from __future__ import annotations

from collections.abc import Iterable


class Trie:
    """Reference entries and their alias paths: ``(key, target)`` or ``(key, target, kind)``, each kind below a root of its own."""

    ENTRY = ""

    def __init__(self, entries) -> None:
        self.nodes: list[dict[str, int]] = [{}]
        self.roots: dict[str, int] = {self.ENTRY: 0}
        self.ends: dict[int, set[int]] = {}
        self.keys: dict[int, str] = {}
        for key, target, *kind in entries:
            self._insert(key, target, kind[0] if kind else self.ENTRY)

    def _insert(self, key: str, target: int, kind: str) -> None:
        at = self.roots.get(kind)
        if at is None:
            at = self.roots[kind] = len(self.nodes)
            self.nodes.append({})
        for ch in key:
            nxt = self.nodes[at].get(ch)
            if nxt is None:
                nxt = len(self.nodes)
                self.nodes[at][ch] = nxt
                self.nodes.append({})
            at = nxt
        self.ends.setdefault(at, set()).add(target)
        self.keys[at] = key

    def find(self, key: str, kind: str = ENTRY) -> set[int]:
        """Targets of the path that spells the key exactly."""
        at = self.roots.get(kind)
        for ch in key:
            if at is None:
                return set()
            at = self.nodes[at].get(ch)
        return self.ends.get(at, set()) if at is not None else set()

    def prefixes(self, text: str, start: int, kind: str = ENTRY) -> list[tuple[int, set[int]]]:
        """``(end, targets)`` of all paths that spell a part of the text from ``start``."""
        at, out = self.roots.get(kind), []
        for i in range(start, len(text)):
            at = self.nodes[at].get(text[i]) if at is not None else None
            if at is None:
                break
            if at in self.ends:
                out.append((i + 1, self.ends[at]))
        return out

    def within(self, word: str, limit: int, allowed) -> list[tuple[int, str, int]]:
        """All ``(distance, key, target)`` whose distance is at most ``limit`` and ``allowed(key)``."""
        auto = LevenshteinAutomaton(word, limit)
        found, stack = [], [(0, auto.start)]
        while stack:
            node, state = stack.pop()
            if node in self.ends:
                d = auto.distance(state)
                if d is not None and d <= allowed(self.keys[node]):
                    found += [(d, self.keys[node], t) for t in self.ends[node]]
            for ch, nxt in self.nodes[node].items():
                after = auto.step(state, ch)
                if after is not None:
                    stack.append((nxt, after))
        return sorted(found)


class LevenshteinAutomaton:
    """Deterministic automaton, built as far as it is walked, of all texts within ``limit`` edits of a word.

    Edits are insertion, deletion, substitution and the swap of neighbours.  A
    state holds, per number of edits, the set of word prefixes reached (as
    bits), that set one step earlier, and the last character, which a swap needs.
    """

    def __init__(self, word: str, limit: int) -> None:
        self.limit, self.last = limit, 1 << len(word)
        self.full = (self.last << 1) - 1
        self.at: dict[str, int] = {}
        for i, ch in enumerate(word):
            self.at[ch] = self.at.get(ch, 0) | 1 << i
        first = tuple(((1 << (e + 1)) - 1) & self.full for e in range(limit + 1))
        self.start = (first, None, "")
        self.memo: dict[tuple, tuple | None] = {}

    def step(self, state: tuple, ch: str) -> tuple | None:
        """The state after one more character, None if no text through it can be accepted."""
        key = (state, ch)
        if key in self.memo:
            return self.memo[key]
        now, before, prev = state
        hit, swap = self.at.get(ch, 0), 0
        if before is not None:
            swap = hit & (self.at.get(prev, 0) >> 1)
        out, lower = [], 0
        for e in range(self.limit + 1):
            bits = (now[e] & hit) << 1
            if e:
                bits |= now[e - 1] | now[e - 1] << 1 | lower << 1
                if before is not None:
                    bits |= (before[e - 1] & swap) << 2
            lower = bits & self.full
            out.append(lower)
        after = (tuple(out), now, ch) if any(out) else None
        self.memo[key] = after
        return after

    def distance(self, state: tuple) -> int | None:
        """Edits after which the word is matched in full, None if it is not."""
        for e, bits in enumerate(state[0]):
            if bits & self.last:
                return e
        return None


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps between two texts; letters may come between swapped ones."""
    far = len(a) + len(b)
    last: dict[str, int] = {}
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (not same), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[-1][-1]
