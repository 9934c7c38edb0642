"""Schema trees, minimum-cost edit scripts between them, and the value profiles that price a rename.

A schema is a tree of named fields: those of the record, and those of the
objects inside list fields.  Two trees are compared by a tree edit distance over
unordered siblings: a matched pair costs its rename price plus the distance of
the subtrees, an unmatched node costs the size of its subtree as an addition or
deletion, the cheapest assignment of siblings is solved at every level, and a
deletion and an addition that fit each other at different parents are a move.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

# Value types, as bits of a mask.
INTEGER, DECIMAL, STRING, BOOLEAN, OBJECT, OBJECTS, STRINGS, OTHERS = (1 << i for i in range(8))
TYPE_NAMES = {
    INTEGER: "integer", DECIMAL: "decimal", STRING: "string", BOOLEAN: "boolean", OBJECT: "object",
    OBJECTS: "array of objects", STRINGS: "array of strings", OTHERS: "array of other values",
}


@lru_cache(maxsize=65_536)
def norm(name: str) -> str:
    """Name without case, blanks and punctuation."""
    return re.sub(r"[\W_]+", "", name).lower()


def read_record(payload: str | None) -> dict | None:
    """The record of a payload, or None if it is null or no readable JSON object."""
    if payload is None:
        return None
    try:
        record = json.loads(payload)
    except (ValueError, RecursionError):
        return None
    return record if isinstance(record, dict) else None


_MASK_OF = {int: INTEGER, float: DECIMAL, str: STRING, bool: BOOLEAN, dict: OBJECT}


def type_mask(values: list) -> int:
    """Value types of JSON values; nulls and lists without a value have none."""
    mask, kinds = 0, set(map(type, values))
    for kind in kinds:
        mask |= _MASK_OF.get(kind, 0)
    if list in kinds:
        for kind in {type(e) for v in values if type(v) is list for e in v}:
            mask |= OBJECTS if kind is dict else STRINGS if kind is str else 0 if kind is type(None) else OTHERS
    return mask


def children(value: object) -> tuple[list, bool]:
    """Elements of a list however it is written, and whether it was written as a list.

    A JSON text inside a string is read; an object or scalar alone is one child;
    a string that is no JSON is split at ``;``.  Null and blank strings have no
    children.
    """
    if isinstance(value, str):
        text = value.strip()
        if not text:
            return [], True
        if text[0] in "[{" or text == "null":
            try:
                return children(json.loads(text))
            except (ValueError, RecursionError):
                pass
        parts = [p.strip() for p in text.split(";")]
        return [p or None for p in parts], len(parts) > 1
    if value is None:
        return [], True
    if isinstance(value, list):
        return value, True
    return [value], False


# ---- value profiles -------------------------------------------------------------------------------------------------

_BLOCKS = {"kind": 5, "size": 26, "truth": 2, "shape": 32, "words": 24, "length": 6, "inner": 32}
PROFILE_SIZE = sum(_BLOCKS.values())
#: The first cells count the kinds of values: their sum is the number of values.
KINDS = _BLOCKS["kind"]
_START = dict(zip(_BLOCKS, np.cumsum([0, *_BLOCKS.values()]).tolist()))
_RUNS = re.compile("([A-Z]+)|([a-z]+)|([0-9]+)")


def _shape(text: str) -> str:
    """Runs of capitals, small letters and digits as U, L and D, long runs twice."""
    return _RUNS.sub(lambda m: "ULD"[m.lastindex - 1] * (1 if m.end() - m.start() < 5 else 2), text)[:24]


def _bucket(text: str, n: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % n


_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?")


@lru_cache(maxsize=65_536)
def _text_cells(value: str) -> tuple[int, ...]:
    cells = [_START["kind"] + 3, _START["shape"] + _bucket(_shape(value), _BLOCKS["shape"]), _START["length"] + min(5, int(math.log2(len(value) + 1)))]
    if len(value) <= 16 and not re.search(r"\d", value):
        cells.append(_START["words"] + _bucket(value.lower(), _BLOCKS["words"]))
    return tuple(cells)


@lru_cache(maxsize=65_536)
def _read_text(value: str) -> object:
    """A text that writes a truth value, a number or a JSON value as that value, others as they are."""
    low = value.strip().lower()
    if low in ("true", "false"):
        return low == "true"
    if _NUMBER.fullmatch(low):
        return float(low) if "." in low or "e" in low else int(low)
    if low[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except (ValueError, RecursionError):
            pass
    return value


@lru_cache(maxsize=4096)
def _name_cell(name: str) -> int:
    return _START["inner"] + _bucket(norm(name), _BLOCKS["inner"])


_KIND, _SIZE, _TRUTH = (_START[k] for k in ("kind", "size", "truth"))


def add_to_profile(vec: np.ndarray, values: list, depth: int = 0) -> None:
    """Count JSON values into a profile vector, all values of a type at once."""
    kinds = Counter(map(type, values))
    numbers = kinds.get(float, 0) + kinds.get(int, 0)
    if numbers:
        x = np.array([v if -1e300 < v < 1e300 else math.copysign(1e300, v) for v in values if type(v) is float or type(v) is int], dtype=float)
        with np.errstate(invalid="ignore"):
            whole = int((np.floor(x) == x).sum())
            size = np.where(np.isnan(x), 7.0, np.log10(np.abs(x) + 1e-7))
        vec[_KIND + 1] += whole
        vec[_KIND + 2] += numbers - whole
        vec[_SIZE : _SIZE + 26] += np.bincount(np.clip(((size + 6.5) * 2).astype(int), 0, 25), minlength=26)
        if int in kinds:
            for v in (0, 1):
                vec[_TRUTH + v] += sum(1 for w in values if w == v and type(w) is int)
    if bool in kinds:
        yes = sum(1 for v in values if v is True)
        vec[_KIND] += kinds[bool]
        vec[_TRUTH + 1] += yes
        vec[_TRUTH] += kinds[bool] - yes
    if str in kinds:
        read = []
        for text, n in Counter(v for v in values if type(v) is str).items():
            short = len(text) <= 64
            value = _read_text(text) if short else _read_text.__wrapped__(text)  # long texts are not kept
            if type(value) is str:
                for i in _text_cells(value) if short else _text_cells.__wrapped__(value):
                    vec[i] += n
            else:
                read += [value] * n
        if read:
            add_to_profile(vec, read, depth)
    if dict in kinds:
        vec[_KIND + 4] += kinds[dict]
        for name, n in Counter(k for v in values if type(v) is dict for k in v).items():
            vec[_name_cell(name)] += n
    if list in kinds and depth < 3:
        add_to_profile(vec, [e for v in values if type(v) is list for e in v], depth + 1)


_WEIGHED = ("size", "truth", "shape", "words", "length", "inner")


def profile_distances(a: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of a profile to each row of others: 0 for the same kind of values, 1 for nothing in common."""
    x = np.vstack([a[None, :], others])
    total = x[:, _KIND : _KIND + 5].sum(axis=1)
    safe = np.where(total > 0, total, 1.0)
    k = x[:, _KIND : _KIND + 5] / safe[:, None]
    # 0/1 written as numbers or as truth values are the same kind of thing
    truth = x[:, _TRUTH : _TRUTH + 2].sum(axis=1) / safe
    merged = np.stack([np.minimum(1.0, truth), np.maximum(0.0, k[:, 1] + k[:, 2] - np.maximum(0.0, truth - k[:, 0])), k[:, 3], k[:, 4]], axis=1)
    base = np.abs(merged[1:] - merged[0]).sum(axis=1) / 2
    inside, weight = np.zeros(len(others)), np.zeros(len(others))
    for block in _WEIGHED:
        part = x[:, _START[block] : _START[block] + _BLOCKS[block]]
        t = part.sum(axis=1)
        p = part / np.where(t > 0, t, 1.0)[:, None]
        share = np.minimum(1.0, t / safe)
        w = (share[1:] + share[0]) / 2
        d = np.where((t[1:] > 0) & (t[0] > 0), np.abs(p[1:] - p[0]).sum(axis=1) / 2, 1.0)
        inside += w * d
        weight += w
    inside = np.where(weight > 0, inside / np.where(weight > 0, weight, 1.0), 1.0)
    return np.where((total[1:] > 0) & (total[0] > 0), 0.4 * np.minimum(1.0, base) + 0.6 * inside, 1.0)


def profile_distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(profile_distances(a, b[None, :])[0])


# ---- edit scripts ---------------------------------------------------------------------------------------------------

#: Cost of removing or adding one node; a rename dearer than both together is none.
UNIT = 0.375
#: Cost of a change of value types.
RETYPE = 0.125
INF = math.inf
FORBIDDEN = 1e9


@dataclass
class Node:
    """A field of a schema: what it stands for, how it is written, its value types, inner fields, and its values' profile."""

    canonical: str
    names: frozenset[str] = frozenset()
    mask: object = 0
    inner: dict[str, "Node"] = field(default_factory=dict)
    known: bool = True
    profile: np.ndarray | None = None
    price: float = 0.0
    types: object = 0

    def size(self) -> int:
        return 1 + sum(n.size() for n in self.inner.values())


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of minimum total cost, every row used; there are at least as many columns as rows.

    Shortest augmenting paths with potentials, one row after the other.
    """
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        low, before, used = np.full(m, INF), np.full(m, -1), np.zeros(m, bool)
        row, last = i, -1
        while True:
            free = ~used
            reduced = cost[row] - u[row] - v
            closer = free & (reduced < low)
            low[closer], before[closer] = reduced[closer], last
            col = int(np.where(free, low, INF).argmin())
            step = low[col]
            held = np.flatnonzero(used)
            u[i] += step
            u[row_of[held]] += step
            v[held] -= step
            low[free] -= step
            used[col] = True
            last, row = col, row_of[col]
            if row < 0:
                break
        while last >= 0:
            previous = before[last]
            row_of[last] = row_of[previous] if previous >= 0 else i
            last = previous
    return sorted((int(r), c) for c, r in enumerate(row_of) if r >= 0)


@dataclass
class Edit:
    """Minimum-cost edit of one sibling set into another: matched pairs with the edits below them, and what is left on both sides."""

    cost: float
    pairs: list[tuple[Node, Node, "Edit | None"]]
    removed: list[Node]
    added: list[Node]


def same_names(old: list[Node], new: list[Node], parents: tuple[Node, Node] | None = None) -> list[tuple[int, int]]:
    """Pairs of one canonical name, which is unique among siblings."""
    at = {b.canonical: j for j, b in enumerate(new)}
    return [(i, at[a.canonical]) for i, a in enumerate(old) if a.canonical in at]


def tree_edit(old: list[Node], new: list[Node], rename, inner_counts=lambda a, b: True, sure=same_names, parents: tuple[Node, Node] | None = None) -> Edit:
    """Tree edit distance over unordered siblings: a minimum-cost assignment whose entries hold the distances of the subtrees.

    ``rename(a, b, parents)`` prices writing ``a`` as ``b`` (infinite if they
    can't be the same); a matched pair costs that, ``RETYPE`` if the value types
    differ, and the distance of the inner fields where ``inner_counts``; an
    unmatched node costs ``UNIT`` for each node of its subtree.  ``sure`` gives
    the pairs that no other node may take part in; all others go through one
    assignment.
    """
    below: dict[tuple[int, int], Edit] = {}

    def match(i: int, j: int) -> float:
        a, b = old[i], new[j]
        p = rename(a, b, parents)
        if p < INF and (a.inner or b.inner) and inner_counts(a, b):
            below[i, j] = tree_edit(list(a.inner.values()), list(b.inner.values()), rename, inner_counts, sure, (a, b))
            p += below[i, j].cost
        return p + (RETYPE if a.mask != b.mask else 0.0)

    pairs = sure(old, new, parents)
    cost = sum(match(i, j) for i, j in pairs)
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    rows, cols = [i for i in range(len(old)) if i not in left], [j for j in range(len(new)) if j not in right]
    gone, come = np.array([UNIT * old[i].size() for i in rows]), np.array([UNIT * new[j].size() for j in cols])
    if rows and cols:
        price = np.array([[match(i, j) for j in cols] for i in rows]) - come[None, :]
        better = price < gone[:, None]
        if better.any():
            if len(rows) == 1 or len(cols) == 1:  # one pair at most
                r, c = divmod(int(np.where(better, price - gone[:, None], INF).argmin()), len(cols))
                chosen = [(r, c)]
            else:
                full = np.hstack([np.where(better, price, FORBIDDEN), np.where(np.eye(len(rows), dtype=bool), gone[:, None], FORBIDDEN)])
                chosen = [(r, c) for r, c in assign(full) if c < len(cols)]
            cost += sum(float(price[r, c] + come[c]) for r, c in chosen)
            pairs = pairs + [(rows[r], cols[c]) for r, c in chosen]
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    removed, added = [a for i, a in enumerate(old) if i not in left], [b for j, b in enumerate(new) if j not in right]
    cost += UNIT * sum(n.size() for n in (*removed, *added))
    return Edit(float(cost), [(old[i], new[j], below.get((i, j))) for i, j in sorted(pairs)], removed, added)


def same_field(a: Node, b: Node, parents: tuple[Node, Node] | None = None) -> float:
    """Price of writing one file's field as another file's: nothing for the same names, a rename for the same meaning.

    The meaning is the canonical field, whose own price (the profile's distance)
    counts in; two fields that fit no canonical one are compared by their profiles.
    """
    if a.canonical == b.canonical:
        return 0.0 if a.names == b.names else 0.125 + 0.0625 * (min(1.0, a.price) + min(1.0, b.price))
    if a.known or b.known or a.profile is None or b.profile is None:
        return INF
    return 0.125 + 0.75 * profile_distance(a.profile, b.profile)


def both_objects(a: Node, b: Node) -> bool:
    return a.mask == b.mask == OBJECTS


def _steps(edit: Edit, prefix: str = "") -> list[tuple[str, str]]:
    out = []
    for a, b, below in edit.pairs:
        path = prefix + b.canonical
        if a.names != b.names:
            out.append((path, "renamed"))
        if a.mask != b.mask:
            out.append((path, "retyped"))
        if below is not None:
            out += _steps(below, path + ".")
    return out + [(prefix + a.canonical, "removed") for a in edit.removed] + [(prefix + b.canonical, "added") for b in edit.added]


def edit_script(old: dict[str, Node], new: dict[str, Node]) -> tuple[float, list[tuple[str, str]]]:
    """Minimum cost and the (field, operation) steps that turn one schema into the other, without moves."""
    edit = tree_edit(list(old.values()), list(new.values()), same_field, both_objects)
    return edit.cost, _steps(edit)


def _loose(edit: Edit, prefix: tuple[str, ...] = ()) -> tuple[list[tuple[tuple[str, ...], Node]], list[tuple[tuple[str, ...], Node]]]:
    """Removed and added nodes with their parents' paths, those of whole removed or added subtrees included."""

    def all_below(at: tuple[str, ...], n: Node) -> list[tuple[tuple[str, ...], Node]]:
        return [(at, n), *[x for m in n.inner.values() for x in all_below((*at, n.canonical), m)]]

    gone = [x for n in edit.removed for x in all_below(prefix, n)]
    come = [x for n in edit.added for x in all_below(prefix, n)]
    for _, b, below in edit.pairs:
        if below is not None:
            g, c = _loose(below, (*prefix, b.canonical))
            gone, come = gone + g, come + c
    return gone, come


def edit_script_with_moves(old: dict[str, Node], new: dict[str, Node]) -> tuple[float, list[tuple[str, str, str | None]]]:
    """The script as ``(field, operation, new place)``: a removal and an addition of one field under different parents is a move.

    What the siblings' assignments left over is assigned once more across
    parents; a move costs one ``UNIT`` (half of removing and adding) beside the
    rename and the retype, and comes about only where that is cheaper.
    """
    edit = tree_edit(list(old.values()), list(new.values()), same_field, both_objects)
    gone, come = _loose(edit)
    moves: list[tuple[str, str]] = []
    cost = edit.cost
    if gone and come:
        price = np.full((len(gone), len(come)), INF)
        for i, (pa, a) in enumerate(gone):
            for j, (pb, b) in enumerate(come):
                if pa != pb:
                    near = 0.0 if a.names & b.names or norm(a.canonical) == norm(b.canonical) else same_field(a, b)
                    p = UNIT + near + (RETYPE if a.mask != b.mask else 0.0)
                    if p < 2 * UNIT:
                        price[i, j] = p - 2 * UNIT
        full = np.hstack([np.where(np.isfinite(price), price, FORBIDDEN), np.where(np.eye(len(gone), dtype=bool), 0.0, FORBIDDEN)])
        for i, j in assign(full):
            if j < len(come):
                cost += float(price[i, j])
                moves.append((".".join((*gone[i][0], gone[i][1].canonical)), ".".join((*come[j][0], come[j][1].canonical))))
    from_, to = {a for a, _ in moves}, {b for _, b in moves}
    rest = [(p, k, None) for p, k in _steps(edit) if not (k == "removed" and p in from_ or k == "added" and p in to)]
    return cost, rest + [(a, "moved", b) for a, b in moves]
