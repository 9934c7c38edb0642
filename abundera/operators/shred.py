"""Columnar shredding of nested records into related flat tables.

Every repeated path of a record set becomes one stream of (repetition level,
definition level) pairs, one entry per list slot or missing list, as in a
columnar file; every leaf below it a stream over the same repetition levels with
definition levels of its own.  The child tables are rebuilt from these streams
alone: a child's place in each list follows from the repetition levels, whether
it is there at all from the definition levels.

Levels of a path with ``m`` repeated nodes: a slot that exists at depth ``k``
has definition level ``2k - 1``, a slot that holds a value ``2k``; a missing or
empty list stops at ``2(k - 1)``.  A leaf of a slot that holds a value has
``2m`` where the field is absent, ``2m + 1`` where it is null, ``2m + 2`` where
it has a value.  Repetition level ``k`` means that the entry continues the list
at depth ``k``; 0 starts a new record.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from abundera.operators import schema_tree as S
from abundera.operators.drift import DropColumns, NameMap, Resolved


@dataclass
class Stream:
    """Level stream of one repeated path over a batch, and the streams of its leaves.

    A leaf's levels are kept for the slots where the field is present (``at``
    gives them); in all others the field is absent.
    """

    depth: int
    record: list[int] = field(default_factory=list)
    rep: list[int] = field(default_factory=list)
    definition: list[int] = field(default_factory=list)
    leaves: dict[str, "Leaf"] = field(default_factory=dict)

    def add(self, record: int, rep: int, definition: int) -> None:
        self.record.append(record)
        self.rep.append(rep)
        self.definition.append(definition)


@dataclass
class Leaf:
    at: list[int] = field(default_factory=list)
    value: list = field(default_factory=list)

    def definition(self, stream: Stream) -> np.ndarray:
        """Definition levels over the whole stream, from those of the slots up."""
        out = np.asarray(stream.definition, dtype=np.int64)
        out = out.copy()
        out[self.at] = [2 * stream.depth + (1 if v is None else 2) for v in self.value]
        return out


def places(rep: np.ndarray, depth: int) -> np.ndarray:
    """Place at each depth of every entry, from the repetition levels alone: shape (entries, depth)."""
    n = len(rep)
    out = np.zeros((n, depth), dtype=np.int64)
    at = np.arange(n)
    for k in range(1, depth + 1):
        steps = np.cumsum(rep == k)
        start = np.maximum.accumulate(np.where(rep < k, at, 0))  # last entry that opened a new list at this depth
        out[:, k - 1] = steps - steps[start]
    return out


def assemble(stream: Stream) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Record index, places and stream index of every child that is there."""
    rep, definition = np.asarray(stream.rep, dtype=np.int64), np.asarray(stream.definition, dtype=np.int64)
    if not len(rep):
        return np.zeros(0, int), np.zeros((0, stream.depth), int), np.zeros(0, int)
    there = np.flatnonzero(definition == 2 * stream.depth)
    return np.asarray(stream.record)[there], places(rep, stream.depth)[there], there


def shred_value(streams: dict[tuple[str, ...], Stream], paths: dict, path: tuple[str, ...], record: int, rep: int, value: object, base: int, leaf_of: Callable | None) -> None:
    """Append the level entries of one list value, and of the lists inside its elements, to the streams.

    ``paths`` is the tree of repeated paths below this one; ``base`` is the
    definition level of the parent slot (it holds a value); ``leaf_of(path,
    name)`` names the leaves, none are kept without it.
    """
    elements = S.children(value)[0]
    depth, n = len(path), len(elements)
    stream = streams[path]
    if not n:
        stream.add(record, rep, base)
        for name, below in paths.items():
            _missing(streams, below, (*path, name), record, rep, base)
        return
    start = len(stream.record)
    stream.record += [record] * n
    stream.rep += [rep] + [depth] * (n - 1)
    stream.definition += [base + 1 if e is None else base + 2 for e in elements]
    if leaf_of is not None:
        for i, element in enumerate(elements, start):
            for k, v in element.items() if type(element) is dict else (("value", element),) if element is not None else ():
                name = leaf_of(path, k)
                if name in paths:
                    continue
                leaf = stream.leaves.get(name)
                if leaf is None:
                    leaf = stream.leaves[name] = Leaf()
                if leaf.at and leaf.at[-1] == i:  # the same field under two names: a value goes before null
                    if leaf.value[-1] is None:
                        leaf.value[-1] = v
                    continue
                leaf.at.append(i)
                leaf.value.append(v)
    for name, below in paths.items():
        for i, element in enumerate(elements):
            r = rep if i == 0 else depth
            if type(element) is dict:
                shred_value(streams, below, (*path, name), record, r, _inner(element, name), base + 2, leaf_of)
            else:
                _missing(streams, below, (*path, name), record, r, base + 1 if element is None else base + 2)


def _inner(element: dict, name: str) -> object:
    """Value of an inner list, however its name is written."""
    if name in element:
        return element[name]
    want = S.norm(name)
    return next((v for k, v in element.items() if S.norm(k) == want), None)


def _missing(streams: dict[tuple[str, ...], Stream], paths: dict, path: tuple[str, ...], record: int, rep: int, level: int) -> None:
    streams[path].add(record, rep, level)
    for name, below in paths.items():
        _missing(streams, below, (*path, name), record, rep, level)


def _all_paths(paths: dict, prefix: tuple[str, ...] = ()) -> list[tuple[str, ...]]:
    return [p for name, below in paths.items() for p in ((*prefix, name), *_all_paths(below, (*prefix, name)))]


_DIGITS = [str(i) for i in range(4096)]


def _pos(place: np.ndarray) -> list[str]:
    if place.shape[1] == 1:
        return [_DIGITS[p] if p < 4096 else str(p) for p in place[:, 0].tolist()]
    return [".".join(map(str, p)) for p in place.tolist()]


def _shred(df: DataFrame, paths: dict, resolved: Resolved, c: DropColumns, leaves: bool, emit: Callable, ddl: str, names_out: list[str]) -> DataFrame:
    """Read every payload through its file's projection into level streams, one set a batch, and ``emit`` rows of them."""
    every, names = _all_paths(paths), resolved.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str | None, NameMap] = {None: names}
        for batch in batches:
            ids, payloads, others = (batch.column(i).to_pylist() for i in range(3))
            streams = {p: Stream(len(p)) for p in every}
            root = Stream(0)
            for i, (payload, other) in enumerate(zip(payloads, others)):
                record = S.read_record(payload)
                if other not in maps:
                    if len(maps) > 10_000:
                        maps = {None: names}
                    maps[other] = names.changed(other)
                use = maps[other]
                found: dict[str, object] = {}
                for k, v in (record or {}).items():
                    f = use.of(k)
                    if found.get(f) is None:  # of one field under two names a value goes before null
                        found[f] = v
                leaf_of = (lambda path, k: use.of_inner(path[0], k) if len(path) == 1 else S.norm(k)) if leaves else None
                for name, below in paths.items():
                    shred_value(streams, below, (name,), i, 0, found.get(name), 0, leaf_of)
                if leaves and record is not None:
                    at = len(root.record)
                    root.add(i, 0, 0)
                    for f, v in found.items():
                        if f not in paths:
                            leaf = root.leaves.setdefault(f, Leaf())
                            leaf.at.append(at)
                            leaf.value.append(v)
            if leaves:
                streams[()] = root
            for path, stream in streams.items():
                for cols in emit(ids, path, stream):
                    yield pa.RecordBatch.from_arrays(cols, names=names_out)

    rows = resolved.attach(df.select(c.row_id, c.payload, c.source, c.file), c)
    return rows.select(c.row_id, c.payload, "_names").mapInArrow(scan, ddl)


def shred_payloads(df: DataFrame, paths: dict, resolved: Resolved, columns: DropColumns = DropColumns()) -> DataFrame:
    """Child rows of raw JSON records: ``(row id, path, pos)``.

    ``paths`` is the tree of repeated paths (``{"intensities": {}, ...}``).
    Lists count however they are written (array, JSON text, one object or value
    without a list, text split by ``;``); null children keep their place but
    give no row; unreadable payloads and missing or empty lists give no rows.
    ``pos`` joins the places in all lists from the record down with dots, from 0.
    """

    def emit(ids: list, path: tuple[str, ...], stream: Stream):
        record, place, there = assemble(stream)
        if len(there):
            yield [pa.array(ids, pa.int64()).take(pa.array(record)), pa.array([".".join(path)] * len(there)), pa.array(_pos(place))]

    return _shred(df, paths, resolved, columns, False, emit, f"`{columns.row_id}` bigint, path string, pos string", [columns.row_id, "path", "pos"])


def shred_leaves(df: DataFrame, paths: dict, resolved: Resolved, columns: DropColumns = DropColumns()) -> DataFrame:
    """Every leaf of raw JSON records: ``(row id, path, pos, leaf, value)`` from the leaves' level streams.

    Path and pos are '' for the fields of the record itself (the parent).  A
    null field gives a row with the value null, an absent one none; a child
    without any field gives none here but stands in ``shred_payloads``.  A value
    that is no object has the leaf ``value``.  Texts come out as they are, other
    values as JSON.
    """

    def text(v: object) -> str | None:
        return v if v is None or type(v) is str else json.dumps(v, ensure_ascii=False)

    def emit(ids: list, path: tuple[str, ...], stream: Stream):
        if not stream.record:
            return
        rep, record = np.asarray(stream.rep, dtype=np.int64), np.asarray(stream.record)
        place = places(rep, stream.depth)
        for name, leaf in stream.leaves.items():
            levels = leaf.definition(stream)
            at = np.flatnonzero(levels > 2 * stream.depth)  # null or a value
            if not len(at):
                continue
            values = pa.array([text(v) for v in leaf.value], pa.string())
            pos = _pos(place[at]) if stream.depth else [""] * len(at)
            yield [pa.array(ids, pa.int64()).take(pa.array(record[at])), pa.array([".".join(path)] * len(at)), pa.array(pos), pa.array([name] * len(at)), values]

    names = [columns.row_id, "path", "pos", "leaf", "value"]
    return _shred(df, paths, resolved, columns, True, emit, f"`{columns.row_id}` bigint, path string, pos string, leaf string, value string", names)


# ---- typed lists: levels straight from Arrow's offsets -----------------------------------------------------------------


def deeper(record: np.ndarray, rep: np.ndarray, definition: np.ndarray, depth: int, lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Levels one list further down, vectorised over the offsets; ``lists`` are those of the entries that hold a value at ``depth``.

    Returns the record indices, repetition and definition levels of the new
    entries, and the elements of the slots that exist.
    """
    holds = definition == 2 * depth
    lengths = np.zeros(len(record), dtype=np.int64)
    valid = np.asarray(lists.is_valid())
    lengths[holds] = np.where(valid, np.diff(lists.offsets.to_numpy(zero_copy_only=False)), 0)
    slots = np.maximum(lengths, 1)
    first = np.zeros(int(slots.sum()), dtype=bool)
    first[np.cumsum(slots) - slots] = True
    elements = lists.flatten()
    new_definition = np.repeat(definition, slots)
    new_definition[np.repeat(lengths > 0, slots)] = 2 * depth + np.where(np.asarray(elements.is_valid()), 2, 1)
    return np.repeat(record, slots), np.where(first, np.repeat(rep, slots), depth + 1), new_definition, elements


def without_nan(leaf: pa.Array) -> pa.Array:
    """A leaf column with NaN as null; columns of other types as they are."""
    return pc.if_else(pc.is_nan(leaf), pa.scalar(None, leaf.type), leaf) if pa.types.is_floating(leaf.type) else leaf


def list_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Paths of all lists of a typed schema, outer before inner, with dots."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            out.append(prefix + f.name)
            if isinstance(f.dataType.elementType, T.StructType):
                out += list_paths(f.dataType.elementType, f"{prefix}{f.name}.")
    return out


def parent_table(df: DataFrame) -> DataFrame:
    """The records themselves: every column that is no list."""
    return df.select(*[f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, T.ArrayType)])


def child_table(df: DataFrame, row_id: str, path: str) -> DataFrame:
    """Children at one list path of a typed table as a flat table with parent id and place.

    ``path`` is a list column, or one inside the elements of another
    (``modifications.positions``).  A list of structs gives one column per field
    that is no list itself, a list of scalars the column ``value``; inner fields
    keep their types.  ``pos`` is the place in the list, in nested lists the
    places from the record down joined by dots, so that the parent's row is the
    one whose pos is this without the last place.  A field named like the id or
    ``pos`` is prefixed by the list's name.  Null and empty lists give no rows,
    null elements keep their place but give no row; NaN is no value and comes
    out null.
    """
    steps = path.split(".")
    column, element = steps[0], df.schema[steps[0]].dataType.elementType
    for s in steps[1:]:
        element = element[s].dataType.elementType
    struct, depth = isinstance(element, T.StructType), len(steps)
    inner = [(f.name, f.dataType) for f in element.fields if not isinstance(f.dataType, T.ArrayType)] if struct else [("value", element)]
    out = [(n if n not in (row_id, "pos") else f"{steps[-1]}_{n}", t) for n, t in inner]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            record, rep, definition, lists = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), batch.column(1)
            for k, step in enumerate(steps):
                if k:
                    lists = pc.struct_field(elements, step)
                record, rep, definition, elements = deeper(record, rep, definition, k, lists)
                elements = elements.filter(elements.is_valid())
            there = np.flatnonzero(definition == 2 * depth)
            place = places(rep, depth)[there]
            pos = pa.array(place[:, 0].astype(np.int32)) if depth == 1 else pa.array(_pos(place))
            leaves = [without_nan(leaf) for leaf in ([pc.struct_field(elements, name) for name, _ in inner] if struct else [elements])]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(record[there])), pos, *leaves], names=[row_id, "pos", *[n for n, _ in out]])

    schema = T.StructType([T.StructField(row_id, df.schema[row_id].dataType), T.StructField("pos", T.IntegerType() if depth == 1 else T.StringType()), *[T.StructField(n, t) for n, t in out]])
    return df.select(row_id, column).mapInArrow(scan, schema)


def flat_tables(df: DataFrame, row_id: str) -> dict[str, DataFrame]:
    """All flat tables of a nested one: the parents under '', the children under their list's path."""
    return {"": parent_table(df), **{p: child_table(df, row_id, p) for p in list_paths(df.schema)}}
