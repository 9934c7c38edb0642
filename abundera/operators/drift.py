"""Schemas that drift between files: names resolved, changes reported, everything read into one table.

1. One map-only pass reduces every payload to the schema of its file (names and
   value types), to a profile of the values under each name the canonical layout
   doesn't know, and to the pooled profiles of the canonical fields; all of the
   size of schemas.
2. Each file's schema tree is matched with the canonical tree by tree edit
   distance.  A known name costs nothing; an unknown one the distance of its
   values (those of the file, backed by those under the same name elsewhere), a
   share for not having come where the field vanished, and one for standing
   beside the field elsewhere.  So a name may mean one thing here, another there.
3. Each file is paired with the one before it by a lag in two levels (within
   exporter and day, then over the days), so no exporter is gathered in a task.
4. The minimum-cost edit script of each pair of trees is the report; the script
   from the canonical tree compiles into the projection that reads the file.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from abundera.operators import schema_tree as S
from abundera.session import collect_bounded, materialize

#: A driver-side table of names must stay the size of a schema.
MAX_NAMES = 100_000
#: Values of the same name elsewhere that back up a file's own.
PRIOR_VALUES = 32.0
#: Weights of the values' distance, of not having come where the field vanished, and of standing beside the field elsewhere.
BY_VALUES, BY_CHANGE, BY_NEIGHBOUR = 0.7, 0.3, 0.5
#: Rows up to which the files that read a name otherwise than most are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Canon:
    """Canonical fields, those inside list fields (as ``list.inner``), and known aliases (field, other name)."""

    fields: tuple[str, ...]
    inner: tuple[str, ...] = ()
    aliases: tuple[tuple[str, str], ...] = ()

    def known(self) -> dict[str, str]:
        top = {S.norm(f): f for f in self.fields}
        for f, other in self.aliases:
            if "." not in f:
                top.setdefault(S.norm(other), f)
        return top

    def known_inner(self) -> dict[tuple[str, str], str]:
        out = {}
        for path in self.inner:
            parent, name = path.split(".", 1)
            out[parent, S.norm(name)] = name
        for path, other in self.aliases:
            if "." in path:
                parent, name = path.split(".", 1)
                out.setdefault((parent, S.norm(other)), name)
        return out


@dataclass
class NameMap:
    """A compiled projection: normalised name to field, and (field, normalised inner name) to inner field."""

    top: dict[str, str] = field(default_factory=dict)
    inner: dict[tuple[str, str], str] = field(default_factory=dict)

    def of(self, name: str) -> str:
        n = S.norm(name)
        return self.top.get(n) or n

    def of_inner(self, parent: str, name: str) -> str:
        n = S.norm(name)
        return self.inner.get((parent, n)) or n

    def changed(self, text: str | None) -> "NameMap":
        """The projection of a file whose names differ as written in ``text`` (see ``Resolved``)."""
        if not text:
            return self
        out = NameMap(dict(self.top), dict(self.inner))
        for parent, name, to in json.loads(text):
            if parent:
                out.inner[parent, name] = to
            else:
                out.top[name] = to
        return out


@dataclass(frozen=True)
class DropColumns:
    """Columns of a table of raw records."""

    source: str = "exporter"
    file: str = "file_name"
    at: str = "exported_at"
    payload: str = "payload"
    row_id: str = "record_id"


def scan_records(df: DataFrame, canon: Canon, columns: DropColumns = DropColumns()) -> DataFrame:
    """The one pass over the payloads, written once to the shared folder.

    ``(pooled, source, file, parent, name, cell, n, mask, at)``: per file and
    written name the value types (cell -1) and, for names the canonical layout
    doesn't know, the counts of the value profile by cell; with ``pooled`` the
    profiles of the canonical fields over all files.  A file without a readable
    record has the name '' only; a null payload is unreadable.
    """
    c, known, known_inner = columns, canon.known(), canon.known_inner()
    inner_of = {p for p, _ in known_inner}

    types = (pa.bool_(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int16(), pa.int64(), pa.int32())
    cells = range(S.PROFILE_SIZE)

    def lists() -> dict:
        return defaultdict(list)

    def emit(rows: list[tuple], at: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*rows), types)), at], names=["pooled", "source", "file", "parent", "name", "cell", "n", "mask", "at"])

    def profile(values: list) -> list[tuple[int, int]]:
        vec = np.zeros(S.PROFILE_SIZE)
        S.add_to_profile(vec, values)
        return [(i, int(vec[i])) for i in cells if vec[i]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pools: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.zeros(S.PROFILE_SIZE))
        at_type = None
        for batch in batches:
            at_type = batch.schema.field(2).type
            files: dict[tuple, tuple[dict, dict, dict]] = {}  # values by name, by list and inner name, and those of lists written otherwise
            for source, name, at, payload in zip(*(batch.column(i).to_pylist() for i in range(4))):
                entry = files.get((source, name, at))
                if entry is None:
                    entry = files[source, name, at] = (defaultdict(list), defaultdict(lists), defaultdict(lists))
                top, inner, other = entry
                for k, v in (S.read_record(payload) or {}).items():
                    top[k].append(v)
                    kind = type(v)
                    if kind is list:
                        elements, into = v, inner
                    elif kind is dict or kind is str and v[:1] in ("[", "{"):
                        elements, into = S.children(v)[0], other
                    else:
                        continue
                    into = into[k]
                    for element in elements:
                        if type(element) is dict:
                            for kk, vv in element.items():
                                into[kk].append(vv)
            rows, ats, pooled = [], [], defaultdict(list)
            for (source, name, at), (top, inner, other) in files.items():
                key = (False, source, name)
                rows.append((*key, "", "", -1, 0, 0))
                for k, values in top.items():
                    f = known.get(S.norm(k))
                    rows.append((*key, "", k, -1, 0, S.type_mask(values)))
                    if f is None:
                        rows += [(*key, "", k, i, n, 0) for i, n in profile(values)]
                    else:
                        pooled["", f] += values
                    if k in inner or k in other:
                        of_lists, of_others = inner.get(k, {}), other.get(k, {})
                        for kk in {**of_lists, **of_others}:
                            g = known_inner.get((f, S.norm(kk))) if f is not None else None
                            values = of_lists.get(kk, [])
                            if kk in of_lists:
                                rows.append((*key, k, kk, -1, 0, S.type_mask(values)))
                            values = values + of_others.get(kk, [])
                            if g is not None:
                                pooled[f, g] += values
                            elif f is None or f in inner_of:
                                rows += [(*key, k, kk, i, n, 0) for i, n in profile(values)]
                ats += [at] * (len(rows) - len(ats))
            for place, values in pooled.items():
                S.add_to_profile(pools[place], values)
            if rows:
                yield emit(rows, pa.array(ats, at_type))
        rows = [(True, None, None, p, f, i, int(vec[i]), 0) for (p, f), vec in pools.items() for i in cells if vec[i]]
        if rows:
            yield emit(rows, pa.nulls(len(rows), at_type))

    at_type = df.schema[c.at].dataType.simpleString()
    ddl = f"pooled boolean, source string, file string, parent string, name string, cell smallint, n bigint, mask int, at {at_type}"
    found = df.select(c.source, c.file, c.at, c.payload).mapInArrow(scan, ddl)
    keys = ["pooled", "source", "file", "parent", "name", "cell"]
    return materialize(found.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.min("at").alias("at")), "schemas")


def file_fields(scanned: DataFrame) -> DataFrame:
    """``(source, file, at, fields)`` with ``fields`` an array of ``(parent, name, mask, cells)``; of the size of a schema each."""
    cell = F.when(F.col("cell") >= 0, F.struct("cell", "n"))
    by_name = scanned.where("NOT pooled").groupBy("source", "file", "parent", "name").agg(F.bit_or("mask").alias("mask"), F.min("at").alias("at"), F.collect_list(cell).alias("cells"))
    return by_name.groupBy("source", "file").agg(F.min("at").alias("at"), F.collect_list(F.struct("parent", "name", "mask", "cells")).alias("fields"))


def with_previous(files: DataFrame, value: str = "fields") -> DataFrame:
    """Each file with the ``value`` of the file before it of the same source as ``previous`` (null for the first).

    Order: time, then file name.  A lag within (source, day) is completed by a
    lag over the last file of each day, so a source's files are never in one
    window unless they are of one day.
    """
    day = F.coalesce(F.to_date("at"), F.lit("1900-01-01").cast("date"))
    order = [F.col("at"), F.col("file")]
    within = files.withColumn("day", day).withColumns(
        {"prev": F.lag(value).over(W.partitionBy("source", "day").orderBy(*order)), "nth": F.row_number().over(W.partitionBy("source", "day").orderBy(*order))}
    )
    last = files.withColumn("day", day).groupBy("source", "day").agg(F.max_by(value, F.struct(F.col("at").isNotNull(), "at", "file")).alias(value))
    carried = last.withColumn("carried", F.lag(value).over(W.partitionBy("source").orderBy("day"))).select("source", "day", "carried")
    joined = within.join(carried, on=[within.source.eqNullSafe(carried.source), within.day == carried.day], how="left").drop(carried.source, carried.day)
    return joined.select("source", "file", "at", value, F.when(F.col("nth") == 1, F.col("carried")).otherwise(F.col("prev")).alias("previous"))


def _context(files: DataFrame, canon: Canon) -> dict[str, Counter]:
    """Where unknown names stand: ``files`` that hold one, ``beside`` which field, where one ``came``, and ``went`` which field there.

    Keyed by (parent field or '', name) and, with a field, by that too: at most
    names times fields, checked.
    """
    known, known_inner = canon.known(), canon.known_inner()
    lists = {p for p, _ in known_inner}
    pairs = with_previous(files.withColumn("fields", F.transform("fields", lambda s: F.struct(s["parent"].alias("parent"), s["name"].alias("name")))))

    def by_parent(fields: Iterable[dict] | None) -> dict[str, tuple[set[str], set[str]]]:
        out: dict[str, tuple[set[str], set[str]]] = {}
        for f in fields or ():
            if f["name"]:
                n = S.norm(f["name"])
                parent = known.get(S.norm(f["parent"])) if f["parent"] else ""
                if parent is None or parent and parent not in lists:
                    continue
                hit = known_inner.get((parent, n)) if parent else known.get(n)
                fields_, odd = out.setdefault(parent, (set(), set()))
                (odd if hit is None else fields_).add(n if hit is None else hit)
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for fields, previous in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now, before = by_parent(fields), by_parent(previous)
                for parent, (have, odd) in now.items():
                    for x in odd:
                        counts["files", parent, x, ""] += 1
                        for f in have:
                            counts["beside", parent, x, f] += 1
                        if parent in before and x not in before[parent][1]:
                            counts["came", parent, x, ""] += 1
                            for f in before[parent][0] - have:
                                counts["went", parent, x, f] += 1
        if counts:
            rows = [(*k, n) for k, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["what", "parent", "x", "f", "n"])

    found = pairs.select("fields", "previous").mapInArrow(scan, "what string, parent string, x string, f string, n long").groupBy("what", "parent", "x", "f").agg(F.sum("n").alias("n"))
    out: dict[str, Counter] = {k: Counter() for k in ("files", "beside", "came", "went")}
    for r in collect_bounded(found, MAX_NAMES, "pairs of field names: this is no schema"):
        out[r["what"]][(r["parent"], r["x"], r["f"]) if r["f"] else (r["parent"], r["x"])] = r["n"]
    return out


class Resolver:
    """Matches a file's schema tree with the canonical one."""

    def __init__(self, canon: Canon, pools: dict[tuple[str, str], np.ndarray], backing: dict[str, np.ndarray], context: dict[str, Counter]) -> None:
        self.known, self.known_inner, self.context, self.backing = canon.known(), canon.known_inner(), context, backing
        self.lists = {p for p, _ in self.known_inner}
        self.at: dict[str, dict[str, int]] = defaultdict(dict)
        rows: dict[str, list[np.ndarray]] = defaultdict(list)
        for (parent, f), vec in sorted(pools.items()):
            self.at[parent][f] = len(rows[parent])
            rows[parent].append(vec)
        self.table = {p: np.stack(v) for p, v in rows.items()}
        fields = sorted(set(self.known.values()))
        self.canonical = [S.Node(f, inner={g: S.Node(g) for g in sorted({g for (p, _), g in self.known_inner.items() if p == f})}) for f in fields]

    def _prices(self, parent: str, name: str, own: np.ndarray) -> dict[str, float]:
        """Price of each canonical field below ``parent`` for an unknown name with these values."""
        table = self.table.get(parent)
        if table is None:
            return {}
        more = self.backing.get(name)
        total = float(more[: S.KINDS].sum()) if more is not None else 0.0
        d = S.profile_distances(own + more * (PRIOR_VALUES / total) if total else own, table)
        came, files = self.context["came"][parent, name], self.context["files"][parent, name]
        out = {}
        for f, i in self.at[parent].items():
            share = min(1.0, self.context["went"][parent, name, f] / came) if came else 0.5
            beside = self.context["beside"][parent, name, f] / files if files else 0.0
            out[f] = BY_VALUES * float(d[i]) + BY_CHANGE * (1 - share) + BY_NEIGHBOUR * beside
        return out

    def tree(self, fields: Iterable[dict] | None) -> list[S.Node]:
        """Nodes of a file before any unknown name is resolved; names that differ only in case and signs are one node."""
        nodes: dict[str, S.Node] = {}
        inner: dict[str, list[dict]] = defaultdict(list)

        def put(at: dict[str, S.Node], f: dict, hit: str | None) -> None:
            key = hit if hit is not None else S.norm(f["name"])
            old = at.get(key)
            vec = None
            if hit is None:
                vec = np.zeros(S.PROFILE_SIZE) if old is None else old.profile
                for c in f["cells"]:
                    vec[c["cell"]] += c["n"]
            at[key] = S.Node(key, (old.names if old else frozenset()) | {f["name"]}, (old.mask if old else 0) | f["mask"], old.inner if old else {}, hit is not None, vec)

        for f in fields or ():
            if f["name"] and not f["parent"]:
                put(nodes, f, self.known.get(S.norm(f["name"])))
            elif f["name"]:
                inner[self.known.get(S.norm(f["parent"]), S.norm(f["parent"]))].append(f)
        for parent, below in inner.items():
            if parent in nodes:
                for f in below:
                    put(nodes[parent].inner, f, self.known_inner.get((parent, S.norm(f["name"]))) if nodes[parent].known else None)
        return [n for n in nodes.values() if not n.inner or self._keep(n)]

    def _keep(self, n: S.Node) -> bool:
        if n.known and n.canonical not in self.lists:
            n.inner = {}  # fields inside other lists do not count
        return True

    def resolve(self, fields: Iterable[dict] | None) -> list[S.Node]:
        """The file's nodes under their canonical names, by tree edit distance from the canonical tree."""
        nodes = self.tree(fields)
        priced: dict[tuple[str, int], dict[str, float]] = {}

        def rename(a: S.Node, b: S.Node, parents: tuple[S.Node, S.Node] | None) -> float:
            """``a`` canonical, ``b`` of the file."""
            parent = parents[0].canonical if parents else ""
            if b.known:
                return 0.0 if a.canonical == b.canonical else S.INF
            if parent:
                hit = self.known_inner.get((parent, b.canonical))
                if hit is not None:
                    return 0.0 if hit == a.canonical else S.INF
            taken = held.get((parent, id(parents[1]) if parents else 0))
            if taken is None:
                siblings = parents[1].inner.values() if parents else nodes
                taken = held[parent, id(parents[1]) if parents else 0] = {n.canonical for n in siblings if n.known} | {self.known_inner[parent, n.canonical] for n in siblings if parent and (parent, n.canonical) in self.known_inner}
            if a.canonical in taken:
                return S.INF
            if (parent, id(b)) not in priced:
                priced[parent, id(b)] = self._prices(parent, b.canonical, b.profile)
            return priced[parent, id(b)].get(a.canonical, S.INF)

        held: dict[tuple[str, int], set[str]] = {}
        for b in nodes:  # types say nothing here: the canonical tree has none
            for m in b.inner.values():
                m.mask, m.types = 0, m.mask
            b.mask, b.types = 0, b.mask

        def sure(old: list[S.Node], new: list[S.Node], parents: tuple[S.Node, S.Node] | None) -> list[tuple[int, int]]:
            at = {b.canonical if b.known or not parents else self.known_inner.get((parents[0].canonical, b.canonical), ""): j for j, b in enumerate(new) if b.known or parents}
            return [(i, at[a.canonical]) for i, a in enumerate(old) if a.canonical in at]

        edit = S.tree_edit(self.canonical, nodes, rename, sure=sure)

        def name(e: S.Edit, parent: str) -> dict[str, S.Node]:
            out: dict[str, S.Node] = {}

            def put(key: str, b: S.Node, known: bool, price: float, inner: dict[str, S.Node]) -> None:
                old = out.get(key)
                out[key] = S.Node(key, b.names | (old.names if old else frozenset()), b.types | (old.mask if old else 0), inner, known, None if known else b.profile, price)

            for a, b, below in e.pairs:
                price = 0.0 if b.known else priced.get((parent, id(b)), {}).get(a.canonical, 0.0)
                put(a.canonical, b, True, price, name(below, a.canonical) if below is not None else {})
            for b in e.added:
                put(b.canonical, b, False, 0.0, {})
            return out

        return list(name(edit, "").values())


_NODE = "struct<parent:string,key:string,names:array<string>,mask:int,price:float,known:boolean,cells:array<struct<cell:smallint,n:bigint>>>"


class Resolved:
    """The files' resolved trees; from them, when first asked for, the projection most files share and the files that read a name otherwise."""

    def __init__(self, files: DataFrame | None, canon: Canon) -> None:
        self.files, self.canon = files, canon

    @cached_property
    def _compiled(self) -> tuple[NameMap, DataFrame | None]:
        names = NameMap(self.canon.known(), self.canon.known_inner())
        if self.files is None:
            return names, None
        flat = self.files.select(F.explode("nodes").alias("n")).select(F.col("n.parent").alias("parent"), F.explode("n.names").alias("name"), F.col("n.key").alias("key"))
        votes: dict[tuple[str, str], Counter] = defaultdict(Counter)
        for r in collect_bounded(flat.groupBy("parent", "name", "key").agg(F.count(F.lit(1)).alias("n")), MAX_NAMES, "field names: this is no schema"):
            votes[r["parent"], S.norm(r["name"])][r["key"]] += r["n"]
        for (parent, n), keys in votes.items():
            most = min(keys, key=lambda k: (-keys[k], k))
            if parent:
                names.inner[parent, n] = most
            else:
                names.top[n] = most
        return names, _exceptions(self.files, names) if any(len(keys) > 1 for keys in votes.values()) else None

    @property
    def names(self) -> NameMap:
        return self._compiled[0]

    @property
    def exceptions(self) -> DataFrame | None:
        return self._compiled[1]

    def attach(self, df: DataFrame, columns: DropColumns) -> DataFrame:
        """``df`` with the column ``_names``: what a record's file reads otherwise, as text, mostly null."""
        if self.exceptions is None:
            return df.withColumn("_names", F.lit(None).cast("string"))
        few = self.exceptions.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
        other = F.broadcast(self.exceptions) if few else self.exceptions
        return df.join(other, df[columns.source].eqNullSafe(other["_source"]) & df[columns.file].eqNullSafe(other["_file"]), "left")


def _rows_of(nodes: Iterable[S.Node], parent: str = "") -> list[dict]:
    out = []
    for n in nodes:
        cells = [] if n.profile is None else [{"cell": int(i), "n": int(n.profile[i])} for i in np.flatnonzero(n.profile)]
        out.append({"parent": parent, "key": n.canonical, "names": sorted(n.names), "mask": n.mask, "price": n.price, "known": n.known, "cells": cells})
        out += _rows_of(n.inner.values(), n.canonical)
    return out


def _nodes_of(rows: Iterable[dict] | None, inner_of: frozenset[str]) -> dict[str, S.Node]:
    nodes: dict[str, S.Node] = {}
    for wanted in (False, True):
        for r in rows or ():
            if bool(r["parent"]) is wanted:
                vec = None
                if r["cells"]:
                    vec = np.zeros(S.PROFILE_SIZE)
                    for c in r["cells"]:
                        vec[c["cell"]] = c["n"]
                node = S.Node(r["key"], frozenset(r["names"]), r["mask"], {}, r["known"], vec, r["price"])
                if not wanted:
                    nodes[r["key"]] = node
                elif r["parent"] in inner_of and r["parent"] in nodes:
                    nodes[r["parent"]].inner[r["key"]] = node
    return nodes


def resolve_files(df: DataFrame, canon: Canon, columns: DropColumns = DropColumns()) -> Resolved:
    """Read every file's schema and match it with the canonical one.

    Names that fit no canonical field stand for themselves.  On the driver lie
    only tables of the size of a schema (names, names times fields), checked
    against ``MAX_NAMES``.
    """
    scanned = scan_records(df, canon, columns)

    by_cell = scanned.where("cell >= 0").groupBy("pooled", F.when(F.col("pooled"), F.col("parent")).alias("parent"), "name", "cell").agg(F.sum("n").alias("n"))
    pools, backing = {}, {}
    for r in collect_bounded(by_cell.groupBy("pooled", "parent", "name").agg(F.collect_list(F.struct("cell", "n")).alias("cells")), MAX_NAMES, "field names: this is no schema"):
        into, key = (pools, (r["parent"], r["name"])) if r["pooled"] else (backing, S.norm(r["name"]))
        vec = into.setdefault(key, np.zeros(S.PROFILE_SIZE))
        for cell, n in r["cells"]:
            vec[cell] += n
    fields = file_fields(scanned)
    resolver = Resolver(canon, pools, backing, _context(fields, canon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                trees = [_rows_of(resolver.resolve(f)) for f in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(trees, _NODE_ARROW)], names=["source", "file", "at", "nodes"])

    files = materialize(fields.mapInArrow(run, f"source string, file string, at {df.schema[columns.at].dataType.simpleString()}, nodes array<{_NODE}>"), "resolved")
    return Resolved(files, canon)


_NODE_ARROW = pa.list_(
    pa.struct(
        [("parent", pa.string()), ("key", pa.string()), ("names", pa.list_(pa.string())), ("mask", pa.int32()), ("price", pa.float32()), ("known", pa.bool_()), ("cells", pa.list_(pa.struct([("cell", pa.int16()), ("n", pa.int64())])))]
    )
)


def _exceptions(files: DataFrame, names: NameMap) -> DataFrame:
    """``(_source, _file, _names)`` of the files in which a name means something else than in most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for source, name, nodes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                odd = [
                    (r["parent"], S.norm(w), r["key"]) for r in nodes for w in r["names"]
                    if (names.of_inner(r["parent"], w) if r["parent"] else names.of(w)) != r["key"]
                ]
                if odd:
                    rows.append((source, name, json.dumps(sorted(odd))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], names=["_source", "_file", "_names"])

    return files.select("source", "file", "nodes").mapInArrow(run, "_source string, _file string, _names string")


def _scripts(resolved: Resolved, inner_of: Iterable[str], script, ddl: str) -> DataFrame:
    lists = frozenset(inner_of)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, nodes, previous in zip(*(batch.column(i).to_pylist() for i in range(3))):
                rows += script(name, _nodes_of(previous, lists), _nodes_of(nodes, lists))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=[c.split()[0] for c in ddl.split(", ")])

    pairs = with_previous(resolved.files, "nodes").where(F.col("previous").isNotNull())
    return pairs.select("file", "nodes", "previous").mapInArrow(scan, ddl)


def file_changes(resolved: Resolved, inner_of: Iterable[str]) -> DataFrame:
    """``(file_name, field_name, change_kind)`` of each file against the one before it; a moved field is removed and added."""
    return _scripts(resolved, inner_of, lambda name, old, new: [(name, path, kind) for path, kind in S.edit_script(old, new)[1]], "file_name string, field_name string, change_kind string")


def file_scripts(resolved: Resolved, inner_of: Iterable[str]) -> DataFrame:
    """``(file_name, cost, field_name, change_kind, new_place)``: the minimum-cost scripts themselves, moves and their new places included."""

    def script(name: str, old: dict, new: dict) -> list[tuple]:
        cost, steps = S.edit_script_with_moves(old, new)
        return [(name, cost, path, kind, to or "") for path, kind, to in steps]

    return _scripts(resolved, inner_of, script, "file_name string, cost double, field_name string, change_kind string, new_place string")


def _schema_nodes(schema: T.StructType, canon: Canon) -> dict[str, S.Node]:
    """Tree of a table's schema; of arrays only whether the elements are objects or strings counts."""
    known, known_inner = canon.known(), canon.known_inner()
    out = {}
    for f in schema.fields:
        n = known.get(S.norm(f.name), S.norm(f.name))
        kind: object = f.dataType.simpleString()
        inner: dict[str, S.Node] = {}
        if isinstance(f.dataType, T.ArrayType):
            e = f.dataType.elementType
            kind = S.OBJECTS if isinstance(e, T.StructType) else S.STRINGS if isinstance(e, T.StringType) else f"array<{e.simpleString()}>"
            if isinstance(e, T.StructType) and any(p == n for p, _ in known_inner):
                for g in e.fields:
                    m = known_inner.get((n, S.norm(g.name)), S.norm(g.name))
                    inner[m] = S.Node(m, frozenset({g.name}), g.dataType.simpleString())
        out[n] = S.Node(n, frozenset({f.name}), kind, inner)
    return out


def table_changes(old: T.StructType, new: T.StructType, canon: Canon) -> list[tuple[str, str]]:
    """``(field, change)`` steps between the schemas of two tables."""
    return S.edit_script(_schema_nodes(old, canon), _schema_nodes(new, canon))[1]


def unified_records(df: DataFrame, resolved: Resolved, columns: DropColumns = DropColumns()) -> DataFrame:
    """All readable records as one table of the canonical layout (values as text or lists of text fields).

    Every record goes through the projection compiled for its file.  Scalars
    come out as strings in their canonical column, to be cast by the caller;
    lists of objects as arrays of string-valued structs.
    """
    c, names = columns, resolved.names
    inner_names = {p for p, _ in names.inner}
    scalars = sorted(set(names.top.values()) - inner_names)
    lists = {p: sorted({f for (q, _), f in names.inner.items() if q == p}) for p in sorted(inner_names)}
    arrow = [pa.field(c.row_id, pa.int64()), *[pa.field(s, pa.string()) for s in scalars]]
    arrow += [pa.field(p, pa.list_(pa.struct([pa.field(f, pa.string()) for f in inner]))) for p, inner in lists.items()]
    target = pa.schema(arrow)
    main_inner = {p: ("accession" if "accession" in inner else inner[0]) for p, inner in lists.items()}

    def text(v: object) -> str | None:
        return None if v is None else v if isinstance(v, str) else "true" if v is True else "false" if v is False else json.dumps(v)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[str | None, NameMap] = {None: names}
        for batch in batches:
            out = []
            for rid, payload, other in zip(*(batch.column(i).to_pylist() for i in range(3))):
                record = S.read_record(payload)
                if record is None:
                    continue
                if other not in maps:
                    if len(maps) > 10_000:
                        maps = {None: names}
                    maps[other] = names.changed(other)
                use = maps[other]
                row: dict = {c.row_id: rid}
                for k, v in record.items():
                    f = use.of(k)
                    if f in lists:
                        row[f] = None if v is None else [
                            None if e is None else {use.of_inner(f, kk): text(vv) for kk, vv in e.items()} if isinstance(e, dict) else {main_inner[f]: text(e)}
                            for e in S.children(v)[0]
                        ]
                    elif f in row and v is None:
                        continue
                    else:
                        row[f] = text(v)
                out.append(row)
            if out:
                yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in target} for r in out], schema=target)

    ddl = ", ".join([f"`{c.row_id}` bigint", *[f"`{s}` string" for s in scalars], *[f"`{p}` array<struct<{','.join(f'`{f}`:string' for f in inner)}>>" for p, inner in lists.items()]])
    return resolved.attach(df.select(c.row_id, c.payload, c.source, c.file), c).select(c.row_id, c.payload, "_names").mapInArrow(scan, ddl)
