"""Drifting schemas, heavy keys, nested records and gap filling on small fixtures, against brute force."""

import itertools
import json
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from abundera.functions.values import is_measured, is_missing
from abundera.operators import drift, fill, heavy, shred
from abundera.operators import schema_tree as S

CANON = drift.Canon(("sequence", "charge", "score", "flag", "intensities"), ("intensities.label", "intensities.intensity"), (("charge", "precursor_charge"), ("intensities.label", "channel")))


def records(spark, files):
    """(exporter, file, day, [payload or object]) -> raw records; with extra columns that clash with inner names."""
    rows, i = [], 0
    for e, f, day, payloads in files:
        for p in payloads:
            rows.append((i, f, e, datetime(2024, 1, 1) + timedelta(days=day), p if p is None or isinstance(p, str) else json.dumps(p), "x", "y", "z"))
            i += 1
    return spark.createDataFrame(rows, "record_id long, file_name string, exporter string, exported_at timestamp, payload string, source string, fields string, mask string")


def rec(i, **extra):
    rng = random.Random(i)
    return {"sequence": "".join(rng.choices("ACDEFGHIK", k=9)) + "K", "charge": rng.randint(2, 4), "score": rng.random(), "flag": rng.random() < 0.5, **extra}


def renamed(r, a, b):
    return {b if k == a else k: v for k, v in r.items()}


def changes(spark, files):
    resolved = drift.resolve_files(records(spark, files), CANON)
    return {tuple(r) for r in drift.file_changes(resolved, ["intensities"]).collect()}, resolved.names


def test_every_kind_of_change(spark):
    many = [rec(i) for i in range(30)]
    files = [
        ("e", "f1", 0, many),
        ("e", "f2", 1, [renamed(r, "charge", "Precursor Charge") for r in many]),
        ("e", "f3", 2, [renamed(r, "charge", "z_state") | {"score": str(r["score"])} for r in many]),
        ("e", "f4", 2 + 1 / 24, [{k: v for k, v in r.items() if k != "flag"} for r in many] + ["{broken", None, "[1]"]),
        ("e", "f5", 9, [r | {"extra_thing": [1]} for r in many]),
        ("other", "g1", 0, many[:2]),
    ]
    got, names = changes(spark, files)
    assert names.of("z_state") == "charge"
    assert got == {
        ("f2", "charge", "renamed"), ("f3", "charge", "renamed"), ("f3", "score", "retyped"), ("f4", "charge", "renamed"), ("f4", "score", "retyped"), ("f4", "flag", "removed"),
        ("f5", "flag", "added"), ("f5", "extrathing", "added"),
    }


def test_inner_fields_count_only_between_arrays_of_objects(spark):
    inner = lambda name: [{name: "126", "intensity": 5.5}, None]
    files = [("e", "a", 0, [rec(1, intensities=inner("label"))]), ("e", "b", 1, [rec(2, intensities=inner("channel"))]), ("e", "c", 2, [rec(3, intensities={"label": "x"})])]
    got, _ = changes(spark, files)
    assert got == {("b", "intensities.label", "renamed"), ("c", "intensities", "retyped")}


def test_value_types():
    assert [S.type_mask([v]) for v in (1, 1.0, "1", True, {}, [{}], ["a", None], [None], [], None, [1])] == [S.INTEGER, S.DECIMAL, S.STRING, S.BOOLEAN, S.OBJECT, S.OBJECTS, S.STRINGS, 0, 0, 0, S.OTHERS]


def tree(**fields):
    """Fields as nodes; a dict value is a list of objects with those inner fields."""
    return {k: S.Node(k, frozenset({k}), S.OBJECTS if isinstance(v, dict) else v, tree(**v) if isinstance(v, dict) else {}) for k, v in fields.items()}


def test_assignment_is_minimal():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 6))
        cost = rng.integers(-5, 20, (n, n + int(rng.integers(0, 3)))).astype(float)
        got = S.assign(cost)
        assert [r for r, _ in got] == list(range(n)) and len({c for _, c in got}) == n
        assert sum(cost[p] for p in got) == min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(cost.shape[1]), n))


def test_edit_distance_against_all_matchings():
    """The distance equals the cheapest of all ways to match two sets of fields that fit no canonical one."""
    rng = random.Random(4)
    for _ in range(60):
        sides = [[S.Node(f"{s}{i}", frozenset({f"{s}{i}"}), 1, {}, False, np.array([rng.random() for _ in range(S.PROFILE_SIZE)])) for i in range(rng.randint(0, 4))] for s in "ab"]
        old, new = sides
        best = math.inf
        for k in range(min(len(old), len(new)) + 1):
            for left in itertools.combinations(range(len(old)), k):
                for right in itertools.permutations(range(len(new)), k):
                    best = min(best, sum(S.same_field(old[i], new[j]) for i, j in zip(left, right)) + S.UNIT * (len(old) + len(new) - 2 * k))
        assert S.tree_edit(old, new, S.same_field).cost == pytest.approx(best)


def test_moves():
    """An inner field that goes from one list to another is one move, dearer than nothing and cheaper than removing and adding it."""
    old, new = tree(l={"x": 1, "y": 1}, m={"z": 1}, u=2), tree(l={"y": 1}, m={"z": 1, "x": 1}, u=4)
    cost, steps = S.edit_script_with_moves(old, new)
    assert sorted(steps, key=str) == [("l.x", "moved", "m.x"), ("u", "retyped", None)] and cost == S.UNIT + S.RETYPE
    plain = S.edit_script(old, new)
    assert set(plain[1]) == {("l.x", "removed"), ("m.x", "added"), ("u", "retyped")} and plain[0] == 2 * S.UNIT + S.RETYPE


def test_a_planted_move_is_reported(spark):
    canon = drift.Canon(("charge", "peaks", "parts"), ("peaks.label", "peaks.mass", "parts.code", "parts.mass"))
    before = {"charge": 2, "peaks": [{"label": "a", "mass": 1.5}], "parts": [{"code": "x"}]}
    after = {"charge": 2, "peaks": [{"label": "a"}], "parts": [{"code": "x", "mass": 1.5}]}
    resolved = drift.resolve_files(records(spark, [("e", "f1", 0, [before]), ("e", "f2", 1, [after])]), canon)
    assert [tuple(r)[2:] for r in drift.file_scripts(resolved, ["peaks", "parts"]).collect()] == [("peaks.mass", "moved", "parts.mass")]
    assert {tuple(r)[1:] for r in drift.file_changes(resolved, ["peaks", "parts"]).collect()} == {("peaks.mass", "removed"), ("parts.mass", "added")}


def test_a_name_with_two_meanings(spark):
    """One exporter writes the charge as ``val``, another the score; each file is read by its own projection."""
    many = [rec(i) for i in range(40)]
    files = [
        ("a", "a1", 0, many), ("a", "a2", 1, [renamed(r, "charge", "val") for r in many]),
        ("b", "b1", 0, many), ("b", "b2", 1, [renamed(r, "score", "val") for r in many]), ("b", "b3", 2, [renamed(r, "score", "val") for r in many]),
    ]
    df = records(spark, files)
    resolved = drift.resolve_files(df, CANON)
    assert {tuple(r) for r in drift.file_changes(resolved, ["intensities"]).collect()} == {("a2", "charge", "renamed"), ("b2", "score", "renamed")}
    read = {r["record_id"]: r for r in drift.unified_records(df, resolved).collect()}
    assert all(read[i]["charge"] == str(many[i % 40]["charge"]) and float(read[i]["score"]) == many[i % 40]["score"] for i in range(200))


def test_drift_on_empty_and_unreadable(spark):
    assert changes(spark, [])[0] == set()
    assert changes(spark, [("e", "a", 0, ["{"]), ("e", "b", 1, [None])])[0] == set()


def test_unified_records(spark):
    df = records(spark, [("e", "a", 0, [rec(1, intensities=json.dumps([{"channel": "126", "intensity": 2}])), "{"])])
    r = drift.unified_records(df, drift.resolve_files(df, CANON)).collect()
    assert len(r) == 1 and r[0]["intensities"][0].asDict() == {"intensity": "2", "label": "126"} and r[0]["charge"] == str(rec(1)["charge"])


# ---- nested records ------------------------------------------------------------------------------------------------------

PATHS = {"intensities": {}, "mods": {"positions": {"scores": {}}}}
MODS = drift.Canon(("intensities", "mods"))


def brute(record):
    def walk(paths, obj, prefix, pos):
        for name, below in paths.items():
            value = next((v for k, v in obj.items() if S.norm(k) == S.norm(name)), None) if isinstance(obj, dict) else None
            for i, e in enumerate(S.children(value)[0]):
                if e is not None:
                    yield ".".join((*prefix, name)), ".".join(map(str, (*pos, i)))
                    yield from walk(below, e, (*prefix, name), (*pos, i))

    yield from walk(PATHS, record, (), ())


def random_record(rng, depth=0):
    def lists(make):
        kind = rng.randrange(6)
        items = [None if rng.random() < 0.2 else make() for _ in range(rng.randrange(4))]
        return [items, json.dumps(items), make(), None, [], "a;b"][kind]

    return {"intensities": lists(lambda: {"label": "x"}), "MODS": lists(lambda: {"Positions": lists(lambda: {"scores": lists(lambda: {"s": 1})})})}


def test_shredding_agrees_with_walking(spark):
    rng = random.Random(3)
    recs = [random_record(rng) for _ in range(300)]
    df = records(spark, [("e", "f", 0, [*recs, "{broken", None])])
    resolved = drift.Resolved(None, MODS)
    got = sorted(tuple(r) for r in shred.shred_payloads(df, PATHS, resolved).collect())
    assert got == sorted((i, path, pos) for i, r in enumerate(recs) for path, pos in brute(r))


def test_places_from_levels():
    assert shred.places(np.array([0, 1, 2, 0, 2, 1]), 2).tolist() == [[0, 0], [1, 0], [1, 1], [0, 0], [0, 1], [1, 0]]


def test_leaves_keep_null_and_absent_apart(spark, rows):
    recs = [{"seq": "A", "n": None, "intensities": [{"label": "x", "v": None}, None, {"label": "y"}, 5]}, {"mods": [{"positions": [{"p": 1, "scores": [{"s": 2.5}]}]}]}]
    df = records(spark, [("e", "f", 0, [*recs, "{broken"])])
    got = rows(shred.shred_leaves(df, PATHS, drift.Resolved(None, MODS)))
    assert got == sorted([
        (0, "", "", "seq", "A"), (0, "", "", "n", None), (0, "intensities", "0", "label", "x"), (0, "intensities", "0", "v", None), (0, "intensities", "2", "label", "y"),
        (0, "intensities", "3", "value", "5"), (1, "mods.positions", "0.0", "p", "1"), (1, "mods.positions.scores", "0.0.0", "s", "2.5"),
    ], key=lambda t: tuple((v is None, str(v)) for v in t))


def test_levels_of_a_leaf():
    stream = shred.Stream(1, [0, 0, 1], [0, 1, 0], [2, 1, 0], {"v": shred.Leaf([0], [None])})
    assert stream.leaves["v"].definition(stream).tolist() == [3, 1, 0]


def test_nested_typed_lists(spark, rows):
    ddl = "id long, name string, mods array<struct<m:string,positions:array<struct<p:int,scores:array<double>>>>>"
    nan = float("nan")
    data = [(1, "a", [("x", [(1, [0.5, nan]), None, (2, None)]), ("y", None), None, ("z", [])]), (2, "b", None), (3, "c", []), (4, "d", [("w", [(7, [])])])]
    tables = shred.flat_tables(spark.createDataFrame(data, ddl), "id")
    assert set(tables) == {"", "mods", "mods.positions", "mods.positions.scores"} and tables[""].columns == ["id", "name"]
    assert rows(tables["mods"]) == [(1, 0, "x"), (1, 1, "y"), (1, 3, "z"), (4, 0, "w")]
    assert rows(tables["mods.positions"]) == [(1, "0.0", 1), (1, "0.2", 2), (4, "0.0", 7)]
    assert [tuple(r) for r in tables["mods.positions.scores"].orderBy("pos").collect()] == [(1, "0.0.0", 0.5), (1, "0.0.1", None)]


def test_nan_in_typed_children_is_null(spark, rows):
    df = spark.createDataFrame([(1, [("a", float("nan")), ("b", 2.0)])], "id long, items array<struct<label:string,v:double>>")
    assert rows(shred.child_table(df, "id", "items")) == [(1, 0, "a", None), (1, 1, "b", 2.0)]


def test_typed_children(spark, rows):
    df = spark.createDataFrame([(1, [("a", 1), None, ("b", None)]), (2, []), (3, None), (4, [None])], "pos long, items array<struct<pos:string,n:int>>")
    assert rows(shred.child_table(df.withColumnRenamed("pos", "id"), "id", "items")) == [(1, 0, "a", 1), (1, 2, "b", None)]
    assert shred.child_table(df.limit(0).withColumnRenamed("pos", "id"), "id", "items").count() == 0
    plain = spark.createDataFrame([(1, ["x", None, "y"])], "id long, value array<string>")
    assert rows(shred.child_table(plain, "id", "value")) == [(1, 0, "x"), (1, 2, "y")]


# ---- heavy keys ----------------------------------------------------------------------------------------------------------


def test_heavy_keys_against_brute_force(spark):
    rng = random.Random(1)
    data = [("hot", f"i{rng.randrange(50)}", rng.random()) for _ in range(3000)] + [(f"k{rng.randrange(2000)}", f"i{rng.randrange(9)}", None if rng.random() < 0.1 else 1.0) for _ in range(6000)] + [(None, None, None)] * 1500
    df = spark.createDataFrame([(*d, 1, 2) for d in data], "key string, item string, v double, total_rows int, _key int")
    got = {r["key"]: r for r in heavy.spread_over_keys(df, "key", "item", "v", 0.02).collect()}
    want = defaultdict(lambda: [0, 0.0, set()])
    for k, i, v in data:
        want[k][0] += 1
        want[k][1] += v or 0
        want[k][2] |= {i} - {None}
    assert got.keys() == want.keys() and {k for k, r in got.items() if r["is_heavy"]} == {"hot"}
    assert all((r["n_rows"], r["n_items"]) == (want[k][0], len(want[k][2])) and (r["sum_value"] or 0) == pytest.approx(want[k][1]) for k, r in got.items())


def test_heavy_keys_of_nothing(spark):
    df = spark.createDataFrame([], "key string, item string, v double")
    assert heavy.spread_over_keys(df, "key", "item", "v").count() == 0 and heavy.heavy_keys(df, "key").count() == 0
    assert heavy.salted(df, "key", F.hash("item")).count() == 0
    nulls = spark.createDataFrame([(None, None, None)] * 3, "key string, item string, v double")
    r = heavy.spread_over_keys(nulls, "key", "item", "v").collect()
    assert len(r) == 1 and r[0]["n_rows"] == 3 and not r[0]["is_heavy"]


# ---- gaps ----------------------------------------------------------------------------------------------------------------

GAPS = "peptide_row_id long, ProteinName string, PeptideCanonical string, PrecursorCharge int, Run string, SampleID string, Condition string, NormIntensity double, g string, bin int, k string"


def gap_rows(spark, data):
    return spark.createDataFrame([(*d, "g", 1, "k") for d in data], GAPS)


def test_fills_and_donors(spark):
    nan = float("nan")
    data = [
        (1, "P", "A", 2, "r1", "s1", "c1", 100.0), (2, "P", "B", 2, "r1", "NA", "", nan), (3, "P", "C", 2, "r1", "s1", None, 1000.0), (4, "P", "C", 2, "r2", "s2", "unknown", 1000.0),
        (5, "P", "B", 2, "r2", "s2", "c2", 900.0), (6, "Q", "A", 2, None, None, "c1", 0.0), (7, "R", "A", 2, "r3", None, None, None), (8, None, "A", 2, "r1", "s1", "c1", None),
        (9, "P", "B", 2, "r1", "s1", "c1", float("inf")), (9, "P", "B", 2, "r1", "s1", "c1", -1.0),
    ]
    got = {(r[0], r[1]): (r["filled_value"], r["donor_id"]) for r in fill.fills(gap_rows(spark, data)).collect()}
    assert set(got) == {(2, "SampleID"), (2, "Condition"), (3, "Condition"), (4, "Condition"), (2, "NormIntensity"), (9, "NormIntensity")}
    assert got[2, "SampleID"] == ("s1", 1) and got[3, "Condition"] == ("c1", 1) and got[4, "Condition"] == ("c2", 5)
    assert got[2, "NormIntensity"][1] in (1, 3)
    wide = {r["peptide_row_id"]: r for r in fill.filled(gap_rows(spark, data[:8])).collect()}
    assert wide[2]["SampleID"] == "s1" and wide[2]["NormIntensity_filled"] and wide[1]["SampleID"] == "s1" and not wide[1]["SampleID_filled"]
    assert wide[6]["SampleID"] is None and wide[6]["NormIntensity"] == 0.0


def test_fill_of_nothing(spark):
    assert fill.fills(gap_rows(spark, [])).count() == 0 and fill.filled(gap_rows(spark, [])).count() == 0


def test_donor_is_the_nearest_prediction(spark):
    """Items with clear levels over many samples: the donor is the item of nearest level."""
    level = {"a": 4.0, "b": 8.0, "c": 12.0, "d": 11.5}
    data, i = [], 0
    for s in range(12):
        for item, v in level.items():
            lost = s == 0 and item == "d"
            data.append((i, "P", item, 2, f"r{s}", f"s{s}", "c", None if lost else float(2 ** (v + 0.1 * s))))
            i += 1
    r = fill.fills(gap_rows(spark, data)).where("field_name = 'NormIntensity'").collect()
    assert len(r) == 1 and data[r[0]["donor_id"]][2] == "c" and float(r[0]["filled_value"]) == 2**12.0


def brute_fills(data):
    """Donor of each value that can be filled, by comparing every prediction of the group."""
    ok = lambda v: v is not None and math.isfinite(v) and v > 0
    groups, effects = defaultdict(list), defaultdict(list)
    for r in data:
        groups[r[1], r[5]].append(r)
    means = {g: np.mean([math.log2(r[7]) for r in rs if ok(r[7])]) for g, rs in groups.items() if any(ok(r[7]) for r in rs)}
    for r in data:
        if ok(r[7]):
            effects[r[2], r[3]].append(math.log2(r[7]) - means[r[1], r[5]])
    effect = {k: sum(v) / (len(v) + 1) for k, v in effects.items()}
    out = {}
    for g, rs in groups.items():
        for r in rs:
            if not ok(r[7]) and g in means:
                p = effect.get((r[2], r[3]), 0.0)
                out[r[0]] = min(abs(effect[d[2], d[3]] - p) for d in rs if ok(d[7]))
    return out, effect


@pytest.mark.parametrize("share", [0.05, 0.002])
def test_donors_against_brute_force(spark, share):
    """The nearest prediction of the whole group, with and without hot keys."""
    rng = random.Random(8)
    data = []
    for i in range(1500):
        g = 0 if rng.random() < 0.4 else rng.randrange(12)  # one group holds the most
        data.append((i, f"P{g}", f"item{rng.randrange(60)}", 2, f"r{g}", f"s{g}", "c", None if rng.random() < 0.2 else float(2 ** rng.uniform(5, 20))))
    base = gap_rows(spark, data)
    rows = fill._keyed(fill.with_filled_samples(fill._base(base, fill.FillColumns()))).cache()
    hot = heavy.hot_hashes(rows, {"g": F.struct(*fill.G), "k": F.struct(*fill.K), "gk": F.struct(*fill.G, *fill.K)}, share)
    assert hot["g"]
    got = {r["_id"]: r for r in fill.value_fills(rows, hot).collect()}
    want, effect = brute_fills(data)
    assert set(got) == set(want)
    for i, r in got.items():
        donor = data[r["_donor"]]
        assert donor[1] == data[i][1] and r["_fill"] == donor[7] and r["_distance"] == pytest.approx(want[i], abs=1e-9)


def test_filled_values_beat_the_group_mean(spark):
    """Hidden cells of a table with items of clear levels: donors of near predictions come closer than the group's mean."""
    rng = random.Random(5)
    level, data, truth = {f"i{k}": rng.uniform(8, 20) for k in range(25)}, [], {}
    for s in range(30):
        for n, (item, v) in enumerate(level.items()):
            i, value = 100 * s + n, 2 ** (v + rng.gauss(0, 0.3) + 0.1 * s)
            hide = rng.random() < 0.1
            truth[i] = value
            data.append((i, "P", item, 2, f"r{s}", f"s{s}", "c", None if hide else float(value)))
    got = fill.fills(gap_rows(spark, data)).where("field_name = 'NormIntensity'").collect()
    error = np.median([abs(math.log2(float(r["filled_value"]) / truth[r["peptide_row_id"]])) for r in got])
    spread = np.median([abs(math.log2(truth[r["peptide_row_id"]]) - 14) for r in got])
    assert error < 0.4 * spread


def test_missing_and_measured(spark):
    d = spark.createDataFrame([("",), ("  ",), ("N/A",), ("Empty",), ("control",), (None,)], "v string")
    assert [r[0] for r in d.select(is_missing("v")).collect()] == [True, True, True, True, False, True]
    n = spark.createDataFrame([(1.0,), (0.0,), (-1.0,), (float("nan"),), (math.inf,), (None,)], "v double")
    assert [r[0] for r in n.select(is_measured("v")).collect()] == [True, False, False, False, False, False]
