"""Matching by trie, top items, percentiles: against brute force, with nulls, ties, repeated rows, empty tables and clashing names."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abundera.llm import canonical, quantiles, topn
from abundera.llm.trie import LevenshteinAutomaton, Trie, edits


def osa(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 3))
def test_automaton_is_the_distance(word, text, limit):
    auto = LevenshteinAutomaton(word, limit)
    state = auto.start
    for ch in text:
        state = auto.step(state, ch) if state is not None else None
    got = auto.distance(state) if state is not None else None
    want = osa(word, text)
    assert got == (want if want <= limit else None)
    assert edits(word, text) <= want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=6), max_size=12), st.text("abcd", max_size=6))
def test_trie_finds_all_within(keys, word):
    trie = Trie((k, i) for i, k in enumerate(keys))
    assert {(d, k) for d, k, _ in trie.within(word, 2, lambda k: 2)} == {(osa(word, k), k) for k in keys if osa(word, k) <= 2}


TERMS = [(1, "organ", "liver", "X:01", ["hepar"]), (2, "organ", "heart left ventricle", "X:02", None), (3, "organ", "skin", "X:03", ["cutis"]), (4, "organ", "type 1 thing", None, None), (5, "organ", "type 2 thing", None, None), (6, "other", "kidney", None, None)]
MEANT = {
    "Liver": 1, "livr": 1, "LIVER ": 1, "ｌｉｖｅｒ": 1, "lívér": 1, '"liver"': 1, "livers": 1, "hepar": 1, "X:01": 1, "x_01": 1, "AC=X:01;NT=Liver": 1, "liver (biopsy)": 1, "section of liver": 1,
    "ventricle left heart": 2, "heartleftventricle": 2, "heart_left-ventricle": 2, "hart left ventricel": 2, "skni": 3, "type 2 thing": 5, "type 1 thin": 4, "type x thing": -1, "kidney": -1, "not liver": -1,
    "liver and skin": -1, "sk": -1, "zebra": -1, "ski jump": -1, "?!": -1, "x" * 5000: -1,
}


def test_meanings(spark):
    terms = spark.createDataFrame(TERMS + [(None, "organ", "nothing", None, None), (9, "organ", None, None, None)], "term_id long, field_name string, term string, code string, synonyms array<string>")
    refs = canonical.load_references(terms)
    assert {v: refs["organ"].match(v) for v in MEANT} == MEANT
    rows = spark.createDataFrame([(i, "organ", v, "clash") for i, v in enumerate([*MEANT, "liver", None, "Liver"])] + [(99, "nofield", "x", "")], "row long, field_name string, value string, term string")
    got = {r["row"]: r["term_id"] for r in canonical.map_rows(rows, terms).collect()}
    want = {i: m for i, (v, m) in enumerate(MEANT.items()) if v not in ("type 2 thing",)}
    assert got == want | {len(MEANT) + 2: 1, 99: -1}
    assert canonical.map_rows(rows.limit(0), terms).count() == 0 and canonical.map_rows(rows, terms.limit(0)).where("term_id <> -1").count() == 0


def brute_top(data, n):
    groups = {}
    for g, item, score, rid in data:
        best = groups.setdefault(g, {})
        if item not in best or (score, -rid) > (best[item][0], -best[item][1]):
            best[item] = (score, rid)
    return {g: sorted(((-s, i, r) for i, (s, r) in b.items()))[:n] for g, b in groups.items()}


def test_top_items_against_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.choice(["hot"] * 6 + [f"g{i}" for i in range(40)] + [None]), f"i{rng.randrange(30)}", float(rng.randrange(40)), i) for i in range(20_000)]
    df = spark.createDataFrame([(*d, 1, "x") for d in data], "grp string, item string, score double, rid long, place int, g string").repartition(7)
    got = {}
    for r in topn.top_items(df, ["grp"], "item", "score", "rid", 3).collect():
        got.setdefault((r["ga"], r["gb"]), []).append((-r["score"], r["item"], r["id"]))
    keys = {r["grp"]: (r["ga"], r["gb"]) for r in df.select("grp", *topn.group_key(["grp"])).distinct().collect()}
    assert {g: sorted(got[k]) for g, k in keys.items()} == brute_top(data, 3) and len(got) == len(keys)
    assert topn.top_items(df.limit(0), ["grp"], "item", "score", "rid", 3).count() == 0


def test_top_items_leave_out_nulls(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", None, 1.0, 1), ("a", "x", None, 2), ("a", "x", nan, 3), ("a", "x", 1.0, None), ("a", "x", 0.5, 5), ("a", "x", 0.5, 5)], "grp string, item string, score double, rid long")
    assert [(r["item"], r["score"], r["id"]) for r in topn.top_items(df, ["grp"], "item", "score", "rid", 2).collect()] == [("x", 0.5, 5)]


def test_row_groups_are_skipped(spark):
    """A hot group among small ones at the size of row groups as shipped: most of its row groups stay unread, the tops are right."""
    hot = spark.range(600_000).select(F.lit("hot").alias("grp"), F.concat(F.lit("item"), F.col("id").cast("string")).alias("item"), (F.hash("id") % 50_000).cast("double").alias("score"), F.col("id").alias("rid"))
    cold = spark.range(5000).select(F.concat(F.lit("g"), (F.col("id") % 500).cast("string")).alias("grp"), F.lit("x").alias("item"), F.col("id").cast("double").alias("score"), (F.col("id") + 1_000_000).alias("rid"))
    df = hot.unionByName(cold)
    folder = topn.cluster(df, ["grp"], "item", "score", "rid")
    read, skipped = topn.skipping(spark, folder, 3).agg(F.sum("row_groups_read"), F.sum("row_groups_skipped")).first()
    assert skipped > read
    top = topn.top_of_layout(spark, folder, 3).collect()
    best = hot.orderBy(F.col("score").desc(), "item").limit(3).collect()
    assert len(top) == 503 and {r["rid"] for r in best} <= {r["id"] for r in top}
    more = topn.top_of_layout(spark, folder, 5)  # the same layout for another N
    assert more.count() == 505


def rank_error(values, sketch, shares):
    v = np.sort(values)
    out = []
    for p, x in zip(shares, sketch.quantile(shares)):
        lo, hi = np.searchsorted(v, x * 0.9993, "left") / len(v), np.searchsorted(v, x * 1.0007, "right") / len(v)
        out.append(max(0.0, lo - p, p - hi) - 1 / len(v))
    return max(out)


SHARES = np.array([0.05, 0.25, 0.5, 0.75, 0.95, 0.99])


@pytest.mark.parametrize("make", [lambda r: r.lognormal(10, 2, 50_000), lambda r: r.uniform(1, 2, 50_000), lambda r: r.choice([5.0, 7.0, 1e300, 1e-300], 50_000), lambda r: np.full(1000, 3.0), lambda r: np.exp(r.uniform(-700, 700, 20_000)), lambda r: r.lognormal(14, 1, 7)])
def test_stated_rank_error(make):
    values = make(np.random.default_rng(3))
    s = quantiles.DyadicSketch()
    s.add(quantiles.encode(values))
    assert s.n == len(values) and rank_error(values, s, SHARES) <= quantiles.RANK_ERROR


def test_merging_and_deleting_are_exact():
    rng = np.random.default_rng(4)
    a, b = quantiles.encode(rng.lognormal(10, 2, 5000)), quantiles.encode(rng.lognormal(12, 1, 3000))
    whole, parts, less = quantiles.DyadicSketch(), quantiles.DyadicSketch(), quantiles.DyadicSketch()
    whole.add(np.concatenate([a, b]))
    parts.add(a)
    more = quantiles.DyadicSketch()
    more.add(b)
    parts.merge(quantiles.DyadicSketch.from_bytes(more.to_bytes()))
    assert np.array_equal(whole.dense(), parts.dense())
    whole.add(b, -1)
    less.add(a)
    assert np.array_equal(whole.dense(), less.dense()) and np.isnan(quantiles.DyadicSketch().quantile(SHARES)).all()


def test_signed_values_and_small_sketches():
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(0, 100, 30_000), np.zeros(3000), [-0.0]])
    s = quantiles.DyadicSketch()
    s.add(quantiles.encode(v))
    got, ordered = s.quantile(SHARES), np.sort(v)
    for p, x in zip(SHARES, got):
        slack = abs(x) * 0.0007 + 1e-300
        lo, hi = np.searchsorted(ordered, x - slack, "left") / len(v), np.searchsorted(ordered, x + slack, "right") / len(v)
        assert lo - quantiles.RANK_ERROR <= p <= hi + quantiles.RANK_ERROR
    few = rng.normal(0, 1, 400)
    exact = quantiles.DyadicSketch()
    exact.add(quantiles.encode(few))
    assert exact.cells is None and exact.quantile(SHARES) == pytest.approx(np.quantile(few, SHARES, method="nearest"), rel=6e-4, abs=0.05)
    again = quantiles.DyadicSketch.from_bytes(exact.to_bytes())
    again.add(quantiles.encode(few), -1)
    assert len(exact.to_bytes()) < 5000 and again.n == 0 and np.isnan(again.quantile(SHARES)).all()
    s.merge(exact)
    both = quantiles.DyadicSketch()
    both.add(quantiles.encode(np.concatenate([v, few])))
    assert np.array_equal(s.dense(), both.dense()) and quantiles.decode(quantiles.encode(np.array([0.0, -0.0, -8.0]))) == pytest.approx([0, 0, -8], rel=6e-4)


def test_sketches_leave_out_what_is_no_number(spark):
    df = spark.createDataFrame([("a", v, i) for i, v in enumerate([None, 0.0, -1.0, float("nan"), float("inf"), float("-inf"), 8.0])] + [(None, 2.0, 9)], "k string, v double, id long")
    got = {r["k"]: (r["n"], r["m"]) for r in quantiles.percentiles(quantiles.build_sketches(df, "k", "v", F.xxhash64("id")), "k", [1.0], ["m"]).collect()}
    assert got["a"][0] == 3 and got["a"][1] == pytest.approx(8.0, rel=1e-3) and got[None][0] == 1


def test_sketches_in_spark(spark):
    rng = np.random.default_rng(5)
    data = [(s, float(v), i, datetime(2024, 1, 1) + timedelta(days=i % 3), "x") for i, (s, v) in enumerate(zip(["hot"] * 9000 + ["b"] * 500 + [f"s{k % 50}" for k in range(500)], rng.lognormal(10, 2, 10_000)))]
    df = spark.createDataFrame(data, "sample string, v double, id long, day timestamp, salt string")
    names = ["a", "b", "c", "d", "e", "f"]
    whole = quantiles.merge_sketches(quantiles.build_sketches(df, "sample", "v", F.xxhash64("id")), "sample")
    by_day = [quantiles.build_sketches(df.where(F.dayofmonth("day") == d), "sample", "v", F.xxhash64("id")) for d in (1, 2, 3)]
    put = quantiles.merge_sketches(by_day[0].union(by_day[1]).union(by_day[2]), "sample")
    a = {r["sample"]: tuple(r) for r in quantiles.percentiles(whole, "sample", SHARES.tolist(), names).collect()}
    assert a == {r["sample"]: tuple(r) for r in quantiles.percentiles(put, "sample", SHARES.tolist(), names).collect()} and len(a) == 52
    v = np.sort([d[1] for d in data if d[0] == "hot"])
    assert a["hot"][1] == 9000 and abs(np.searchsorted(v, a["hot"][4]) / 9000 - 0.5) < quantiles.RANK_ERROR + 0.001
    signed = df.withColumn("w", F.lit(1)).union(df.where("sample = 'b'").withColumn("w", F.lit(-1)))
    gone = quantiles.percentiles(quantiles.merge_sketches(quantiles.build_sketches(signed, "sample", "v", F.xxhash64("id"), "w"), "sample"), "sample", [0.5], ["m"])
    assert gone.where("sample = 'b'").first()["n"] == 0 and gone.where("sample = 'b'").first()["m"] is None
    assert quantiles.merge_sketches(quantiles.build_sketches(df.limit(0), "sample", "v", F.xxhash64("id")), "sample").count() == 0


def test_all_entries_within_the_distance():
    """Against the edit distance to every entry."""
    rng = random.Random(11)
    words = ["".join(rng.choices("abc", k=rng.randint(2, 9))) for _ in range(60)]
    ref = canonical.Reference([(i, w, None, None) for i, w in enumerate(words, 1)])
    for _ in range(60):
        text = "".join(rng.choices("abc", k=rng.randint(2, 9)))
        want = {(edits(text, w), w, i) for i, w in enumerate(words, 1) if edits(text, w) <= canonical.term_distance(w)}
        assert set(ref.candidates(text)) == want
