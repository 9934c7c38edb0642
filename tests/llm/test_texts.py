"""Token ids, containers and restored texts: exact round trips and brute force."""

import itertools
import random
from pathlib import Path

import pytest

from abundera.llm import bpe, mojibake, packing

VOCABULARY = Path(bpe.DEFAULT_VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary file")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary())


def texts():
    rng = random.Random(1)
    pool = [chr(c) for c in (*range(32, 127), *range(0xA0, 0x180), *range(0x400, 0x450), *range(0x4E00, 0x4E40), 0x1F9EA, 0x200D, 10, 13, 9)]
    out = ["", " ", "\n\n  x", "<|endoftext|>", "it's we'll DON'T", "a" * 3000, "ab" * 2000, "日本語" * 800, "\u0000\u007f", "Ångström 75 µm", "﻿x", "1234567890" * 30]
    return out + ["".join(rng.choices(pool, k=rng.randrange(200))) for _ in range(300)]


@needs_vocabulary
def test_ids_equal_the_public_tokenizers(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(VOCABULARY.with_suffix(".json")))
    t.encode_special_tokens = True
    assert [encoder.encode(x) for x in texts()] == [e.ids for e in t.encode_batch(texts(), add_special_tokens=False)]


@needs_vocabulary
def test_decoding_gives_the_text_back(encoder):
    token = {i: b for b, i in encoder.ranks.items()}
    assert all(b"".join(token[i] for i in encoder.encode(x)).decode() == x for x in texts())


@needs_vocabulary
def test_ids_in_spark(spark, encoder):
    data = [(i, t, "x") for i, t in enumerate([*texts(), None])]
    df = spark.createDataFrame(data, "id long, text string, ids string").repartition(3)
    got = {r["id"]: r["ids"] for r in bpe.encode_texts(df, "id", "text").collect()}
    assert got == {i: encoder.encode(t) for i, t, _ in data} and got[len(data) - 1] == []
    n = {r["id"]: r["n_tokens"] for r in bpe.count_tokens(df, "id", "text").collect()}
    assert n == {i: len(v) for i, v in got.items()} and bpe.encode_texts(df.limit(0), "id", "text").count() == 0


def fewest(sizes, capacity):
    """Fewest containers by trying all assignments of few items."""
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            if all(sum(s for s, w in zip(sizes, where) if w == b) <= capacity for b in range(n)):
                return n
    return 0


def test_completion_is_optimal_on_small_cases():
    rng = random.Random(5)
    for _ in range(40):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        got = packing.complete(sizes, 20)
        assert sorted(s for b in got for s in b) == sorted(sizes) and all(sum(b) <= 20 for b in got)
        assert len(got) == fewest(sizes, 20), sizes


def test_completion_beats_best_fit():
    rng = random.Random(1)
    sizes = [rng.randint(20, 60) for _ in range(200)]
    assert len(packing.complete(sizes, 100)) < len(packing.best_fit(sizes, 100))
    assert packing.complete([], 10) == []


def test_fillings_are_the_undominated_ones():
    """Against all sub-multisets: none that a swap of some items for one larger item within the room improves."""
    rng = random.Random(7)
    for _ in range(60):
        items, slack = sorted(rng.randint(1, 12) for _ in range(rng.randint(1, 7))), rng.randint(1, 25)
        every = {tuple(sorted((items[i] for i in c), reverse=True)) for n in range(len(items) + 1) for c in itertools.combinations(range(len(items)), n)}
        fits = [f for f in every if sum(f) <= slack]

        def swapped(f):
            left = list(items)
            for x in f:
                left.remove(x)
            room = slack - sum(f)
            for n in range(len(f) + 1):
                for c in itertools.combinations(f, n):
                    if any(sum(c) <= x <= sum(c) + room and c != (x,) for x in left):
                        return True
            return False

        got = list(packing.fillings(packing.Stock(items), slack))
        assert sorted(got) == sorted(f for f in fits if not swapped(f)) and [sum(f) for f in got] == sorted((sum(f) for f in got), reverse=True)


def test_lower_bound():
    rng = random.Random(6)
    for _ in range(40):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        assert packing.lower_bound(sizes, 20) <= fewest(sizes, 20)
    assert packing.lower_bound([11] * 5, 20) == 5


def test_packing_in_spark(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_ITEMS", 300)
    rng = random.Random(2)
    sizes = [0, None, 2048, 2049, 10_000, 4096] + [rng.randint(1, 900) for _ in range(2000)]
    df = spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "doc_id long, n_tokens int, shard string, id int")
    rows = packing.pack(df, "doc_id", "n_tokens", 2048).collect()
    used, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
        if r["container_id"] is not None:
            used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 2048 and len(pieces) == len(sizes)
    for i, s in enumerate(sizes):
        parts = sorted(pieces[i])
        assert sum(p[2] for p in parts) == (s or 0) and (len(parts) == 1) == ((s or 0) <= 2048)
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:k]) for k in range(len(parts))]
    assert sum(used.values()) / (2048 * len(used)) > 0.97
    assert packing.pack(df.limit(0), "doc_id", "n_tokens", 2048).count() == 0


CLEAN = [
    "Naïve scaling of the 75 µm column at 40 °C means “not measured” – don’t merge.", "Die Säule lief größtenteils ohne Auffälligkeiten für 20 Minuten.", "A proteína não está presente na condição de referência.",
    "Колонку заменили перед партией, давление было высокое.", "Les peptides ont été élués après une étape de séchage.", "请检查色谱柱压力。蛋白质由肽段定量。", "El año anterior no se añadió ningún estándar.",
]
DAMAGE = [("utf-8", "cp1252", 0), ("utf-8", "latin-1", 1), ("utf-8", "mac_roman", 4), ("utf-8", "cp437", 0), ("cp1251", "latin-1", 3), ("koi8-r", "cp1251", 3), ("utf-8", "cp1251", 1), ("gb18030", "latin-1", 5), ("utf-8", "cp850", 6)]


def sloppy(text, true, read):
    return b"".join(bytes([b]).decode(read, "ignore").encode("utf-8") or chr(b).encode() for b in text.encode(true)).decode() if read.startswith("cp125") else text.encode(true).decode(read)


def corpus():
    base = [(i, CLEAN[i % len(CLEAN)] + f" Run {i}.") for i in range(700)]
    bad = [(1000 + k, sloppy(CLEAN[c], true, read)) for k, (true, read, c) in enumerate(DAMAGE)]
    bad += [(1100, CLEAN[1].encode("latin-1").decode("utf-8", "replace")), (1101, sloppy(sloppy(CLEAN[4], "utf-8", "cp1252"), "utf-8", "cp1252")), (1102, CLEAN[0] + " " + sloppy("Use café-grade filters.", "utf-8", "cp1252"))]
    good = [(2000, "An import showed “Ã©” where é was meant."), (2001, "If you see â€™ in an export, it was opened wrongly."), (2002, "Write \\u00b5 or &micro; here."), (2003, "Giá trị đo ở nhiệt độ phòng, Νερό, שלום, ﬁ 𝛼 ✅"), (2004, "├── raw\n└── out"), (2005, None), (2006, ""), (2007, "   "), (2008, "plain ascii " * 5000)]
    return base, bad, good


def test_damage_is_found_and_restored(spark):
    base, bad, good = corpus()
    df = spark.createDataFrame([(*r, "x") for r in base + bad + good], "doc_id long, text string, restored string").repartition(4)
    got = {r["doc_id"]: r["restored"] for r in mojibake.restore_documents(df, "doc_id", "text").collect()}
    assert set(got) == {i for i, _ in bad}
    wrong = [i for k, (_, _, c) in enumerate(DAMAGE) if got[(i := 1000 + k)] != CLEAN[c]]
    assert not wrong, [got[i] for i in wrong]
    assert got[1100] == CLEAN[1] and got[1101] == CLEAN[4] and got[1102].endswith("café-grade filters.")


def test_nothing_to_restore(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "abc")], "doc_id long, text string")
    assert mojibake.restore_documents(df, "doc_id", "text").count() == 0 and mojibake.restore_documents(df.limit(0), "doc_id", "text").count() == 0


def test_very_long_words_take_linear_time(spark):
    import time

    sentence = CLEAN[5]
    rows = [(i, sentence * 3) for i in range(50)] + [(100, sentence * 4000), (101, sloppy(sentence * 1500, "utf-8", "latin-1")), (102, ("é" * 20 + "x") * 2000), (103, ("ab\ufffd" * 10_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["doc_id"]: r["restored"] for r in mojibake.restore_documents(df, "doc_id", "text").collect()}
    assert got[101] == sentence * 1500 and 100 not in got and 103 in got and time.time() - began < 60
