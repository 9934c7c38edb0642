"""Channels of problem 10: each damages clean texts, which must come back."""

import sys
from pathlib import Path

import pytest

from abundera.llm import mojibake

sys.path.insert(0, str(Path(__file__).parent))
from test_texts import CLEAN  # noqa: E402


def restored(spark, damaged, copies=1, base=700):
    """Restored texts of the damaged ones, each standing so many times beside clean ones, by place and copy."""
    rows = [(i, CLEAN[i % len(CLEAN)] + f" Run {i}.") for i in range(base)]
    rows += [(1_000_000 + k * 10_000 + c, t) for k, t in enumerate(damaged) for c in range(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["restored"] for r in mojibake.restore_documents(df, "doc_id", "text").collect()}
    assert not [i for i in got if i < 1_000_000]
    return [[got.get(1_000_000 + k * 10_000 + c) for c in range(copies)] for k in range(len(damaged))]


@pytest.mark.parametrize(("true", "read", "text"), [("cp1252", "gb18030", CLEAN[1]), ("cp1251", "big5", CLEAN[3]), ("koi8-r", "euc_kr", CLEAN[3]), ("cp1252", "gb18030", "Größe für Lösung")])
def test_single_byte_text_in_a_multibyte_reader(spark, true, read, text):
    assert restored(spark, [text.encode(true).decode(read, "replace")]) == [[text]]


@pytest.mark.parametrize("copies", [1, 10, 1000])
def test_copies_do_not_change_the_verdict(spark, copies):
    texts = [(CLEAN[3], "koi8-r", "cp1251"), (CLEAN[5], "gb18030", "latin-1")]
    assert restored(spark, [t.encode(true).decode(read) for t, true, read in texts], copies) == [[t] * copies for t, _, _ in texts]


def test_a_damaged_word_may_recur(spark):
    text = "Насос: давленили"  # spelled like words of the corpus, which does not hold it
    damaged = [text.encode("koi8-r").decode("cp1251") + f" {'x' * i}" for i in range(12)]
    assert all(got.endswith(f"давленили {'x' * i}") for i, (got,) in enumerate(restored(spark, damaged, base=2800)))


@pytest.mark.parametrize("errors", ["ignore", "replace"])
def test_many_lost_bytes_in_a_text_without_blanks(spark, errors):
    texts = [CLEAN[5] * 6, CLEAN[5] * 60]  # 108 and 1,080 characters
    assert restored(spark, [t.encode().decode("cp1252", errors) for t in texts]) == [[t] for t in texts]


def test_more_than_eight_lost_letters(spark):
    text = "Prüflösungsmengenänderungsüberprüfungsausschüsse für Größenänderungen überall"
    base = [(i, f"{text} {CLEAN[1]} {i}") for i in range(200)]
    damaged = "".join(w + " " for w in text.split())[:-1].encode("latin-1").decode("utf-8", "replace")
    assert damaged.split()[0].count("\ufffd") > 4
    long_word = "ä".join(["Größe", "für", "Lösung", "Säule", "größtenteils", "Auffälligkeiten"])
    assert long_word.encode("latin-1").decode("utf-8", "replace").count("\ufffd") == 13
    rows = base + [(300 + i, f"{long_word} {i}") for i in range(50)] + [(1000, damaged), (1001, long_word.encode("latin-1").decode("utf-8", "replace"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["restored"] for r in mojibake.restore_documents(df, "doc_id", "text").collect()}
    assert got == {1000: text, 1001: long_word}


def test_lost_first_bytes(spark):
    """A replacement sign for the first byte of a character; the others still stand."""
    text = CLEAN[5]
    data, lost = text.encode(), [3, 12, 24]
    damaged = "".join("\ufffd" if i in lost else bytes([b]).decode("latin-1") for i, b in enumerate(data))
    assert restored(spark, [damaged]) == [[text]]


@pytest.mark.parametrize("times", [17, 170])
def test_gaps_in_words_of_any_length(spark, times):
    """306 and 3,060 characters without a blank, every tenth continuation byte lost: one search."""
    text = CLEAN[5] * times
    out, n = [], 0
    for b in text.encode():
        n += 0x80 <= b < 0xC0
        out.append("\ufffd" if 0x80 <= b < 0xC0 and n % 10 == 0 else bytes([b]).decode("latin-1"))
    assert restored(spark, ["".join(out)]) == [[text]]


def test_the_sketch_grows_with_the_corpus():
    assert mojibake.word_cells(0) == mojibake.word_cells(100_000) == mojibake.LEAST_CELLS < mojibake.word_cells(1_000_000) == mojibake.MOST_CELLS
