import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import analysis, lexicon, tokenizer
from lexiloom.operators.analysis import SplitMode
from lexiloom.operators.lexicon import UNKNOWN, Entry, Lexicon


def every_path(text, words, at=0):
    """All ways to write a text without white space in entries and unknown characters."""
    if at == len(text):
        yield []
        return
    for e in [*words, UNKNOWN]:
        size = len(e.surface) or 1
        if e is UNKNOWN or text.startswith(e.surface, at):
            for rest in every_path(text, words, at + size):
                yield [(at, at + size, e), *rest]


def price(path, words):
    before, total = "", 0
    for _, _, e in path:
        total += (words.unknown_cost if e is UNKNOWN else e.cost) + words.connections.get((before, e.pos[0]), 0)
        before = e.pos[0]
    return total


def test_cheapest_path_by_brute_force():
    r = random.Random(1)
    for trial in range(400):
        entries = [Entry("".join(r.choice("abc") for _ in range(r.randint(1, 3))), r.randint(1, 30), pos=(r.choice("NV"),)) for _ in range(r.randint(1, 6))]
        joins = {(x, y): r.randint(-5, 20) for x in ("", "N", "V", "unknown") for y in ("N", "V", "unknown")} if trial % 2 else {}
        words = Lexicon(entries, joins, unknown_cost=25, group_unknown=False)
        text = "".join(r.choice("abcd") for _ in range(r.randint(0, 7)))
        found = words.path(text)
        assert "".join(text[a:b] for a, b, _ in found) == text
        ways = list(every_path(text, entries))
        least = min(price(w, words) for w in ways)
        assert price(found, words) == least
        if not joins:  # of equal ones, the longest last entry, and so on backwards
            cheap = [[(a, b) for a, b, _ in w] for w in ways if price(w, words) == least]
            assert [(a, b) for a, b, _ in found] == min(cheap, key=lambda w: [a for a, _ in reversed(w)])


def test_white_space_and_unknown_runs():
    words = Lexicon([Entry("ab", 5), Entry("c", 5)])
    at = lambda text: [(text[a:b], e is UNKNOWN) for a, b, e in words.path(text)]
    assert at(" ab　c\n") == [("ab", False), ("c", False)] and at("") == [] and at(" \t") == []
    assert at("xyzab12.!?") == [("xyz", True), ("ab", False), ("12", True), (".", True), ("!", True), ("?", True)]
    assert at("x y") == [("x", True), ("y", True)] and at("a b") == [("a", True), ("b", True)]


def test_units_and_forms(spark):
    rows = [
        ("選挙管理委員会", 10, None, None, None, ["noun", "proper"], ["選挙", "管理", "委員", "会"], ["選挙", "管理", "委員会"]),
        ("選挙", 10, None, None, "センキョ", ["noun"], None, None),
        ("走っ", 10, "走る", "走る", None, ["verb"], None, None),
        ("た", 5, None, None, None, ["aux"], None, None),
        (" ", 5, None, None, None, ["x"], None, None),
        (None, 5, None, None, None, ["x"], None, None),
    ]
    table = spark.createDataFrame(rows, "surface string, cost int, dictionary_form string, normalized_form string, reading_form string, pos array<string>, units_a array<string>, units_b array<string>")
    analyze = lexicon.lexicon_analyzer(lexicon.lexicon_of(table), table)
    df = spark.createDataFrame([(1, "選挙管理委員会 走った"), (2, None), (3, "")], "id long, t string")
    got = {m: [r.x for r in df.orderBy("id").select(analysis.in_mode(analyze, m)(F.col("t")).alias("x")).collect()] for m in "ABC"}
    assert {m: [x.surface for x in got[m][0]] for m in "ABC"} == {"A": ["選挙", "管理", "委員", "会", "走っ", "た"], "B": ["選挙", "管理", "委員会", "走っ", "た"], "C": ["選挙管理委員会", "走っ", "た"]}
    first, last = got["A"][0][0], got["C"][0][1]
    assert (first.reading_form, first.begin, first.end, list(first.pos)) == ("センキョ", 0, 2, ["noun", "*", "*", "*", "*", "*"])
    assert (last.dictionary_form, last.normalized_form, last.reading_form, last.begin, last.end) == ("走る", "走る", "走っ", 8, 10)
    assert list(got["A"][0][1].pos)[:2] == ["noun", "proper"]  # a unit that is no entry
    assert got["C"][1] is None and got["C"][2] == []
    words = tokenizer.Tokenizer(["[UNK]", "走る", "た"], word_form="dictionary", analyzer=analyze, split_mode="A")
    assert df.where("id = 1").select(words.tokens(F.col("t"))).first()[0] == ["[UNK]"] * 4 + ["走る", "た"]


def test_refused(spark):
    with pytest.raises(ValueError, match="spell"):
        Lexicon([Entry("ab", 1, units_a=("a", "c"))])
    with pytest.raises(ValueError, match="empty"):
        Lexicon([Entry("", 1)])
    with pytest.raises(ValueError, match="more than 2"):
        lexicon.lexicon_of(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "surface string, cost int"), most=2)


def test_a_corpus_s_own_words(spark):
    counts = spark.createDataFrame([("the", 50), ("cat", 10), ("t", 1), ("he", 1)], "word string, freq long")
    words = lexicon.lexicon_of(lexicon.with_costs(counts))
    assert [e.surface for _, _, e in words.path("thecatthe")] == ["the", "cat", "the"]
    assert [e.surface for e in sorted(words.entries, key=lambda e: e.cost)][:2] == ["the", "cat"]


def test_long_texts():
    words = Lexicon([Entry("ab", 5), Entry("a", 3), Entry("abab", 7)])
    found = words.path("ab" * 100_000)
    assert len(found) == 50_000 and all(e.surface == "abab" for _, _, e in found)
