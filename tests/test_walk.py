"""Paths by arrays against the path of each text by itself."""

import random

import pyarrow as pa
import pytest

from lexiloom.functions.encoding import rolled
from lexiloom.operators import lexicon
from lexiloom.operators.lexicon import UNKNOWN, Entry, Lexicon, Walk
from lexiloom.plans import catalogue


@pytest.mark.parametrize("table, beside", [(1 << 20, 64), (1 << 20, 3), (0, 64)])
def test_walked_together_as_alone(monkeypatch, table, beside):
    monkeypatch.setattr(lexicon, "TABLE", table)
    monkeypatch.setattr(lexicon, "SIDE_BY_SIDE", beside)
    r = random.Random(2)
    for _ in range(150):
        entries = [Entry("".join(r.choice("abcé走😀") for _ in range(r.randint(1, 4))), r.randint(1, 30)) for _ in range(r.randint(0, 8))]
        words = Lexicon(entries, unknown_cost=r.choice([5, 25]), group_unknown=False)
        texts = [None if r.random() < 0.1 else "".join(r.choice("abcdé走😀 \t　") for _ in range(r.randint(0, 30))) for _ in range(r.randint(0, 20))]
        cost, ends = Walk(words).texts(pa.array(["zz", *texts], pa.string()).slice(1))
        paths = [words.path(t or "") for t in texts]
        assert ends.to_pylist() == [[end for _, end, _ in p] for p in paths]
        assert cost.to_pylist() == [sum(words.unknown_cost if e is UNKNOWN else e.cost for _, _, e in p) for p in paths]


def test_other_white_space_can_cost():
    words = Lexicon([Entry("ab", 5)], unknown_cost=9, group_unknown=False)
    for text, cost, ends in (("ab\tab ab", 24, [2, 3, 5, 8]), ("\t" * 70, 630, list(range(1, 71))), ("  ", 0, [])):
        assert [x.to_pylist() for x in Walk(words, " ").texts(pa.array([text]))] == [[cost], [ends]]


def test_refused():
    for words in (Lexicon([Entry("ab", 5)]), Lexicon([Entry("a b", 5)], group_unknown=False), Lexicon([Entry("ab", 5)], {("noun", "noun"): 1}, group_unknown=False)):
        with pytest.raises(ValueError, match="by arrays"):
            Walk(words)


def test_rolled_sums():
    r = random.Random(1)
    for base, modulus in ((31, 1000003), (7, 13), (2**31 - 2, 2**31 - 1)):
        lists = [[r.randint(0, 10**6) for _ in range(r.randint(0, 40))] for _ in range(r.randint(0, 12))]
        want = []
        for numbers in lists:
            a = 0
            for n in numbers:
                a = (a * base + n) % modulus
            want.append(a)
        assert rolled(pa.array([[1], *lists], pa.list_(pa.int32())).slice(1), base, modulus).to_pylist() == want


def test_no_morphemes_are_made_for_paths(spark):
    plan = catalogue.queries()["lexicon_paths"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "dictionary_form" not in plan and "lambda" not in plan
