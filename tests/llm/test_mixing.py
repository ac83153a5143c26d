from collections import Counter

import pytest

from lexiloom.llm import mixing
from tests.llm import brute


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 50, "d": 1, "e": 300, None: 7, "zero": 0}
    rows = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = brute.targets(sizes)
    assert {r.source: pytest.approx(r.target) for r in rows} == want
    assert sum(r.target for r in rows) == pytest.approx(sum(sizes.values()))


def test_mix_of_odd_rows(spark, odd, odd_rows):
    size = mixing.fresh(odd, "size")
    rows = mixing.with_copies(odd.withColumn(size, mixing.word_count(odd.text)), size, ("a_size", "a_target", "a_copies")).collect()
    assert len(rows) == len(odd_rows)
    assert all(0 <= x.a_copies <= 3 for x in rows)
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    drawn = Counter()
    for x in rows:
        drawn[x.doc_id, x.text] += x.a_copies
    for _ in range(2):
        assert Counter((x.doc_id, x.text) for x in mixed.collect()) == +drawn


def test_copies_follow_the_prefix_sums(spark, sf):
    """The query against a walk over each source's documents: one offset, one copy for each integer boundary."""
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    copies, words, sizes, target = brute.mixed_copies(docs)
    got = mixing.op1_mixing(spark, sf).collect()
    assert {r.doc_id: (r["size"], r.source_size, r.taken) for r in got} == {d: (words[d], sizes[s], copies[d] * words[d]) for d, _, s in docs}
    assert {r.doc_id: pytest.approx(r.target) for r in got} == {d: target[s] for d, _, s in docs}


def test_taken_words_come_near_the_target(spark):
    rows = [(i, "w " * (1 + i % 37), f"s{i % 4}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.with_copies(docs.withColumn("size", mixing.word_count(docs.text)), "size").collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.copies * r["size"]
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) < 2 * 37 for s in target)


def test_empty(spark, none):
    assert mixing.mix(none).count() == 0
