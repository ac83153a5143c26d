import hashlib
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions.encoding import Lookup
from lexiloom.operators import pretraining

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "a", "##b", "c", "d", "##e", "##f", "g"]


def brute(key, sentences, room, most, share, dupes, seed, whole=True):
    """The same scheme as a plain walk."""
    draw = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    runs, own = [], []
    for s in sentences:
        if own and len(own) + len(s) > room:
            runs.append(own)
            own = []
        own = own + s
        while len(own) > room:
            runs.append(own[:room])
            own = own[room:]
    runs += [own] if own else []
    out = []
    for d in range(dupes):
        for q, tokens in enumerate(runs):
            ids = [VOCAB.index(t) if t in VOCAB else 1 for t in tokens]
            groups = []
            for i, t in enumerate(tokens):
                if i and whole and t.startswith("##"):
                    groups[-1].append(i)
                else:
                    groups.append([i])
            want, at = min(most, max(1, int((len(tokens) + 2) * share + 0.5))), []
            for _, g in sorted((draw(seed, key, d, q, "word", k), g) for k, g in enumerate(groups)):
                if len(at) + len(g) <= want:
                    at += g
            shown = list(ids)
            for i in at:
                h = draw(seed, key, d, q, "token", i)
                kind = int(h[:8], 16) % 10
                shown[i] = 4 if kind < 8 else ids[i] if kind == 8 else int(h[8:16], 16) % len(VOCAB)
            at.sort()
            out.append((key, d, q, [2, *shown, 3], [i + 1 for i in at], [ids[i] for i in at]))
    return out


DOCS = [
    (1, [["a", "##b", "c"], ["d", "##e", "##f", "g"], [], ["c"] * 5]),
    (2, [["g"] * 23]),
    (3, [["##b", "##e"], ["unknown", "a"]]),
    (4, []),
    (5, [[], []]),
    (6, None),
    (7, [["a"], ["d", "##e", "##f", "##f", "##f", "##f", "##f", "##f", "##f"], ["g"] * 8]),
]


@pytest.mark.parametrize("whole", [True, False])
def test_masked_examples(spark, whole):
    docs = spark.createDataFrame(DOCS, "ids long, tokens array<array<string>>").withColumn("own", F.lit("x"))
    frames = [pretraining.masked_examples(docs.repartition(n), "ids", Lookup.of(VOCAB), max_length=10, most=3, share=0.3, dupes=3, seed=7, whole_words=whole) for n in (1, 5)]
    want = sorted(x for key, tokens in DOCS for x in brute(key, tokens or [], 8, 3, 0.3, 3, 7, whole))
    for found in frames:
        assert sorted(tuple(r) for r in found.collect()) == want
    assert frames[0].columns == ["ids", "dupe", "sequence_idx", "input_ids", "masked_positions", "masked_ids"]
    assert pretraining.masked_examples(docs.limit(0), "ids", Lookup.of(VOCAB)).count() == 0


def test_shares(spark):
    """At scale eight in ten of the hidden tokens are masks, and as many are hidden as asked for."""
    docs = spark.createDataFrame([(i, [["a", "c", "d", "g"] * 30] * 4) for i in range(40)], "id long, tokens array<array<string>>")
    rows = pretraining.masked_examples(docs, "id", Lookup.of(VOCAB), max_length=512, dupes=4).collect()
    assert all(len(r.masked_ids) == 72 for r in rows)
    shown = [r.input_ids[p] for r in rows for p in r.masked_positions]
    assert 0.78 < sum(x == 4 for x in shown) / len(shown) < 0.83
    assert len({tuple(r.masked_positions) for r in rows}) == len(rows) == 160


def test_cuts():
    assert pretraining.cuts([3, 3, 3], 6) == [6, 3]
    assert pretraining.cuts([7, 13, 1], 6) == [6, 1, 6, 6, 2] and pretraining.cuts([], 5) == [] and pretraining.cuts([0, 5, 0, 5], 5) == [5, 5]


def test_wrong_settings(spark):
    docs = spark.createDataFrame(DOCS, "id long, tokens array<array<string>>")
    with pytest.raises(ValueError, match="lacks"):
        pretraining.masked_examples(docs, "id", Lookup.of(["a"]))
    with pytest.raises(ValueError):
        pretraining.masked_examples(docs, "id", Lookup.of(VOCAB), dupes=0)
    with pytest.raises(ValueError):
        pretraining.masked_examples(docs, "id", Lookup.of(VOCAB), max_length=2)


def test_a_sequence_costs_in_proportion_to_its_length(spark):
    """Groups of a long sequence are found once: looked for again at each of them, 6,000 took minutes."""
    rows = spark.createDataFrame([(1, [["a", "##b"] * 6000])], "id int, tokens array<array<string>>")
    began = time.time()
    got = pretraining.masked_examples(rows, "id", Lookup.of(VOCAB), max_length=12_002, most=500, dupes=2, seed=3).collect()
    assert time.time() - began < 20
    assert sorted((r.id, r.dupe, r.sequence_idx, r.input_ids, r.masked_positions, r.masked_ids) for r in got) == brute(1, [["a", "##b"] * 6000], 12_000, 500, 0.15, 2, 3)
