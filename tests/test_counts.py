import random

from pyspark.sql import functions as F

from lexiloom.operators import vocab


def test_arrays_are_counted_before_the_shuffle(spark, monkeypatch):
    """The counts and first places of exploded words, with a row a word and task shuffled, not one a place."""
    r = random.Random(1)
    lines = [(d, i, [r.choice(["a", "b", "c", "é", "", f"w{d}"]) for _ in range(r.randint(0, 9))]) for d in range(40, -3, -1) for i in range(3)]
    rows = spark.createDataFrame([*lines, (50, 0, None)], "d long, i int, w array<string>").repartition(3)
    exploded = rows.select("d", "i", F.posexplode("w").alias("pos", "word"))
    want = sorted(map(str, vocab.word_counts(exploded, ["d", "i", "pos"]).collect()))
    for held in (vocab.HELD, 4):
        monkeypatch.setattr(vocab, "HELD", held)
        assert sorted(map(str, vocab.array_counts(rows, "w", ["d", "i"]).collect())) == want
    parts = [p for p in vocab.array_counts(rows, "w", ["d", "i"])._jdf.queryExecution().optimizedPlan().toString().split("\n")]
    assert any("MapInArrow" in p for p in parts) and not any("Generate" in p for p in parts)
    assert vocab.array_counts(rows.limit(0), "w", ["d", "i"]).count() == 0


def test_best_pairs_meet_no_join(spark):
    """A feature's pairs are found within its row: none but the best become rows, nor does a join of all starts and ends."""
    from lexiloom.operators import qa

    rows = spark.createDataFrame([(1, 0, [0.0, 2.0, 1.0], [0.0, 1.0, 3.0], [None, (0, 1), (1, 2)])], "id long, feature_idx int, start_logits array<double>, end_logits array<double>, offsets array<struct<start:int,end:int>>")
    out = qa.answers(rows, spark.createDataFrame([(1, "ab")], "id long, context string"), n_best=2)
    assert [(r.rank, r.text, r.score, r.chosen) for r in out.orderBy("rank").collect()] == [(1, "ab", 5.0, "ab"), (2, "b", 4.0, "ab"), (4 - 1, "", 0.0, "ab")]
    plan = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not any("Join" in line and "feature_idx" in line for line in plan)
