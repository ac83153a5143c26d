import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexiloom.llm import lm


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()) + [None]


def expected(rows):
    train = Counter()
    for r in rows:
        if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2:
            train.update(words(r[1]))
    n, v = sum(train.values()), len(train)
    base = lambda t: sum(math.log10((train[w] + 1) / (n + v + 1)) for w in words(t))
    return n, [(r[0], len(words(r[1])), sum(train[w] > 0 for w in words(r[1])), round(base(r[1]), 6)) for r in rows]


@pytest.fixture(autouse=True)
def few_updates(monkeypatch):
    monkeypatch.setattr(lm, "LEAST_UPDATES", 20_000)


def test_counts_and_base_of_odd_rows(odd, odd_rows):
    model, counts = lm.fit(odd)
    got = lm.score(odd, model, counts).collect()
    n, want = expected(odd_rows)
    assert model.n == n
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got], key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def by_hand(model, text, train):
    """The score of one text, token by token, straight from the parameters."""
    v, p = model.vocabulary, lm.Parameters(model.vocabulary, model.rows)
    r, q, words = p.of("r")[:, :-1], p.of("q"), p.of("v")
    ids = [v.words[lm.END]] * 2
    total = 0.0
    for word in lm.tokens((text or "").encode()):
        k = v.words.get(word)
        k = v.unknown(word) if k is None else k
        h = np.append(r[ids[-2]] @ p.of("c1")[:, :-1] + r[ids[-1]] @ p.of("c2")[:, :-1], 1)
        runs = len(v.starts) - 1
        of = next(i for i in range(runs) if k < v.starts[i + 1]) if k < v.n_words else runs + k - v.n_words
        share = np.exp(q @ h)
        total += math.log10(share[of] / share.sum())
        if k < v.n_words:
            own = np.exp(words[v.starts[of] : v.starts[of + 1]] @ h)
            total += math.log10(own[k - v.starts[of]] / own.sum())
        else:
            c, j = train[word], k - v.n_words
            if model.unknown_words[j]:
                total += math.log10((c - model.discount if c else model.discount * model.unknown_words[j]) / model.unknown_tokens[j])
        ids.append(k)
    return total


def test_score_by_hand(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 500)
    model, counts = lm.fit(odd)
    train = Counter({bytes(r.word): r.c for r in counts.collect()})
    got = sorted((str(r.doc_id), round(r.score, 3)) for r in lm.score(odd, model, counts).collect())
    want = sorted((str(r[0]), round(by_hand(model, r[1], train), 3)) for r in odd_rows)
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-4, atol=2e-2)


def test_query_of_every_document(spark, sf):
    """Counts and base score of the query by brute force; its score beats the base on rows that it hasn't learnt from."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, want = expected(rows)
    got = lm.op2_lm_scoring(spark, sf).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 3)) for r in got) == [(d, t, k, round(x, 3)) for d, t, k, x in sorted(want)]
    assert {r.train_tokens for r in got} == {n} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in got)
    new = [r for r in got if r.held_out]
    assert sum(r.score for r in new) > sum(r.base_score for r in new)


def test_probabilities_sum_to_one(odd):
    model, counts = lm.fit(odd)
    v = model.vocabulary
    every = np.arange(v.n_words + lm.SUFFIXES)
    for a, b in ((0, 1), (v.words[lm.END],) * 2, (v.n_words, 2)):
        assert math.isclose((10 ** model.log_probabilities(np.full(len(every), a), np.full(len(every), b), every)).sum(), 1, rel_tol=1e-4)
    rows = [(bytes(r.word), r.c) for r in counts.collect() if bytes(r.word) not in v.words]
    k = np.array([v.unknown(w) - v.n_words for w, _ in rows])
    sums = np.bincount(k, weights=10 ** model.behind(k, np.array([c for _, c in rows])), minlength=lm.SUFFIXES)
    for i in set(k.tolist()):
        assert math.isclose(sums[i] + 10 ** model.behind(np.array([i]), np.array([0]))[0], 1, rel_tol=1e-6)


def test_what_is_learnt_grows_with_the_corpus(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 900}" for k in range(30))) for i in range(200)]
    sizes = []
    for n in (20, 200):
        docs = spark.createDataFrame(rows[:n], "doc_id long, text string")
        sizes.append(lm.fit(docs)[0].vocabulary.n_words)
    assert sizes[1] > 2 * sizes[0]


def test_context_helps_on_held_out_texts(spark, monkeypatch):
    import random

    monkeypatch.setattr(lm, "LEAST_UPDATES", 400_000)
    r = random.Random(0)
    sides = [[f"x{i}" for i in range(50)], [f"y{i}" for i in range(50)]]
    rows = [(i, " ".join(r.choice(sides[i % 2]) for _ in range(40))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = lm.fit(docs)
    got = [x for x in lm.score(docs, model, counts).collect() if x.held_out]
    assert len(got) > 20 and sum(x.score for x in got) > sum(x.base_score for x in got) + 0.1 * sum(x.n_tokens for x in got)


def test_scores_do_not_depend_on_the_layout(spark, sf, monkeypatch):
    """The same scores of documents in 1, 4 and 16 partitions, by several trainers."""
    monkeypatch.setattr(lm, "TRAINER_TOKENS", 1 << 13)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = []
    for n in (1, 4, 16):
        dealt = docs.repartition(n)
        model, counts = lm.fit(dealt)
        got.append(sorted((r.doc_id, r.score) for r in lm.score(dealt, model, counts).collect()))
    for other in got[1:]:
        assert [d for d, _ in other] == [d for d, _ in got[0]] and np.allclose([x for _, x in other], [x for _, x in got[0]], rtol=1e-6)


def test_score_by_hand_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, counts = lm.fit(docs)
    train = Counter({bytes(r.word): r.c for r in counts.collect()})
    got = {r.doc_id: r.score for r in lm.score(docs, model, counts).collect()}
    some = sorted(rows, key=lambda r: len(r[1] or ""))[:150]  # the walk is slow: short texts
    assert np.allclose([got[d] for d, _ in some], [by_hand(model, t, train) for _, t in some], rtol=1e-4, atol=2e-2)


def test_words_with_known_counts_meet_no_join(spark, sf, monkeypatch):
    """The same scores however many counts the tasks know; rows for the join are only of words beyond these."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    monkeypatch.setattr(lm, "LEAST_COUNT", 40)
    got, joined = [], []
    for most in (1 << 18, 1000, 0):
        monkeypatch.setattr(lm, "COUNTED", most)
        model, counts = lm.fit(docs)
        assert len(model.counted) <= most and sum(model.counts) == sum(r.c for r in counts.collect() if bytes(r.word) in set(model.counted))
        joined.append(lm.uncounted(docs, model).where("word IS NOT NULL").count())
        got.append(sorted(tuple(r) for r in lm.score(docs, model, counts).collect()))
    known = set(model.vocabulary.words)
    rare = sum(len({w for w in lm.tokens((r.text or "").encode()) if w not in known}) for r in docs.collect())
    assert joined[2] == rare and joined[0] < 0.1 * rare and joined[0] < joined[1] < rare
    for other in got[1:]:
        assert [x[:4] for x in other] == [x[:4] for x in got[0]] and np.allclose([x[4:] for x in other], [x[4:] for x in got[0]], rtol=1e-9)


def test_batches_move_rows_once(monkeypatch):
    """A step's moves are those of summed gradients, written out token by token."""
    vocabulary = lm.vocabulary_of([(b"w%d" % i, 60 - i) for i in range(40)] + [(lm.END, 10)], [b"xx"])
    shares = np.concatenate([np.add.reduceat(vocabulary.counts, vocabulary.starts[:-1]), np.ones(lm.SUFFIXES)])
    trainer = lm.Trainer(vocabulary, shares, lm.Parameters(vocabulary).rows, 1)
    rng = np.random.default_rng(0)
    a, b, w = rng.integers(0, vocabulary.n_words + lm.SUFFIXES, (3, 200))
    w.sort()
    moved = {}
    monkeypatch.setattr(trainer, "move", lambda name, rows, sums, times, rate: moved.__setitem__(name, (rows, sums, times)))
    p, draws = trainer.parameters, np.random.default_rng([lm.SEED, 1])
    trainer.step(a, b, w, 0.1)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    r, q, v, c1, c2 = (p.of(x).astype(float) for x in ("r", "q", "v", "c1", "c2"))
    noise = np.searchsorted(trainer.class_sums, draws.random(lm.NOISE) * trainer.class_sums[-1])
    k = vocabulary.class_of()[w]
    inside = [i for i in range(200) if w[i] < vocabulary.n_words and vocabulary.starts[k[i] + 1] - vocabulary.starts[k[i]] > 1]
    spread = dict(zip(inside, draws.random((len(inside), lm.WORD_NOISE))))
    want = {x: np.zeros_like(p.of(x), float) for x in ("r", "q", "v", "c1", "c2")}
    for i in range(200):
        h = np.append(r[a[i], :-1] @ c1[:, :-1] + r[b[i], :-1] @ c2[:, :-1], 1)
        back = np.zeros(lm.DIMS + 1)
        for to, x, g in [("q", k[i], 1 - sigmoid(q[k[i]] @ h - trainer.class_noise[k[i]])), *(("q", j, -sigmoid(q[j] @ h - trainer.class_noise[j])) for j in noise)]:
            want[to][x] += g * h
            back += g * q[x]
        if i in spread:
            low, high = trainer.low[k[i]], trainer.high[k[i]]
            drawn = np.searchsorted(trainer.word_sums, low + spread[i] * (high - low), "right")
            for x, own in [(w[i], 1), *((x, 0) for x in drawn)]:
                g = own - sigmoid(v[x] @ h - trainer.word_noise[x])
                want["v"][x] += g * h
                back += g * v[x]
        for to, x, c in (("c1", a[i], c1), ("c2", b[i], c2)):
            want["r"][x, :-1] += c[:, :-1] @ back[:-1]
            want[to][:, :-1] += np.outer(r[x, :-1], back[:-1])
    for name, (rows, sums, _) in moved.items():
        full = np.zeros_like(want[name])
        full[rows] = sums
        assert len(set(rows.tolist())) == len(rows) and np.allclose(full, want[name], rtol=1e-3, atol=1e-4), name


def test_empty(none):
    model, counts = lm.fit(none)
    assert lm.score(none, model, counts).count() == 0


def test_no_word_is_the_end():
    assert lm.tokens(b"\0end x") == [b"\0\0end", b"x", lm.END] and lm.tokens(None) == lm.tokens(b" ") == [lm.END]
