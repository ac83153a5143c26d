import random
from itertools import combinations

import numpy as np
import pytest

from lexiloom.llm import neardedup, shingles
from lexiloom.llm.components import connected_components
from tests.llm.conftest import SCHEMA


def brute(rows, width, percent=80):
    """{(doc_id, text): component} by all pairs."""
    sets = []
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        n = min(width, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[find(i)] = find(j)
    ids = {}
    for i, (doc_id, _) in enumerate(rows):
        if sets[i] and doc_id is not None:
            r = find(i)
            ids[r] = min(ids.get(r, doc_id), doc_id)
    return {(d, t): ids.get(find(i), d) if sets[i] else d for i, (d, t) in enumerate(rows)}, {(d, t): len(s) for (d, t), s in zip(rows, sets)}


def check(spark, rows, width):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want, sizes = brute(rows, width)
    got = neardedup.near_duplicates(docs, width).join(docs.selectExpr("doc_id AS d", "text", "xxhash64(text) AS h").distinct(), neardedup.F.expr("doc_id <=> d AND th = h")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.text): r.component_id for r in got} == want
    assert {(r.doc_id, r.text): r.n_shingles for r in got} == sizes


def edited(words, r, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = r.choice("abcdefgh") * 3
    return " ".join(out)


def test_groups_of_copies(spark):
    r = random.Random(0)
    rows = []
    for g in range(12):
        words = [f"w{r.randrange(400)}" for _ in range(80)]
        rows += [(len(rows) + k, edited(words, r, r.randrange(0, 6))) for k in range(8)]
    rows += [(1000 + i, t) for i, t in enumerate(["", None, "one", "one", "One", "two words", "a b c", "a b c d", "A B C D"])]
    check(spark, rows, 4)


def test_chains_meet_in_the_second_look(spark):
    """Copies of copies: neighbours link, ends don't."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(30):
        rows.append((500 - i, " ".join(words)))
        words[r.randrange(100)] = f"new{i}"
    check(spark, rows, 3)


def test_large_buckets_are_split(spark, monkeypatch):
    """Groups of copies of copies that share words with each other, in blocks of four members."""
    monkeypatch.setattr(neardedup, "BLOCK", 4)
    monkeypatch.setattr(neardedup, "SPLIT", 6)
    monkeypatch.setattr(neardedup, "BLOCK_BYTES", 2000)
    r = random.Random(5)
    rows, common = [], [f"w{i}" for i in range(70)]
    for g in range(8):
        words = common + [f"g{g}x{i}" for i in range(30)]
        for i in range(12):
            rows.append((900 - len(rows), " ".join(words)))
            words[r.randrange(100)] = f"new{g}x{i}"
    for depth in (1, 3):
        monkeypatch.setattr(neardedup, "DEPTH", depth)
        check(spark, rows, 3)


def test_query_of_every_document(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, sizes = brute(rows, 4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardedup.op8_near_dedup(spark, sf).collect()}
    assert got == {d: (sizes[d, t], want[d, t], want[d, t] == d) for d, t in rows}


def test_recall_on_a_larger_table(spark):
    """Links of a thousand documents, found through the rarest shingles, against the groups."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    sets = {}
    for d, text in rows:
        w = (text or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(0, len(w) - 4))} or ({tuple(w)} if w else set())
    holders = {}
    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    pairs = set()
    for d, s in sets.items():
        # Two sets at 0.8 share one of any fifth of either's shingles, and one more.
        rare = sorted(s, key=lambda x: (len(holders[x]), x))[: len(s) - (4 * len(s) + 4) // 5 + 1]
        pairs |= {(min(d, e), max(d, e)) for x in rare for e in holders[x] if e != d}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = {r.doc_id: r.component_id for r in neardedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(group[a] == group[b] for a, b in links)
    assert len(links) > 50 and found >= 0.99 * len(links)


def test_odd_rows(spark, odd, odd_rows, none):
    check(spark, [r[:2] for r in odd_rows], 5)
    kept = neardedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in [0, 1, 2, 3, 4, 8, None, 9, 10, 11])
    assert neardedup.near_duplicates(none).count() == 0 and neardedup.keep_one(none).count() == 0


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        x = np.unique(r.integers(0, 2**63, 400).astype(np.uint64))
        y = np.concatenate([x[:320], r.integers(0, 2**63, 80).astype(np.uint64)])
        a, b = (np.frombuffer(shingles.lanes(shingles.signature(s)), "<u2") for s in (x, np.unique(y)))
        errors.append((a == b).mean() - 320 / 480)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.v: r.l for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("n", [300, 2000])
def test_components_of_shuffled_paths(spark, n):
    """Keys are hashes, so a chain's vertices stand in no order."""
    names = list(range(n))
    random.Random(n).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    assert {r.v: r.l for r in connected_components(edges).collect()} == dict.fromkeys(range(n), 0)


def test_components_of_any_graph(spark):
    r = random.Random(7)
    edges = [(r.randrange(600), r.randrange(600)) for _ in range(280)] + [(900, r.randrange(600)) for _ in range(20)]
    least = {v: v for e in edges for v in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {x.v: x.l for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == least
