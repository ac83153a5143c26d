import hashlib
import math
from collections import Counter

import numpy as np

from lexiloom.llm import fingerprints as fp
from tests.llm.conftest import prose

RANKS = np.arange(fp.LEVELS)


def test_levels_are_entropies():
    data = prose(5, 60).encode()
    levels = fp.entropy_levels(np.frombuffer(data, np.uint8))
    assert len(levels) == len(data) - fp.WINDOW + 1
    for i in range(0, len(levels), 5):
        n = np.array(list(Counter(data[i : i + fp.WINDOW]).values())) / fp.WINDOW
        assert abs(levels[i] - -(n * np.log2(n)).sum() / math.log2(fp.WINDOW) * (fp.LEVELS - 1)) < 1.01


def test_features_by_brute_force(monkeypatch):
    for words in (5, 20, 400):
        data = prose(words, words).encode()
        if len(data) < fp.WINDOW:
            continue
        ranks = RANKS[fp.entropy_levels(np.frombuffer(data, np.uint8))]
        width = min(fp.NEIGHBOURS, len(ranks))
        marks = Counter(a + int(np.argmin(ranks[a : a + width])) for a in range(len(ranks) - width + 1))
        least = min(fp.MARKS, max(1, len(ranks) - width + 1))
        want = [data[i : i + fp.WINDOW] for i in sorted(marks) if marks[i] >= least]
        assert fp.features(data, RANKS) == want
        monkeypatch.setattr(fp, "BLOCK", 512)
        assert fp.features(data, RANKS) == want
        monkeypatch.undo()


def test_likeness():
    a, b = prose(1, 900).encode(), prose(2, 900).encode()
    fa, fb = fp.filters(fp.features(a, RANKS)), fp.filters(fp.features(b, RANKS))
    half = fp.filters(fp.features(a[: len(a) // 2] + b[: len(b) // 2], RANKS))
    assert fp.likeness(fa, fa) == 1.0 and fp.likeness(fa, fb) < 0.1 < 0.3 < fp.likeness(fa, half)
    none = fp.filters([])
    assert fp.likeness(none, none) == 1.0 and fp.likeness(none, fa) == 0.0


def test_query_by_brute_force(spark, sf, monkeypatch):
    monkeypatch.setattr(fp, "PER_RANGE", 30)
    got = {r.doc_id: r for r in fp.op4_fingerprints(spark, sf).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert set(got) == {d for d, _ in rows}
    for i, (d, text) in enumerate(rows):
        half = len(text) // 2
        edited = text[: len(text) - half] + rows[(i + 1) % len(rows)][1][:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(text)
    by_text = {}
    for d, text in rows:
        assert by_text.setdefault(text, got[d].fingerprint) == got[d].fingerprint


def test_odd_rows(odd, odd_rows, none):
    ranks = fp.rarity_of(odd)
    assert sorted(ranks) == list(range(fp.LEVELS))
    got = fp.fingerprint(odd, ranks).collect()
    assert len(got) == len(odd_rows) and got[0].fingerprint == got[1].fingerprint == ""
    assert fp.fingerprint(none, fp.rarity_of(none)).count() == 0
    dealt = fp.with_next(odd).collect()
    assert sum(not r["__lead"] for r in dealt) == len(odd_rows)
    assert fp.with_next(none).count() == 0


def test_every_text_has_a_feature():
    """Short texts whose runs mark different windows, and texts that repeat, which spread their marks evenly."""
    periodic = ["a" * 500, "ab" * 250, "xyz" * 200, "0123456789" * 50, "0123456789abcde" * 40, "a" * (fp.BLOCK + 500)]
    cut = [prose(seed, 80)[: 100 + seed % 61] for seed in range(300)]
    for text in periodic + cut:
        assert fp.features(text.encode(), RANKS)
    a, b = (fp.filters(fp.features(x.encode(), RANKS)) for x in ("a" * 500, "xyz" * 200))
    assert fp.likeness(a, b) < 0.1
    turned = fp.filters(fp.features(("yzx" * 200).encode(), RANKS))
    assert fp.likeness(b, turned) == 1.0


def brute_features(data, ranks):
    if len(data) < fp.WINDOW:
        return [data] if data else []
    level = ranks[fp.entropy_levels(np.frombuffer(data, np.uint8))].tolist()
    width = min(fp.NEIGHBOURS, len(level))
    marks = Counter(min(range(a, a + width), key=lambda i: (level[i], i)) for a in range(len(level) - width + 1))
    least = min(fp.MARKS, len(level) - width + 1, max(marks.values()))
    return [data[i : i + fp.WINDOW] for i in sorted(marks) if marks[i] >= least]


def brute_chain(found):
    """Sets of bits, a filter each."""
    found = list(dict.fromkeys(found))
    bits = lambda x: [int.from_bytes(hashlib.sha1(x).digest()[4 * i : 4 * i + 4], "big") % fp.BITS for i in range(fp.HASHES)]
    return [{b for x in found[i : i + fp.PER_FILTER] for b in bits(x)} for i in range(0, len(found), fp.PER_FILTER)]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    best = []
    for x in a:
        chance = [len(x) * len(y) / fp.BITS for y in b]
        best.append(max(min(1, max(0, (len(x & y) - c) / (min(len(x), len(y)) - c))) for y, c in zip(b, chance)))
    return sum(best) / len(best)


def brute_rows(rows):
    """What the query gives for (doc_id, text) in their order, each followed by the next."""
    counts = Counter()
    for _, text in rows:
        if len(text.encode()) >= fp.WINDOW:
            counts.update(fp.entropy_levels(np.frombuffer(text.encode(), np.uint8)).tolist())
    ranks = np.zeros(fp.LEVELS, np.int64)
    ranks[sorted(range(fp.LEVELS), key=lambda k: (counts[k], k))] = range(fp.LEVELS)
    spelled = lambda chain: fp.encoded(np.array([np.packbits(np.isin(np.arange(fp.BITS), list(x))) for x in chain], np.uint8).reshape(-1, fp.BITS // 8))
    chains = [brute_chain(brute_features(t.encode(), ranks)) for _, t in rows]
    out = []
    for i, (d, text) in enumerate(rows):
        j, half = (i + 1) % len(rows), len(text) // 2
        edited = (text[: len(text) - half] + rows[j][1][:half]).encode()
        new = brute_chain(brute_features(edited, ranks))
        out.append((d, len(text), hashlib.sha256(edited).hexdigest(), spelled(chains[i]), spelled(new), round(brute_likeness(chains[i], new), 4), round(brute_likeness(chains[i], chains[j]), 4)))
    return out


def as_rows(df):
    return [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 4), round(r.near_next, 4)) for r in df.collect()]


def test_query_by_a_walk(spark, sf, monkeypatch):
    monkeypatch.setattr(fp, "PER_RANGE", 30)
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert sorted(as_rows(fp.op4_fingerprints(spark, sf))) == brute_rows(rows)


def test_query_of_odd_tables(spark, odd, odd_rows, none):
    """Repeated ids in the order of their texts; a null id comes last of all, and nothing follows it."""
    got = as_rows(fp.fingerprints_with_edits(odd))
    known = sorted((r[0], r[1] or "") for r in odd_rows if r[0] is not None)
    assert len(got) == len(odd_rows)
    assert sorted((g[0], g[1]) for g in got if g[0] is not None) == [(d, len(t)) for d, t in known]
    after = {}
    for (d, t), (_, n) in zip(known, known[1:]):
        half = len(t) // 2
        after.setdefault(d, set()).add(hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest())
    assert all(g[2] in after[g[0]] for g in got if g[0] is not None and g[0] != known[-1][0])
    assert fp.fingerprints_with_edits(none).count() == 0
