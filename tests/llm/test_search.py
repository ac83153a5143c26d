import random
import re
from collections import Counter
from math import floor, log

import numpy as np

from lexiloom.llm import search
from tests.llm.conftest import prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(terms_of(t))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, total = len(bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            m = 25 + (75 * b.total() * n) // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in terms_of(text) if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def test_counts():
    assert search.term_counts("Ab_c É—x 9é\u0085Z　 \x7fÀB".encode()) == Counter(x.encode() for x in ["ab", "c", "É—x", "9é\u0085z　", "Àb"])
    long = ("word " * 700_000 + "x" * 3_000_000 + " word").encode()
    assert search.term_counts(long) == Counter({b"word": 700_001, b"x" * 3_000_000: 1})


def test_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "ñandú", "the", "THE", "of"]
    text = lambda n: " ".join(r.choice(words[: r.choice([5, 65])]) for _ in range(n))
    docs = [(i, text(r.randint(0, 40))) for i in range(400)] + [(900 + i, "the w1 w2") for i in range(30)]
    docs += [(None, "w3 w4 w5"), (7, "w3 w3"), (7, "w3 w3"), (8, None), (9, ""), (10, " ?!")]
    r.shuffle(docs)
    items = [(i, text(12)) for i in range(12)] + [(50, "the w1 w2"), (50, "the w1 w2"), (51, None), (52, ""), (53, "unheard of"), (None, "w3 w4"), (54, "w1 " * 300)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert rows_of(search.search(search.index_documents(frame), asked)) == want
    some = search.index_documents(frame, search.item_terms(asked, "item_id").select("term"), shard_docs=7, shard_postings=50)
    assert rows_of(search.search(some, asked, most_pairs=20)) == want
    assert [x for x in want if x[0] == 50][0][2:] == [x for x in rows_of(search.search(some, asked, k=1)) if x[0] == 50][0][2:]


def test_tree_opens_equal_bounds_and_few_others(spark):
    """A tree of three levels gives what sorting all scores gives, at any k, ties by id; and opens few ranges for a rare term."""
    r = np.random.default_rng(3)
    n, terms = 3000, 20
    held = r.random((n, terms)) < r.random(terms) * 0.5
    held[:, 0] = True
    impacts = r.integers(1, 4, (n, terms)) * 100 * held
    codes, of = np.nonzero(impacts.T)[0], np.nonzero(impacts.T)[1]
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    starts = np.searchsorted(of, np.arange(n + 1))
    tree = search.Tree(starts, codes, impacts[of, codes], terms)
    assert [level.shape[1] for level in tree.levels] == [188, 12, 1]
    ids = list(map(int, r.permutation(n)))
    for k in (1, 10, 500):
        for rows in ([0], [1, 2, 3], [5, 19]):
            weights, best = r.integers(1, 5, len(rows)), []
            tree.search(np.array(rows), weights, np.zeros(terms, np.int64), ids, best, k)
            scores = impacts[:, rows] @ weights
            assert best == sorted((-int(s), False, ids[i]) for i, s in enumerate(scores) if s)[:k]


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "a b c", "x"), (2, prose(1, 50), "x")], "item_id long, text string, rank string")
    found = search.search(search.index_documents(odd), items)
    want = brute([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows_of(found) == want and found.columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(search.index_documents(none), items).count() == 0
    assert search.search(search.index_documents(odd), items.limit(0)).count() == 0
