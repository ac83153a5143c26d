"""Plain walks over rows, to hold the operators' results against."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np

from lexiloom.llm import mixing, quality


def quality_scores(docs, labels):
    """{doc_id: score} of (doc_id, text) by the textbook form of the discriminant, learnt from (doc_id, label) outside the held-out third."""
    x = {d: np.array(quality.statistics((t or "").encode())) for d, t in docs}
    rows = {k: np.array([x[d] for d, label in labels if label == k and d in x and zlib.crc32(str(d).encode()) % 3 != 1]) for k in (0, 1)}
    n = {k: len(r) for k, r in rows.items()}
    mean = {k: r.mean(axis=0) for k, r in rows.items()}
    cov = {k: (r - mean[k]).T @ (r - mean[k]) / n[k] for k, r in rows.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    density = {}
    for k in (0, 1):
        shrunk = (1 - quality.TO_DIAGONAL - quality.TO_POOLED) * cov[k] + quality.TO_DIAGONAL * np.diag(np.diag(cov[k])) + quality.TO_POOLED * pooled
        shrunk = shrunk + np.diag(quality.RIDGE * np.diag(pooled) + 1e-9)
        inverse, log_det = np.linalg.inv(shrunk), np.linalg.slogdet(shrunk)[1]
        density[k] = {d: math.log(n[k] / (n[0] + n[1])) - 0.5 * log_det - 0.5 * (v - mean[k]) @ inverse @ (v - mean[k]) for d, v in x.items()}
    odds = {d: max(-quality.MOST_LOG_ODDS, min(quality.MOST_LOG_ODDS, density[1][d] - density[0][d])) for d in x}
    return {d: 1 / (1 + math.exp(-o)) for d, o in odds.items()}


def without_boilerplate(docs, ratio=0.1, least=2):
    """(doc_id, text, source) without lines that over `ratio` of a source's documents, and `least` of them, hold."""
    hosts = {}
    for d, text, source in docs:
        hosts.setdefault(source, {}).setdefault(d, set()).update(x for x in (text or "").split("\n") if x.strip(" "))
    bad = {}
    for source, pages in hosts.items():
        n = Counter(x for lines in pages.values() for x in lines)
        bad[source] = {x for x, k in n.items() if k >= least and k > ratio * len(pages)}
    return [(d, text if text is None else "\n".join(x for x in text.split("\n") if x not in bad[source]), source) for d, text, source in docs]


def shingles(text, width):
    w = (text or "").encode().lower().split()
    n = min(width, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def representatives(docs, width=5, percent=80):
    """The doc_ids, all different, of (doc_id, text) that stay: the least of each group, and those without words."""
    sets = {d: shingles(t, width) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {d for d in sets if find(d) == d}


def targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST_COPIES):
    """Targets by repeated resharing."""
    names = sorted([s for s in sizes if s is not None]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def mixed_copies(docs):
    """({doc_id: copies}, {source: size}, {source: target}) of (doc_id, text, source): a walk over each source's documents with one offset."""
    words = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in docs}
    sizes = Counter()
    for d, _, source in docs:
        sizes[source] += words[d]
    target = targets(sizes)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    copies = {}
    for source in sizes:
        own = sorted((words[d] - (1 << 60) if md5(str(d)) < "8" else -words[d], md5(str(d)), d) for d, _, s in docs if s == source)
        start = int(md5(f"{mixing.SEED}:{chr(0) if source is None else source}")[:8], 16) / 2**32
        rate = target[source] / sizes[source] if sizes[source] else 0.0
        for k, (_, _, d) in enumerate(own):
            copies[d] = min(mixing.MOST_COPIES, math.floor(start + rate * (k + 1)) - math.floor(start + rate * k))
    return copies, words, sizes, target
