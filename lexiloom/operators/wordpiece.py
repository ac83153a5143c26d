"""WordPiece training on a cluster: words and their pieces stay in tables, the driver holds the vocabulary.

Training merges the most frequent neighbouring pair, over and over. A round counts all
pairs in the tables and opens the most frequent ones. Pairs only lose places while
others merge, and a merge's new pairs have no more places than the pair that stood at
their border, so until the best opened pair is as rare as the best closed one, no
closed pair can be next: words fall apart at closed pairs, into runs that recur in many
words. The driver takes the distinct runs, of a bounded number and length, and merges
in them one pair after another, exactly. Where two ways lead to one token, its pairs may
have places at closed borders; these have an upper bound, and the round ends before a
bound could matter. Tasks then replace the runs in their words.

Where even few opened pairs give too long runs or too many, a round of another kind
takes along what stands beside the most frequent pairs, in place of runs, and follows
their merges as far as these numbers tell.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.storage import discard, materialize

CONTINUED = "##"
#: Pairs that a round without runs takes to the driver.
TOP = 1024
#: Pairs opened in the first round, and at least and at most in others.
OPENED, LEAST_OPENED, MOST_OPENED = 128, 2, 32_768
#: Distinct runs that come to the driver, some 1 KB each there, and the pieces of one.
MOST_RUNS, MOST_RUN = 100_000, 128
#: Pieces that a task counts or cuts into runs at a time.
GATHERED = 1 << 20

Pair = tuple[int, int]


@dataclass
class Round:
    """The most frequent pairs, in order, and the counts of what stands before and after them."""

    pairs: list[tuple[int, int, int]]  # (count, first, second), by count descending, then ids
    all: bool  # whether there are no other pairs
    before: dict[Pair, dict[int, int]] = field(default_factory=lambda: defaultdict(dict))
    after: dict[Pair, dict[int, int]] = field(default_factory=lambda: defaultdict(dict))


class Vocabulary:
    """Tokens and their ids, in the order of their making."""

    def __init__(self, tokens: Sequence[str]):
        self.tokens = list(dict.fromkeys(tokens))
        self.ids = {t: i for i, t in enumerate(self.tokens)}

    def id(self, token: str) -> int:
        if token not in self.ids:
            self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return self.ids[token]


def merges_of(found: Round, vocab: Vocabulary, size: int, least: int) -> tuple[list[tuple[int, int, int]], bool]:
    """The merges (first, second, merged) that are certain after a round, and whether training has ended. Adds to the vocabulary."""
    n: dict[Pair, int] = {(a, b): c for c, a, b in found.pairs}
    exact = dict.fromkeys(n, True)
    listed = set(n)
    firsts, seconds = defaultdict(set), defaultdict(set)
    for a, b in n:
        firsts[a].add((a, b))
        seconds[b].add((a, b))
    heap = [(-c, p) for p, c in n.items()]
    heapify(heap)
    last = None if found.all or not found.pairs else (-found.pairs[-1][0], found.pairs[-1][1:])
    touched: set[int] = set()
    out: list[tuple[int, int, int]] = []

    def put(p: Pair, count: int, certain: bool) -> None:
        if count <= 0:
            n.pop(p, None)
            return
        n[p], exact[p] = count, certain
        firsts[p[0]].add(p)
        seconds[p[1]].add(p)
        heappush(heap, (-count, p))

    while heap and len(vocab.tokens) < size:
        entry = heappop(heap)
        count, (a, b) = -entry[0], entry[1]
        if n.get((a, b)) != count:
            continue  # counted anew since
        if (last is not None and entry > last) or not exact[a, b]:
            return out, False
        if count < max(least, 1):
            return out, True
        name = vocab.tokens[a] + vocab.tokens[b].removeprefix(CONTINUED)
        known = name in vocab.ids
        m = vocab.id(name)
        out.append((a, b, m))
        del n[a, b]
        if known:  # its pairs add to others' counts
            return out, False
        before, after = found.before.get((a, b), {}), found.after.get((a, b), {})
        plain = (a, b) in listed and not {a, b} & touched and a != b and b not in before and a not in after
        for p in [*seconds[a], *firsts[b]]:
            if p not in n:
                continue
            left = p[1] == a
            other = p[0] if left else p[1]
            own = (before if left else after).get(other, 0)
            new = (other, m) if left else (m, other)
            if plain and other not in touched and other not in (a, b):
                if own:
                    put(p, n[p] - own, exact[p])
            else:  # it may have lost some of its places, and the new pair has no more than it had
                put(p, n[p], False)
                put(new, min(n[p], count, own if plain else count), False)
        if plain:
            for side, beside in ((True, before), (False, after)):
                for other, own in beside.items():
                    if other not in touched and other not in (a, b):
                        put((other, m) if side else (m, other), own, True)
                    elif ((other, a) if side else (b, other)) not in n:
                        put((other, m) if side else (m, other), own, False)
        # two merged places side by side were a pair (b, a); of equal tokens the merged pair itself, which may leave one over
        if a == b:
            for new in ((m, m), (a, m), (m, a)):
                put(new, count, False)
        elif (b, a) in n and not plain:
            put((m, m), min(n[b, a], count), False)
        touched |= {a, b, m}
    return out, found.all or len(vocab.tokens) >= size


@dataclass
class Opened:
    """A round's pairs (count, first, second) by count descending, then ids; the first `n` are open."""

    pairs: list[tuple[int, int, int]]
    n: int
    all: bool  # whether there are no other pairs


class Borders:
    """Upper bounds for the places that pairs have outside the runs.

    A token's borders are the round's first pieces at which its spellings begin and end:
    one each, but for tokens that several merges gave.
    """

    def __init__(self, opened: Opened):
        self.open = {(a, b) for _, a, b in opened.pairs[: opened.n]}
        self.closed = {(a, b): c for c, a, b in opened.pairs[opened.n :]}
        self.rest = 0 if opened.all else opened.pairs[-1][0]
        self.firsts: dict[int, tuple[int, ...]] = {}
        self.lasts: dict[int, tuple[int, ...]] = {}
        self.several: set[int] = set()
        self.beside: tuple[dict, dict] | None = None
        #: Of any pair without a place in the runs that a token of several borders may be in.
        self.unseen = 0

    def add(self, a: int, b: int, m: int, known: bool) -> None:
        """a and b were merged to m."""
        first, last = self.firsts.get(a, (a,)), self.lasts.get(b, (b,))
        if known:
            first = tuple(dict.fromkeys((*self.firsts.get(m, (m,)), *first)))
            last = tuple(dict.fromkeys((*self.lasts.get(m, (m,)), *last)))
        self.firsts[m], self.lasts[m] = first, last
        if max(len(first), len(last)) == 1:
            return
        self.several.add(m)
        if self.beside is None:
            self.beside = defaultdict(list), defaultdict(list)
            for (x, y), c in self.closed.items():
                self.beside[0][x].append((y, c))
                self.beside[1][y].append((x, c))
        for own, beside in ((last, self.beside[0]), (first, self.beside[1])):
            sums: Counter = Counter()
            for x in own:
                for y, c in beside.get(x, ()):
                    sums[y] += c
            self.unseen = max(self.unseen, max(sums.values(), default=0) + len(own) * self.rest)
        for other in self.several:
            self.unseen = max(self.unseen, self.outside(m, other), self.outside(other, m))

    def outside(self, a: int, b: int) -> int:
        """The most places that (a, b) may have outside the runs."""
        if a not in self.several and b not in self.several:
            return 0  # it has places in the runs, so its one border is open
        pairs = [(x, y) for x in self.lasts.get(a, (a,)) for y in self.firsts.get(b, (b,))]
        return sum(self.closed.get(p, self.rest) for p in pairs if p not in self.open)


def merge_runs(runs: dict[tuple[int, ...], int], opened: Opened, vocab: Vocabulary, size: int, least: int) -> tuple[list[list[int]], bool]:
    """The runs (pieces -> count) after all merges that are certain, and whether training has ended. Adds to the vocabulary."""
    words, freqs = [list(r) for r in runs], list(runs.values())
    n: Counter = Counter()
    where: dict[Pair, set[int]] = defaultdict(set)
    firsts, seconds = defaultdict(set), defaultdict(set)
    for k, word in enumerate(words):
        for p in zip(word, word[1:]):
            n[p] += freqs[k]
            where[p].add(k)
    for p in n:
        firsts[p[0]].add(p)
        seconds[p[1]].add(p)
    borders = Borders(opened)
    most = dict(n)  # with what may stand outside
    heap = [(-c, p) for p, c in n.items()]
    heapify(heap)
    last = None  # no pair after it in this order is certain
    if opened.n < len(opened.pairs) or opened.pairs and not opened.all:
        c, a, b = opened.pairs[min(opened.n, len(opened.pairs) - 1)]
        last = (-c, (a, b))
    while heap and len(vocab.tokens) < size:
        entry = heappop(heap)
        count, best = -entry[0], entry[1]
        if most.get(best) != count:
            continue  # counted anew since
        if n[best] != count or (last is not None and entry > last) or count <= borders.unseen:
            return words, False
        if count < max(least, 1):
            return words, True
        a, b = best
        name = vocab.tokens[a] + vocab.tokens[b].removeprefix(CONTINUED)
        known = name in vocab.ids
        m = vocab.id(name)
        borders.add(a, b, m, known)
        changed = set()
        for k in list(where[best]):
            word = words[k]
            for p in zip(word, word[1:]):
                n[p] -= freqs[k]
                where[p].discard(k)
                changed.add(p)
            words[k] = word = apply_merges(word, {best: (0, m)}, once=True)
            for p in zip(word, word[1:]):
                n[p] += freqs[k]
                where[p].add(k)
                changed.add(p)
        for p in changed:
            firsts[p[0]].add(p)
            seconds[p[1]].add(p)
        if m in borders.several:
            changed |= firsts[m] | seconds[m]
        for p in changed:
            if n[p] <= 0:
                del n[p]
                most.pop(p, None)
                firsts[p[0]].discard(p)
                seconds[p[1]].discard(p)
            else:
                most[p] = n[p] + borders.outside(*p)
                heappush(heap, (-most[p], p))
    return words, len(vocab.tokens) >= size or last is None


def apply_merges(ids: list[int], ranks: dict[Pair, tuple[int, int]], once: bool = False) -> list[int]:
    """A word's pieces after merges, pair -> (rank, merged), in the order of their ranks; or after the first of them alone."""
    while len(ids) > 1:
        best = min((ranks[p] for p in zip(ids, ids[1:]) if p in ranks), default=None)
        if best is None:
            return ids
        out, i = [], 0
        while i < len(ids):
            if i + 1 < len(ids) and ranks.get((ids[i], ids[i + 1])) == best:
                out.append(best[1])
                i += 2
            else:
                out.append(ids[i])
                i += 1
        ids = out
        if once:
            break
    return ids


def counted_round(words: DataFrame, top: int = TOP) -> Round:
    """A round's counts from words (freq, ids)."""
    at = lambda i: F.get("ids", i)
    runs = lambda k: F.when(F.size("ids") >= k, F.sequence(F.lit(0), F.size("ids") - k))
    pairs = words.select("freq", F.explode(F.transform(runs(2), lambda i: F.struct(at(i).alias("a"), at(i + 1).alias("b")))).alias("p"))
    counts = pairs.groupBy("p.a", "p.b").agg(F.sum("freq").alias("n"))
    rows = [(r.n, r.a, r.b) for r in counts.orderBy(F.desc("n"), "a", "b").limit(top + 1).collect()]
    found = Round(rows[:top], len(rows) <= top)
    if found.pairs:
        code = lambda a, b: a.cast("long") * (1 << 32) + b
        asked = [(a << 32) + b for _, a, b in found.pairs]
        three = words.select("freq", F.explode(F.transform(runs(3), lambda i: F.struct(at(i).alias("x"), at(i + 1).alias("y"), at(i + 2).alias("z")))).alias("t")).select("freq", "t.*")
        three = three.where(code(F.col("x"), F.col("y")).isin(asked) | code(F.col("y"), F.col("z")).isin(asked))
        wanted = {(a, b) for _, a, b in found.pairs}
        for r in three.groupBy("x", "y", "z").agg(F.sum("freq").alias("n")).collect():  # as many as the pairs have neighbours
            if (r.y, r.z) in wanted:
                found.before[r.y, r.z][r.x] = r.n
            if (r.x, r.y) in wanted:
                found.after[r.x, r.y][r.z] = r.n
    return found


def characters(rows: DataFrame) -> DataFrame:
    """(c, n, first) of words (word, freq): how often a character stands, and the first word, and place in it, that it continues."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        first: dict[str, tuple[str, int]] = {}
        for batch in batches:
            for word, freq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for c in word:
                    n[c] += freq
                for c in set(word[1:]):
                    if c not in first or word < first[c][0]:
                        first[c] = word, word.index(c, 1)
        words, places = zip(*(first.get(c, (None, None)) for c in n)) if n else ((), ())
        columns = [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array(words, pa.string()), pa.array(places, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["c", "n", "word", "at"])

    found = rows.select("word", F.col("freq").cast("long")).mapInArrow(run, "c string, n long, word string, at int")
    return found.groupBy("c").agg(F.sum("n").alias("n"), F.min(F.when(F.col("word").isNotNull(), F.struct("word", "at"))).alias("first"))


def first_pieces(counts: DataFrame, vocab: Vocabulary, kept: set[str]) -> DataFrame:
    """(word, freq) -> (freq, ids) of words of two kept characters and more."""
    ids = dict(vocab.ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [[ids[(CONTINUED if i else "") + c] for i, c in enumerate(w) if c in kept] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(split, pa.list_(pa.int32()))], ["freq", "ids"])

    return counts.select("word", F.col("freq").cast("long").alias("freq")).mapInArrow(run, "freq long, ids array<int>").where(F.size("ids") > 1)


def merged(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    ranks = {(a, b): (k, m) for k, (a, b, m) in enumerate(merges)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [apply_merges(x, ranks) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["freq", "ids"])

    return words.mapInArrow(run, words.schema).where(F.size("ids") > 1)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of words (freq, ids), some at a time: counts, pieces one after another, where each word ends, and of each two neighbours their code and whether they are in one word."""
    held: list[pa.RecordBatch] = []

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows.column(1).combine_chunks()
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
        code = (flat[:-1].astype(np.int64) << 32) + flat[1:]
        inside = np.ones(len(code), bool)
        inside[ends[:-1] - 1] = False
        return rows.column(0).to_numpy(), flat, ends, code, inside

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(len(x.column(1).flatten()) for x in held) >= GATHERED:
            yield out()
            held = []
    if held:
        yield out()


def opened_pairs(words: DataFrame, n: int) -> Opened:
    """The n most frequent pairs of words (freq, ids), open, and as many others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for freq, _, ends, code, inside in gathered(batches):
            of = np.searchsorted(ends, np.flatnonzero(inside), "right")
            codes, at = np.unique(code[inside], return_inverse=True)
            sums = np.zeros(len(codes), np.int64)
            np.add.at(sums, at, freq[of])
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(sums)], ["code", "n"])

    counts = words.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "code").limit(2 * n + 1).toArrow().to_pydict()
    pairs = [(c, code >> 32, code & 0xFFFFFFFF) for c, code in zip(rows["n"], rows["code"])]
    return Opened(pairs[: 2 * n], min(n, len(pairs)), len(pairs) <= 2 * n)


def stretches(code: np.ndarray, inside: np.ndarray, opened: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of opened pairs begin and end: the places of their first pieces, and of their last."""
    at = np.searchsorted(opened, code).clip(max=len(opened) - 1)
    here = np.concatenate([[False], inside & (opened[at] == code), [False]])
    return np.flatnonzero(here[1:] & ~here[:-1]), np.flatnonzero(~here[1:] & here[:-1])


def codes(opened: Opened) -> np.ndarray:
    return np.sort(np.array([(a << 32) + b for _, a, b in opened.pairs[: opened.n]], np.int64))


def runs_of(words: DataFrame, opened: Opened) -> dict[tuple[int, ...], int] | None:
    """The distinct runs of opened pairs with their counts, or nothing if they are too many or one is too long."""
    asked, most, longest = codes(opened), MOST_RUNS, 4 * MOST_RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for freq, flat, ends, code, inside in gathered(batches):
            first, end = stretches(code, inside, asked)
            bytes_ = flat.tobytes()
            counts = freq[np.searchsorted(ends, first, "right")].tolist()
            for i, j, n in zip((4 * first).tolist(), (4 * end + 4).tolist(), counts):
                found[bytes_[i:j] if j - i <= longest else b""] += n
            if len(found) > most or b"" in found:  # an empty run tells that there are too many
                found = Counter({b"": 1})
                break
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["run", "n"])

    counts = words.mapInArrow(run, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
    rows = counts.orderBy("run").limit(most + 1).toArrow()  # an empty run comes first
    if rows.num_rows > most or (rows.num_rows and not len(rows.column(0)[0].as_py())):
        return None
    return {tuple(np.frombuffer(r, np.int32).tolist()): n for r, n in zip(*(c.to_pylist() for c in rows.columns))}


def replaced(words: DataFrame, opened: Opened, runs: dict[tuple[int, ...], int], after: list[list[int]]) -> DataFrame:
    """words (freq, ids) with the runs as they are after a round."""
    asked, table = codes(opened), {}
    for run, ids in zip(runs, after):
        if len(ids) < len(run):
            table[np.array(run, np.int32).tobytes()] = np.array(ids + [-1] * (len(run) - len(ids)), np.int32).tobytes()
    known = words.sparkSession.sparkContext.broadcast((asked, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, table = known.value
        for freq, flat, ends, code, inside in gathered(batches):
            first, end = stretches(code, inside, asked)
            old = flat.tobytes()
            new = bytearray(old)
            for i, j in zip((4 * first).tolist(), (4 * end + 4).tolist()):
                ids = table.get(old[i:j])
                if ids is not None:
                    new[i:j] = ids
            ids = np.frombuffer(new, np.int32)
            kept = ids >= 0
            begins = np.cumsum(kept)[ends - 1]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], begins]), pa.int32()), pa.array(ids[kept]))
            rows = pa.RecordBatch.from_arrays([pa.array(freq), lists], ["freq", "ids"])
            yield from (rows.slice(i, 10_000) for i in range(0, rows.num_rows, 10_000))

    return words.mapInArrow(run, words.schema).where(F.size("ids") > 1)


def train_distributed(counts: DataFrame, size: int, least: int, alphabet: int, specials: Sequence[str], top: int = TOP) -> list[str]:
    """The vocabulary that merging one pair after another over (word, freq) gives, without words on the driver.

    A round reads the words' pieces three times, once more where it must open fewer
    pairs, and writes them once; the pairs opened follow the runs found. Rows of equal
    words count each; null and empty words are passed over.
    """
    rows = counts.where("word <> ''").select("word", "freq")
    # There are at most as many characters as Unicode has.
    letters = characters(rows).collect()
    heavy = sorted(letters, key=lambda r: (-r.n, r.c))[:alphabet]
    kept = {r.c for r in heavy}
    vocab = Vocabulary([*specials, *sorted(kept)])
    for r in sorted((r for r in heavy if r.first), key=lambda r: r.first):
        vocab.id(CONTINUED + r.c)
    words = materialize(first_pieces(rows, vocab, kept), "words")
    ended, n = False, OPENED
    while not ended and len(vocab.tokens) < size:
        opened = opened_pairs(words, min(n, 2 * (size - len(vocab.tokens)) + LEAST_OPENED))
        if not opened.pairs:
            break
        while (runs := runs_of(words, opened)) is None and opened.n > LEAST_OPENED:
            n = max(LEAST_OPENED, opened.n // 4)
            opened = Opened(opened.pairs, n, opened.all)
        if runs is None:
            merges, ended = merges_of(counted_round(words, top), vocab, size, least)
            after = merged(words, merges)
        else:
            done, ended = merge_runs(runs, opened, vocab, size, least)
            after = replaced(words, opened, runs, done)
            n = min(MOST_OPENED, n * (4 if len(runs) < MOST_RUNS // 16 else 2 if len(runs) < MOST_RUNS // 2 else 1))
        if not ended:
            words, old = materialize(after, "words"), words
            discard(old)
    discard(words)
    return vocab.tokens[: max(size, len(specials))]


class PieceTrie:
    """A vocabulary as a trie with failure links: a word's longest pieces are found in one pass over its characters.

    A node where no piece ends links to where matching goes on once the pieces on the
    way to it are taken; which ones, and where, is worked out once for every node.
    Nodes are numbers: 0 begins a word, 1 begins a continuation.
    """

    def __init__(self, tokens: Sequence[str], unk: str = "[UNK]", most_chars: int = 100):
        self.unk, self.most_chars = unk, most_chars
        self.next: dict[tuple[int, str], int] = {}
        self.link: list[int] = [-1, -1]
        self.taken: list[tuple[str, ...]] = [(), ()]
        ends: dict[int, str] = {}
        levels: list[list[tuple[int, str, int]]] = []
        for token in sorted(set(tokens)):
            self._insert(0, token, token, ends, levels)
            if token.startswith(CONTINUED):
                self._insert(1, token[len(CONTINUED) :], token, ends, levels)
        for level in levels:
            for parent, c, node in level:
                if node in ends:
                    self.link[node], self.taken[node] = 1, (ends[node],)
                    continue
                at, taken = self.link[parent], self.taken[parent]
                while at >= 0 and (at, c) not in self.next:
                    at, taken = self.link[at], taken + self.taken[at]
                if at >= 0:
                    self.link[node], self.taken[node] = self.next[at, c], taken

    def _insert(self, node: int, rest: str, token: str, ends: dict[int, str], levels: list[list[tuple[int, str, int]]]) -> None:
        for depth, c in enumerate(rest):
            below = self.next.get((node, c))
            if below is None:
                below = self.next[node, c] = len(self.link)
                self.link.append(-1)
                self.taken.append(())
                if depth == len(levels):
                    levels.append([])
                levels[depth].append((node, c, below))
            node = below
        if rest:
            ends[node] = token

    def pieces(self, word: str) -> list[str]:
        """Longest pieces first, continuations marked; unk alone if a part of the word is no piece or it is too long."""
        if len(word) > self.most_chars:
            return [self.unk]
        out: list[str] = []
        node, follow = 0, self.next.get
        for c in word:
            below = follow((node, c))
            while below is None:
                if self.link[node] < 0:
                    return [self.unk]
                out += self.taken[node]
                node = self.link[node]
                below = follow((node, c))
            node = below
        while node > 1:
            if self.link[node] < 0:
                return [self.unk]
            out += self.taken[node]
            node = self.link[node]
        return out
