"""Operator 10: best-fit packing by a configuration linear program.

Documents become token pieces of at most CAPACITY tokens. Only the histogram of
piece lengths, at most CAPACITY numbers however large the corpus, comes to the
driver. There the configuration program - how many sequences are filled by each
multiset of lengths - is solved by multiplicative weights, each round pricing the
best configuration of every length by one knapsack dynamic program, and rounded;
what is left is solved again, until few tokens are, which best fit places. The plan
says which ranks of each length go to which sequences; tasks look their pieces up in it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm.common import fresh, in_slices, materialize, ranked, table, thrifty

TOKENIZER = "byte_bpe_50k.json"
CAPACITY = 2048
END_ID = 0
#: Rounds of multiplicative weights, how fast weights of covered lengths fall, and the part of a length's pieces a step covers at most.
ROUNDS, RATE, STEP = 20, 0.3, 0.5
#: Configurations priced within this part of the best are used; the solution is scaled to the coverage that all but this part of the lengths have.
NEAR_BEST, LEAST_COVERED = 0.02, 0.1
#: The program is solved again on what is left until that is TAIL of all tokens.
SOLVES, TAIL = 40, 0.04
#: Bytes of text encoded at a time.
GROUP_BYTES = 1 << 20


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for a byte-level vocabulary file.

    That library takes long over words that it meets for the first time, so where
    the file says nothing that tiktoken doesn't do as well - a plain byte-level rule,
    merges in the order of their ids - tiktoken encodes, from the file's own
    vocabulary; tests hold its ids against the library's. Other files are the library's,
    and so are texts with a run of white space over which tiktoken's rule, that steps
    back from the run's end, would fail.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, rule = spec["model"], spec["pre_tokenizer"] or {}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        plain = model["type"] == "BPE" and not spec["normalizer"] and not model.get("ignore_merges") and merged == sorted(merged)
        plain = plain and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
        if plain and not any(x[k] for x in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            ranks = {bytes(map(BYTE_OF.__getitem__, t)): i for t, i in model["vocab"].items() if t not in special}
            known = tiktoken.Encoding(os.path.basename(path), pat_str=WORDS, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda text: self.by_library(text) if long_space(text) else known.encode_to_numpy(text, allowed_special="all")
        else:
            self.encode = self.by_library
        self.path, self.library = path, None

    def by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> bytes:
        """Little-endian, four bytes an id."""
        return self.encode(text).astype("<u4", copy=False).tobytes()


#: Characters of white space in a row that tiktoken is still given.
MOST_SPACE = 100_000


def long_space(text: str) -> bool:
    return len(text) > MOST_SPACE and any(m.end() - m.start() > MOST_SPACE for m in re.finditer(r"\s+", text))


def byte_of() -> dict[str, int]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others as the characters from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


BYTE_OF = byte_of()
#: Fixed value: how the byte-level rule takes a text apart.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def loaded(path: str) -> Encoder:
    return Encoder(path)


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; the first takes what doesn't fill one."""
    head = tokens % capacity or capacity
    return [(0, min(head, tokens))] + [(a, capacity) for a in range(head, tokens, capacity)]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null or empty text is its end token alone. Rows of one doc_id, equal or not,
    are cut each by itself; ids may be null; an empty table stays empty; extra columns don't matter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in in_slices(batches, 1, GROUP_BYTES):
            rows, at, ids = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                raw = encoder.ids(text or "") + end
                for n, (start, length) in enumerate(cut(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((n, start, length, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            columns = [np.array(c) for c in zip(*rows)]
            arrays = [batch.column(0).take(pa.array(at)), pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(thrifty(run), schema)


def knapsack(worth: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to capacity the greatest worth of lengths that fit, and the length taken last; worth[l] is that of length l, 0 where there is none."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    lengths = np.flatnonzero(worth)
    each = worth[lengths]
    fitting = np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        k = fitting[c]
        best[c] = best[c - 1]
        if k:
            got = best[c - lengths[:k]] + each[:k]
            i = got.argmax()
            if got[i] > best[c]:
                best[c], took[c] = got[i], lengths[i]
    return best, took


def filling(took: list[int], room: int) -> list[int]:
    """The lengths that knapsack() put into a room."""
    out = []
    while room:
        if took[room]:
            out.append(took[room])
            room -= took[room]
        else:
            room -= 1
    return out


def configurations(hist: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> dict[tuple[int, ...], float]:
    """A fractional solution: configurations (lengths, longest first) and how many sequences each fills.

    A length's price is its own length, the dual of perfect packing, times a
    weight that falls exponentially with the part of its pieces already covered,
    counted from the least covered length. One knapsack a round gives the best
    configuration that holds each length; those priced near the best are used
    until a part of their scarcest length's pieces is covered. The weights have
    settled after half of the rounds; the solution is what the others used.
    """
    has = hist > 0
    demand = np.where(has, hist, 1).astype(float)
    lengths, size = np.flatnonzero(has), np.arange(capacity + 1)
    covered, before = np.zeros(capacity + 1), np.zeros(capacity + 1)
    used: dict[tuple[int, ...], float] = {}
    for turn in range(rounds if len(lengths) else 0):
        if turn == rounds // 2:
            used, before = {}, covered.copy()
        part = covered / demand
        worth = np.where(has, size * np.exp(-rate * (part - part[has].min())), 0)
        best, took = knapsack(worth, capacity)
        room = took.tolist()
        near = lengths[worth[lengths] + best[capacity - lengths] >= (1 - NEAR_BEST) * best[capacity]]
        for config in dict.fromkeys(tuple(sorted([x, *filling(room, capacity - x)], reverse=True)) for x in near[::-1].tolist()):
            n = Counter(config)
            step = STEP * min(demand[x] / k for x, k in n.items())
            for x, k in n.items():
                covered[x] += step * k
            used[config] = used.get(config, 0.0) + step
    scale = np.quantile(((covered - before) / demand)[has], LEAST_COVERED) if used else 1.0
    return {c: x / max(scale, 1e-9) for c, x in used.items()}


def rounded(hist: np.ndarray, solution: dict[tuple[int, ...], float], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of sequences, one at least, that never use more pieces than there are.

    Only full configurations count as long as there are any, then the fullest with
    their longest piece; the others wait for the next solution. Those of long pieces
    come first, for short ones are easier to place later.
    """
    left, out = hist.copy(), []
    fullest: dict[int, int] = {}
    for config in solution:
        fullest[config[0]] = max(fullest.get(config[0], 0), sum(config))
    if capacity in fullest.values():
        fullest = dict.fromkeys(fullest, capacity)
    for config in sorted((c for c in solution if sum(c) == fullest[c[0]]), key=lambda c: (-sum(c), -c[0], len(c), -solution[c], c)):
        n = Counter(config)
        times = min(max(1, int(solution[config])), min(int(left[x]) // k for x, k in n.items()))
        if times > 0:
            for x, k in n.items():
                left[x] -= times * k
            out.append((config, times))
    return out


class Plan:
    """Placements (length, first rank, pieces, first sequence, offset): ranks of a length are dealt out in order."""

    def __init__(self, hist: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, hist.copy()
        self.next_rank = np.ones(capacity + 1, np.int64)
        self.sequences = self.programmed = 0  # all, and those that the configuration program filled
        self.placements: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.placements.append((length, int(self.next_rank[length]), count, sequence, offset))
        self.next_rank[length] += count
        self.left[length] -= count

    def open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def fill(self, config: tuple[int, ...], times: int) -> None:
        first, offset = self.open(times), 0
        for length in sorted(config, reverse=True):
            self.put(length, times, first, offset)
            offset += length

    def best_fit(self) -> None:
        """Longest first, each into the fullest sequences that it fits, runs of equal sequences at once."""
        room: dict[int, list[tuple[int, int]]] = {}  # by room left: runs (first sequence, count)
        filled = np.zeros(self.capacity + 1, bool)
        for length in range(self.capacity, 0, -1):
            while count := int(self.left[length]):
                fits = length + int(filled[length:].argmax())
                if not filled[fits]:
                    each = self.capacity // length
                    count = -(-count // each)
                    runs, fits = [(self.open(count), count)], self.capacity
                else:
                    runs = room[fits]
                first, n = runs.pop()
                if fits < self.capacity and not runs:
                    filled[fits] = False
                k = min(n, int(self.left[length]))
                self.put(length, k, first, self.capacity - fits)
                for rest, run in ((fits - length, (first, k)), (fits, (first + k, n - k))):
                    if run[1] and rest:
                        room.setdefault(rest, []).append(run)
                        filled[rest] = True


def packing_plan(hist: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> Plan:
    """The rounded program, solved again on what it left until TAIL of the tokens is, and best fit for that rest."""
    plan, size = Plan(hist, capacity), np.arange(capacity + 1)
    if hist[capacity]:
        plan.fill((capacity,), int(hist[capacity]))
    rest = TAIL * int((hist * size).sum())
    for _ in range(SOLVES):
        if (plan.left * size).sum() <= rest:
            break
        found = rounded(plan.left, configurations(plan.left, capacity, rounds), capacity)
        for config, times in found:
            plan.fill(config, times)
        if not found:
            break
    plan.programmed = plan.sequences
    plan.best_fit()
    return plan


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to pieces; sequences are gapless from 0 and hold at most `capacity` tokens.

    Pieces of a length are ranked without a task that holds them all; the plan's
    table has a bounded number of rows, a function of `capacity` and `rounds` alone.
    Extra columns pass through.
    """
    name = fresh(cut_pieces, "__rank")
    rows = ranked(cut_pieces, ["length"], ["doc_id", "piece", "ids_crc32"], name, "pack")
    hist = np.zeros(capacity + 1, np.int64)
    for length, n in rows.groupBy("length").agg(F.max(name)).collect():  # at most `capacity` rows
        hist[length] = n
    plan = np.array(packing_plan(hist, capacity, rounds).placements, np.int64).reshape(-1, 5)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    known = rows.sparkSession.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))
    at = rows.columns.index("length"), rows.columns.index(name)
    kept = [c for c in rows.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = known.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in at)
            found = table[np.searchsorted(keys, length << 44 | rank, "right") - 1].reshape(-1, 5)
            out = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != name]
            out += [pa.array(found[:, 3] + rank - found[:, 1], pa.int64()), pa.array(found[:, 4], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [*kept, "sequence_id", "offset"])

    schema = rows.select(kept).schema.add("sequence_id", "long").add("offset", "long")
    return rows.mapInArrow(thrifty(run), schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack; pieces are written once, so that nothing is tokenized twice."""
    cut_pieces = pieces(docs, path or public_tokenizers.path(TOKENIZER), capacity)
    return pack(materialize(cut_pieces, "pieces"), capacity)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack_documents(table(spark, sf_dir, "documents"))
