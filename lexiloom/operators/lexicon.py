"""An analyzer with a lexicon: the cheapest way to write a text as a row of its entries.

Every entry has a cost, and a character that begins none can stand by itself as an
unknown one. The matches at each place are found along a trie, and the cheapest path
through the lattice of all matches is kept place by place; costs of two parts of speech
side by side may be added. The longest units are the entries themselves, mode C; modes
B and A take an entry apart into the units that it lists.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.analysis import MORPHEMES, Analyzer, SplitMode

#: Entries that a lexicon may have: it goes to the driver and to each task, some 600 bytes an entry.
MOST_ENTRIES = 2_000_000
UNKNOWN_COST = 10_000
#: Words whose morphemes a task remembers; bytes of text that it analyses at a time.
REMEMBERED, SLICE = 50_000, 1 << 20
#: Characters up to which words are walked side by side; longer ones are walked one by one.
SIDE_BY_SIDE = 64
#: Places in a table of what follows each node of a trie; a larger trie is searched.
TABLE = 1 << 20
_WORD, _WHOLE = re.compile(r"\S+"), re.compile(r"(?s).+")
UNSET = "*"


class Entry(NamedTuple):
    """A word of the lexicon; forms that are None are the surface, units that are empty are the entry itself."""

    surface: str
    cost: int
    dictionary_form: str | None = None
    normalized_form: str | None = None
    reading_form: str | None = None
    pos: tuple[str, ...] = ("noun",)
    units_a: tuple[str, ...] = ()
    units_b: tuple[str, ...] = ()


UNKNOWN = Entry("", UNKNOWN_COST, pos=("unknown",))


@dataclass
class Lexicon:
    """Entries by trie. connections: what (part of speech, next part of speech) side by side cost more, 0 where not named; group_unknown joins unknown characters that stand together and are of one kind."""

    entries: list[Entry]
    connections: Mapping[tuple[str, str], int] = field(default_factory=dict)
    unknown_cost: int = UNKNOWN_COST
    group_unknown: bool = True

    def __post_init__(self) -> None:
        self.root: dict = {}
        self.by_surface: dict[str, Entry] = {}
        for e in self.entries:
            if not e.surface or e.surface.isspace():
                raise ValueError("an entry's surface is empty or white space")
            for units in (e.units_a, e.units_b):
                if units and "".join(units) != e.surface:
                    raise ValueError(f"the units of {e.surface!r} don't spell it")
            node = self.root
            for c in e.surface:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(e)
            known = self.by_surface.get(e.surface)
            if known is None or e.cost < known.cost:
                self.by_surface[e.surface] = e

    def path(self, text: str) -> list[tuple[int, int, Entry]]:
        """(begin, end, entry) of the cheapest path; of equally cheap ones that whose last entry is longest, and so on backwards. White space costs nothing and is left out."""
        if not self.connections:
            return self._found(text, self._plain(text))
        # for each place, by the part of speech that ends there: cost, begin, entry, part of speech before
        best: list[dict[str, tuple[int, int, Entry | None, str]]] = [{} for _ in range(len(text) + 1)]
        best[0][""] = (0, 0, None, "")

        def reach(end: int, begin: int, e: Entry | None) -> None:
            if e is None:  # white space keeps what stood before it
                for pos, (cost, _, _, _) in best[begin].items():
                    if pos not in best[end] or cost < best[end][pos][0]:
                        best[end][pos] = (cost, begin, None, pos)
                return
            own = e.pos[0]
            own_cost = self.unknown_cost if e is UNKNOWN else e.cost
            for pos, (cost, _, _, _) in best[begin].items():
                total = cost + own_cost + self.connections.get((pos, e.pos[0]), 0)
                if own not in best[end] or total < best[end][own][0]:
                    best[end][own] = (total, begin, e, pos)

        for i, c in enumerate(text):
            if c.isspace():
                reach(i + 1, i, None)
                continue
            node, j = self.root.get(c), i + 1
            while node is not None:
                for e in node.get("", ()):
                    reach(j, i, e)
                node = node.get(text[j]) if j < len(text) else None
                j += 1
            reach(i + 1, i, UNKNOWN)
        out, at = [], len(text)
        pos = min(best[at], key=lambda p: (best[at][p][0], p))
        while at > 0:
            _, begin, e, before = best[at][pos]
            if e is not None:
                out.append((begin, at, e))
            at, pos = begin, before
        return self._found(text, out[::-1])

    def _plain(self, text: str, spaced: bool = True) -> list[tuple[int, int, Entry]]:
        """The cheapest path where only entries cost: one cost a place. Unless spaced, white space is as other characters."""
        size, unknown, follow = len(text), self.unknown_cost, self.root.get
        cost: list[float] = [0, *[float("inf")] * size]
        back: list[tuple[int, Entry | None]] = [(0, None)] * (size + 1)
        for i, c in enumerate(text):
            so_far = cost[i]
            if spaced and c.isspace():
                if so_far < cost[i + 1]:
                    cost[i + 1], back[i + 1] = so_far, (i, None)
                continue
            node, j = follow(c), i + 1
            while node is not None:
                if "" in node:
                    for e in node[""]:
                        if so_far + e.cost < cost[j]:
                            cost[j], back[j] = so_far + e.cost, (i, e)
                node = node.get(text[j]) if j < size else None
                j += 1
            if so_far + unknown < cost[i + 1]:
                cost[i + 1], back[i + 1] = so_far + unknown, (i, UNKNOWN)
        out, at = [], size
        while at > 0:
            begin, e = back[at]
            if e is not None:
                out.append((begin, at, e))
            at = begin
        return out[::-1]

    def _found(self, text: str, path: list[tuple[int, int, Entry]]) -> list[tuple[int, int, Entry]]:
        return self._grouped(text, path) if self.group_unknown else path

    def _grouped(self, text: str, found: list[tuple[int, int, Entry]]) -> list[tuple[int, int, Entry]]:
        kind = lambda c: "d" if c.isdigit() else "l" if c.isalpha() or c == "_" else c
        out: list[tuple[int, int, Entry]] = []
        for begin, end, e in found:
            if out and e is UNKNOWN and out[-1][2] is UNKNOWN and out[-1][1] == begin and kind(text[begin - 1]) == kind(text[begin]):
                out[-1] = (out[-1][0], end, e)
            else:
                out.append((begin, end, e))
        return out

    def morphemes(self, text: str, mode: SplitMode) -> list[dict]:
        out = []
        for begin, end, e in self.path(text):
            units = e.units_a if mode is SplitMode.A else e.units_b if mode is SplitMode.B else ()
            for unit in units or (text[begin:end],):
                own = self.by_surface.get(unit, UNKNOWN._replace(pos=e.pos)) if units else e
                out.append(self._morpheme(unit, own, begin))
                begin += len(unit)
        return out

    def parted(self) -> bool:
        """Whether the words between white space have paths of their own: nothing costs across it, and no entry holds any."""
        return not self.connections and not any(c.isspace() for e in self.entries for c in e.surface)

    def arrays(self, texts: list[str | None], mode: SplitMode, memory: dict[str, list[dict]], parted: bool) -> pa.Array:
        """The morphemes of texts; words are worked out once, REMEMBERED of them kept in memory."""
        words: list[str] = []
        starts: list[int] = []
        rows = [0]
        for t in texts:
            for m in (_WORD if parted else _WHOLE).finditer(t or ""):
                words.append(m.group())
                starts.append(m.start())
            rows.append(len(words))

        def found(w: str) -> list[dict]:
            if w not in memory:
                if len(memory) > REMEMBERED:
                    memory.clear()
                memory[w] = self.morphemes(w, mode)
            return memory[w] if parted else memory.pop(w)

        coded = pa.array(words, pa.string()).dictionary_encode()
        lists = pa.array(list(map(found, coded.dictionary.to_pylist())), _PLACES).take(coded.indices)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        *forms, begins, ends = lists.flatten().flatten()
        shift = pa.array(np.repeat(np.array(starts, np.int32), sizes))
        columns = [*forms, pc.add(begins, shift), pc.add(ends, shift)]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)[rows]
        missing = pa.array([t is None for t in texts])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_PLACES.value_type)), mask=missing)

    @staticmethod
    def _morpheme(surface: str, e: Entry, begin: int) -> dict:
        forms = {f: getattr(e, f) or surface for f in ("dictionary_form", "normalized_form", "reading_form")}
        pos = [*e.pos[:6], *[UNSET] * (6 - len(e.pos))]
        return {"surface": surface, **forms, "pos": pos, "begin": begin, "end": begin + len(surface)}


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, one text after another, and how many each has; a null has none."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    own = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = memoryview(data)[own[0] : own[-1]] if data is not None else b""
    return np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32), pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)


class Walk:
    """Paths of many words side by side, by arrays: where the morphemes end and what they cost, the paths of Lexicon.path. For lexicons whose words have paths of their own and whose unknown characters stay by themselves."""

    def __init__(self, lexicon: Lexicon, spaces: str | None = None):
        if not lexicon.parted() or lexicon.group_unknown:
            raise ValueError("a lexicon with connections, with white space in entries or with groups of unknown characters has no paths by arrays")
        self.lexicon = lexicon
        blanks = [c for c in map(chr, range(0x3001)) if c.isspace()] if spaces is None else spaces
        self.blank = np.zeros(max(map(ord, blanks), default=0) + 2, bool)  # the last for all characters beyond
        self.blank[list(map(ord, blanks))] = True
        nodes, edges = [lexicon.root], []
        for at, node in enumerate(nodes):  # grows as it is walked
            for c, below in node.items():
                if c:
                    edges.append((at, ord(c), len(nodes)))
                    nodes.append(below)
        above, letters, below = np.array(edges, np.int64).reshape(-1, 3).T
        known = np.unique(letters)
        self.width = len(known) + 1
        self.letter = np.full(int(known[-1]) + 2 if len(known) else 1, len(known))  # the last for all characters beyond, which are no entry's
        self.letter[known] = np.arange(len(known))
        keys = above * self.width + self.letter[letters]
        order = np.argsort(keys)
        self.keys, self.below, self.table = keys[order], below[order], None
        if len(nodes) * self.width <= TABLE or not edges:
            self.table = np.full(len(nodes) * self.width, -1)
            self.table[keys] = below
        self.ends = np.array(["" in node for node in nodes])
        self.cost = np.array([min((e.cost for e in node.get("", ())), default=0) for node in nodes], np.int64)

    def _next(self, node: np.ndarray | int, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have the letter below them, and the nodes there."""
        key = node * self.width + letter
        if self.table is not None:
            below = self.table[key]
            kept = np.flatnonzero(below >= 0)
            return kept, below[kept]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        kept = np.flatnonzero(self.keys[at] == key)
        return kept, self.below[at[kept]]

    def words(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(morphemes, costs, ends) of words without white space, given by their characters, one word after another, and their sizes; ends one after another too."""
        count, cost, begins = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.cumsum(sizes) - sizes
        long = np.flatnonzero(sizes > SIDE_BY_SIDE)
        alone: dict[int, np.ndarray] = {}
        for w in long.tolist():
            path = self.lexicon._plain(codes[begins[w] : begins[w] + sizes[w]].tobytes().decode("utf-32-le"), spaced=False)
            alone[w] = np.array([end for _, end, _ in path], np.int32)
            count[w], cost[w] = len(path), sum(self.lexicon.unknown_cost if e is UNKNOWN else e.cost for _, _, e in path)
        short = np.flatnonzero(sizes <= SIDE_BY_SIDE)
        short = short[np.argsort(-sizes[short], kind="stable")]  # the longest first: those that go on stand first
        steps, found = self._side_by_side(codes, begins[short], sizes[short])
        count[short], cost[short] = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(short)) if steps else 0, found
        firsts = np.cumsum(count) - count
        ends = np.zeros(int(count.sum()), np.int32)
        for back, (w, end) in enumerate(steps):  # the last end comes first
            ends[(firsts + count)[short[w]] - 1 - back] = end
        for w, own in alone.items():
            ends[firsts[w] : firsts[w] + len(own)] = own
        return count, cost, ends

    def _side_by_side(self, codes: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """For words by falling size: from the last place back, (words, ends) of a morpheme each, and the paths' costs."""
        most = int(sizes[0]) if len(sizes) else 0
        reach = np.searchsorted(-sizes, -np.arange(most + 2), "right")  # words of at least so many characters
        best = [np.full(reach[i], np.iinfo(np.int64).max) for i in range(most + 1)]
        back = [np.zeros(reach[i], np.int64) for i in range(most + 1)]
        best[0][:] = 0
        letter = self.letter[np.minimum(codes, len(self.letter) - 1)]
        letters = [letter[begins[: reach[i + 1]] + i] for i in range(most)]
        for i in range(most):
            words, node = self._next(0, letters[i])
            j = i + 1
            while len(words):
                whole = self.ends[node]
                own = words[whole]
                total = best[i][own] + self.cost[node[whole]]
                cheaper = total < best[j][own]
                own = own[cheaper]
                best[j][own], back[j][own] = total[cheaper], i
                if j == most:
                    break
                on = words < reach[j + 1]
                words, node = words[on], node[on]
                kept, node = self._next(node, letters[j][words])
                words, j = words[kept], j + 1
            total = best[i][: reach[i + 1]] + self.lexicon.unknown_cost
            cheaper = total < best[i + 1]
            best[i + 1][cheaper], back[i + 1][cheaper] = total[cheaper], i
        cost = np.zeros(len(sizes), np.int64)
        for i in range(most + 1):
            own = slice(reach[i + 1], reach[i])
            cost[own] = best[i][own]
        base = np.cumsum([0, *map(len, back)])
        flat = np.concatenate(back)
        words, at, steps = np.flatnonzero(sizes > 0), sizes[sizes > 0].astype(np.int64), []
        while len(words):
            steps.append((words, at))
            at = flat[base[at] + words]
            words, at = words[at > 0], at[at > 0]
        return steps, cost

    def texts(self, texts: pa.Array) -> tuple[pa.Array, pa.ListArray]:
        """Cost and ends of each text, 0 and none of a null; each distinct word is walked once."""
        codes, sizes = characters(texts)
        blank = self.blank[np.minimum(codes, len(self.blank) - 1)]
        firsts = np.cumsum(sizes) - sizes
        starts = ~blank
        starts[1:] &= blank[:-1]
        starts[firsts[sizes > 0]] = ~blank[firsts[sizes > 0]]
        starts = np.flatnonzero(starts)
        shown, inner = codes[~blank], np.cumsum(~blank, dtype=np.int32)  # the characters of words alone
        wide = np.ones(len(shown), np.uint8)
        for over in (0x7F, 0x7FF, 0xFFFF):  # bytes that a character takes
            wide += shown > over
        place = np.concatenate([np.zeros(1, np.int32), np.cumsum(wide, dtype=np.int32)])
        bytes_at = place[np.append(inner[starts] - 1, len(shown))]
        data = shown.tobytes().decode("utf-32-le").encode()
        coded = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bytes_at), pa.py_buffer(data)).dictionary_encode()
        of = coded.indices.to_numpy()
        count, cost, ends = self.words(*characters(coded.dictionary))
        # a text's words are those that start in it
        bounds = np.append(np.searchsorted(starts, firsts), len(starts))
        shift = starts - np.repeat(firsts, np.diff(bounds))
        own = count[of]
        before = np.concatenate([[0], np.cumsum(own)])
        places = np.arange(before[-1]) + np.repeat((np.cumsum(count) - count)[of] - before[:-1], own)
        placed = ends[places] + np.repeat(shift, own).astype(np.int32)
        total = np.concatenate([[0], np.cumsum(cost[of])])[bounds]
        lists = pa.ListArray.from_arrays(pa.array(before[bounds].astype(np.int32)), pa.array(placed))
        return pa.array(np.diff(total)), lists


_PLACES = pa.list_(
    pa.struct(
        [(f, pa.string()) for f in ("surface", "dictionary_form", "normalized_form", "reading_form")]
        + [("pos", pa.list_(pa.string())), ("begin", pa.int32()), ("end", pa.int32())]
    )
)


def lexicon_of(entries: DataFrame, connections: Mapping[tuple[str, str], int] | None = None, unknown_cost: int = UNKNOWN_COST, group_unknown: bool = True, most: int = MOST_ENTRIES) -> Lexicon:
    """The lexicon of a table (surface, cost, ...), with whichever other columns of Entry it has; rows of null or blank surfaces go. More than `most` entries are refused."""
    names = [f for f in Entry._fields if f in entries.columns]
    rows = entries.where("surface IS NOT NULL").where(~F.col("surface").rlike(r"^\s*$")).select(*names).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has more than {most} entries")
    plain = lambda v: tuple(v) if isinstance(v, list) else v
    made = [Entry(**{n: plain(v) for n, v in r.asDict().items() if v is not None}) for r in rows]
    return Lexicon(sorted(made, key=lambda e: (e.surface, e.cost, str(e))), connections or {}, unknown_cost, group_unknown)


def lexicon_analyzer(lexicon: Lexicon, entries: DataFrame) -> Analyzer:
    """An analyzer with split modes; the lexicon is sent to each executor once. entries: any table of the session that is to run it."""
    shared = entries.sparkSession.sparkContext.broadcast(lexicon)

    def analyze(s: Column, mode: SplitMode = SplitMode.C) -> Column:
        @F.arrow_udf(MORPHEMES)
        def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            parted, memory = shared.value.parted(), {}
            for texts in sliced(batches):
                yield shared.value.arrays(texts.to_pylist(), mode, memory, parted)

        return found(s)

    return analyze


def sliced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts in order, SLICE bytes at a time, or one text of more."""
    for texts in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + SLICE, "right")))
            yield texts.slice(at, to - at)
            at = to


def lexicon_ends(lexicon: Lexicon, entries: DataFrame, spaces: str | None = None, fold: Callable[[pa.ListArray], pa.Array] | None = None, kind: str = "array<int>") -> Callable[[Column], Column]:
    """struct<n, cost, ends> of texts: how many morphemes the cheapest path has, what it costs and where they end; none of them is made, so it takes a small part of lexicon_analyzer's time.

    spaces: the characters that cost nothing and part words, all white space if None.
    fold: what becomes of the arrays of ends in the task that finds them, and kind, its type.
    """
    shared = entries.sparkSession.sparkContext.broadcast(Walk(lexicon, spaces))

    @F.arrow_udf(f"struct<n:bigint,cost:bigint,ends:{kind}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in sliced(batches):
            cost, ends = shared.value.texts(texts)
            n = pc.list_value_length(ends).cast(pa.int64())
            yield pa.StructArray.from_arrays([n, cost, fold(ends) if fold else ends], ["n", "cost", "ends"], mask=texts.is_null())

    return found


def with_costs(counts: DataFrame, scale: float = 100.0) -> DataFrame:
    """(word, freq) -> (surface, cost): rarer words cost more, by the logarithm of their share; a lexicon of a corpus's own words."""
    total = counts.agg(F.sum("freq").alias("total"))
    return counts.join(F.broadcast(total)).select(F.col("word").alias("surface"), F.round(-F.log(F.col("freq") / F.col("total")) * scale).cast("int").alias("cost"))
