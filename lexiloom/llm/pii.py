"""Operator 13: personal data by candidate gradient boosting, in DataFrame functions only.

Base rules find what their formats and checks decide. Generators, of high recall,
propose more: addresses with (at) and (dot), numbers in groups without a plus or with
other separators, dotted numbers in brackets; what they propose may overlap. Each
candidate has small features of its format and of what stands around it, none of
which states what the base rule itself checks (the @, the plus, the Luhn sum, parts up
to 255). The labels are the base rules': a candidate that a base match covers is
personal, one of the same shape that the rule refuses is not. Spark counts candidates
by combination of features, of which there are at most some thousands however large
the corpus; boosted trees are fitted to these counts on the driver, with a fold held
out, on which scores are calibrated and each kind's threshold is set. Trees are then
CASE expressions over candidates. What scores enough is added to the base spans.

Patterns start where a run of their characters starts and never give back what they
took, so a text is passed over once, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, materialize, table

KINDS = ("email", "ip", "card", "phone")

#: Characters before @; at the end of the match before, a match may start inside a run of them.
_LOCAL = "[A-Za-z0-9._%+-]"
_START = rf"(?:\G|(?<!{_LOCAL}))"
#: The base rules, in the order of KINDS.
BASE = {
    "email": rf"{_START}{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What is proposed beyond them.
_AT, _DOT = r"(?:\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20)", r"(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)"
GENERATORS = {
    "email": rf"{_START}{_LOCAL}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:(?:\.|\[\.\]|\x20?\(dot\)\x20?)[0-9]++){3}+",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){11,}+",
    "phone": r"(?:(?<![0-9])\(?[0-9]|\+[0-9])(?:[\x20().-]{0,2}+[0-9]){6,}+",
}
#: Words that stand before personal data of a kind, and before numbers that are none; fixed values of this operator.
CUES = {
    "email": r"(?i)(?:mail|contact|write|schreib|escrib|correo|courriel)",
    "ip": r"(?i)(?:\bip\b|host|server|address|client|peer)",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|tel\b|tel[.:]|call|mobile|cell|fax|telefon|móvil|appel)",
}
AGAINST = r"(?i)(?:version|\bv\.?$|isbn|issn|order|invoice|\bid\b|serial|token|secret|key|hash|commit|build|[=#\"'])"
#: Characters of context before and after a candidate; context ends where the match before ends.
BEFORE, AFTER = 24, 1

#: Rows whose remainder is this are held out from the trees and calibrate them.
FOLDS, HELD_OUT = 4, 3
ROUNDS, RATE, DEPTH, SMOOTH, LEAST_LEAF = 24, 0.3, 3, 1.0, 20
#: A candidate is added where at least this share of held-out candidates of its score or more are personal.
PRECISION = 0.9
#: Held-out candidates of a score or more that its threshold needs.
LEAST_HELD = 10

SPANS = "array<struct<rank:int,start:int,end:int,kind:string>>"
CANDIDATES = "array<struct<rank:int,start:int,end:int,shape:array<int>,label:int>>"
#: Matches whose places are summed up together.
CHUNK = 256


# -- matches -------------------------------------------------------------------------


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, before, after>> of the leftmost, non-overlapping matches, in code points; before and after are the texts between matches.

    Places are sums of lengths: first over runs of CHUNK matches, then within each,
    so that a text of many matches takes no quadratic time.
    """
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"

    def of_steps(steps: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(steps) - 1, F.lit(CHUNK))
        total = lambda part: F.aggregate(part, F.lit(0), lambda a, s: a + s["size"])
        runs = F.transform(starts, lambda i: F.slice(steps, i + 1, F.lit(CHUNK)))
        return bound(runs, lambda r: with_bases(r, F.transform(r, total)))

    def with_bases(runs: Column, sizes: Column) -> Column:
        bases = F.aggregate(sizes, F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
        return F.flatten(F.zip_with(runs, F.slice(bases, F.lit(1), F.size(sizes)), within))

    def within(run: Column, base: Column) -> Column:
        begin = F.struct(base.cast("int").alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, s: Column) -> Column:
            end = (acc["at"] + s["size"]).cast("int")
            one = F.struct((end - F.char_length(s["value"])).alias("start"), end.alias("end"), s["value"].alias("value"), s["before"].alias("before"), s["after"].alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(run, begin, step, lambda acc: acc["out"])

    def of_gaps(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        sized = lambda m, i: F.struct(m.alias("value"), F.get(gaps, i).alias("before"), F.get(gaps, i + 1).alias("after"), (F.char_length(F.get(gaps, i)) + F.char_length(m)).alias("size"))
        return bound(F.transform(found, sized), of_steps)

    # split gives one part more than there are matches; the limit keeps empty ones at the end
    found = bound(F.split(text, pattern, -1), of_gaps)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kind))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    def weighed(d: Column, i: Column) -> Column:
        twice = d * (1 + i % 2)
        return twice - F.when(twice > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: weighed(F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)), i))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """A base rule's check of its match."""
    n = F.char_length(digits(value))
    if kind == "ip":
        return F.forall(F.split(value, "[.]"), lambda p: p.rlike("^0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """What the base rules find, by kind, then start."""
    def of(rank: int, kind: str) -> Column:
        kept = F.filter(matches(text, BASE[kind]), lambda m: passes(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)]).cast(SPANS)


# -- candidates ----------------------------------------------------------------------


def bucket(value: Column, *bounds: int) -> Column:
    """How many of the ascending bounds a number reaches."""
    out = F.lit(0)
    for i, b in enumerate(bounds):
        out = F.when(value >= b, i + 1).otherwise(out)
    return out


def beside(c: Column) -> Column:
    """The kind of a neighbouring character: none or a line's end, space, letter or digit, other."""
    return F.when((c == "") | (c == "\n"), 0).when(c == " ", 1).when(c.rlike(r"^[\p{L}\p{N}_]"), 2).otherwise(3)


def shape(kind: str, m: Column) -> Column:
    """A candidate's features, each a small number: at most 4 * 4 * 2 * 2 combinations of context by 512 of format."""
    near = F.right(m["before"], F.lit(BEFORE))
    context = [beside(F.right(m["before"], F.lit(1))), beside(F.left(m["after"], F.lit(AFTER))), near.rlike(CUES[kind]).cast("int"), near.rlike(AGAINST).cast("int")]
    value = m["value"]
    if kind == "email":
        plain = F.regexp_replace(value, _AT, "@")
        parts = F.split(F.regexp_replace(F.substring_index(plain, "@", -1), _DOT, "."), "[.]")
        last = F.lower(F.element_at(parts, -1))
        common = F.when(last.isin("com", "org", "net", "edu", "gov", "info", "io"), 2).when(last.rlike("^[a-z]{2}$"), 1).otherwise(0)
        own = [common, bucket(F.size(parts), 3, 4), bucket(F.char_length(F.substring_index(plain, "@", 1)), 2, 4, 16)]
    else:
        if kind == "phone":  # a country's prefix is the plus's own
            value = F.regexp_replace(value, r"^\+[0-9]{1,3}(?![0-9])[\x20.-]?", "")
        n, groups = F.char_length(digits(value)), F.regexp_extract_all(value, F.lit("([0-9]+)"), F.lit(0))
        between = F.when(value.rlike("[0-9] [0-9]|[0-9] [(]|[)] ?[0-9]"), 1).when(value.contains("-"), 2).when(value.contains("."), 3).otherwise(0)
        own = [
            bucket(n, 7, 8, 9, 12, 13, 16, 17),
            bucket(F.size(groups), 2, 3, 4),
            bucket(F.char_length(F.element_at(groups, -1)), 3, 4, 5),
            between if kind != "ip" else F.lit(0),
            value.contains("(").cast("int") if kind == "phone" else F.lit(0),
        ]
    return F.array(*[c.cast("int") for c in [*context, *own]])


def candidates(docs: DataFrame, names: tuple[str, str] = ("base", "proposed"), text: str = "text") -> DataFrame:
    """docs with the base spans and the proposed ones, by kind, then start; a null text counts as empty.

    label: 1 where the base rule of the kind finds something in the candidate, else 0.
    """
    whole = fresh(docs, "whole")
    rows = docs.withColumn(whole, F.coalesce(F.col(f"`{text}`"), F.lit(""))).withColumn(names[0], base_spans(F.col(whole)))

    def of(rank: int, kind: str) -> Column:
        def one(m: Column) -> Column:
            label = F.exists(F.regexp_extract_all(m["value"], F.lit(BASE[kind]), F.lit(0)), lambda v: passes(kind, v)).cast("int")
            return F.struct(F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), shape(kind, m).alias("shape"), label.alias("label"))

        return F.transform(matches(F.col(whole), GENERATORS[kind]), one)

    proposed = F.concat(*[of(i, k) for i, k in enumerate(KINDS)]).cast(CANDIDATES)
    return rows.withColumn(names[1], proposed).drop(whole)


# -- boosted trees -------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A split, to `low` where feature <= at, else `high`; or a leaf, its value."""

    value: float = 0.0
    feature: int = -1
    at: int = 0
    low: Node | None = None
    high: Node | None = None


@dataclass(frozen=True)
class Model:
    """The trees of a kind, and the calibrated threshold of their sum; None where no score is precise enough."""

    start: float
    trees: tuple[Node, ...]
    threshold: float | None

    def score(self, x: Sequence[int]) -> float:
        return self.start + sum(_value(t, x) for t in self.trees)


Counts = list[tuple[tuple[int, ...], float, float]]  # a combination of features, its personal candidates, all of them


def _value(node: Node, x: Sequence[int]) -> float:
    while node.feature >= 0:
        node = node.low if x[node.feature] <= node.at else node.high
    return node.value


def grown(rows: list[tuple[tuple[int, ...], float, float, float]], depth: int) -> Node:
    """A tree for rows (features, gradient, weight, candidates): the splits that gain most, of equal ones the first feature and value; each side keeps LEAST_LEAF candidates."""
    g, h, n = (sum(r[i] for r in rows) for i in (1, 2, 3))
    leaf = Node(RATE * g / (h + SMOOTH))
    if not depth or not rows:
        return leaf
    best, chosen = g * g / (h + SMOOTH) + 1e-9, None
    for f in range(len(rows[0][0])):
        sums: dict[int, list[float]] = {}
        for x, *own in rows:
            old = sums.setdefault(x[f], [0.0, 0.0, 0.0])
            for i in range(3):
                old[i] += own[i]
        low = [0.0, 0.0, 0.0]
        for v in sorted(sums)[:-1]:
            low = [a + b for a, b in zip(low, sums[v])]
            gain = low[0] ** 2 / (low[1] + SMOOTH) + (g - low[0]) ** 2 / (h - low[1] + SMOOTH)
            if gain > best and min(low[2], n - low[2]) >= LEAST_LEAF:
                best, chosen = gain, (f, v)
    if chosen is None:
        return leaf
    f, v = chosen
    return Node(0.0, f, v, grown([r for r in rows if r[0][f] <= v], depth - 1), grown([r for r in rows if r[0][f] > v], depth - 1))


def boosted(counts: Counts) -> tuple[float, tuple[Node, ...]]:
    """Trees on the logistic loss of counted combinations, in a fixed order: equal counts give equal trees."""
    positive, total = sum(c[1] for c in counts), sum(c[2] for c in counts)
    start = log((positive + 1) / (total - positive + 1))
    scores, trees = [start] * len(counts), []
    for _ in range(ROUNDS if counts else 0):
        p = [1 / (1 + exp(-s)) for s in scores]
        tree = grown([(x, y - n * q, n * q * (1 - q), n) for (x, y, n), q in zip(counts, p)], DEPTH)
        scores = [s + _value(tree, x) for s, (x, _, _) in zip(scores, counts)]
        trees.append(tree)
    return start, tuple(trees)


def calibrated(held: list[tuple[float, float, float]]) -> float | None:
    """The least score from which on held-out candidates, (score, personal, all), are personal to PRECISION at least; None if none is."""
    best, positive, total = None, 0.0, 0.0
    held = sorted(held, reverse=True)
    for i, (score, y, n) in enumerate(held):
        positive, total = positive + y, total + n
        last = i + 1 == len(held) or held[i + 1][0] < score
        if last and total >= LEAST_HELD and positive >= PRECISION * total:
            best = score
    return best


def fit(proposed: DataFrame, doc_id: str = "doc_id", column: str = "proposed") -> dict[str, Model]:
    """A model a kind from rows with candidates(); all candidates count. Rows of a null id are not held out."""
    fold = F.coalesce(F.pmod(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0)) == HELD_OUT
    each = proposed.select(fold.alias("held"), F.explode(column).alias("c")).groupBy("held", "c.rank", "c.shape")
    counts = each.agg(F.sum("c.label").alias("y"), F.count(F.lit(1)).alias("n")).collect()  # combinations, not candidates
    models = {}
    for rank, kind in enumerate(KINDS):
        own = sorted((r.held, tuple(r["shape"]), float(r.y), float(r.n)) for r in counts if r["rank"] == rank)
        start, trees = boosted([r[1:] for r in own if not r[0]])
        model = Model(start, trees, None)
        models[kind] = Model(start, trees, calibrated([(model.score(x), y, n) for held, x, y, n in own if held]))
    return models


def score_of(model: Model, shape: Column) -> Column:
    """A model's score of a candidate's features."""
    def of(node: Node) -> Column:
        if node.feature < 0:
            return F.lit(node.value)
        return F.when(F.get(shape, F.lit(node.feature)) <= node.at, of(node.low)).otherwise(of(node.high))

    return reduce(lambda a, t: a + of(t), model.trees, F.lit(model.start))


def families(spans: Column) -> Column:
    """Spans by kind: an array a kind, each in order and without overlaps."""
    of = lambda rank: F.filter(spans, lambda s: s["rank"] == rank)
    return F.array(*map(of, range(len(KINDS))))


#: Steps of a search by halves through an array of any length.
_STEPS = [1 << i for i in range(30, -1, -1)]


def how_many(family: Column, before: Callable[[Column], Column]) -> Column:
    """How many leading spans of a family satisfy a condition that holds up to some span and for none after."""
    def step(n: Column, more: Column) -> Column:
        return F.when((n + more <= F.size(family)) & before(F.get(family, n + more - 1)), n + more).otherwise(n)

    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)


def meeting(family: Column, c: Column) -> Column:
    """The spans of a family that overlap c: a run of it, found by halves, so that rows of many spans take no quadratic time."""
    first, last = how_many(family, lambda s: s["end"] <= c["start"]), how_many(family, lambda s: s["start"] < c["end"])
    return F.slice(family, first + 1, F.greatest(last - first, F.lit(0)))


def selected(base: Column, proposed: Column, models: dict[str, Model]) -> Column:
    """The base spans and those proposed ones that score enough, meet no base span, and no better proposed one: of a higher score, of equals the longer, the earlier kind, the earlier start."""
    by_kind = lambda c, of: reduce(lambda out, k: F.when(c["rank"] == k[0], of(k[1])).otherwise(out), enumerate(KINDS), F.lit(None))

    def enough(c: Column) -> Column:
        # a hair below: sums of the same trees may round otherwise in another order
        return F.coalesce(by_kind(c, lambda k: F.lit(False) if models[k].threshold is None else score_of(models[k], c["shape"]) >= models[k].threshold - 1e-9), F.lit(False))

    def scored(c: Column) -> Column:
        score = F.round(by_kind(c, lambda k: score_of(models[k], c["shape"])), 6)
        order = F.struct(score.alias("score"), (c["end"] - c["start"]).alias("size"), (-c["rank"]).alias("first"), (-c["start"]).alias("place"))
        return F.struct(c["rank"].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), order.alias("order"))

    def free(found: Column, c: Column) -> Column:
        return reduce(lambda a, b: a & b, [F.size(meeting(F.get(found, F.lit(i)), c)) == 0 for i in range(len(KINDS))])

    def alone(good: Column) -> Column:
        others = [F.get(good, F.lit(i)) for i in range(len(KINDS))]
        best = lambda s: reduce(lambda a, b: a & b, [F.forall(meeting(o, s), lambda x: x["order"] <= s["order"]) for o in others])
        named = lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1).alias("kind"))
        return F.transform(F.filter(F.flatten(good), best), named)

    worth = F.filter(proposed, lambda c: (c["label"] == 0) & enough(c))
    none = F.array().cast(SPANS)
    # most rows have no such candidate, and no more to do
    added = bound(worth, lambda w: F.when(F.size(w) == 0, none).otherwise(
        bound(families(base), lambda found: bound(families(F.transform(F.filter(w, lambda c: free(found, c)), scored)), alone)).cast(SPANS)))
    return F.array_sort(F.concat(base, added))


def find_personal(docs: DataFrame, name: str = "spans", models: dict[str, Model] | None = None, text: str = "text") -> DataFrame:
    """docs with `name`, array<struct<rank, start, end, kind>> by kind, then start; needs doc_id and a text.

    A null text counts as empty. Rows may repeat, ids may be null; an empty table stays
    empty; extra columns pass through, whatever their names, but for one called `name`.
    Nothing is shuffled but counts. Without models they are fitted to docs first.
    """
    names = fresh(docs, "base"), fresh(docs, "proposed")
    if models is None:
        models = fit(candidates(docs.select("doc_id", F.col(f"`{text}`").alias("text"))))
    rows = candidates(docs, names, text)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return rows.select(*kept, selected(F.col(names[0]), F.col(names[1]), models).alias(name))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span as its kind in brackets; spans that overlap are one stretch, named by the first."""
    def ends_before(found: Column, s: Column) -> Column:
        """The last end of the spans that stand before s, in a family each."""
        earlier = lambda o: (o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["rank"] < s["rank"]))
        last = [F.get(F.get(found, F.lit(i)), how_many(F.get(found, F.lit(i)), earlier) - 1)["end"] for i in range(len(KINDS))]
        return F.coalesce(F.greatest(*last), F.lit(0))

    def written(found: Column) -> Column:
        ordered = F.array_sort(F.transform(F.flatten(found), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"))))

        def part(s: Column) -> Column:
            gap = lambda at: F.concat(F.substring(text, at + 1, s["start"] - at), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return bound(ends_before(found, s), lambda at: F.when(s["start"] >= at, gap(at)).otherwise(""))

        end = F.coalesce(F.array_max(F.transform(F.flatten(found), lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(F.transform(ordered, part), ""), F.substring(text, end + 1, F.char_length(text)))

    return bound(families(spans), written)


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every document. Texts are read once: candidates are written, counted and selected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = materialize(candidates(docs).drop("text"), "candidates")
    base, models = F.col("base"), fit(found)
    count = lambda rank: F.size(F.filter(base, lambda s: s["rank"] == rank)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    spans = selected(base, F.col("proposed"), models)
    return found.select("doc_id", *counts, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(spans).alias("spans"))
