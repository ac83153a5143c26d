"""Operator 5: secret scans with a trigram inverted index, in DataFrame functions only.

Each rule's pattern is read once, on the driver, for the trigrams that any match must
hold: a set of alternatives, each a set of trigrams. The index, which may be stored,
has a posting (trigram, text) for every trigram that some rule asks for. Postings are intersected
by counting, per alternative, how many of its trigrams a text has; texts with all of
them are candidates and alone are matched against the rule. Rules without mandatory
trigrams are matched against every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import fresh, materialize, table


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, the same in any dialect."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


_WORDS = "|".join(map(either_case, ("password", "passwd", "secret", "token"))) + f"|{either_case('api')}_?{either_case('key')}"
BASE = (
    Rule("assign", rf"""({_WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the method adds to the base kinds.
ADDED = (
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("privatekey", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE + ADDED

#: Strings, and characters of a class, that are spelled out at most.
_MOST, _MOST_CHARACTERS = 64, 8

Run = set[str] | None  # the lower-cased strings that a part of a pattern must be one of, or None where much may stand


class Pattern:
    """Reads the parts of a pattern as Java's dialect has them.

    Anchors, word boundaries and lookarounds take no characters; classes, back
    references and repeats may be anything; what is not known here is refused.
    """

    def __init__(self, pattern: str):
        self.text, self.at = pattern, 0
        self.runs = self.alternatives()
        if self.at < len(pattern):
            raise ValueError(f"unmatched parenthesis in {pattern!r}")

    def refuse(self) -> ValueError:
        return ValueError(f"a part at {self.at} of {self.text!r} that can't be read for trigrams")

    def alternatives(self) -> list[Run]:
        branches = [self.sequence()]
        while self.take("|"):
            branches.append(self.sequence())
        if len(branches) == 1:
            return branches[0]
        whole = [product_of(x) for x in branches]
        return [None if None in whole else set().union(*whole)]

    def sequence(self) -> list[Run]:
        out: list[Run] = []
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            part = self.atom()
            while self.text[self.at : self.at + 1] in ("?", "*", "+", "{") and self.at < len(self.text):
                if self.take("?"):
                    strings = product_of(part)
                    part = [None if strings is None else strings | {""}]
                elif self.take("{"):
                    if not self.text[self.at : self.at + 1].isdigit() or "}" not in self.text[self.at :]:
                        raise self.refuse()
                    self.at = self.text.index("}", self.at) + 1
                    part = [None]
                else:
                    self.at += 1
                    part = [None]
                self.take("?") or self.take("+")  # lazy or possessive: the same strings at most
            out += part
        return out

    def atom(self) -> list[Run]:
        if self.take("("):
            return self.group()
        if self.take("["):
            return [self.characters()]
        if self.take("."):
            return [None]
        if self.take("^") or self.take("$"):
            return [{""}]
        if self.text[self.at] in "?*+{":
            raise self.refuse()
        if self.text[self.at : self.at + 2] in (r"\b", r"\B", r"\A", r"\z", r"\Z", r"\G"):
            self.at += 2
            return [{""}]
        return [lowered([self.character()])]

    def group(self) -> list[Run]:
        """What follows an opening parenthesis, up to the closing one."""
        looks = any(self.take(x) for x in ("?=", "?!", "?<=", "?<!"))
        if not looks and self.take("?"):
            if self.take("<"):
                self.at = self.text.index(">", self.at) + 1
            elif not self.take(">"):
                first = self.at
                while self.text[self.at : self.at + 1] in ("i", "m", "s", "d", "-") and self.at < len(self.text):
                    self.at += 1
                if self.take(")"):  # flags: none of these changes which lower-cased ASCII a literal is
                    return [{""}]
                if not self.take(":"):
                    self.at = first
                    raise self.refuse()
        part = self.alternatives()
        if not self.take(")"):
            raise ValueError(f"unclosed group in {self.text!r}")
        return [{""}] if looks else part

    def character(self) -> str | None:
        """A literal character; None for a class like \\d and a back reference."""
        c = self.text[self.at]
        self.at += 1
        return self.escaped() if c == "\\" else c

    def escaped(self) -> str | None:
        c = self.text[self.at]
        self.at += 1
        if c == "x" and self.take("{"):
            end = self.text.index("}", self.at)
            c, self.at = chr(int(self.text[self.at : end], 16)), end + 1
            return c
        if c in "xu":
            size = 2 if c == "x" else 4
            self.at += size
            return chr(int(self.text[self.at - size : self.at], 16))
        if c in "pP":
            self.at = self.text.index("}", self.at) + 1 if self.take("{") else self.at + 1
            return None
        if c == "k" and self.take("<"):
            self.at = self.text.index(">", self.at) + 1
            return None
        if c in "tnrfea":
            return {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "e": "\x1b", "a": "\a"}[c]
        if c in "dDwWsShHvVRX123456789":
            return None
        if c.isalnum():
            self.at -= 1
            raise self.refuse()
        return c

    def characters(self) -> Run:
        """A class's characters, if they are few; classes within and their intersections may be anything."""
        found: set[str] = set()
        open_ = self.take("^")
        first = True
        while first or self.text[self.at : self.at + 1] != "]":
            if self.at >= len(self.text):
                raise ValueError(f"unclosed class in {self.text!r}")
            if self.take("&&"):
                open_, first = True, False
                continue
            if self.take("["):
                self.characters()
                open_, first = True, False
                continue
            low, first = self.character(), False
            high = low
            if self.text[self.at : self.at + 1] == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", "["):
                self.at += 1
                high = self.character()
            several = None if low is None or high is None or ord(high) - ord(low) > 2 * _MOST_CHARACTERS else lowered(map(chr, range(ord(low), ord(high) + 1)))
            open_ |= several is None
            found |= several or set()
        self.at += 1
        return None if open_ or len(found) > _MOST_CHARACTERS else found

    def take(self, text: str) -> bool:
        there = self.text.startswith(text, self.at)
        self.at += len(text) if there else 0
        return there


def lowered(characters: Iterable[str | None]) -> Run:
    """Characters as lower-casing a text leaves them; None if one may be anything, or is a letter beyond ASCII with another case."""
    found = set(characters)
    return None if any(c is None or (ord(c) > 127 and (c.lower() != c or c.upper() != c)) for c in found) else {c.lower() for c in found}


def product_of(runs: list[Run]) -> Run:
    """All the strings of a sequence of runs, None if one is open or there are too many."""
    found = {""}
    for strings in runs:
        if strings is None or len(found) * len(strings) > _MOST:
            return None
        found = {a + b for a, b in product(found, strings)}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """The Boolean query of a pattern over lower-cased text: any of these sets of trigrams, all of a set. Empty: no trigram is mandatory.

    Neighbouring runs with few possible strings are joined; the query is that of
    the joined run whose strings all have the most trigrams. A pattern with a part
    that can't be read raises ValueError.
    """
    best: list[frozenset[str]] = []
    joined: set[str] = {""}

    def offer(strings: set[str]) -> None:
        nonlocal best
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        if all(sets) and (not best or min(map(len, sets)) > min(map(len, best))):
            best = sorted({a for a in sets if not any(b < a for b in sets)}, key=sorted)

    for strings in Pattern(pattern).runs:
        if strings is not None and len(joined) * len(strings) <= _MOST:
            joined = {a + b for a, b in product(joined, strings)}
        else:
            offer(joined)
            joined = strings if strings is not None else {""}
    offer(joined)
    return best


def postings(keyed: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """(key, text) -> (key, trigram): the index, of the trigrams that the rules ask for; None if they ask for none. It can be written and used again."""
    grams = sorted({g for r in rules for clause in trigram_query(r.pattern) for g in clause})
    if not grams:
        return None
    lowered = keyed.select("key", F.lower("text").alias("text"))
    holds = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(g)), F.lit(g)) for g in grams]))
    return lowered.select("key", F.explode(holds).alias("trigram"))


def candidates(index: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(key, trigram) -> (key, kinds): which rules' queries a text's postings satisfy.

    Postings of equal keys merge, which can only add candidates.
    """
    asked = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(f"{r.kind}{i}").alias("clause"), F.lit(g).alias("trigram"), F.lit(len(clause)).alias("needed"))
        for r in rules
        for i, clause in enumerate(trigram_query(r.pattern))
        for g in sorted(clause)
    ]
    clauses = index.sparkSession.range(1).select(F.inline(F.array(*asked)))  # as many rows as the rules ask for
    met = index.join(F.broadcast(clauses), "trigram").groupBy("key", "clause").agg(
        F.count_distinct("trigram").alias("have"), F.first("needed").alias("needed"), F.first("kind").alias("kind")
    )
    return met.where("have = needed").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of a rule's leftmost, non-overlapping matches that are long enough, in code points."""
    between, found = F.split(text, rule.pattern), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sizes = F.zip_with(found, counted, lambda a, b: F.struct(F.char_length(a).alias("size"), F.char_length(b).alias("counted")))
    steps = F.zip_with(between, sizes, lambda a, m: F.struct(F.char_length(a).alias("gap"), m["size"].alias("size"), m["counted"].alias("counted")))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + s["gap"]
        end = start + F.coalesce(s["size"], F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(s["counted"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, nothing, step, lambda acc: acc["out"])


def tight(rule: Rule) -> Rule:
    """A rule whose whole match counts and ends in one repeated class needs no filter afterwards: {n,} for +, less the literal before."""
    if rule.group == 0 and rule.least > 1 and rule.pattern.endswith("]+"):
        head = rule.pattern[: rule.pattern.rindex("[")]
        return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - len(head)},}}", 0, 1)
    return rule


def _named(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What stands for a row in the index: a hash of its id and text."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def indexed(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame | None:
    """The index of docs (doc_id, text)."""
    return postings(docs.select(key_of().alias("key"), F.coalesce("text", F.lit("")).alias("text")), rules)


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, name: str = "spans", index: DataFrame | None = None) -> DataFrame:
    """docs with a column `name`, array<struct<start, rank, end, kind>> sorted by start, then by the order of the rules; needs doc_id and text.

    A null text counts as empty. Rows may repeat, ids may be null; an empty table
    stays empty; extra columns pass through, whatever their names, but for one
    called `name`. The key that candidates go by is a hash of id and text: rows that
    share one share candidates, and every candidate is verified on its own text.
    Texts cross one shuffle, to meet their candidates; hot keys are identical rows,
    which the join's skew handling splits. index is what indexed() gave for the
    same docs and rules, if it is at hand.
    """
    text, key = fresh(docs, "whole"), fresh(docs, "key")
    keyed = docs.withColumn(text, F.coalesce("text", F.lit(""))).withColumn(key, key_of()).alias("here")
    index = indexed(docs, rules) if index is None else index
    whole, kinds = F.col(f"here.{text}"), F.array().cast("array<string>")
    if index is not None:
        found = candidates(index, rules).alias("there")
        keyed, kinds = keyed.join(found, F.col(f"here.{key}") == F.col("there.key"), "left"), F.col("there.kinds")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = F.transform(spans_of(whole, tight(rule)), _named(rank, rule.kind))
        if trigram_query(rule.pattern):
            spans = F.when(F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)), spans).otherwise(none)
        parts.append(spans)
    return keyed.select(*[F.col(f"here.`{c}`") for c in docs.columns if c != name], F.array_sort(F.concat(*parts)).alias(name))


def spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, index=materialize(indexed(docs), "postings"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans"))


def _sql_spans(rule: Rule, rank: int) -> str:
    quoted = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, row, start, {rank} AS rank, stop, '{rule.kind}' AS kind FROM (
    SELECT doc_id, row, i, counted[i] AS counted,
      list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(f) for f in found[1:i - 1]]), 0) AS start,
      list_sum([length(g) for g in gaps[1:i]]) + list_sum([length(f) for f in found[1:i]]) AS stop
    FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT doc_id, row, regexp_split_to_array(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS found,
        regexp_extract_all(text, '{quoted}', {rule.group}) AS counted FROM d))
  ) WHERE length(counted) >= {rule.least}"""


SQL = {
    "op5_secrets": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_sql_spans(r, i) for i, r in enumerate(RULES))}),
spelled AS (
  SELECT row, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (WHERE rank < {len(BASE)}) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM spans GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN spelled USING (row)
"""
}
