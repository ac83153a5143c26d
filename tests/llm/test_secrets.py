import random
import re

import pytest

from lexiloom.llm import secrets


def test_spans_by_brute_force(spark):
    r = random.Random(2)
    parts = ["token", "=", ": ", "secret", '"', "'", "abc", "é😀", " ", "\n", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "API_KEY", "apikey", "passwd", "passWord", "x" * 6, "ghp_", "q" * 36, "deadbeef"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 14)))) for i in range(400)]
    rows += [(1000, None), (None, "token=abcdefgh"), (1001, "token=token :abcdefgh"), (1001, "token=token :abcdefgh"), (1002, "AKIA" * 5 + " " + "AKIA" + "Z" * 16), (1003, "-----BEGIN RSA PRIVATE KEY-----")]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for g in got:
        want = []
        for rank, rule in enumerate(secrets.RULES):
            want += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern, g.text or "") if len(m.group(rule.group)) >= rule.least]
        assert [tuple(s) for s in g.spans] == sorted(want)


def test_queries_are_mandatory():
    """Every match holds all trigrams of some alternative."""
    samples = {"assign": ["Password=abcdef", "api_key: xyzxyz", "APIKEY='123456", "passwd =aaaaaa", "TOKEN:bbbbbb", "secret=cccccc"], "access": ["AKIA" + "Q" * 16], "hosting": ["ghp_" + "a" * 36], "chat": ["xoxb-1234567890"], "webtoken": ["eyJaaaaaaaaa.eyJbbbbbbbbb.cccccccccc"], "privatekey": ["-----BEGIN EC PRIVATE KEY-----"]}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        assert bool(query) == (rule.kind != "hex")
        for s in samples.get(rule.kind, []):
            assert re.search(rule.pattern, s)
            assert any(all(g in s.lower() for g in q) for q in query)
    assert secrets.trigram_query("[a-z]+") == [] and secrets.trigram_query("ab|cde") == []


def test_no_python_in_the_plan(spark, sf):
    plan = secrets.op5_secrets(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(odd, odd_rows, none):
    got = secrets.find_secrets(odd, name="found")
    assert got.columns == [*odd.columns, "found"] and got.count() == len(odd_rows)
    assert secrets.find_secrets(none).count() == 0


def test_pattern_parts():
    assert secrets.Pattern("a(b|cd)?[xy]\\x20").runs == [{"a"}, {"b", "cd", ""}, {"x", "y"}, {" "}]
    assert secrets.Pattern("[a-z]\\d.[^a][A-]k{2,}").runs == [None, None, None, None, {"a", "-"}, None]
    assert secrets.Pattern("[]x](?:q)").runs == [{"]", "x"}, {"q"}]


def test_no_match_is_lost():
    """Random patterns of every construct that is read, over random texts: what matches satisfies the query."""
    r = random.Random(9)
    atoms = ["a", "b", "c", "D", "xyz", "token", "[ab]", "[^a]", "[a-c]", "[A-C]", "[A-b]", "[\\x41-\\x62]", "[-x]", ".", r"\d", r"\.", r"\x61", r"\t", "é", "É", r"\w", r"\u0062"]

    def pattern(depth):
        out = ""
        for _ in range(r.randint(1, 5)):
            kind = r.random()
            if kind < 0.55 or not depth:
                part = r.choice(atoms)
            elif kind < 0.8:
                part = f"{r.choice(['(', '(?:', '(?i:'])}{pattern(depth - 1)}{r.choice(['', '|' + pattern(depth - 1)])})"
            elif kind < 0.9:
                part = f"{r.choice(['(?=', '(?!'])}{pattern(0)})"
            else:
                out += r.choice(["^", "$", r"\b", r"\B", "(?<!x)", "(?<=a)"])
                continue
            # groups have bounded repeats only: nested open ones make a matcher try forever
            out += part + r.choice(["", "", "", "?", "??", "{2}", "{0,2}", *([] if part[0] == "(" else ["*", "+", "+?", "{1,}?", "*+"])])
        return out

    def text(n):
        return "".join(r.choice(["a", "b", "c", "d", "D", "A", "xyz", "token", "TOKEN", "é", "É", ".", "\t", "1", "x", " "]) for _ in range(n))

    met = 0
    for _ in range(1500):
        p = r.choice(["", "", "(?i)"]) + pattern(2)
        try:
            compiled = re.compile(p)
        except re.error:
            continue
        query = secrets.trigram_query(p)
        for _ in range(8):
            t = text(r.randint(0, 7))
            if query and compiled.search(t):
                met += 1
                assert any(all(g in t.lower() for g in q) for q in query), (p, t, query)
    assert met > 60


def test_constructs(spark):
    assert secrets.trigram_query("^abcdef$") == secrets.trigram_query("abcdef") == [frozenset({"abc", "bcd", "cde", "def"})]
    assert secrets.trigram_query("(?<!x)token=[a-z]+") == [frozenset({"tok", "oke", "ken", "en="})]
    assert secrets.trigram_query("abc+?def") == [frozenset({"def"})] and secrets.trigram_query(r"(?i)\bABC\b") == [frozenset({"abc"})]
    assert secrets.trigram_query(r"[a-z&&[^b]]\p{L}\1(?<n>abc)\k<n>") == [frozenset({"abc"})]
    for bad in ("(?x)a b c", "(?iu)abc", r"\Qabc\E", r"\cA", "a{x}", "*a"):
        with pytest.raises(ValueError):
            secrets.trigram_query(bad)
    rules = [secrets.Rule("a", "^abcdef$"), secrets.Rule("b", "abc+?def"), secrets.Rule("c", r"(?i)(?<!x)TOKEN=[a-z]++")]
    found = secrets.find_secrets(spark.createDataFrame([(1, "abcdef"), (2, "my token=xyz")], "doc_id long, text string"), rules).orderBy("doc_id").collect()
    assert [[s.kind for s in r.spans] for r in found] == [["a", "b"], ["c"]]
