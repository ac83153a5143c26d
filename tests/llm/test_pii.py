import hashlib
import random
import re

from pyspark.sql import functions as F

from lexiloom.llm import pii
from tests.llm.conftest import prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(number):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            bad = {"email": False, "ip": any(int(p) > 255 for p in m.group().split(".") if kind == "ip"), "card": kind == "card" and not (13 <= len(digits) <= 19 and valid(digits)), "phone": not 9 <= len(digits) <= 15}
            if not bad[kind]:
                out.append((rank, m.start(), m.end(), kind))
    return out


def test_base_by_brute_force(spark):
    r = random.Random(4)
    parts = ["a.b", "@", "x-y", ".com", ".", "_", "%", "1", "22", "255", "256", "0001", "+1", "+", "(", ")", "-", " ", "\n", "é", "😀", "4111111111111111", "4111 1111 1111 1111", "378282246310005", "555-0123", "10.0.0.1", "a@b.c", "@d.e"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 16)))) for i in range(1500)]
    rows += [(2000, None), (None, "a@b.c_d@e.f"), (2001, "1.2.3.4.5.6.7.8"), (2001, "1.2.3.4.5.6.7.8"), (2002, "a@b.c" * 3), (2003, "+1 (377) 555-0271" * 700)]
    got = spark.createDataFrame(rows, "doc_id long, text string").select("text", pii.base_spans(F.coalesce("text", F.lit(""))).alias("spans")).collect()
    assert len(got) == len(rows)
    for g in got:
        assert [tuple(s) for s in g.spans] == base(g.text), g.text


def test_very_long_texts(spark):
    """Long runs of one kind take no quadratic time and no deep stack."""
    texts = {"1" * 300_000: 0, "a" * 300_000: 0, "1." * 80_000: 20_000, "a." * 150_000: 0, "+1 " * 100_000: 0, "+1" + " " * 300_000: 0, "(" * 300_000: 0, "a@b.c " * 10_000: 10_000, "1 " * 150_000: 0, "4111 1111 1111 1111," * 2000: 2000, "10.0.0.1 " * 5000: 5000}
    rows = [(i, t) for i, t in enumerate(texts)]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", F.size("base").alias("n")).collect()
    assert {r.doc_id: r.n for r in found} == dict(enumerate(texts.values()))


def corpus():
    """Prose with numbers of many kinds, whose labels the base rules give."""
    r = random.Random(6)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows = []
    for i in range(1600):
        what = r.choice([f"call +1 ({d(3)}) 555-{d(4)}", f"+1 ({d(3)}) 555-{d(4)}", f"token = \"{d(9)}{r.choice('abc')}{d(10)}\"", f"version {d(2)}.{d(7)}", f"order {d(12)}", f"mail ann.{d(2)}@host{d(1)}.example.com", f"host 10.{r.randint(0, 255)}.{r.randint(0, 255)}.7", f"id {d(8)}", ""])
        rows.append((i, f"{prose(i, 8)} {what} {prose(i + 5, 4)}"))
    extra = ["call (377) 555-0271 now", "write to ann.42 (at) host3.example (dot) com please", "order 123456789012 came", "version 12.3456789", "look at this. Then dot it", "host 10[.]20[.]30[.]7 is down"]
    return rows + [(5000 + i, t) for i, t in enumerate(extra)], extra


def test_added_spans(spark):
    """Forms that the base rules don't know are found by their shape and context; numbers of other uses are not. Spark's selection equals a walk over candidates."""
    rows, extra = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.candidates(docs).cache()
    models = pii.fit(found)
    assert models == pii.fit(found.repartition(13))
    assert all(models[k].threshold is not None for k in ("email", "ip", "phone")) and models["card"].threshold is None
    got = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.spans] for r in pii.find_personal(docs, models=models).collect()}
    assert [got[5000 + i] for i in range(len(extra))] == [[("phone", "(377) 555-0271")], [("email", "ann.42 (at) host3.example (dot) com")], [], [], [], [("ip", "10[.]20[.]30[.]7")]]
    for r in found.withColumn("spans", pii.selected(F.col("base"), F.col("proposed"), models)).collect():
        want, good = [tuple(s) for s in r.base], []
        for c in r.proposed:
            model = models[pii.KINDS[c.rank]]
            if c.label == 0 and model.threshold is not None and model.score(c["shape"]) >= model.threshold - 1e-9 and not any(b.start < c.end and c.start < b.end for b in r.base):
                good.append(((round(model.score(c["shape"]), 6), c.end - c.start, -c.rank, -c.start), c))
        for order, c in good:
            if not any(o > order and x.start < c.end and c.start < x.end for o, x in good):
                want.append((c.rank, c.start, c.end, pii.KINDS[c.rank]))
        assert [tuple(s) for s in r.spans] == sorted(want)


def test_trees_fit():
    """Boosting reaches the shares of the counts; thresholds keep to the asked precision."""
    counts = [((0, 0), 1.0, 100.0), ((0, 1), 90.0, 100.0), ((1, 0), 95.0, 100.0), ((1, 1), 2.0, 100.0)]
    start, trees = pii.boosted(counts)
    model = pii.Model(start, trees, None)
    scores = [model.score(x) for x, _, _ in counts]
    assert scores[2] > scores[1] > scores[3] > scores[0] and scores[1] > 1 and scores[3] < -1
    assert pii.calibrated([(s, y, n) for s, (_, y, n) in zip(scores, counts)]) == scores[1]
    assert pii.calibrated([(1.0, 5.0, 100.0)]) is None and pii.calibrated([]) is None
    assert pii.boosted([]) == (0.0, ())


def test_query(spark, sf):
    got = pii.op13_pii(spark, sf)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for _, a, b, k in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[3] == k for w in want) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for _, a, b, k in want} <= set(r.spans.split(",")) | {""}


def test_redaction(spark):
    text = "mail a@b.com or +1 (377) 555-0271, é 10.0.0.1"
    df = spark.createDataFrame([(1, text), (2, "none"), (3, "")], "doc_id long, text string").withColumn("spans", pii.base_spans(F.col("text")))
    assert [r.x for r in df.orderBy("doc_id").select(pii.redacted(F.col("text"), F.col("spans")).alias("x")).collect()] == ["mail [EMAIL] or [PHONE], é [IP]", "none", ""]
    spans = F.expr("array(named_struct('rank', 0, 'start', 2, 'end', 6, 'kind', 'a'), named_struct('rank', 1, 'start', 4, 'end', 9, 'kind', 'b'))")
    assert spark.range(1).select(pii.redacted(F.lit("0123456789xyz"), spans)).first()[0] == "01[A]9xyz"


def test_odd_rows(odd, odd_rows, none):
    got = pii.find_personal(odd, name="found")
    assert got.columns == [*odd.columns, "found"] and got.count() == len(odd_rows)
    assert pii.find_personal(none).count() == 0
