from lexiloom.llm import linededup


def test_line_dedup(spark):
    rows = [(i, "common\n\nown line %d" % i, "s") for i in range(20)] + [(100 + i, "rare\nmine %d" % i, "t") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got[3] == "\nown line 3"
    assert got[101] == "mine 1"


def test_a_page_alone_repeats_nothing(spark):
    docs = spark.createDataFrame([(i, "a %d\nb" % i, "s%d" % i) for i in range(3)], "doc_id long, text string, source string")
    assert sorted(r.text for r in linededup.dedup_lines(docs).collect()) == ["a %d\nb" % i for i in range(3)]


def test_large_tables_of_lines_meet_by_salt(spark):
    """What doesn't fit a broadcast gives the same rows."""
    rows = [(i, "common %d\nown %d" % (i % 4, i), "s%d" % (i % 3) if i % 5 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    parts = [linededup.F.col("source"), linededup.F.split("text", "\n")]
    kept = [sorted((r.doc_id, tuple(r.kept)) for r in linededup.drop_boilerplate(docs, "doc_id", *parts, most_broadcast=m).collect()) for m in (1 << 20, 0)]
    assert kept[0] == kept[1] and any(len(k) == 1 for _, k in kept[0]) and len(kept[0]) == 120


def test_pages_of_odd_rows(spark):
    """Against a walk over the pages of each host."""
    import hashlib
    import re

    rows = [(i, f"http://h{i % 3}.x/{i}", f"<p>menu</p><p>text {i}</p>same<br>") for i in range(40)]
    rows += [(None, "http://h0.x/", "<p>menu</p>"), (50, None, "<p>menu</p>one"), (51, None, None), (52, "no url", ""), (52, "no url", ""), (1, rows[1][1], rows[1][2])]
    got = linededup.page_lines(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kept", linededup.F.lit(1))).collect()
    hosts = {}
    host = lambda u: None if u is None else (re.match(linededup.HOST, u) or [None, ""])[1].lower()
    lines = lambda h: None if h is None else re.split(linededup.BREAKS, h)
    for page, url, html in rows:
        hosts.setdefault(host(url), {}).setdefault(page, set()).update(x for x in lines(html) or [] if x.strip(" "))
    want = []
    for page, url, html in rows:
        pages = hosts[host(url)].values()
        bad = {x for p in pages for x in p if (n := sum(x in q for q in pages)) >= 2 and n > 0.1 * len(pages)}
        kept = None if html is None else "\n".join(x for x in lines(html) if x not in bad)
        n = len(lines(html) or [])
        want.append((page, host(url), n, 0 if html is None else n - len([x for x in lines(html) if x not in bad]), None if kept is None else len(kept), None if kept is None else hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert linededup.page_lines(empty).count() == 0

def test_a_page_that_repeats_counts_once(spark):
    rows = [(1, "x\nx\nx", "s")] * 10 + [(i, "y %d" % i, "s") for i in range(2, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.text for r in linededup.dedup_lines(docs).where("doc_id = 1").collect()} == {"x\nx\nx"}


def test_odd_rows(odd, none, odd_rows):
    got = linededup.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    by_source = {}
    for r in odd_rows:
        by_source.setdefault(r[3], {}).setdefault(r[0], set()).update((r[1] or "").split("\n"))

    def kept(text, source):
        pages = by_source[source].values()
        often = lambda x: x.strip(" ") and (n := sum(x in p for p in pages)) >= 2 and n > 0.1 * len(pages)
        return text if text is None else "\n".join(x for x in text.split("\n") if not often(x))

    assert sorted((tuple(r)[:2] for r in got.collect()), key=str) == sorted(((r[0], kept(r[1], r[3])) for r in odd_rows), key=str)
    assert linededup.dedup_lines(none).count() == 0


def test_null_hosts_form_one(spark):
    docs = spark.createDataFrame([(i, "menu\nn %d" % i, None) for i in range(9)], "doc_id long, text string, source string")
    assert {r.text for r in linededup.dedup_lines(docs).collect()} == {"n %d" % i for i in range(9)}
