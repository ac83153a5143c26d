"""What a query costs as its tables grow: one pass where there were several, a row a word where there was one a place."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import morphology
from lexiloom.operators import analysis, documents, lexicon
from lexiloom.plans import catalogue
from lexiloom.sources import corpus, readers, sinks

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pos_substitute", "lexicon_forms", "character_subwords"])
def test_words_are_counted_before_they_are_analysed(spark, name):
    assert "MapInArrow" in plan(spark, name)


@pytest.mark.parametrize("name, passes", [("span_labels", 1), ("decode_ids", 1), ("class_features", 1)])
def test_functions_run_once(spark, name, passes):
    found = [line for line in plan(spark, name).split("\n") if "ArrowEvalPython" in line]
    assert len(found) == passes and not any(line.endswith(", 204") or ", 204]" in line for line in found)


def test_slices_walk_a_text_once(spark):
    words = [f"w{i}é" for i in range(120_000)]
    rows = spark.createDataFrame([(" ".join(words),), (None,), ("",)], "t string")
    began = time.time()
    got = rows.select(morphology.slices(F.col("t"), analysis.offsets_of(F.col("t")))).collect()
    assert [r[0] for r in got] == [words, None, []] and time.time() - began < 20


def test_cuts_are_walked_range_by_range(spark, monkeypatch):
    r, ends, at = random.Random(4), [], 0
    for _ in range(900):
        at += r.randint(1, 40)
        ends.append(at)
    want, last = [], 0
    for e in ends:
        if e - last > 100:
            want.append(e)
            last = e

    def leaps(*_):
        raise AssertionError("a table for every doubling")

    monkeypatch.setattr(documents, "materialize", leaps)
    rows = spark.createDataFrame([(e,) for e in ends], "end long").repartition(5)
    for adaptive in ("true", "false"):  # without it there are several ranges
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        assert sorted(x.end for x in documents.closing_ends(rows, 100).collect()) == want
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert documents.closing_ends(rows.limit(0), 100).count() == 0


def test_small_ranges_share_tasks(tmp_path):
    (tmp_path / "a.txt").write_text("x\n\n" * 100_000)
    (tmp_path / "b.txt").write_text("y\n\n" * 10)
    parts = corpus.CorpusReader(str(tmp_path), "documents", 100).partitions()
    ranges = [r for p in parts for r in p.ranges]
    assert len(parts) <= corpus.LEAST_TASKS + 1 and len(ranges) == 3001 and sum(r.end - r.start for r in ranges) == 300_030


def test_a_word_is_worked_out_once(monkeypatch):
    known = lexicon.Lexicon([lexicon.Entry(w, 10 * len(w)) for w in ("the", "cat", "th", "e", "at")], unknown_cost=50)
    r, calls, path = random.Random(5), [], lexicon.Lexicon.path
    texts = ["".join(r.choice("thecat \n　") for _ in range(r.randint(0, 40))) for _ in range(60)] + [None, "", "the cat the cat"] * 20
    want = [None if t is None else known.morphemes(t, analysis.SplitMode.C) for t in texts]
    monkeypatch.setattr(lexicon.Lexicon, "path", lambda self, t: calls.append(t) or path(self, t))
    assert known.parted() and known.arrays(texts, analysis.SplitMode.C, {}, True).to_pylist() == want
    assert len(calls) == len(set(calls))
    spaced = lexicon.Lexicon([lexicon.Entry("the cat", 5), lexicon.Entry("the", 10)], unknown_cost=50)
    assert not spaced.parted() and spaced.arrays(texts, analysis.SplitMode.C, {}, False).to_pylist() == [None if t is None else spaced.morphemes(t, analysis.SplitMode.C) for t in texts]


def test_files_that_are_read_whole_stay_small(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_DOCUMENTS", 10)
    rows = spark.range(95).coalesce(1).select("id", F.array(F.lit("a"), F.col("id").cast("string")).alias("sentences"))
    sinks.write_corpus(rows, str(tmp_path / "c"), ["id"])
    sinks.write_articles(rows.select(F.concat(F.lit("_START_ARTICLE_\n"), F.col("id").cast("string")).alias("value")), str(tmp_path / "a"))
    for name, found in (("c", readers.blank_line_documents(spark, str(tmp_path / "c"))), ("a", readers.articles(spark, str(tmp_path / "a")))):
        sizes = [r["count"] for r in found.groupBy("path").count().collect()]
        assert sum(sizes) == 95 and max(sizes) == 10
