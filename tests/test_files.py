import json

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import analysis, datasets, documents, metrics, tokenizer, vocab
from lexiloom.sources import readers, sinks


def test_corpora_survive_a_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(i, [f"a{i}", "b"]) for i in range(9)], "doc_id long, sentences array<string>")
    sinks.write_corpus(docs, str(tmp_path / "c"), ["doc_id"])
    back = readers.blank_line_documents(spark, str(tmp_path / "c"))
    assert sorted(tuple(r.sentences) for r in back.collect()) == sorted((f"a{i}", "b") for i in range(9))
    with pytest.raises(Exception):
        sinks.write_corpus(docs, str(tmp_path / "c"), ["doc_id"])
    sinks.write_corpus(docs.limit(1), str(tmp_path / "c"), ["doc_id"], overwrite=True)
    assert readers.blank_line_documents(spark, str(tmp_path / "c")).count() == 1


def test_shards_are_directories(spark, tmp_path):
    docs = spark.createDataFrame([(i, ["x", "y"]) for i in range(6)], "doc_id long, sentences array<string>")
    sinks.write_shards(documents.shard_ids(docs, "doc_id", 5), str(tmp_path / "s"), ["doc_id"])
    assert sorted(p.name for p in (tmp_path / "s").glob("shard_id=*")) == ["shard_id=1", "shard_id=2", "shard_id=3"]
    assert readers.blank_line_documents(spark, str(tmp_path / "s" / "shard_id=1")).count() == 2


def test_articles(spark, tmp_path):
    text = "\n_START_ARTICLE_\ntitle\n_START_PARAGRAPH_\nOne. Two!_NEWLINE_Three\n_START_SECTION_\nhead\n_START_PARAGRAPH_\nFour\n"
    (tmp_path / "a.txt").write_text(text + text.replace("One", "Uno"))
    got = readers.articles(spark, str(tmp_path)).orderBy("article_idx").withColumn("raw", documents.article_lines(F.col("article")))
    rows = got.withColumn("plain", documents.strip_markers(F.col("raw"))).collect()
    assert [r.raw for r in rows] == [["_START_ARTICLE_", "_START_PARAGRAPH_", w, "Two!", "Three", "_START_PARAGRAPH_", "Four"] for w in ("One.", "Uno.")]
    assert rows[0].plain == ["", "One.", "Two!", "Three", "", "Four"]
    sinks.write_lines_and_info(got.select(F.posexplode("raw").alias("order", "value")), spark.createDataFrame([("made",)], "name string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "corpus")).count() == 14 and spark.read.json(str(tmp_path / "out" / "info")).first().name == "made"


def test_json_sources(spark, tmp_path):
    import gzip

    row = {"context": "c", "choice_a": "1", "choice_b": "2", "choice_c": "3", "choice_d": "4", "label": "b"}
    for name in ("train", "development", "test"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(row) + "\n")
    assert {r.split: r.label for r in readers.json_splits(spark, str(tmp_path)).collect()} == dict.fromkeys(("train", "dev", "test"), "b")
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        f.write(json.dumps({"qid": "q", "question": "?", "answer": "a", "timestamp": "2009", "documents": [{"text": "a", "score": 3}]}))
    assert readers.json_rows(spark, str(tmp_path / "r.json.gz")).first().documents[0].score == 3


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("three\n")
    assert readers.lines(spark, directory=str(tmp_path)).count() == 3 and readers.lines(spark, path=str(tmp_path / "b.txt"), directory="x").count() == 1
    with pytest.raises(ValueError):
        readers.lines(spark)
    (tmp_path / "w.txt").write_text("bad\t\n\u3000\n\t\n word \u3000\n")
    assert sorted(r.word for r in readers.word_list(spark, str(tmp_path / "w.txt")).collect()) == [" word", "bad"]


def test_evaluation_files_are_found(spark, tmp_path):
    for name, x in (("train_b.csv", 2), ("train_a.csv", 1), ("dev.csv", 3)):
        (tmp_path / name).write_text(f'a,b\n{x},"two\nlines"\n')
    got = readers.evaluation_splits(spark, str(tmp_path))
    assert set(got) == {"train", "validation"} and got["train"].first().a == "1" and got["train"].count() == 1
    (tmp_path / "test.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.evaluation_splits(spark, str(tmp_path), ("train",))


def test_prediction_logs(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 0), (1, -1, 1)], "index int, label int, prediction int")
    sinks.write_predictions(rows, str(tmp_path / "p"), ["index"], labels=["no", "yes"])
    back = spark.read.csv(str(tmp_path / "p"), sep="\t", header=True).orderBy("index").collect()
    assert [tuple(r) for r in back] == [("0", "yes", "no"), ("1", "-1", "yes")]


def test_answer_files_and_summaries(spark, tmp_path):
    nbest = spark.createDataFrame([("q", 1, "x", 2.0, 0.7, "x"), ("q", 2, "", 1.0, 0.3, "x")], "id string, rank int, text string, score double, probability double, chosen string")
    sinks.write_answers(nbest, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a" / "predictions")).first().prediction == "x"
    assert len(spark.read.json(str(tmp_path / "a" / "nbest_predictions")).first().nbest) == 2
    assert spark.read.json(str(tmp_path / "a" / "null_odds")).first().null_odds == -1.0
    sinks.write_summary(spark.createDataFrame([("s", 0.5)], "setting string, dev double"), str(tmp_path / "s"))
    assert spark.read.csv(str(tmp_path / "s"), header=True).first().dev == "0.5"


def test_tokenizer_files(spark, tmp_path):
    made = tokenizer.Tokenizer(["[UNK]", "[CLS]", "[SEP]", "a", "##b"], do_lower_case=True)
    tokenizer.write_tokenizer(spark, made, str(tmp_path / "t"))
    config = json.loads("".join(p.read_text() for p in (tmp_path / "t" / "config").glob("part-*")))
    assert config["model"]["vocab"] == made.ids and config["normalizer"]["lowercase"] and config["special_tokens"] == ["[UNK]", "[CLS]", "[SEP]"] and config["pre_tokenizer"] is None
    assert {r.token: r.id for r in readers.vocabulary(spark, str(tmp_path / "t" / "vocab" / "part-*")).collect()} == made.ids


def test_split_modes(spark):
    df = spark.createDataFrame([("BigCat_2go x9",)], "s string")
    units = lambda mode: [m.surface for m in df.select(analysis.in_mode(analysis.split_morphemes, mode)(F.col("s"))).first()[0]]
    assert units("a") == ["Big", "Cat", "_", "2", "go", "x", "9"] and units("B") == ["BigCat_", "2", "go", "x", "9"] and units("c") == ["BigCat_2go", "x9"]
    with pytest.raises(ValueError):
        analysis.in_mode(analysis.regex_morphemes, "A")
    with pytest.raises(ValueError):
        analysis.split_mode("D")
    short = tokenizer.Tokenizer(["[UNK]"], subword="none", analyzer=analysis.split_morphemes, split_mode="A")
    assert df.select(short.tokens(F.col("s"))).first()[0][:2] == ["Big", "Cat"]


def test_word_filter_in_the_factory(spark):
    df = spark.createDataFrame([(1, ["fine words", "the cats"]), (2, ["ok", "a cat sat"]), (3, []), (4, ["(cat)"])], "doc_id int, sentences array<string>")
    kept = documents.clean(df, document_filters=["ng_words"], ng_words=["cat "])
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    for options in ({"names": ["ng_words"]}, {"names": ["nope"]}):
        with pytest.raises(ValueError):
            documents.document_filter(**options)


def test_seeded_shuffle(spark):
    rows = spark.range(50)
    one, same, other = (datasets.shuffled(rows, "id", s).orderBy("place").collect() for s in (1, 1, 2))
    assert [r.id for r in one] == [r.id for r in same] != [r.id for r in other] and sorted(r.id for r in other) == list(range(50))
    assert [r.place for r in other] == list(range(50))
    assert [r.id for r in readers.numbered(rows.withColumn("k", -F.col("id")), "k", "n").orderBy("n").collect()][:2] == [49, 48]


def test_longer_text_gives_way(spark):
    def model(a, b, room):
        while a + b > room:
            a, b = (a - 1, b) if a > b else (a, b - 1)
        return a, b

    sizes = [(a, b) for a in range(0, 9) for b in range(0, 9)]
    df = spark.createDataFrame([(a, b, [1] * a, [1] * b) for a, b in sizes], "a int, b int, x array<int>, y array<int>")
    got = df.select("a", "b", *[F.size(c) for c in tokenizer.fitting(F.col("x"), F.col("y"), 7)]).collect()
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == {s: model(*s, 7) for s in sizes}


def test_shortest_run_by_all_runs():
    import random

    r = random.Random(3)
    for _ in range(500):
        parts = ["".join(r.choice("ab") for _ in range(r.randint(0, 3))) for _ in range(r.randint(0, 7))]
        answer = "".join(r.choice("ab") for _ in range(r.randint(1, 4)))
        runs = [(size, at) for size in range(1, len(parts) + 1) for at in range(len(parts) - size + 1) if answer in "".join(parts[at : at + size])]
        want = min(runs, default=None)
        got = datasets.shortest_run(parts, answer)
        assert (got is None) == (want is None) and (want is None or got[1] - got[0] == want[0])


def test_exact_match_and_reviews(spark):
    one = lambda a, b: spark.range(1).select(metrics.exact_match(F.lit(a), F.lit(b))).first()[0]
    assert one("The cat!", "cat") == 1 and one("cat", "dog") == 0 and one("", "the") == 1
    rows = spark.createDataFrame([("good", 5)], "review string, stars int")
    assert tuple(datasets.convert_reviews(rows, "review", "stars").first()) == ("good", 5)
    assert datasets.limit_rows(rows, ["stars"], None) is rows


def test_large_vocabularies_cost_no_more(spark):
    """Lookups by a vocabulary of 32,000 tokens give what one of 30 gives."""
    df = spark.createDataFrame([(["w5", "w29", "zz"],)], "t array<string>")
    small, large = (vocab.Lookup.of([*vocab.SPECIALS, *(f"w{i}" for i in range(n))]) for n in (30, 32_000))
    assert df.select(small.ids(F.col("t"))).first()[0] == df.select(large.ids(F.col("t"))).first()[0] == [10, 34, 1]
