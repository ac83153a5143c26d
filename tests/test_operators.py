import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import analysis, datasets, documents, metrics, qa, vocab
from lexiloom.sources import readers, sinks
from lexiloom.streaming.cleaning import clean_stream


def one(spark, column, **values):
    return spark.range(1).select(*[v.alias(k) for k, v in values.items()]).select(column).first()[0]


def test_blank_lines_end_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n two \n\n\nthree\n\nlost")
    rows = readers.blank_line_documents(spark, str(tmp_path)).orderBy("doc_idx").collect()
    assert [r.sentences for r in rows] == [["one", "two"], [], ["three"]]


def test_articles(spark):
    text = "\n_START_ARTICLE_\ntitle\n_START_SECTION_\nsection\n_START_PARAGRAPH_\na_NEWLINE_b\n_START_PARAGRAPH_\nc"
    got = one(spark, documents.article_paragraphs(F.col("t")), t=F.lit(text))
    lines = text.split("\n")
    assert got == [lines[i].split("_NEWLINE_") for i in range(2, len(lines), 2) if lines[i - 1] == "_START_PARAGRAPH_"]


def test_concat_short(spark):
    r = random.Random(1)
    rows = [(i, ["x" * r.randint(1, 5) for _ in range(r.randint(0, 7))]) for i in range(200)]

    def model(s):
        out = list(s)
        for i in range(len(s) - 1, 0, -1):
            if len(s[i]) <= 2:
                out[i - 1] += out.pop(i)
        return out

    df = spark.createDataFrame(rows, "id int, s array<string>")
    got = {x.id: x.s for x in df.select("id", documents.concat_short_sentences(F.col("s")).alias("s")).collect()}
    assert got == {i: model(s) for i, s in rows}


def test_shards_by_line_scan(spark):
    r = random.Random(2)
    rows = [(i, ["l"] * r.randint(0, 9)) for i in range(120)]
    shard, lines, want = 1, 0, {}
    for i, s in rows:
        want[i] = shard
        lines += len(s) + 1
        if lines > 25:
            shard, lines = shard + 1, 0
    df = spark.createDataFrame(rows, "doc_id int, sentences array<string>")
    assert {x.doc_id: x.shard_id for x in documents.shard_ids(df, "doc_id", 25).collect()} == want


def test_word_list_spans(spark):
    rows = [("the cat sat", True), ("the cats sat", False), ("the c at", True), ("a catat", False), ("cat", True)]
    df = spark.createDataFrame(rows, "s string, want boolean")
    hit = documents.has_ng_word(F.col("s"), analysis.regex_morphemes(F.col("s")), ["cat", "at"])
    assert [x[0] for x in df.select(hit).collect()] == [w for _, w in rows]


def test_flatten(spark):
    df = spark.createDataFrame([("q", [("a", 1), ("b", 2)]), ("r", [])], "qid string, documents array<struct<text:string,score:int>>")
    got = documents.flatten_documents(df)
    assert got.columns == ["qid", "doc_id", "documents.text", "documents.score"] and [tuple(x) for x in got.collect()] == [("q", 1, "a", 1), ("q", 2, "b", 2)]


def test_reading(spark):
    rows = [("q1", "?", "b", "2009", [("abc", 1), ("cab", 2)]), ("q2", "?", "b", "2010", [("xb", 5)])]
    got = datasets.convert_reading(spark.createDataFrame(rows, readers.READING_SCHEMA)).collect()
    assert [(r.id, r.answers.answer_start, r.split) for r in got] == [("q10001", [], "dev"), ("q10002", [2], "dev"), ("q20001", [1], "test")]


def test_ratio_split(spark):
    rows = spark.range(101)
    counts = {r.split: r["count"] for r in datasets.split_by_ratio(rows, "id", "8/1/1").groupBy("split").count().collect()}
    assert counts == {"train": 80, "dev": 10, "test": 11} and sum(counts.values()) == 101
    assert set(r.split for r in datasets.split_by_ratio(rows, "id", "8/0/2").collect()) == {"train", "test"}
    for bad in ("0/1/1", "8/1/0", "8/1"):
        with pytest.raises(ValueError):
            datasets.ratios(bad)


def test_choices(spark):
    row = [("c x", "a 1", "b", "c", "d", "c")]
    got = datasets.convert_choices(spark.createDataFrame(row, readers.CHOICE_SCHEMA))
    assert tuple(got.first()) == ("cx", "a1", "b", "c", "d", 2)
    pairs = datasets.explode_choices(got.withColumn("id", F.lit(1)), [f"choice_{i}" for i in range(4)])
    back = datasets.regroup_choices(pairs, ["id"], ["text_b"]).first()
    assert back.text_b == ["a1", "b", "c", "d"]


def test_relocation_and_spans(spark):
    words = F.array(*map(F.lit, ["foo", "bar", "baz"]))
    forms = F.array(*map(F.lit, ["FOO", "BAR", "BAZ"]))
    get = lambda a, n: one(spark, datasets.relocated_answer(F.lit(a), F.lit("FOO BAR BAZ"), F.lit(n), words, forms))
    assert get("FOO", "x") == "FOO" and get("q", "BAR") == "BAR" and get("oba", "z") == "FOOBAR" and get("nope", "z") is None
    span = one(spark, datasets.spaced_span(F.lit("a b c d"), F.lit("bc")))
    assert (span.start, span.end) == (2, 5)


def test_roles():
    assert datasets.column_roles(["sentence1", "label"], "classification") == {"label": "label", "texts": ["sentence1"]}
    assert datasets.column_roles(["a", "choice_0", "choice_1", "z"], "multiple_choice") == {"choices": ["choice_0", "choice_1"], "context": "a", "label": "z"}


def test_batches(spark):
    df = spark.createDataFrame([(i, [1] * (i + 1)) for i in range(5)], "id int, ids array<int>")
    got = datasets.padded_batches(df, "id", "ids", 2).orderBy("id").collect()
    assert [len(r.ids) for r in got] == [2, 2, 4, 4, 5]
    assert datasets.padded_batches(df, "id", "ids", 2, drop_remainder=True).count() == 4


def test_wordpiece(spark):
    from tokenizers import Tokenizer, models

    tokens = ["[UNK]", "a", "b", "ab", "##a", "##b", "##ba", "abc", "##c"]
    library = Tokenizer(models.WordPiece({t: i for i, t in enumerate(tokens)}, unk_token="[UNK]", max_input_chars_per_word=100))
    r = random.Random(0)
    words = list({"".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(300)}) + ["a" * 101]
    got = {x.word: x.pieces for x in vocab.wordpiece_of_words(spark.createDataFrame([(w,) for w in words], "word string"), tokens).collect()}
    assert got == {w: library.encode(w).tokens for w in words}


def test_wordpiece_training(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers, trainers

    r = random.Random(5)
    text = [" ".join("".join(r.choice(["ab", "c", "de", "f"]) for _ in range(r.randint(1, 4))) for _ in range(30)) for _ in range(20)]
    library = Tokenizer(models.WordPiece(unk_token="[UNK]"))
    library.pre_tokenizer = pre_tokenizers.Whitespace()
    library.train_from_iterator(text, trainers.WordPieceTrainer(vocab_size=60, min_frequency=2, limit_alphabet=10, special_tokens=list(vocab.SPECIALS), show_progress=False))
    rows = spark.createDataFrame([(w,) for t in text for w in t.split()], "word string").groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    assert set(vocab.train_wordpiece(rows, 60, 2, 10)) == set(library.get_vocab())


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("[UNK]\na\tx\nb\na\n")
    read = readers.vocabulary(spark, str(tmp_path / "v.txt"))
    assert {r.token: r.id for r in read.collect()} == {"[UNK]": 0, "a": 3, "b": 2}
    lines = [r.token for r in sinks.vocabulary_lines(read).orderBy("id").collect()]
    assert lines == ["[UNK]", "", "b", "a"]
    sinks.write_vocabulary(read, str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.write_vocabulary(read, str(tmp_path / "out"))


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"V": {"t|f": [["a", "b"]]}}')
    got = readers.rule_table(spark, str(tmp_path / "r.json"), "array<array<string>>").first()
    assert (got["class"], got.key, got.value) == ("V", "t|f", [["a", "b"]])


def qa_model(starts, ends, offsets, context, n_best=20, most=30):
    order = lambda x: sorted(range(len(x)), key=lambda i: (-x[i], i))[:n_best]
    found = [(starts[s] + ends[e], s, e) for s in order(starts) for e in order(ends) if offsets[s] and offsets[e] and s <= e < s + most]
    null = starts[0] + ends[0]
    found.sort(key=lambda x: (-x[0], x[1], x[2]))
    texts = [(context[offsets[s][0] : offsets[e][1]], score) for score, s, e in found[:n_best]]
    texts = [t for t in texts if t[0]] or [("empty", 0.0)]
    return "" if null - texts[0][1] > 0 else texts[0][0]


def test_answers(spark):
    r = random.Random(7)
    context = "abcdefghijklmnopqrstuvwxyz"
    offsets = [None, None] + [(i, i + 1) for i in range(20)]
    rows = [(f"q{i}", 0, [r.gauss(0, 1) + (3 * (k == 0) * (i % 2)) for k in range(22)], [r.gauss(0, 1) for _ in range(22)], offsets) for i in range(60)]
    features = spark.createDataFrame(rows, "id string, feature_idx int, start_logits array<double>, end_logits array<double>, offsets array<struct<start:int,end:int>>")
    contexts = spark.createDataFrame([(x[0], context) for x in rows], "id string, context string")
    got = qa.answers(features, contexts)
    chosen = {x.id: x.chosen for x in got.select("id", "chosen").distinct().collect()}
    assert chosen == {x[0]: qa_model(x[2], x[3], offsets, context) for x in rows}
    sums = got.groupBy("id").agg(F.sum("probability").alias("p")).collect()
    assert all(abs(x.p - 1) < 1e-9 for x in sums)


def test_span_labels_and_offsets(spark):
    offsets = F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in [(0, 3), (4, 7), (8, 9)]])
    label = lambda a, b: tuple(one(spark, qa.span_labels(offsets, F.lit(a), F.lit(b), shift=5)))
    assert label(4, 9) == (6, 7) and label(5, 6) == (6, 6) and label(8, 12) == (0, 0)
    df = spark.createDataFrame([("Hello wörld", ["[CLS]", "hello", "w", "##örld", "[SEP]"])], "t string, k array<string>")
    got = [tuple(x) for x in df.select(qa.token_offsets("t", "k")).first()[0]]
    assert got == [(0, 0), (0, 5), (6, 7), (7, 11), (0, 0)]


def test_metrics(spark):
    f1 = lambda a, b, p: one(spark, metrics.overlap_f1(F.lit(a), F.lit(b), p))
    assert f1("The cat", "a cat!", metrics.answer_words) == 1.0 and f1("", "", metrics.answer_words) == 1.0 and f1("x", "", metrics.answer_words) == 0.0
    assert f1("東京。", "東京都", metrics.answer_characters) == pytest.approx(0.8)
    df = spark.createDataFrame([("LABEL_3", "5"), ("LABEL_1", "1")], "label string, prediction string")
    assert tuple(df.select(metrics.squared_error(F.col("label"), F.col("prediction")), metrics.absolute_error(F.col("label"), F.col("prediction"))).first()) == (2.0, 1.0)
    assert one(spark, metrics.argmax(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7)))) == 1


def test_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "x string, split string")
    sinks.write_splits(df, str(tmp_path / "d"), "json")
    assert {(r.x, r.split) for r in spark.read.json(str(tmp_path / "d")).collect()} == {("a", "train"), ("b", "test")}
    for kind in ("train", "dev"):
        (tmp_path / f"{kind}_0.csv").write_text("a,b\n1,2\n")
    got = readers.evaluation_splits(spark, str(tmp_path), ("train", "dev"))
    assert set(got) == {"train", "validation"} and got["validation"].first().b == "2"


def test_summaries(spark, tmp_path):
    for s, label in (("5e-5_16_3", "1"), ("3e-5_32_4", "0")):
        (tmp_path / s).mkdir()
        (tmp_path / s / "dev_predictions.tsv").write_text(f"index\tlabel\tprediction\n0\t1\t{label}\n")
        (tmp_path / s / "dev_metrics.json").write_text('{"exact": 1.0,\n "f1": 2.0}')
    logs = readers.prediction_logs(spark, str(tmp_path), "dev")
    by = logs.groupBy("setting").agg(metrics.accuracy(F.col("label"), F.col("prediction")).alias("value"))
    assert tuple(metrics.best_setting(by, "setting", "value").first()) == ("5e-5_16_3", 1.0)
    assert readers.metric_files(spark, str(tmp_path), "dev").count() == 2


def test_stream(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(str(tmp_path / "in"))
    stream = clean_stream(spark, str(tmp_path / "in"), schema, sentence_filters=["email", "sequence_length"], document_filters=["short_document", "script"])
    job = stream.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).start()
    job.processAllAvailable()
    job.stop()
    batch = documents.clean(spark.read.parquet(f"{sf}/documents.parquet").withColumn("sentences", F.split("text", "\n")), sentence_filters=["email", "sequence_length"], document_filters=["short_document", "script"])
    assert spark.table("cleaned").count() == batch.count()
