import pytest
from pyspark.sql import functions as F

from lexiloom.operators.tokenizer import Tokenizer, choice_features, classification_features, normalize_columns, segment_columns

VOCAB = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "foo", "ba", "##r", "x", "b", "a", "r", "[noun]", "[number]"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(1, "foo Bar?", "x"), (2, None, "x"), (3, "", "foo 7")], "id int, a string, b string")


def tokens(df, **options):
    t = Tokenizer(VOCAB, **options)
    return [r[0] for r in df.orderBy("id").select(t.tokens(F.col("a"))).collect()]


def test_subwords(texts):
    assert tokens(texts, do_lower_case=True) == [["foo", "ba", "##r", "[UNK]"], None, []]
    assert tokens(texts, subword="character", word_form="normalized")[0] == ["[UNK]"] * 3 + ["b", "a", "r", "[UNK]"]
    assert tokens(texts, subword="pos_substitution", word_form="normalized")[0] == ["foo", "[noun]", "[UNK]"]
    assert tokens(texts, subword="none")[0] == ["foo", "Bar", "?"]


def test_encode(texts):
    t = Tokenizer(VOCAB, do_lower_case=True)
    assert t.vocab_size == len(VOCAB)
    row = t.encode(texts, "a", "b", max_length=10, padded=True).where("id = 1").first()
    assert row.input_ids == [2, 4, 5, 6, 1, 3, 7, 3, 0, 0] and row.token_type_ids == [0] * 6 + [1, 1, 0, 0]
    assert row.attention_mask == [1] * 8 + [0, 0] and row.special_tokens_mask == [1, 0, 0, 0, 0, 1, 0, 1, 1, 1]
    cut = t.encode(texts, "a", max_length=4).where("id = 1").first()
    assert cut.input_ids == [2, 4, 5, 3]


def test_features(spark, texts):
    t = Tokenizer(VOCAB)
    got = classification_features(texts.withColumn("label", F.when(F.col("id") == 1, "yes").otherwise("-1")), t, ["a"], "label", ["no", "yes"]).orderBy("id").collect()
    assert [r.label_id for r in got] == [1, -1, -1]
    rows = spark.createDataFrame([(1, "foo", "x", "b")], "id int, context string, choice_0 string, choice_1 string")
    assert choice_features(rows, t, ["id"], ["choice_0", "choice_1"]).first().input_ids == [[2, 4, 3, 7, 3], [2, 4, 3, 8, 3]]


def test_columns(texts):
    assert normalize_columns(texts, ["a"], "normalized").orderBy("id").first().a == "foobar?"
    assert normalize_columns(texts, ["a"], "surface") is texts
    assert segment_columns(texts, ["a"], "spaced").orderBy("id").first().a == "foo Bar ?"
    assert segment_columns(texts, ["a"], "wide").orderBy("id").first().a.replace(" ", "").startswith("ｆｏｏ")


def test_arguments():
    for options in ({"subword": "nope"}, {"vocab": None}, {"vocab": ["a"]}, {"word_form": "nope"}, {"word_form": "normalized_conjugation"}):
        with pytest.raises(ValueError):
            Tokenizer(**{"vocab": VOCAB} | options)
