import random
import re
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lexiloom import storage
from lexiloom.functions import morphology, wordlist
from lexiloom.operators import analysis, documents


def test_automaton_gives_the_pattern_s_matches():
    r = random.Random(1)
    for _ in range(500):
        words = ["".join(r.choice("abé😀 ") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 8))]
        kept = [w.rstrip() for w in words if w.strip()]
        if not kept:
            continue
        text = "".join(r.choice("abé😀 ") for _ in range(r.randint(0, 25)))
        assert wordlist.spans_in(text, wordlist.automaton(words)) == [m.span() for m in re.finditer("|".join(map(re.escape, kept)), text)], (words, text)


def test_either_way_gives_the_same(spark):
    """A list of literal words, by the automaton and as a pattern."""
    words = ["bad word", "bad", "worse", "ばか", "x"]
    rows = [(1, ["a bad word here", "fine"]), (2, ["badly x-ed"]), (3, ["あの ばか だ"]), (4, []), (5, ["worse"]), (6, None)]
    df = spark.createDataFrame(rows, "id long, s array<string>")
    assert wordlist.are_literal(words) and not wordlist.are_literal([*words, "(never)"])
    got = [df.where("s IS NOT NULL").where(documents.any_ng_word(F.col("s"), w)).select("id").orderBy("id").collect() for w in (words, [*words, "(never)"])]
    assert got[0] == got[1] and [r.id for r in got[0]] == [2, 3, 5]  # "bad word" spans two morphemes and hides "bad"
    assert df.where(documents.any_ng_word(F.col("s"), words)).count() == 3
    with pytest.raises(ValueError):
        documents.any_ng_word(F.col("s"), [" ", ""])


def test_long_lists_cost_no_more_than_short_ones():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    short, long = [word() for _ in range(10)], [word() for _ in range(100_000)]
    text = " ".join(word() for _ in range(20_000))
    took = []
    for words in (short, long):
        found = wordlist.automaton(words)
        began = time.time()
        wordlist.spans_in(text, found)
        took.append(time.time() - began)
    assert took[1] < 10 * took[0] + 0.2


def test_counts_come_with_the_cleaned_rows(spark):
    rows = [(1, ["one", "two", "three"]), (2, ["one {x}", "two"]), (3, ["{y}"]), (4, []), (5, ["ok", "fine", "x" * 50, "good"])]
    df = spark.createDataFrame(rows, "id long, sentences array<string>").withColumn("answers", F.lit("own"))
    how = {"document_filters": ["short_document", "script"], "least_sentences": 2, "sentence_filters": ["sequence_length"], "least_chars": 1, "most_chars": 20}
    seen = Observation()
    cleaned = documents.clean_observed(df, seen, **how)
    assert cleaned.columns == df.columns
    assert [tuple(r) for r in sorted(cleaned.collect())] == [tuple(r) for r in documents.clean(df, **how).orderBy("id").collect()]
    want = {"n_before": 5, "n_after": 2, "n_short_document": 2, "n_script": 2, "n_sentences_before": 10, "n_sentences_after": 6}
    assert seen.get == want == documents.clean_counts(df, **how).first().asDict()
    assert documents.clean_counts(df.limit(0), **how).first().asDict() == dict.fromkeys(want, 0)


def test_one_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.split("text", "\n").alias("sentences"))
    plan = documents.clean_counts(docs, ["short_document", "script"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_shards_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(i, ["a"] * 3, "kept") for i in range(6)], "id long, sentences array<string>, of string")
    found = documents.shard_ids(df, "id", 7)
    assert found.columns == ["id", "sentences", "of", "shard_id"] and [r.shard_id for r in found.orderBy("id").collect()] == [1, 1, 2, 2, 3, 3]


def test_conjugation_by_tables(spark):
    """The same forms by joined tables as by maps in the plan; the plan doesn't grow with the tables."""
    r = random.Random(3)
    types = {"動詞": {f"s{i}|r{i}|走る|サ行変格": r.choice(["五段", "上一段"]) for i in range(30)}}
    rules = {"動詞": {"五段|連用形-一般": [["る", "り"]], "五段|仮定形-促音便": [["x", "y"]], "五段|仮定形-一般": [["る", "れ"]], "サ行変格|連用形-一般": [["", "!"]]}, "形容詞": {"*|連用形-一般": [["る", "く"]]}}
    rows = []
    for i in range(200):
        k = r.randint(0, 40)
        pos = [r.choice(["動詞", "形容詞", "名詞"]), "*", "*", "*", r.choice(["サ行変格", "五段", "*"]), r.choice(["終止形-一般", "連用形-一般", "仮定形-促音便", "仮定形-一般", "*"])]
        rows.append((i, (f"s{k}", "d", "走る", f"r{k}", pos, 0, 2), "own"))
    df = spark.createDataFrame(rows, f"id long, m {analysis.MORPHEMES[6:-1]}, `key of` string")
    rule_rows = [(c, k, [tuple(x) for x in v]) for c, inner in rules.items() for k, v in inner.items()]
    rule_table = spark.createDataFrame(rule_rows, "class string, key string, value array<struct<src:string,tgt:string>>")
    type_rows = [(c, k, v) for c, inner in types.items() for k, v in inner.items()]
    type_table = spark.createDataFrame(type_rows, "class string, key string, value string")
    got = analysis.conjugated_by_tables(df, rule_table, type_table)
    want = df.select("id", morphology.conjugated(F.col("m"), morphology.inflection_rules(rules), morphology.conjugation_types(types)).alias("form"))
    assert got.columns == [*df.columns, "form"]
    assert [tuple(x) for x in got.select("id", "form").orderBy("id").collect()] == [tuple(x) for x in want.orderBy("id").collect()]
    many = spark.range(100_000).selectExpr("'動詞' AS class", "concat('s', id, '|r', id, '|走る|サ行変格') AS key", "'五段' AS value")
    large = analysis.conjugated_by_tables(df, rule_table, many)
    assert large.count() == 200 and len(large._jdf.queryExecution().toString()) < 60_000


def test_only_what_a_form_needs(spark):
    texts = ["Hello, World_1 x", "", " 　", "a--b é😀", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    row = df.select(
        analysis.offsets_of(F.col("t")).alias("o"),
        F.transform(analysis.regex_morphemes(F.col("t")), lambda m: F.struct(m["begin"].alias("start"), m["end"].alias("end"))).alias("p"),
        *[analysis.split_words(F.col("t"), m).alias(f"w{m.name}") for m in analysis.SplitMode],
        *[F.transform(analysis.split_morphemes(F.col("t"), m), lambda x: x["surface"]).alias(f"v{m.name}") for m in analysis.SplitMode],
        *[analysis.words_in_form(analysis.regex_morphemes, n, morphology.word_form(n))(F.col("t")).alias(f"a{n}") for n in ("surface", "normalized", "dictionary")],
        *[F.transform(analysis.regex_morphemes(F.col("t")), morphology.word_form(n)).alias(f"b{n}") for n in ("surface", "normalized", "dictionary")],
    )
    for r in row.collect():
        assert r.o == r.p and all(r[f"w{m.name}"] == r[f"v{m.name}"] for m in analysis.SplitMode)
        assert all(r[f"a{n}"] == r[f"b{n}"] for n in ("surface", "normalized", "dictionary"))


def test_a_folder_where_none_is_named(tmp_path):
    """Without a checkpoint folder one in the warehouse is set, once."""

    class Context:
        folder = None

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path + "/made"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return f"file://{tmp_path}/warehouse" if key == "spark.sql.warehouse.dir" else default

    made = f"file://{tmp_path}/warehouse/lexiloom-checkpoints/made"
    assert storage.checkpoint_dir(Session) == made and storage.checkpoint_dir(Session) == made
