import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import encoding, morphology, text
from lexiloom.operators import analysis, documents

ALPHABET = ["a", "B", "é", "。", "あ", "😀", " ", "  ", "\t", "\n", "\xa0", "　", "​", "\x1c", "[", "]", "12", "?", "{{", "}}", "要", "@", ".", "|", "{", "-", "https://", "sft://", "ftp://", "Ａ", "～", "℡"]


@pytest.fixture(scope="module")
def dirty(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 14)))) for i in range(1500)] + [(9999, "x[a] b?]y")]
    return rows, spark.createDataFrame(rows, "id int, s string")


def same(dirty, column, model):
    rows, df = dirty
    got = {r.id: r.x for r in df.select("id", column(F.col("s")).alias("x")).collect()}
    assert got == {i: model(s) for i, s in rows}


def test_whitespace(dirty):
    same(dirty, text.whitespace_normalizer, lambda s: re.sub(r"\s+", " ", "".join(c for c in s if c.isprintable())))


def test_citation(dirty):
    pattern = re.compile(r"\[\d+?\]|\[要.+?\]|\{\{+[^{}]+?\}\}+|\[(要出典|リンク切れ|.+?\?)\]")
    same(dirty, text.citation_normalizer, lambda s: pattern.sub("", s))


def test_filters(dirty):
    same(dirty, text.has_url, lambda s: bool(re.search(r"(https?|sftp?)://[\w/:%#\$&\?\(\)~\.=\+\-]+", s)))
    same(dirty, text.has_email, lambda s: bool(re.search(r"[\w\-]+@[\w\-]+\.[\w\-.]+", s)))
    same(dirty, text.has_script, lambda s: bool(re.search(r"[{|}]", s)))
    same(dirty, lambda s: text.bad_length(s, 3, 8), lambda s: not 3 <= len(s) <= 8)


def test_input_normalizer(dirty):
    same(dirty, text.input_normalizer(True, True, True), lambda s: unicodedata.normalize("NFKC", _strip(s).lower()))
    same(dirty, text.half_ascii, lambda s: s.translate({0xFF01 + i: 0x21 + i for i in range(94)}))
    same(dirty, text.drop_spaces, lambda s: "".join(s.split()))


def _strip(s):
    space = lambda c: c.isspace() and not "\x1c" <= c <= "\x1f"
    while s and space(s[0]):
        s = s[1:]
    while s and space(s[-1]):
        s = s[:-1]
    return s


def test_truncate(dirty):
    def model(s):
        return s.encode()[:7].decode(errors="ignore")

    same(dirty, lambda s: text.truncate_utf8(s, 7), model)


def test_unknown_names():
    for make in (text.sentence_normalizer, text.sentence_filter, documents.document_normalizer, documents.document_filter):
        with pytest.raises(ValueError):
            make(["nope"])
    with pytest.raises(ValueError):
        morphology.word_form("nope")
    with pytest.raises(ValueError):
        analysis.split_mode("D")
    with pytest.raises(ValueError):
        documents.ng_pattern(["", " "])


def test_morphemes(dirty):
    def model(s):
        return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\W]+|[^\w\s]", s)]

    rows, df = dirty
    got = {r.id: [(m.surface, m.begin, m.end) for m in r.x] for r in df.select("id", analysis.regex_morphemes(F.col("s")).alias("x")).collect()}
    java_space = re.compile(r"[ \t\n\x0b\f\r]")
    for i, s in rows:
        want = [(m.group(), m.start(), m.end()) for m in re.finditer(r"\w+|[^\w]", s) if not java_space.fullmatch(m.group())]
        assert got[i] == want


MORPHEMES = [
    ("食べ", "食べる", "食べる", "タベ", ["動詞", "一般", "*", "*", "下一段-バ行", "連用形-一般"], 0, 2),
    ("た", "た", "た", "タ", ["助動詞", "*", "*", "*", "助動詞-タ", "終止形-一般"], 2, 3),
    ("Ａ社", "Ａ社", "A社", "エーシャ", ["名詞", "普通名詞", "*", "*", "*", "*"], 3, 5),
    ("っぽい", "っぽい", "ぽい", "ッポイ", ["接尾辞", "形容詞的", "*", "*", "形容詞", "終止形-一般"], 5, 8),
]


@pytest.fixture(scope="module")
def analysed(spark):
    return spark.createDataFrame([(MORPHEMES, "食べたＡ社っぽい")], f"m {analysis.MORPHEMES}, s string")


@pytest.mark.parametrize(
    "name,want",
    [
        ("surface", ["食べ", "た", "Ａ社", "っぽい"]),
        ("dictionary", ["食べる", "た", "Ａ社", "っぽい"]),
        ("normalized", ["食べる", "た", "A社", "ぽい"]),
        ("dictionary_and_surface", ["食べ", "た", "Ａ社", "っぽい"]),
        ("normalized_and_surface", ["食べ", "た", "A社", "ぽい"]),
        ("normalized_nouns", ["食べ", "た", "A社", "っぽい"]),
        ("surface_half_ascii", ["食べ", "た", "A社", "っぽい"]),
        ("dictionary_half_ascii", ["食べる", "た", "A社", "っぽい"]),
        ("dictionary_and_surface_half_ascii", ["食べ", "た", "A社", "っぽい"]),
    ],
)
def test_word_forms(analysed, name, want):
    assert analysed.select(morphology.word_forms(F.col("m"), name)).first()[0] == want


def test_conjugation(analysed):
    rules = morphology.inflection_rules({"動詞": {"下一段-バ行|連用形-一般": [["xx", "y"], ["る", ""]], "五段|連用形-一般": [["る", "り"]]}})
    one = lambda types: analysed.select(morphology.word_forms(F.col("m"), "normalized_conjugation", rules=rules, types=morphology.conjugation_types(types))).first()[0]
    assert one({}) == ["食べ", "た", "A社", "ぽい"]
    assert one({"動詞": {"食べ|タベ|食べる|下一段-バ行": "五段"}})[0] == "食べり"


def test_pos_tag(spark):
    df = spark.createDataFrame([(["a", "*", "b", "*", "*", "*"],), (["a", "b", "c", "d", "e", "f"],), (["*", "b", "*", "*", "*", "*"],)], "p array<string>")
    assert [r[0] for r in df.select(morphology.pos_tag(F.col("p"))).collect()] == ["[a]", "[a-b-c-d-e-f]", "[*-b]"]


def test_pretokens_and_texts(analysed):
    m, s = F.col("m"), F.col("s")
    row = analysed.select(morphology.pretokens(m, s, "surface"), morphology.pretokens(m, s, "normalized"), morphology.normalized_text(m, s, "normalized"), morphology.normalized_text(m, s, "surface"), morphology.segmented(m)).first()
    assert row[0] == ["食べ", "た", "Ａ社", "っぽい"] and row[1][2] == "A社" and row[2] == "食べるたA社ぽい" and row[3] == "食べたＡ社っぽい" and row[4] == "食べ た Ａ社 っぽい"


def test_encoding(spark):
    df = spark.createDataFrame([(["a", "##b", "zz"], ["c"])], "a array<string>, b array<string>")
    a, b, v = F.col("a"), F.col("b"), encoding.Lookup({"a": 5, "##b": 6, "[UNK]": 1, "c": 7})
    row = df.select(
        v.ids(a), encoding.to_text(a), encoding.with_specials(a, b), encoding.special_mask(a, b), encoding.token_types(a, b),
        encoding.padded(v.ids(a), 5), encoding.padded(v.ids(a), 2), encoding.word_index(a), v.tokens(F.array(F.lit(5), F.lit(99))),
        encoding.merge_space_tokens(F.array(F.lit(" "), F.lit("x"), F.lit(" "), F.lit("y"))),
    ).first()
    assert row[0] == [5, 6, 1] and row[1] == "ab zz" and row[2] == ["[CLS]", "a", "##b", "zz", "[SEP]", "c", "[SEP]"]
    assert row[3] == [1, 0, 0, 0, 1, 0, 1] and row[4] == [0, 0, 0, 0, 0, 1, 1] and row[5] == [5, 6, 1, 0, 0] and row[6] == [5, 6]
    assert row[7] == [0, 0, 1] and row[8] == ["a", "[UNK]"] and row[9] == [" x ", "y"]


def test_lookups_of_odd_arrays(spark):
    """Null and empty arrays, null tokens, arrays that begin amid a batch."""
    rows = [(1, ["a", None, "b"]), (2, None), (3, []), (4, ["zz"]), (5, ["b", "b"])]
    df = spark.createDataFrame(rows, "id int, a array<string>").coalesce(1)
    known = encoding.Lookup.of(["[UNK]", "a", "b"])
    got = df.orderBy("id").select(known.ids(F.col("a")), known.kept(F.col("a")), encoding.running_sums(F.transform("a", lambda x: F.char_length(F.coalesce(x, F.lit("")))))).collect()
    assert [r[0] for r in got] == [[1, 0, 2], None, [], [0], [2, 2]]
    assert [r[1] for r in got] == [["a", "[UNK]", "b"], None, [], ["[UNK]"], ["b", "b"]]
    assert [r[2] for r in got] == [[1, 1, 2], None, [], [2], [1, 2]]
    tags = spark.createDataFrame([(["a", "x", "y"], ["t", "b", "u"]), ([], [])], "w array<string>, t array<string>")
    assert [r[0] for r in tags.select(known.either(F.col("w"), F.col("t"))).collect()] == [["a", "b", "[UNK]"], []]


def test_joined_runs_by_a_model(spark):
    import random

    r = random.Random(4)
    rows = [(i, ["".join(r.choice(" ab") for _ in range(r.randint(0, 2))) for _ in range(r.randint(0, 8))]) for i in range(200)]

    def model(tokens):
        out = []
        for t in tokens:
            if out and (not t.strip(" ") or not out[-1].strip(" ")):
                out[-1] += t
            else:
                out.append(t)
        return out

    got = spark.createDataFrame(rows, "id int, t array<string>").select("id", encoding.merge_space_tokens(F.col("t"))).collect()
    assert {x[0]: x[1] for x in got} == {i: model(t) for i, t in rows}
