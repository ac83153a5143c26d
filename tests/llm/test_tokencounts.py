import random

import public_tokenizers

from lexiloom.llm import tokencounts

PATH = public_tokenizers.path(tokencounts.MODEL)


def test_chunks_give_the_whole_text_counts():
    pieces, r = tokencounts.Pieces(PATH), random.Random(0)
    for _ in range(1500):
        text = "".join(r.choice("ab  \n▁é的<s>0_℡") for _ in range(r.randint(0, 60)))
        assert tokencounts.huge_count(text, pieces, 8, 2) == pieces.counts([text])[0], repr(text)


def test_splices_happen_and_overlaps_widen(monkeypatch):
    pieces, made = tokencounts.Pieces(PATH), []
    real = tokencounts.splice
    monkeypatch.setattr(tokencounts, "splice", lambda *a: made.append(real(*a)) or made[-1])
    text = "word and more " * 300 + "x" * 900 + " tail " * 50
    assert tokencounts.huge_count(text, pieces, 400, 20) == pieces.counts([text])[0]
    assert None in made and sum(x is not None for x in made) > 5


def test_texts_without_spaces(monkeypatch):
    """Two million characters of Chinese and Japanese, spliced between any two; a run of one letter, which has no splice, at once."""
    pieces, made, r = tokencounts.Pieces(PATH), [], random.Random(4)
    real = tokencounts.splice
    monkeypatch.setattr(tokencounts, "splice", lambda *a: made.append((a[3] - a[1], real(*a))) or made[-1][1])
    text = "".join(chr(r.choice((r.randrange(0x4E00, 0x9FA0), r.randrange(0x3041, 0x3097), 0x61))) for _ in range(2_000_000))
    assert tokencounts.huge_count(text, pieces) == pieces.counts([text])[0]
    assert len(made) > 100 and all(x is not None for _, x in made) and max(n for n, _ in made) <= tokencounts.CHUNK + tokencounts.OVERLAP
    for text in ("a" * 100_000, "的" * 100_000, "=" * 50_000 + "é的" * 50_000):
        assert tokencounts.huge_count(text, pieces) == pieces.counts([text])[0]


def test_stable_boundaries():
    pieces = tokencounts.Pieces(PATH)
    assert pieces.stable("a", " ") and not pieces.stable(" ", " ") and not pieces.stable(" ", "a") and not pieces.stable("t", "h")


def test_odd_rows(odd, odd_rows, none):
    pieces = tokencounts.Pieces(PATH)
    got = tokencounts.token_counts(odd, PATH, chunk=100, overlap=10).collect()
    want = [(r[0], len((r[1] or "").encode()), pieces.counts([r[1] or ""])[0]) for r in odd_rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencounts.token_counts(none, PATH).count() == 0


def test_query_of_every_document(spark, sf, none):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokencounts.MODEL))
    want = {r.doc_id: (len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = tokencounts.op7_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 4096) for r in got)
    assert tokencounts.token_counts(none, public_tokenizers.path(tokencounts.MODEL)).count() == 0
