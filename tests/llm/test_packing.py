import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import packing

PATH = public_tokenizers.path(packing.TOKENIZER)


def test_encoder_gives_the_library_ids():
    model, encoder, r = Tokenizer.from_file(PATH), packing.Encoder(PATH), random.Random(0)
    texts = ["".join(r.choice("ab  \n\t'sé的\x1c\x85　 1!?.,|*b\r'll've") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(1, 0xD800), r.randrange(0xE000, 0x11000), r.randrange(32, 300), 32])) for _ in range(40)) for _ in range(2000)]
    texts += ["a <|endoftext|> b", "x<|endoftext|>y", "x<|endoftext|>. z|", "", "the *** end\nNew line.", "a" * 20000, " " * 3000]
    want = [np.array(e.ids, "<u4").tobytes() for e in model.encode_batch(texts, add_special_tokens=False)]
    assert list(map(encoder.ids, texts)) == want


def test_other_files_are_the_library_s(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    ids = Tokenizer.from_file(str(tmp_path / "t.json")).encode("Some TEXT", add_special_tokens=False).ids
    assert packing.Encoder(str(tmp_path / "t.json")).ids("Some TEXT") == np.array(ids, "<u4").tobytes()


def placed(plan, hist):
    """Lengths in each sequence, from a plan's runs, checked to be gapless and whole."""
    bins, ranks = {}, {}
    for length, rank, count, first, offset in plan.placements:
        assert ranks.get(length, 1) == rank
        ranks[length] = rank + count
        for k in range(count):
            bins.setdefault(first + k, []).append((offset, length))
    assert {k: v - 1 for k, v in ranks.items()} == {i: int(n) for i, n in enumerate(hist) if n}
    for parts in bins.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= plan.capacity
    assert sorted(bins) == list(range(plan.sequences))


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    r = np.random.default_rng(seed)
    hist = np.zeros(101, np.int64)
    np.add.at(hist, r.integers(1, 101, 3000), 1)
    plan = packing.packing_plan(hist, 100, rounds=80)
    placed(plan, hist)
    bound = max(-(-int((hist * np.arange(101)).sum()) // 100), int(hist[51:].sum()))
    assert plan.sequences <= bound * 1.02 + 1


def test_thirds_need_the_program():
    """Best fit alone is bound to pair these badly; the configurations are exact."""
    hist = np.zeros(13, np.int64)
    hist[[6, 3, 4, 5]] = 600, 600, 600, 600
    plan = packing.packing_plan(hist, 12)
    placed(plan, hist)
    assert plan.sequences <= -(-(600 * 18) // 12) + 5


def test_program_beats_best_fit_where_nothing_small_fills_gaps():
    r = np.random.default_rng(9)
    hist = np.zeros(101, np.int64)
    np.add.at(hist, r.integers(20, 50, 30000), 1)
    plain = packing.Plan(hist, 100)
    plain.best_fit()
    plan = packing.packing_plan(hist, 100)
    placed(plan, hist)
    assert plan.sequences < 0.95 * plain.sequences


def test_price_is_the_best_knapsack():
    from itertools import combinations_with_replacement

    values = np.zeros(13)
    values[[3, 4, 5, 7]] = 1.0, 1.5, 1.9, 2.6
    best = max(sum(values[list(c)]) for n in range(1, 5) for c in combinations_with_replacement([3, 4, 5, 7], n) if sum(c) <= 12)
    worth, took = packing.knapsack(values, 12)
    got = packing.filling(took.tolist(), 12)
    assert sum(got) <= 12 and values[got].sum() == pytest.approx(best) == worth[12]


@pytest.mark.parametrize("times", [1, 10, 100])
def test_the_program_packs_documents(spark, times):
    """On the documents' own lengths, at three sizes: no more sequences than best fit alone, nearly all of them from configurations."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lengths = [r.length for r in packing.pieces(docs, PATH).select("length").collect()]
    hist = np.bincount(lengths, minlength=packing.CAPACITY + 1) * times
    plain = packing.Plan(hist, packing.CAPACITY)
    plain.best_fit()
    plan = packing.packing_plan(hist)
    placed(plan, hist)
    assert plan.sequences <= plain.sequences and plan.programmed >= 0.95 * plan.sequences


def test_query_against_the_library(spark, sf):
    """Every document's pieces by the library's ids, and sequences that hold them without gaps, few more than tokens need."""
    model = Tokenizer.from_file(PATH)
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = np.array(model.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for n, (a, k) in enumerate(packing.cut(len(ids))):
            want[r.doc_id, n] = (a, k, zlib.crc32(ids[a : a + k].tobytes()))
    rows = packing.op10_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))] and sum(parts[-1]) <= packing.CAPACITY
    assert len(sequences) <= -(-sum(k for _, k, _ in want.values()) // packing.CAPACITY) * 1.01 + 1


def test_pieces_of_odd_rows(odd, odd_rows, none):
    model = Tokenizer.from_file(PATH)
    got = packing.pack_documents(odd).toPandas()
    want = []
    for r in odd_rows:
        ids = np.array(model.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(r[0], n, a, k, zlib.crc32(ids[a : a + k].tobytes())) for n, (a, k) in enumerate(packing.cut(len(ids)))]
    rows = [(None if np.isnan(x.doc_id) else int(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got.itertuples()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    for _, part in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= packing.CAPACITY
    assert packing.pack_documents(none).count() == 0


def test_cut():
    assert packing.cut(5000) == [(0, 904), (904, 2048), (2952, 2048)]
    assert packing.cut(2048) == [(0, 2048)] and packing.cut(1) == [(0, 1)]


@pytest.mark.parametrize("space", [" ", "\t", "\n", " \t\n\u3000"])
def test_long_white_space(spark, space):
    """Runs of millions of spaces, with and without an end, have the library's ids; they stop no job."""
    library = Tokenizer.from_file(PATH)
    texts = ["a" + space * (1_200_000 // len(space)) + "b", space * (1_000_001 // len(space)), "x " + space * 150_000 + "y" + space * 99_000 + "z"]
    want = [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert [len(packing.loaded(PATH).ids(t)) // 4 + 1 for t in texts] == want
    if space == " ":
        rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert {r.doc_id: r.n for r in rows.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()} == dict(enumerate(want))
