import corpus_pipeline
from lexiloom.llm import linededup, mixing, neardedup, packing, quality
from lexiloom.llm.common import materialize


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        names.append(name)
        before = docs
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and docs.count() > 0
        if name != "mixing":
            assert docs.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)
    assert names + ["packing"] == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]


def test_stages_on_odd_rows(spark, sf, odd, none):
    for docs in (odd, none):
        for stage in (lambda d: linededup.dedup_lines(d), lambda d: neardedup.keep_one(d), lambda d: mixing.mix(d), lambda d: quality.keep_good(spark, d, sf)):
            docs = materialize(stage(docs), "stage")
        assert packing.pack_documents(docs).count() >= docs.count()


def test_run_against_a_walk(spark, sf):
    """run() against plain walks over the same documents, stage by stage, to the library's tokens of what is left."""
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from tests.llm import brute

    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    scores = brute.quality_scores([d[:2] for d in docs], {(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()})
    docs = brute.without_boilerplate([d for d in docs if scores[d[0]] >= 0.5])
    kept = brute.representatives([d[:2] for d in docs])
    docs = [d for d in docs if d[0] in kept]
    copies = brute.mixed_copies(docs)[0]
    model = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for d, text, _ in docs:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(d, n, a, k, zlib.crc32(ids[a : a + k].tobytes())) for n, (a, k) in enumerate(packing.cut(len(ids)))] * copies[d]
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
