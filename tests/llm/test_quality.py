import zlib
import numpy as np

from lexiloom.llm import quality
from tests.llm.conftest import prose


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.op3_quality(spark, "/root/testdata/sf0.01").toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 50 and (held.predicted == held.quality).mean() > 0.95
    assert got.score.between(0, 1).all() and docs.count() >= len(got)


def test_score_is_the_density_difference():
    r = np.random.default_rng(0)
    x = [r.normal(k, 1 + k, (500, 3)) for k in (0, 1)]
    model = quality.fitted({k: (len(v), v.sum(axis=0), v.T @ v) for k, v in enumerate(x)}, 3)
    covs = [np.linalg.inv(f).dot(np.linalg.inv(f).T) for f in model.factors]
    one = x[1][:5]
    want = [[np.log(0.5) - 0.5 * np.linalg.slogdet(covs[k])[1] - 0.5 * (v - model.means[k]) @ np.linalg.solve(covs[k], v - model.means[k]) for k in (0, 1)] for v in one]
    assert np.allclose(model.log_density(one), want)
    assert (model.score(x[1]) > 0.5).mean() > 0.7 > (model.score(x[0]) > 0.5).mean()


def test_odd_rows(spark, odd, odd_rows, none):
    labels = spark.createDataFrame([(3, 1), (4, 1), (4, 0), (None, 1), (9, None), (11, 5), (5, 0)], "doc_id long, quality int")
    model = quality.train(quality.described(odd), labels)
    got = quality.score(odd, model, "p").collect()
    assert len(got) == len(odd_rows) and all(0 <= r.p <= 1 for r in got)
    assert got[0].p == got[1].p == quality.score(odd, model, "p").where("doc_id = 0").first().p
    assert quality.train(quality.described(none), labels) == 0.5 and quality.score(none, 0.5).count() == 0


def test_statistics_are_finite():
    for text in ("", " ", "\n\n", "a", "***", prose(1, 3000), "é" * 5000):
        assert np.isfinite(quality.statistics(text.encode())).all()
    assert len(quality.statistics(b"")) == len(quality.FEATURES)


def test_query_by_the_textbook_formula(spark, sf):
    from tests.llm import brute

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute.quality_scores(docs, {(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()})
    got = quality.op3_quality(spark, sf).collect()
    assert len(got) == len(docs) and all(abs(r.score - want[r.doc_id]) < 1e-6 for r in got)
    assert all(r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_query_of_odd_and_empty_tables(spark, odd, odd_rows, none, tmp_path):
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, 0), (10, 0, 0), (8, 0, 1), (11, 0, 0), (3, 1, 0), (None, 1, 0), (12, 7, 0)], "doc_id long, quality int, toxic int")
    for name, docs, marks in (("odd", odd, labels), ("unmarked", odd, labels.limit(0)), ("none", none, labels)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        marks.write.parquet(str(tmp_path / name / "labels.parquet"))
        got = quality.op3_quality(spark, str(tmp_path / name)).collect()
        assert len(got) == (0 if name == "none" else len(odd_rows)) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        kept = quality.keep_good(spark, docs, str(tmp_path / name))
        assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
