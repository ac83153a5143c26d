"""Queries over documents with null, empty and oddly spaced texts, against their SQL."""

import duckdb
import pytest

from lexiloom.plans import catalogue

TEXTS = [None, None, "", "", "\n", "\n\n\n", " ", " \n ", "\t", "One.\n\nTwo!\n", "\n\nlead. in", "cr.\r\nlf. x\r", "!", ".", "a\n.\n!", "... ...", "　", " x. y", "a.\x0c b", "plain"]
ENDS = ["a.\x0bb. c", "x!\x0by", "end.\x85", "end. ", "q. \nz", "tail \x85\nmore.  x", "\x0b", "the\ttin\xa0es " + "he\u3000" * 40]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    with duckdb.connect() as db:
        db.execute("create table d (doc_id bigint, text varchar, lang varchar, source varchar)")
        db.executemany("insert into d values (?, ?, 'en', 's')", list(enumerate(TEXTS + ENDS)))
        db.execute(f"copy d to '{folder}/documents.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["article_corpus", "article_files", "article_ranges", "sentence_bounds", "lexicon_paths"])
def test_odd_texts_equal_sql(spark, odd, name):
    with duckdb.connect() as db:
        db.execute(f"create view documents as from '{odd}/documents.parquet'")
        want = db.execute(catalogue.SQL[name])
        names = [d[0] for d in want.description]
        want = sorted(map(str, want.fetchall()))
    assert sorted(str(tuple(r)) for r in catalogue.QUERIES[name](spark, str(odd)).select(*names).collect()) == want
