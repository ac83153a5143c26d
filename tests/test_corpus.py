import random
import re

import pyarrow as pa
import pytest

from lexiloom.operators.documents import ARTICLE
from lexiloom.sources import corpus, readers


def split_read(data, kind, size):
    file = pa.PythonFile(pa.BufferReader(data), mode="r")
    return [x for at in range(0, len(data), size) for x in corpus.READERS[kind](file, at, min(at + size, len(data)))]


def documents_of(text):
    """(position, sentences) by a plain walk over lines."""
    out, own, begin, at = [], [], 0, 0
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall("[^\n]*\n|[^\n]+$", text):
        at += len(line.encode())
        if line.strip() == "" and line.endswith("\n"):
            out.append((begin, own))
            own, begin = [], at
        elif line.strip():
            own.append(line.strip())
    return out


TEXTS = ["", "\n", "a", "a\n", "a\n\n", "\n\n\n", "a\nb\n\nc\n \t\n　\nd\n\n", " a \n\nb", "\n\na\n\n", "é\r\n\r\nlong line " * 3 + "\n\n", "x\n\n   ", "   \nx\n\n"]


@pytest.mark.parametrize("text", TEXTS)
def test_documents_at_any_split_size(text):
    data, want = text.encode(), documents_of(text)
    for size in range(1, len(data) + 2):
        assert split_read(data, "documents", size) == want, size


def test_random_corpora():
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice(["a", "bc d", "\n", "\n\n", " ", "　", "é😀", "\t\n", f"{ARTICLE}\n", f"\n{ARTICLE}\n", ARTICLE]) for _ in range(r.randint(0, 40)))
        data = text.encode()
        parts = [(m.start(), m.end()) for m in re.finditer(f"(?m)^{ARTICLE}$", text)]
        ends = [a for a, _ in parts[1:]] + [len(text)]
        articles = [(len(text[:a].encode()), "\n" + text[a:e].rstrip("\n")) for (a, _), e in zip(parts, ends)]
        for size in (1, 2, 3, 5, 8, 13, 40, 1000):
            assert split_read(data, "documents", size) == documents_of(text)
            assert split_read(data, "articles", size) == articles


def test_blocks_smaller_than_lines(monkeypatch):
    monkeypatch.setattr(corpus, "BLOCK", 16)
    text = ("word " * 50 + "\n") * 3 + " " * 90 + "\n" + "x" * 70 + "\n\n" + "end\n\n"
    for size in (1, 7, 64, 100, 5000):
        assert split_read(text.encode(), "documents", size) == documents_of(text)


def test_one_file_by_several_tasks(spark, tmp_path):
    text = "".join(f"first {i}\nsecond é {i}\n{'more ' * (i % 50)}\n\n" for i in range(3000))
    (tmp_path / "c.txt").write_text(text)
    (tmp_path / "_hidden").write_text("no\n\n")
    whole = readers.blank_line_documents(spark, str(tmp_path / "c.txt")).orderBy("doc_idx").select("sentences").collect()
    found = corpus.read_corpus(spark, f"file://{tmp_path}", split_bytes=10_000)
    assert found.rdd.getNumPartitions() > 20
    rows = found.orderBy("path", "at").collect()
    assert [r.sentences for r in rows] == [r.sentences for r in whole] and len({r["at"] for r in rows}) == 3060
    assert corpus.read_corpus(spark, f"{tmp_path}/*.txt").count() == 3060
    with pytest.raises(Exception, match="unknown kind"):
        corpus.read_corpus(spark, str(tmp_path), "other").count()
    with pytest.raises(Exception, match="nothing-here"):
        corpus.read_corpus(spark, f"{tmp_path}/nothing-here").count()
    (tmp_path / "empty").mkdir()
    assert corpus.read_corpus(spark, f"{tmp_path}/empty", "articles").count() == 0
