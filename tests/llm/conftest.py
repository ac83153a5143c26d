import pytest

#: Besides the documents' own columns, extra ones named like helper columns of the operators.
CLASHING = ["score", "size", "key", "whole", "spans", "rank", "tie", "wave", "copies", "nth", "source_size", "target", "lines", "kept", "at", "salt",
            "has", "id", "th", "__size", "__p", "__of", "__drop", "__th", "__id", "__copies", "__kept", "__text", "__kinds", "__pid", "__pos"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def prose(seed: int, words: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(["ka", "to", "mi", "ren", "sol", "é", "Va"]) for _ in range(r.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empties, a very long text, ties, repeated rows and near copies, with extra columns of clashing names."""
    long = prose(1, 6000)
    base = prose(2, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (0, None, None, None, None),
        (1, "", "en", "a", 0),
        (2, " \t\n", "en", "a", 3),
        (3, "one", "en", "a", 3),
        (4, base, "en", "a", len(base)),
        (5, " ".join(near), "fr", "b", None),
        (6, base, "en", "b", len(base)),
        (7, base, "en", "b", len(base)),
        (7, base, "en", "b", len(base)),
        (8, long, "de", None, len(long)),
        (None, "no id here", "en", "c", 10),
        (9, "line one\nshared\n" + prose(3, 40), "en", "a", 9),
        (10, prose(4, 30) + "\nshared\n　é😀", "en", "a", 9),
        (11, "a b c", "en", "c", 5),
        (12, "a b c", "en", "c", 5),
    ]
    return [(*r, *["x"] * len(CLASHING)) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
