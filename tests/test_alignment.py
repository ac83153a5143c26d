import random
import time
import unicodedata
from functools import lru_cache

from lexiloom.functions.alignment import aligned, anchors, fewest_edits
from lexiloom.operators.qa import _aligned, _placed, token_offsets


def longest(a, b):
    @lru_cache(None)
    def f(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + f(i + 1, j + 1) if a[i] == b[j] else max(f(i + 1, j), f(i, j + 1))

    return f(0, 0)


def test_fewest_edits_by_brute_force():
    r = random.Random(1)
    for _ in range(800):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in range(2))
        pairs = fewest_edits(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert fewest_edits("a" * 300, "b" * 300, 200) is None and fewest_edits("ab", "cd", 3) is None and fewest_edits("", "") == []


def test_alignment_is_in_order_and_of_equal_characters():
    r = random.Random(2)
    for _ in range(300):
        a, b = ("".join(r.choice("ab \n") for _ in range(r.randint(0, 20))) for _ in range(2))
        out = aligned(a, b)
        assert len(out) == len(a) and all(p < 0 or a[i] == b[p] for i, p in enumerate(out))
        kept = [p for p in out if p >= 0]
        assert kept == sorted(set(kept)) and len(kept) == longest("".join(a.split()), "".join(b.split()))


def prose(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    return " ".join(r.choice(words) for _ in range(n))


def test_long_texts_in_a_second():
    """20,000 characters, with edits throughout, with a large part replaced, and with nothing in common."""
    text = prose(3, 4000)[:20_000]
    r = random.Random(4)
    edited = "".join(c if r.random() > 0.03 else r.choice(["", "x", c + "y"]) for c in text)
    for other, least in ((text.replace(" ", ""), 1.0), (edited, 0.9), (text[:8000] + prose(9, 900) + text[12_000:], 0.75), ("#" * 20_000, 0)):
        began = time.time()
        out = aligned(text, other)
        assert time.time() - began < 1.5
        solid = sum(not c.isspace() for c in text)
        assert sum(p >= 0 for p in out) >= least * solid
    assert anchors("abcdefg", "xxcdefyy", 4) == [(2, 2)]


def test_offsets_of_normalized_tokens():
    spans = lambda text, tokens: [(o["start"], o["end"]) for o in _aligned(text, tokens)]
    assert spans("Ｈｅｌｌｏ world", ["hello", "wor", "##ld"]) == [(0, 6), (6, 9), (9, 11)]
    assert spans("a b", ["[CLS]", "a", "zz", "b", "[SEP]"]) == [(0, 0), (0, 1), (1, 2), (2, 3), (0, 0)]
    assert spans("", ["a"]) == [(0, 0)] and spans("text", []) == []
    text = prose(5, 3000)
    assert [text[a:b] for a, b in spans(text, text.upper().split())] == text.split()
    assert unicodedata.normalize("NFKC", "ｱ") == "ア" and spans("xｱy", ["x", "ア", "y"]) == [(0, 1), (1, 2), (2, 3)]


def test_offsets_of_long_texts_take_little_memory(spark):
    """A batch of rows is placed some texts at a time; all spans of one as objects took some 200 bytes a token."""
    import pyarrow as pa

    text = prose(3, 20_000)
    rows, tokens = 300, [w[i : i + 3] for w in text.lower().split() for i in range(0, len(w), 3)]
    batch = pa.array([text] * rows), pa.array([tokens] * rows, pa.list_(pa.string()))
    sizes = [len(part) for part in token_offsets.func(iter([batch]))]
    assert sum(sizes) == rows and len(sizes) > 10 and max(sizes) * len(text) <= 1 << 20
    out = _placed(batch[0].slice(0, 2), batch[1].slice(0, 2))
    assert out.nbytes < 20 * 2 * len(tokens)
    assert [text[o["start"] : o["end"]].lower() for o in out[1].as_py()] == tokens
    assert _placed(pa.array(["a", None, "b c"]), pa.array([None, ["a"], ["b", "[CLS]", "##c"]], pa.list_(pa.string()))).to_pylist() == [
        None,
        None,
        [{"start": 0, "end": 1}, {"start": 0, "end": 0}, {"start": 2, "end": 3}],
    ]
