import random
import time
from collections import Counter

from pyspark.sql import functions as F

from lexiloom.operators import tokenizer, vocab, wordpiece


def one_by_one(split, freqs, found, size, least):
    """Merges of the most frequent pair, one after another, counted anew each time."""
    while len(found.tokens) < size:
        pairs = Counter()
        for w, f in zip(split, freqs):
            for p in zip(w, w[1:]):
                pairs[p] += f
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < max(least, 1):
            break
        m = found.id(found.tokens[a] + found.tokens[b].removeprefix("##"))
        split = [wordpiece.apply_merges(w, {(a, b): (0, m)}) for w in split]
    return found.tokens


def round_of(split, freqs, top):
    pairs, threes = Counter(), Counter()
    for w, f in zip(split, freqs):
        for p in zip(w, w[1:]):
            pairs[p] += f
        for t in zip(w, w[1:], w[2:]):
            threes[t] += f
    rows = sorted((-n, p) for p, n in pairs.items())
    found = wordpiece.Round([(-n, *p) for n, p in rows[:top]], len(rows) <= top)
    listed = {p for _, p in rows[:top]}
    for (x, y, z), n in threes.items():
        if (y, z) in listed:
            found.before[y, z][x] = n
        if (x, y) in listed:
            found.after[x, y][z] = n
    return found


def test_rounds_equal_single_merges():
    """Whatever a round takes along, its merges are those that single steps would make: repeats, overlaps, ties and all."""
    r, merges, rounds = random.Random(1), 0, 0
    for _ in range(600):
        letters = "abcdefgh"[: r.choice([1, 2, 3, 5, 8])]
        words = list({"".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 40))})
        freqs = [r.choice([1, 1, 2, 3, 10]) for _ in words]
        tokens = sorted(set("".join(words))) + ["##" + c for c in sorted(set("".join(words)))]
        size, least, top = len(tokens) + r.randint(0, 60), r.choice([1, 1, 2, 3]), r.choice([1, 2, 5, 20, 1000])
        one, many = wordpiece.Vocabulary(tokens), wordpiece.Vocabulary(tokens)
        split = [[one.ids[("##" if i else "") + c] for i, c in enumerate(w)] for w in words]
        want = one_by_one(split, freqs, one, size, least)
        while len(many.tokens) < size:
            found, ended = wordpiece.merges_of(round_of(split, freqs, top), many, size, least)
            merges, rounds = merges + len(found), rounds + 1
            if ended or not found:
                break
            split = [wordpiece.apply_merges(w, {(a, b): (k, m) for k, (a, b, m) in enumerate(found)}) for w in split]
        assert many.tokens == want
    assert merges > 1.5 * rounds


def cut(word, opened):
    out = [[word[0]]]
    for p in zip(word, word[1:]):
        if p in opened:
            out[-1].append(p[1])
        else:
            out.append([p[1]])
    return out


def test_runs_equal_single_merges():
    """Merges in the runs of opened pairs are those of single steps, also where several merges give one token, as marks within words do."""
    r, tokens_of_two_ways = random.Random(3), 0
    for _ in range(600):
        letters = r.choice(["ab#", "a#", "abc##", "ab", "abcdefgh"])
        words = list({"".join(r.choice(letters) for _ in range(r.randint(1, 16))) for _ in range(r.randint(1, 40))})
        freqs = [r.choice([1, 1, 2, 3, 10, 30, 100]) for _ in words]
        tokens = list(dict.fromkeys([*sorted(set("".join(words))), *("##" + c for c in sorted(set("".join(words))))]))
        size, least = len(tokens) + r.randint(0, 60), r.choice([1, 1, 2, 3])
        n, listed = r.choice([1, 2, 3, 6, 12, 1000]), r.choice([1, 2, 3])
        one, many = wordpiece.Vocabulary(tokens), wordpiece.Vocabulary(tokens)
        split = [[one.ids[("##" if i else "") + c] for i, c in enumerate(w)] for w in words]
        want = one_by_one(split, freqs, one, size, least)
        ended = False
        while not ended and len(many.tokens) < size and any(len(w) > 1 for w in split):
            found = round_of(split, freqs, n * listed)
            pairs = wordpiece.Opened(found.pairs, min(n, len(found.pairs)), found.all)
            opened = {(a, b) for _, a, b in pairs.pairs[: pairs.n]}
            runs = Counter()
            for w, f in zip(split, freqs):
                for x in cut(w, opened):
                    runs[tuple(x)] += f * (len(x) > 1)
            runs, before = +runs, len(many.tokens)
            after, ended = wordpiece.merge_runs(runs, pairs, many, size, least)
            assert ended or any(len(x) < len(y) for x, y in zip(after, runs))
            tokens_of_two_ways += len(many.tokens) == before
            known = dict(zip(runs, after))
            split = [[i for x in cut(w, opened) for i in known.get(tuple(x), x)] for w in split]
        assert many.tokens == want
    assert tokens_of_two_ways


def test_rounds_in_tables_are_few(spark, monkeypatch):
    """300 merges in a few rounds, each with a bounded number of runs on the driver; where runs are too many or too long, the same vocabulary by other rounds."""
    r = random.Random(4)
    words = list({"".join(r.choice(["the", "er", "in", "an", "st", "om", "ul"]) for _ in range(r.randint(1, 6))) for _ in range(1500)})
    counts = spark.createDataFrame([*((w, r.randint(1, 9)) for w in words), ("ab" * 200, 3)], "word string, freq long")
    want = vocab.train_wordpiece(counts, 330)
    rounds, merge = [], wordpiece.merge_runs
    monkeypatch.setattr(wordpiece, "merge_runs", lambda runs, *x: rounds.append(len(runs)) or merge(runs, *x))
    monkeypatch.setattr(wordpiece, "MOST_RUN", 500)
    assert vocab.train_wordpiece(counts, 330, most_local=10) == want and len(rounds) <= 12
    rounds.clear()
    monkeypatch.setattr(wordpiece, "MOST_RUNS", 100)
    assert vocab.train_wordpiece(counts, 330, most_local=10) == want and max(rounds) <= 100
    rounds.clear()
    monkeypatch.setattr(wordpiece, "MOST_RUNS", 0)
    assert wordpiece.train_distributed(counts, 40, 1, 5000, vocab.SPECIALS) == want[:40] and not rounds
    monkeypatch.undo()
    assert vocab.MOST_LOCAL_WORDS <= 100_000  # more never meet on the driver


def test_training_in_tables(spark):
    """The same vocabulary, in the same order, as on the driver; the way is chosen by the number of words."""
    r = random.Random(2)
    words = [("".join(r.choice(["the", "er", "in", "an", "é", "s", "😀"]) for _ in range(r.randint(1, 4))), r.randint(1, 30)) for _ in range(120)]
    counts = spark.createDataFrame([*words, ("", 5), (None, 7), ("rare", 1)], "word string, freq long")
    for size, least, alphabet in ((60, 1, 100), (1000, 20, 8)):
        want = vocab.train_wordpiece(counts, size, least, alphabet)
        assert vocab.train_wordpiece(counts, size, least, alphabet, most_local=10) == want
    assert wordpiece.train_distributed(counts.limit(0), 50, 1, 10, vocab.SPECIALS) == list(vocab.SPECIALS)


def test_trie_gives_the_longest_pieces():
    r = random.Random(3)
    for _ in range(300):
        tokens = {"".join(r.choice("ab#") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 12))}
        tokens |= {"##" + "".join(r.choice("ab#") for _ in range(r.randint(0, 4))) for _ in range(r.randint(1, 12))}
        trie = wordpiece.PieceTrie(list(tokens))
        for _ in range(60):
            w = "".join(r.choice("aab#") for _ in range(r.randint(0, 12)))
            assert trie.pieces(w) == vocab.greedy_pieces(w, tokens), (w, tokens)
    assert wordpiece.PieceTrie(["a", "##a"]).pieces("a" * 101) == ["[UNK]"]


def test_one_pass_over_long_words():
    """A word on which every piece is tried in vain at each place takes time in proportion to its length."""
    trie = wordpiece.PieceTrie(["a" * n for n in range(1, 200)] + ["##" + "a" * n for n in range(1, 200)], most_chars=10**9)
    began = time.time()
    assert len(trie.pieces("a" * 500_000)) == 2513
    assert time.time() - began < 3


def test_written_tokenizers_read_back(spark, tmp_path):
    """Ids, also of repeated tokens, flags, names and encodings survive."""
    tokens = ["[UNK]", "[BOS]", "[SEP]", "[PAD]", "un", "##aff", "##able", "a", "un", "。"]
    own = tokenizer.Tokenizer(tokens, word_form="normalized", do_lower_case=True, cls="[BOS]", split_mode="C")
    tokenizer.write_tokenizer(spark, own, f"file://{tmp_path}/t")
    again = tokenizer.read_tokenizer(spark, f"file://{tmp_path}/t")
    assert again.config() == own.config() and again.ids == own.ids and again.cls == "[BOS]"
    rows = spark.createDataFrame([("UNAFFABLE a。",), ("x",), ("",)], "t string")
    encoded = [t.encode(rows, "t", max_length=8, padded=True).collect() for t in (own, again)]
    assert encoded[0] == encoded[1] and encoded[0][0].input_ids == [1, 8, 5, 6, 7, 9, 2, 3]


def test_every_word_in_pieces(spark, sf):
    words = spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"\W+")).alias("word")).distinct()
    known = ["e", "##e", "##n", "en", "##ti", "th", "##he"]
    rows = vocab.wordpiece_of_words(words, known).collect()
    assert len(rows) > 5000 and all(r.pieces == vocab.greedy_pieces(r.word, set(known)) for r in rows)
