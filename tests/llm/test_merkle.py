import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import merkle


def h(x):
    return sha256(x.encode()).hexdigest()


def leaf_of(*fields):
    return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(nodes):
    """The root of a list of nodes, and each one's siblings by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(nodes)))
            proofs[k].append(("".join(nodes[j] for j in run if j < i), "".join(nodes[j] for j in run if j > i)))
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], proofs


def brute(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups, out, subroots = {}, [], []
    for d, s, lang, n, t in rows:
        groups.setdefault(s, []).append((d is not None, d or 0, leaf_of(d, s, lang, n, t), (d, s, lang, n, t)))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        leaves = sorted(groups[s], key=lambda x: x[:3])
        top, proofs = climb([x[2] for x in leaves])
        subroots.append(top)
        out.append((leaves, proofs))
    root, above = climb(subroots)
    found = []
    for (leaves, proofs), up, top in zip(out, above, subroots):
        for x, proof in zip(leaves, proofs):
            d, s, lang, n, t = x[3]
            if d is not None and zlib.crc32(str(d).encode()) % 2 == 0 and t is not None:
                t = t.replace("\n", "")
            node = leaf_of(d, s, lang, n, t)
            for a, b in proof + up:
                node = h(a + node + b)
            found.append((d, x[2], top, root, h("".join(a + b for a, b in proof + up)), node, node == root))
    return sorted(found, key=str)


def run(spark, rows, tmp_path):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op12_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted([tuple(r) for r in got.collect()], key=str)


def test_brute_force(spark, tmp_path):
    """A source of several buckets, sources of each small size, null and empty ones, repeated rows, null ids, lone leaves."""
    r = random.Random(1)
    rows = [(i, "big", "en", i, f"text {i}" + "\n" * (i % 3)) for i in range(5000)]
    for size in range(1, 11):
        rows += [(10_000 + 100 * size + i, f"s{size}é", None, None, "a\nb" if i % 2 else None) for i in range(size)]
    rows += [(1, None, "en", 1, "x"), (2, "", "en", 1, ""), (2, "", "en", 1, ""), (None, "", None, None, None), (None, None, "de", 5, "a\n"), (3, "😀", "en", 1, "\n"), (3, "￿", "en", 1, "\n")]
    r.shuffle(rows)
    assert run(spark, rows, tmp_path) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(4, "a", "en", 1, "one\n")], [(4, None, None, None, None)], [(i, "a", "en", 1, "t") for i in range(4)]])
def test_small_tables(spark, rows, tmp_path):
    assert run(spark, rows, tmp_path) == (brute(rows) if rows else [])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_levels(n):
    """The SQL of a bucket gives the same nodes and siblings as a walk."""
    import duckdb
    import pyarrow as pa

    names = [h(str(i)) for i in range(n)]
    nodes = pa.table({"pos": pa.array(range(n), pa.int64()), "node": names})
    with duckdb.connect() as db:
        db.register("nodes", nodes)
        got = db.sql(merkle.bucket_levels(merkle.height_of(n))).fetchall()
    top, proofs = climb(names)
    assert [(list((p["before"], p["after"]) for p in proof), t) for proof, t in got] == [(p, top) for p in proofs]


def test_odd_rows(odd, odd_rows, none):
    found = merkle.manifest(odd.withColumn("leaf", merkle.leaf()))
    assert found.columns == [*odd.columns, "leaf", "subroot", "root", "proof"] and found.count() == len(odd_rows)
    assert found.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    assert merkle.manifest(none.withColumn("leaf", merkle.leaf())).count() == 0
