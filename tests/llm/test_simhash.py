import random

import numpy as np
import pytest
import xxhash

from assayer.llm import simhash
from assayer.llm.components import components


def slow(text):
    words = text.lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in linked:
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_documents(docs, documents):
    got = {}
    for r in simhash.near_duplicates(docs).collect():
        got.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    rows = sorted((r[0], slow((r[1] or "").encode())) for r in documents)
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (rows[i][1] ^ rows[j][1]).bit_count() <= 2])
    assert got == {k: {(f"{p:016x}", rows[root[i]][0])} for i, (k, p) in enumerate(rows)}


def some_prints(n, seed, spread=4):
    """Fingerprints in groups around common ones, and some far from all."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, max(1, n // 12), dtype=np.uint64)
    flips = [sum(1 << int(k) for k in set(rng.integers(0, 64, rng.integers(0, spread)).tolist())) for _ in range(n)]
    return np.unique([int(b) ^ f for b, f in zip(np.repeat(base, 14)[:n], flips, strict=False)]).astype(np.uint64)


def wanted_groups(prints):
    near = np.bitwise_count(prints[:, None] ^ prints[None]) <= 2
    return roots(len(prints), [(int(i), int(j)) for i, j in zip(*np.nonzero(near), strict=True) if i > j])


@pytest.mark.parametrize("n", [1, 2, 63, 65, 900])
def test_range(n):
    prints = some_prints(n, n)
    ordered = prints[np.argsort(simhash.gray_rank(prints))]
    groups = simhash.Range([ordered[k : k + 64] for k in range(0, len(ordered), 64)], 2).groups
    got = [groups.top(int(p)) for p in prints]
    want = wanted_groups(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_tree_prunes_only_what_is_far():
    rng = np.random.default_rng(3)
    v = np.sort(rng.integers(0, 2**63, 64 * 300, dtype=np.uint64))
    v = v[np.argsort(simhash.gray_rank(v))]
    leaves = v.reshape(-1, 64)
    tree = simhash.Tree(np.bitwise_and.reduce(leaves, 1), np.bitwise_or.reduce(leaves, 1))
    assert len(tree.own) == 2 and not any(int(a & b) for a, b in zip(tree.own[0], np.repeat(tree.own[1], 64), strict=False))
    for k in rng.integers(0, len(v), 40).tolist():
        asked = int(v[k]) ^ (1 << 60) ^ (1 << 3)
        found = set(tree.near(np.uint64(asked), np.uint64(2**64 - 1), 2).tolist())
        assert {int(x) // 64 for x in np.flatnonzero(np.bitwise_count(v ^ np.uint64(asked)) <= 2)} <= found
        assert len(found) < 150


@pytest.mark.parametrize("size", [40, 16_384])
def test_ranges_and_tree_find_every_link(spark, monkeypatch, size):
    """Many small ranges, whose leaves meet across tasks, and one; a group of over a thousand near fingerprints."""
    monkeypatch.setattr(simhash, "RANGE", size)
    base = 0x0F0F_1234_5678_9ABC
    hot = [base ^ (1 << a) ^ (1 << b) for a in range(45) for b in range(a)]
    prints = np.unique(np.concatenate([some_prints(1500, 8), np.array(hot, np.uint64)]))
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(3)
    got = {r["print"] & 2**64 - 1: r["root"] for r in simhash.clusters(df).collect()}
    want = wanted_groups(prints)
    named = [got.get(int(p), ("alone", int(p))) for p in prints]
    assert len(set(zip(named, want, strict=True))) == len(set(named)) == len(set(want))


def test_hot_and_equal_fingerprints(spark):
    """A fingerprint that most rows have, texts without words, null ids and a column of another operator's name."""
    rows = [(k, "one common text of words", "x") for k in range(3000)] + [(5000, None, "x"), (5001, "", "x"), (None, "one common text of words", "x"), (9000, "quite another text stands here alone", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rows string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert {r["component_id"] for r in got if r["doc_id"] is None or r["doc_id"] < 3000} == {0}
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None and r["doc_id"] >= 5000} == {5000: 5000, 5001: 5000, 9000: 9000}


def test_very_long_text(spark):
    text = " ".join(f"w{k % 977}" for k in range(60_000)) + " " + "x" * 30_000
    df = spark.createDataFrame([(1, text), (2, text + "!"), (3, "y" * 40_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_gray_rank_orders_neighbours_one_bit_apart():
    v = np.arange(1024, dtype=np.uint64)
    ordered = v[np.argsort(simhash.gray_rank(v))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_long_chains(spark):
    chain = list(range(200))
    random.Random(2).shuffle(chain)
    edges = [(chain[k], chain[k + 1]) for k in range(199)] + [(1000, 1001), (5, 5)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(200), 0) | {1000: 1000, 1001: 1000}


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
