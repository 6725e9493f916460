import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import suffix_dedup
from assayer.llm.suffix_sort import suffix_order


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.integers(1, 70))
def test_suffix_order(values, depth):
    order = suffix_order(np.array(values, np.int64), depth).tolist()
    assert sorted(order) == list(range(len(values)))
    prefixes = [values[i : i + depth] for i in order]
    assert prefixes == sorted(prefixes)


def brute(texts, length):
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, most", [(200, 48, 2000), (200, 48, 1), (40, 10, 2000), (40, 40, 2), (12, 3, 5)])
def test_against_brute_force(docs, documents, length, gram, most):
    got = suffix_dedup.cut_repeats(docs, length=length, gram=gram, most=most).collect()
    assert all(sum(b - a for a, b in r["spans"]) == r["n_removed"] and len(r["spans"]) == r["n_spans"] for r in got)
    want = brute([(r[1] or "").encode() for r in documents], length)
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted((d[0], *w) for d, w in zip(documents, want, strict=True))


@pytest.mark.parametrize("share", [1, 2])
def test_small_batches_and_hot_names(spark, docs, documents, monkeypatch, share):
    names = lambda t: suffix_dedup.anchors(t, 30, 8)[0]
    every = np.unique(np.concatenate([names(r[1].encode()) for r in documents if r[1] and len(r[1].encode()) >= 30]))
    monkeypatch.setattr(suffix_dedup, "hot_names", lambda *_: every[every % 2 < share])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = suffix_dedup.cut_repeats(docs, length=30, gram=8, most=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute([(r[1] or "").encode() for r in documents], 30)
    assert sorted((r["doc_id"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((d[0], w[1], w[3]) for d, w in zip(documents, want, strict=True))


def test_empty_table(no_docs):
    assert suffix_dedup.cut_repeats(no_docs).collect() == []


def test_anchors_are_shared():
    rng = random.Random(3)
    middle = bytes(rng.choice(b"abc ") for _ in range(200))
    one, two = b"x" * 77 + middle, b"yz" * 100 + middle + b"tail" * 50
    (_, _, _, p1, f1, l1), (_, _, _, p2, f2, l2) = suffix_dedup.anchors(one), suffix_dedup.anchors(two)
    at = lambda f, l, p, s: next(int(p[k]) for k in range(len(p)) if f[k] <= s <= l[k])  # noqa: E731, E741
    assert at(f1, l1, p1, 77) - 77 == at(f2, l2, p2, 200) - 200


def test_neighbours_are_compared_by_their_bytes(monkeypatch):
    """With a hash that says that all strings are equal, the result is that of the bytes."""
    rng = random.Random(5)
    blocks = [bytes(rng.choice(b"ab") for _ in range(60)) for _ in range(20)] + [b"ab" * 30]
    seen = Counter(b[k : k + 12] for b in blocks for k in range(len(b) - 11))
    monkeypatch.setattr(suffix_dedup, "window_hashes", lambda text, *sizes: [np.zeros(len(text) - n + 1, np.uint64) for n in sizes])
    got = suffix_dedup.repeats(blocks, 12)
    assert [g.tolist() for g in got] == [[seen[b[k : k + 12]] > 1 for k in range(len(b) - 11)] for b in blocks]


def test_long_texts_null_ids_and_clashing_columns(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(70_000))
    texts = [long, "x" * 40_000, long[30_000:31_000] + "tail", long, None, "", "x" * 199, "x" * 200]
    ids = [1, 2, 3, None, None, 5, 6, 7]
    rows = [(i, t, 1, 2, "c") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, check int, size string").repartition(4)
    got = suffix_dedup.cut_repeats(df).collect()
    want = brute([(t or "").encode() for t in texts], 200)
    order = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=order)
