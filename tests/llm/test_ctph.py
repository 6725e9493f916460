import hashlib
import random
import time

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.llm import ctph


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40))
def test_likeness_is_by_edit_distance(a, b):
    got = ctph._alike(a, b)
    k = min(ctph.COMMON, len(a), len(b))
    common = k and any(a[i : i + k] in b for i in range(len(a) - k + 1))
    assert got == (1.0 if a == b else 2 * lcs(a, b) / (len(a) + len(b)) if common else 0.0)


def slow(text):
    """The fingerprint by its definition, a byte at a time."""
    mask = (1 << 64) - 1
    spread = [int(x) for x in ctph._SPREAD]
    rolled = []
    for k in range(len(text)):
        h = sum(spread[text[k - j]] * pow(0x100000001B3, j, 1 << 64) for j in range(ctph.WINDOW) if k - j >= 0) & mask
        rolled.append(((h ^ h >> 29) * int(ctph._M)) & mask)

    def signature(block):
        totals, total = [], 0
        for k, r in enumerate(rolled):
            total = (total + (r ^ r >> 32)) & mask
            if (r >> 20) & (block - 1) == 0 or k == len(rolled) - 1:
                totals.append(total)
                total = 0
        if len(totals) > 64:
            totals = totals[:63] + [sum(totals[63:]) & mask]
        return "".join(ctph.ALPHABET[((t * int(ctph._M)) & mask) >> 58] for t in totals)

    block = ctph.LEAST_BLOCK
    while block * ctph.PIECES < len(text):
        block *= 2
    while len(signature(block)) < ctph.PIECES // 2 and block > ctph.LEAST_BLOCK:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}" if text else "0::"


def test_fingerprint_by_hand():
    rng = random.Random(4)
    for n in (0, 1, 5, 8, 100, 3000):
        text = bytes(rng.randrange(256) for _ in range(n))
        assert ctph.fingerprint(text) == slow(text)
    for text in (b" " * 3000, b"0123456789" * 500, b"ab\n" * 700 + b"end"):
        assert ctph.fingerprint(text) == slow(text) and len(ctph.fingerprint(text)) < 140


def test_texts_that_repeat_themselves():
    """A megabyte of a short period has a bounded fingerprint, compared at once."""
    prints = [ctph.fingerprint(t[: 10**6]) for t in (b" " * 10**6, b"0123456789" * 10**5, b"\n\t" * 500_000, bytes(range(256)) * 4000)]
    began = time.perf_counter()
    assert all(len(p) < 140 for p in prints) and all(0 <= ctph.likeness(a, b) <= 1 for a in prints for b in prints)
    assert time.perf_counter() - began < 1


def test_every_successor(spark):
    """Repeated ids, null ids, the least id, equal rows and clashing names, against a sorted list."""
    rng = random.Random(6)
    ids = [None, None, -(2**63), -(2**63), 2**63 - 1, -1, 0, *[7] * 40, *range(20)]
    rows = [(i, rng.choice([None, "", "é", *(f"text number {k} " * k for k in range(30))])) for i in ids] + [(7, "alike")] * 5
    key = lambda r: (r[0] is None, -(r[0] or 0), (h := xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)) - (h >> 63 << 64))
    order = sorted(rows, key=key)
    want = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        new = ctph.edited(text, after).encode()
        print_ = ctph.fingerprint(text.encode())
        want.append((i, len(text), hashlib.sha256(new).hexdigest(), print_, ctph.fingerprint(new), round(ctph.likeness(print_, ctph.fingerprint(new)), 6), round(ctph.likeness(print_, ctph.fingerprint(after.encode())), 6)))
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], "doc_id long, text string, key string, target int, ghost string").repartition(5)
    assert sorted(map(str, map(tuple, ctph.fingerprints(df).collect()))) == sorted(map(str, want))


def test_documents(docs, documents):
    rows = {}
    for r in ctph.fingerprints(docs).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, rows.values())) == len(documents)
    # Ids that stand once are enough to hold every successor but the repeated row's.
    texts = {r[0]: r[1] or "" for r in documents}
    order = sorted(texts, reverse=True)
    for k, key in enumerate(order):
        follower = order[(k + 1) % len(order)]
        for r in rows[key][-1:] if len(rows[key]) == 1 else ():
            new = ctph.edited(texts[key], texts[follower])
            print_, mark = ctph.fingerprint(texts[key].encode()), ctph.fingerprint(new.encode())
            assert (r["n_chars"], r["fingerprint"], r["edited_fingerprint"]) == (len(texts[key]), print_, mark)
            assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            assert r["near_edited"] == round(ctph.likeness(print_, mark), 6)
            assert r["near_next"] == round(ctph.likeness(print_, ctph.fingerprint(texts[follower].encode())), 6)


def test_single_row_and_empty_table(spark, no_docs):
    one = spark.createDataFrame([(None, None)], "doc_id long, text string")
    (row,) = ctph.fingerprints(one).collect()
    assert (row["doc_id"], row["n_chars"], row["fingerprint"], row["near_edited"], row["near_next"]) == (None, 0, "0::", 1.0, 1.0)
    assert ctph.fingerprints(no_docs).collect() == []


def test_an_edit_leaves_likeness():
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(500)).encode()
    a = ctph.fingerprint(text)
    assert ctph.likeness(a, ctph.fingerprint(text[:1000] + b"changed" + text[1007:])) > 0.9
    assert ctph.likeness(a, ctph.fingerprint(text[::-1])) == 0
