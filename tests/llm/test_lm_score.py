import math
import os
import zlib
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pytest

from assayer.llm import lm_score
from assayer.llm.lm_score import EDGE, ORDER


class Plain:
    """The model as its definition says, with dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(Counter)
        for t in texts:
            s = [EDGE] * ORDER + list(t) + [EDGE]
            for k in range(ORDER, len(s)):
                for n in range(ORDER + 1):
                    self.counts[tuple(s[k - n : k])][s[k]] += 1
        total = sum(self.counts[()].values())
        self.nodes = {c for c, n in self.counts.items() if sum(n.values()) >= max(1, total * lm_score.NODE_SHARE)}

    def log(self, context, symbol):
        longest = next((context[len(context) - n :] for n in range(ORDER, -1, -1) if context[len(context) - n :] in self.nodes), ())
        excluded, left = set(), 1.0
        for n in range(len(longest), -1, -1):
            held = {s: c for s, c in self.counts[longest[len(longest) - n :]].items() if s not in excluded}
            whole = sum(held.values()) + len(held)
            if symbol in held:
                return math.log10(left * held[symbol] / whole)
            left *= len(held) / whole if held else 1
            excluded |= held.keys()
        return math.log10(left / (EDGE + 1 - len(excluded)))

    def score(self, t):
        s = [EDGE] * ORDER + list(t) + [EDGE]
        return sum(self.log(tuple(s[k - ORDER : k]), s[k]) for k in range(ORDER, len(s)))


def test_against_brute_force(docs, documents):
    got = sorted(map(tuple, lm_score.score(docs).collect()))
    out = [zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in documents]
    texts = [(r[1] or "").encode().lower() for r in documents]
    train = [t for t, h in zip(texts, out) if not h]
    words = Counter(w for t in train for w in t.split())
    total, distinct = sum(words.values()) + len(train), len(words) + 1
    log = lambda c: math.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))
    plain = Plain(train)
    want = sorted((r[0], h, len(t.split()) + 1, sum(words[w] > 0 for w in t.split()) + 1, total, sum(log(words[w]) for w in t.split()) + log(len(train)), plain.score(t)) for r, h, t in zip(documents, out, texts))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-4, abs=1e-3)


def test_chances_sum_to_one():
    model = lm_score.Model(counts([b"abracadabra", b"banana"]))
    seen = np.exp(model.table[:, :-1] * np.log(10)).sum(1)
    unseen = np.exp(model.table[:, -1] * np.log(10)) * (EDGE + 1 - (model.size - 1))
    assert seen + unseen == pytest.approx(1, abs=1e-5)


def counts(texts):
    code, n = lm_score.grams(texts)
    out = []
    for k in range(ORDER + 1):
        own, where = np.unique(code & ((1 << (9 * (k + 1))) - 1), return_inverse=True)
        out.append((own, np.bincount(where, weights=n).astype(np.int64)))
    return out


def test_without_training_rows(spark):
    df = spark.createDataFrame([(None, "ab"), (None, None)], "doc_id long, text string")
    rows = lm_score.score(df).collect()
    assert sorted(round(r["score"], 4) for r in rows) == [round(-3 * math.log10(257), 4), round(-math.log10(257), 4)]
    assert {r["n_known"] for r in rows} == {0} and {r["train_tokens"] for r in rows} == {0}


def test_empty_table(no_docs):
    assert lm_score.score(no_docs).collect() == []


def test_rare_contexts_are_kept(spark):
    """Past 2^18 symbols, a context that training met twice still predicts."""
    rng = np.random.default_rng(5)
    noise = ["".join(chr(97 + c) for c in rng.integers(0, 26, 2000)) for _ in range(400)]
    docs = [(k, t) for k, t in enumerate(noise)] + [(1000 + k, "#zq!%x@") for k in range(8)]
    out = [zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in docs]
    train = [t.encode() for (_, t), h in zip(docs, out) if not h]
    assert sum(map(len, train)) > 2 * 2**18
    got = {r["doc_id"]: r["score"] for r in lm_score.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    plain = Plain(train)
    plain.nodes = plain.counts.keys()
    for key, text in [*docs[:3], *docs[-2:]]:
        assert got[key] == pytest.approx(plain.score(text.encode()), rel=1e-4)


def test_what_is_shuffled_is_squeezed():
    rng = np.random.default_rng(3)
    code = np.unique(rng.integers(0, 2**54, 20_000))
    first = np.array([0, 7000, 7001])
    held = lm_score._packed(lm_score._steps(code, first), np.append(first, len(code))).to_pylist()
    parts = [np.cumsum(lm_score.widened(x, n, np.int64)) for x, n in zip(held, np.diff(np.append(first, len(code))), strict=True)]
    assert np.array_equal(np.concatenate(parts), code)
    assert sum(map(len, held)) < 0.85 * code.nbytes  # made-up codes are far apart, which real ones aren't
    logs = np.log10(rng.integers(1, 9, 5000) / 9).astype(np.float32)
    assert np.array_equal(lm_score.widened(lm_score.squeezed(logs), len(logs), np.float32), logs) and len(lm_score.squeezed(logs)) < logs.nbytes / 2
    assert lm_score.widened(lm_score.squeezed(code[:0]), 0, np.int64).size == 0


def test_texts_travel_in_compressed_bundles(spark):
    records = [(None, False, b""), (7, True, "ü 日本 ".encode() * 500), (2**40, False, b"\0 bytes " * 3000)]
    held = lm_score.bundled(records)
    assert list(zip(*lm_score.unbundled(held), strict=True)) == records
    assert len(held) < sum(len(t) for _, _, t in records) / 10


def test_counted_texts_are_dropped_once_scored(docs, monkeypatch):
    """What is left in the shared folder are the words and the scores."""
    tables = []
    monkeypatch.setattr(lm_score, "stored", lambda df, own=lm_score.stored: tables.append(own(df)) or tables[-1])
    out = lm_score.score(docs)
    counted = [t for t in tables if "grams" in t.columns]
    files = [urlparse(f).path for t in counted for f in t.inputFiles()]
    assert counted and not any(map(os.path.exists, files))
    assert out.count() == docs.count()
