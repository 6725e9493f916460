import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from assayer.llm import language_id
from assayer.llm.common import held_out


def test_held_out_accuracy(docs, documents):
    coder = language_id.train(docs.filter(~held_out("doc_id", 4, 2)))
    assert coder.langs == ["de", "en", "fr"]
    rows = language_id.identify(docs, coder).select("doc_id", "lang", "lang_pred", "score", "id").collect()
    assert len(rows) == len(documents) and {r["id"] for r in rows} == {"extra"}
    out = [r for r in rows if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert out and all(r["lang_pred"] == r["lang"] for r in out)
    odd = {r["doc_id"]: r for r in rows if r["doc_id"] >= 1000}
    assert all((odd[1000 + k]["lang_pred"] == "und") == (k in (0, 1, 2, 3, 4)) for k in range(13))
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_features_by_hand():
    (row,) = language_id.features([b"Ab"])
    padded = b"  ab"
    slot = lambda code: ((code * int(language_id._MULTIPLIER)) >> 15) & (language_id.FEATURES - 1)
    want = np.zeros(language_id.FEATURES, int)
    for k in range(2, 4):
        want[slot(padded[k - 2] << 16 | padded[k - 1] << 8 | padded[k])] += 1
        want[slot((padded[k - 1] << 8 | padded[k]) + (1 << 24))] += 1
    assert row.tolist() == want.tolist()


def test_texts_do_not_bear_on_each_other():
    texts = [b"abc", b"", b"zz top", b"\xc3\xbc", b"q"]
    together = language_id.features(texts)
    assert all((together[k] == language_id.features([t])[0]).all() for k, t in enumerate(texts))


def slow_grams(text):
    """n-gram slots of a text, one letter at a time."""
    fold = lambda b: b if b >= 128 or chr(b).islower() else b + 32 if chr(b).isupper() else 32
    padded = [32, 32, *map(fold, text)]
    slot = lambda code: ((code * int(language_id._MULTIPLIER)) >> 15) % language_id.FEATURES
    out = Counter()
    for a, b, c in zip(padded, padded[1:], padded[2:]):
        if (a, b, c) != (32, 32, 32):
            out[slot(a << 16 | b << 8 | c)] += 1
            if (b, c) != (32, 32):
                out[slot((b << 8 | c) + (1 << 24))] += 1
    return out


def slow_predictions(rows, texts):
    """Training on (text, language) and prediction by loops: weights, margins, weighted losses."""
    f, langs = language_id.FEATURES, sorted({lang for _, lang in rows})
    sums = {lang: Counter() for lang in langs}
    for t, lang in rows:
        sums[lang].update(slow_grams(t))
    share = {lang: [(sums[lang][k] + 0.5) / (sum(sums[lang].values()) + 0.5 * f) for k in range(f)] for lang in langs}
    bits = [(1, *c) for c in itertools.product((1, -1), repeat=len(langs) - 1) if -1 in c]
    weights, scale, trust = [], [], []
    for bit in bits:
        mean = {s: [sum(share[lang][k] for lang, b in zip(langs, bit) if b == s) / bit.count(s) for k in range(f)] for s in (1, -1)}
        weights.append([math.log(a) - math.log(b) for a, b in zip(mean[1], mean[-1])])
        margins = [b * sum(x * w for x, w in zip(share[lang], weights[-1])) for lang, b in zip(langs, bit)]
        scale.append(max(sum(margins) / len(margins), 1e-9))
        trust.append(max(min(margins) / scale[-1], 1e-3))
    out = []
    for t in texts:
        grams = slow_grams(t)
        n = max(1, sum(grams.values()))
        signal = [sum(c * w[k] for k, c in grams.items()) / n / s for w, s in zip(weights, scale)]
        loss = [sum(tr / sum(trust) * math.log1p(math.exp(-4.0 * x * bit[k])) for tr, x, bit in zip(trust, signal, bits)) for k in range(len(langs))]
        low = min(loss)
        score = 1 / sum(math.exp(-4.0 * (x - low)) for x in loss)
        out.append((langs[loss.index(low)], score, sorted(loss)[1] - low))
    return out


def test_decoding_against_brute_force(spark, documents):
    rng = random.Random(8)
    known = [(r[1].encode(), r[2]) for r in documents if r[1] and r[2]][:40] + [(b"ko ka ku ki tama neko " * 5, "zz")]
    letters = "the der le ka \u00fc \u00e9 ing sch".split()
    texts = [r[1].encode() for r in documents[40:60] if r[1]] + [" ".join(rng.choice(letters) for _ in range(rng.randint(1, 9))).encode() for _ in range(60)]
    coder = language_id.train(spark.createDataFrame([(bytearray(t).decode(), lang) for t, lang in known], "text string, lang string"))
    ambiguous = 0
    for t, (lang, score, flag), (slow_lang, slow_score, gap) in zip(texts, coder.predict(texts), slow_predictions(known, texts), strict=True):
        assert score == pytest.approx(slow_score, abs=2e-6)
        assert lang == slow_lang or gap < 1e-9
        assert flag == (gap < language_id.AMBIGUOUS) or abs(gap - language_id.AMBIGUOUS) < 1e-9
        ambiguous += flag
    assert 0 < ambiguous < len(texts)


def test_a_planted_tie_is_flagged():
    counts = np.zeros((3, language_id.FEATURES))
    for k, t in enumerate((b"aaaa aaaa", b"aaaa aaaa", b"zzzz zzzz")):
        counts[k] = language_id.features([t])[0]
    coder = language_id.Coder(["one", "two", "zed"], counts)
    (tied, clear) = coder.predict([b"aaaa", b"zzzz"])
    assert tied[0] == "one" and tied[2] and tied[1] == pytest.approx(0.5, abs=0.01)
    assert clear[0] == "zed" and not clear[2]


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, "the and " * 20_000, "en", "b", "p"), (2, "\u00fc" * 50_000, "de", "b", "p"), (3, None, None, "b", "p"), (4, "", None, "b", "p"), (4, "", None, "b", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, bytes string, lang_pred string")
    got = sorted((r["doc_id"], r["lang_pred"], r["bytes"]) for r in language_id.identify(df, language_id.train(df)).collect())
    assert got == [(1, "en", "b"), (2, "de", "b"), (3, "und", "b"), (4, "und", "b"), (4, "und", "b")]


def test_codewords_differ():
    for n in (2, 3, 4, 6, 7, 30, 120):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2 + 10**6 * np.eye(n)
        assert apart.min() >= max(1, code.shape[1] // 5)


def test_few_languages(spark):
    df = spark.createDataFrame([(1, "abc", "en"), (2, None, None), (3, "...", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language_id.identify(df, language_id.train(df)).collect()] == ["en", "und", "und"]
    none = language_id.train(df.limit(0))
    assert {r["lang_pred"] for r in language_id.identify(df, none).collect()} == {"und"}
    assert language_id.identify(df.limit(0), none).collect() == []
