import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from assayer.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(text):
    return np.array([*packing.tokenizer(PATH).encode(text or "", add_special_tokens=False).ids, 2], "<u4")


@pytest.mark.parametrize("window", [4096, 64])
def test_pieces(docs, documents, window):
    got = packing.pack(docs, PATH, window=window, with_ids=True).collect()
    wanted = defaultdict(list)
    for r in documents:
        wanted[r[0]].append(whole(r[1]))
    covered, sequences = defaultdict(int), defaultdict(list)
    for r in got:
        ids = wanted[r["doc_id"]][0]
        assert r["doc_tokens"] == len(ids)
        piece = ids[r["start"] : r["start"] + r["length"]]
        assert piece.tolist() == r["ids"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and len(piece) == r["length"] > 0
        covered[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == {k: sum(map(len, v)) for k, v in wanted.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0  # nothing is padded


@pytest.mark.parametrize("text", ["Don't stop, it's 3.5% of (x)...", "a.b,c", "ÉTÉ œuvre×2 ÷ÿ", "ΑΣ σΣ İstanbul i̇", "x\x1cy z\tw q　r", "<|endoftext|> a<|STARTOFTEXT|>b", "¡Hola! ¿qué?—“q”", "é combining é́", "", "   ", "word.,' 's 'S it'S", "ﬁ ﬀ ǅ ß SS", "a b\u0085c.\n\n.d", "😀 emoji👍🏽x"])
def test_words_apart_are_encoded_alike(text):
    (raw,) = packing.encode([text], PATH, "H")
    assert np.frombuffer(raw, "H").tolist() == packing.tokenizer(PATH).encode(text, add_special_tokens=False).ids


def test_neighbours_are_ranked_by_bm25():
    rng = np.random.default_rng(0)
    tokens = [rng.integers(0, 40, rng.integers(5, 60)) for _ in range(30)]
    df = np.bincount(np.concatenate([np.unique(t) for t in tokens]), minlength=40)
    idf, mean = np.log1p((30 - df + 0.5) / (df + 0.5)), np.mean([len(t) for t in tokens])
    shard = packing.Shard(tokens, idf, mean)
    weight = lambda t, d: idf[t] * (tf := (tokens[d] == t).sum()) * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.SLOPE + packing.SLOPE * len(tokens[d]) / mean))
    shard.used[[3, 7]] = True
    terms = sorted(set(tokens[0].tolist()), key=lambda t: (-weight(t, 0), t))[: packing.QUERY_TERMS]
    best = sorted((d for d in range(30) if d not in (3, 7)), key=lambda d: (-np.float32(sum(weight(t, d) for t in terms)), d))
    assert shard.neighbours(0)[:10].tolist() == best[:10]


def test_copies_are_packed_together():
    windows = packing.Windows(64, 0, False)
    rng = np.random.default_rng(1)
    tokens = [rng.integers(0, 500, 32) for _ in range(10)]
    docs = [(k, t) for k, t in enumerate(tokens)] + [(100 + k, t) for k, t in enumerate(tokens)]
    packing.fill(windows, docs, np.ones(500), 32.0)
    pairs = defaultdict(set)
    for piece in windows.made:
        pairs[piece[5]].add(piece[0] % 100)
    assert all(len(p) == 1 for p in pairs.values())


def test_documents_of_like_tokens_have_the_same_place():
    rng, draws = np.random.default_rng(2), packing.chances(2000)
    same = 0
    for _ in range(400):
        one = np.unique(rng.integers(0, 2000, 200))
        other = np.unique(np.concatenate([one[: len(one) * 9 // 10], rng.integers(0, 2000, 20)]))
        a, b = packing.place(one, draws), packing.place(other, draws)
        same += a >> 32 == b >> 32
        assert a == packing.place(one, draws)
    assert same > 280  # weighted Jaccard similarities of some 0.82


def test_many_shards_long_texts_and_clashing_columns(spark, monkeypatch):
    """Each id of each text once, however many shards and tasks; one text far longer than a window, one without a space."""
    monkeypatch.setattr(packing, "TASK_TOKENS", 4000)
    monkeypatch.setattr(packing, "SHARD_TOKENS", 500)
    texts = ["some words " * (k % 40) for k in range(120)] + ["many other words " * 8000, "x" * 30_000, None, ""]
    rows = [(k if k % 7 else None, t, 1, "p") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, place string").repartition(5)
    got = packing.pack(df, PATH, window=64).collect()
    total = defaultdict(int)
    for r in got:
        total[r["doc_id"]] += r["length"]
    want = defaultdict(int)
    for k, t, *_ in rows:
        want[k] += len(whole(t))
    assert total == want and len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_empty_table(no_docs):
    assert packing.pack(no_docs, PATH).collect() == []
