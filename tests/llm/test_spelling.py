import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from assayer.llm import spelling


def slow_words(rows, least, count, modulus):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run if h % modulus else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= least and n >= count}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def slow_groups(vocabulary, factor):
    forms, out = {}, []
    near = {w: [v for v in vocabulary if is_near(v, w)] for w in vocabulary}
    for w, n in vocabulary.items():
        best = min(near[w], key=lambda v: (-vocabulary[v], v), default=None)
        forms[w] = best if best is not None and vocabulary[best] >= factor * n else None
    for w, n in vocabulary.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n, len(near[w]), forms[w] and vocabulary[forms[w]]))
    return sorted(out)


def misspelt(rng, word):
    k = rng.randrange(len(word))
    return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("aeéÿ") + word[k:], word[:k] + rng.choice("aeéÿ") + word[k + 1 :]])


def made(seed):
    """Texts over words with variants, variants of variants, runs of one letter, words beyond LONG, and odd rows."""
    rng = random.Random(seed)
    pool = ["banana", "aaaaaa", "aaaaaaa", "Élévation", "colour", "×÷ABCdef", "q" * 90, "ab" * 40, "x" * spelling.LONG, "x" * (spelling.LONG + 1)]
    for _ in range(60):
        pool.append(misspelt(rng, rng.choice(pool)))
    weights = [rng.choice([1, 1, 6, 40, 250]) for _ in pool]
    rows = [(k, rng.choice([" ", ", ", "1"]).join(rng.choices(pool, weights, k=rng.randint(0, 90)))) for k in range(120)]
    return rows + [(None, "banana banana"), (-5, None), (6, ""), (7, "BANANA 日本 😀 banana" * 3), *rows[:4]]


@pytest.mark.parametrize(("seed", "least", "count", "factor", "modulus"), [(1, 6, 5, 5, 199), (2, 5, 1, 2, 3), (3, 6, 2, 5, 7)])
def test_against_all_pairs(spark, seed, least, count, factor, modulus):
    rows = made(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    words = spelling.words(df, least_length=least, least_count=count, modulus=modulus)
    want = slow_words(rows, least, count, modulus)
    assert {r["word"]: r["n"] for r in words.collect()} == want
    got = spelling.group(words, least, factor).collect()
    assert sorted(map(tuple, got)) == slow_groups(want, factor)
    assert any(r["root"] != r["form"] is not None for r in got) or factor == 5


def test_chains_of_forms(spark):
    """Each step is five times as frequent; twelve steps take four rounds of pointers."""
    words = {"w" * 6 + "abcdefghijklm"[:k]: 5 ** (13 - k) for k in range(13)}
    got = spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert {r["root"] for r in got} == {"wwwwww"}
    assert sorted(map(tuple, got)) == slow_groups(words, 5)


def test_ties_and_full_groups(spark):
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    words = {f"{c}zzzzz": 9 for c in letters} | {"zzzzz" + c: 9 for c in "éÿ"} | {"mzzzzzm": 1}
    got = spelling.group(spark.createDataFrame(list(words.items()), "word string, n long")).collect()
    assert sorted(map(tuple, got)) == slow_groups(words, 5)
    assert {r["form"] for r in got if r["word"] == "mzzzzzm"} == {"mzzzzz"}


def test_very_long_word(spark):
    long = "".join(random.Random(1).choices("abcdef", k=30_000))
    df = spark.createDataFrame([(1, " ".join([long] * 40)), (2, " ".join([long[:777] + "é" + long[778:]] * 6)), (3, " ".join([long[:9] + long[10:]] * 7))], "doc_id long, text string")
    got = {len(r["word"]): r for r in spelling.group(spelling.words(df)).filter("form is not null").collect()}
    assert {r["form"] == long for r in got.values()} == {True} and set(got) == {30_000, 29_999}


def test_twin(spark):
    rows = [(k, t) for k, (_, t) in enumerate(made(4))]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(spelling.twin()).fetchall()
    got = spelling.group(spelling.words(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_empty_table(spark, no_docs):
    assert spelling.group(spelling.words(no_docs)).collect() == []
    assert spelling.group(spark.createDataFrame([], "word string, n long")).collect() == []
