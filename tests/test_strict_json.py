import json
import random

import pytest
from pyspark.sql import functions as F

from assayer.functions import strict_json

BY_HAND = ['{}', '[]', '""', '0', 'null', ' [1, -0.5e+3, "a\\n\\u00e9"]\n', '{"a":{"b":[{}]},"a":2}', '', ' ', '01', '+1', '1.', '.5', '1e', 'nul', 'NaN', '-Infinity', '[1,]', '[,1]', '{"a":1,}', '{"a"}', '{"a":}', '{a:1}', "{'a':1}", '[1}', '{"a":1]', '[[1]', '[1]]', '1 2', '[1] x', '"a', 'a"', '"\\"', '"\\\\"', '"\\x"', '"\\u12g4"', '"a\tb"', '\\"a"', '"a"\\', '{"a":1 "b":2}', '{"a":"b":"c"}', '[1:2]', '{"a","b"}', '{1:2}', '{[]:1}', '["a""b"]', '[1 2]', 'true', '[true,false,null]', '﻿1', '"é "', '{"a":[1,{"b":[]}],"c":"]}"}', '//x', '[]{}', ',', ':', '}{', '][', '""""', '\f1', '\x001', '[\xa01]', '{"":""}']


def slow(text, deepest=strict_json.DEEPEST):
    """By the standard library, with the depth counted bracket by bracket."""
    def refuse(name):
        raise ValueError(name)
    try:
        json.loads(text, parse_constant=refuse)
    except (ValueError, RecursionError):
        return False
    depth = most = 0
    quoted = escaped = False
    for c in text:
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        else:
            depth += (c in "[{") - (c in "]}")
            most = max(most, depth)
    return most <= deepest


def made(rng, depth=0):
    kind = rng.randrange(8 if depth < 5 else 6)
    if kind < 6:
        return [None, True, rng.randrange(-99, 99), rng.random() * 10 ** rng.randrange(-9, 20), rng.choice(["", "a", 'q"\\', "é\n\t", "{[,:]}"]), "\u0001x"][kind]
    return [made(rng, depth + 1) for _ in range(rng.randrange(4))] if kind == 6 else {rng.choice('ab"\\{'): made(rng, depth + 1) for _ in range(rng.randrange(4))}


def damaged(rng, text):
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(text) + 1)
        text = text[:k] + rng.choice(["", *'{}[],:"\\ 0-e.tn\n\x02é']) + text[k + rng.randrange(2) :]
    return text


def check(texts, deepest=strict_json.DEEPEST):
    got = strict_json.scan([t.encode() for t in texts], deepest).tolist()
    want = [slow(t, deepest) for t in texts]
    assert [(t, g) for t, g, w in zip(texts, got, want) if g != w] == []
    return want


def test_by_hand():
    check(BY_HAND)
    for t in BY_HAND:
        check([t])


@pytest.mark.parametrize("seed", range(4))
def test_made_damage(seed):
    rng = random.Random(seed)
    texts = [damaged(rng, json.dumps(made(rng), ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))) for _ in range(5000)]
    want = check(texts)
    assert 1000 < sum(want) < 4500


def test_depth():
    texts = ["[" * n + "]" * n for n in (1, 2, 3, 4, 64, 65)] + ['{"a":' * 3 + "1" + "}" * 3, '"[[[[[["', "[" * 100_000, "]" * 100_000]
    check(texts[:-2])
    check(texts[:-2], 2)
    assert strict_json.scan([t.encode() for t in texts[-2:]]).tolist() == [False, False]


def test_empty():
    assert strict_json.scan([]).tolist() == []


def test_long_texts():
    long = b'["' + b"\\\\" * 3_000_000 + b'"]'
    assert strict_json.scan([long, long[:-3] + b'"]', b"[" + b"1," * 1_000_000 + b"1]"]).tolist() == [True, False, True]


def test_column_and_sql(spark):
    rows = [(k, t) for k, t in enumerate(BY_HAND)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r["k"]: r["v"] for r in df.select("k", strict_json.valid_json(F.col("t")).alias("v")).collect()}
    assert got == {k: None if t is None else slow(t) for k, t in rows}
    strict_json.register(spark)
    df.createOrReplaceTempView("texts_of_json")
    assert {r["k"]: r["v"] for r in spark.sql("SELECT k, valid_json(t, 64) AS v FROM texts_of_json").collect()} == got
    read = strict_json.from_strict_json(F.col("t"), "a int")
    some = spark.createDataFrame([('{"a":1,"a":2}',), ('{"a":1} x',), (None,), ("[[1]",)], "t string")
    assert [r[0] and r[0]["a"] for r in some.select(read).collect()] == [2, None, None, None]
    assert some.limit(0).select(read).collect() == []
