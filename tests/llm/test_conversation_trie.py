import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from assayer.llm import conversation_trie

KINDS = "conv_id long, turn long, role string, text string, depth string, owner long"


def slow_rebuilt(rows):
    """conv -> [(role, text)], as the contract words it."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(ts)] for c, ts in own.items()}
    cut = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    base = lambda c: c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
    return {c: own.get(base(c), [])[: cut[c]] + own[c][cut[c] :] for c in own}


def slow_trie(convs):
    nodes = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes[tuple(convs[c][:d])].append(c)
    kids = defaultdict(list)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in kids[p])
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in nodes[p] if len(convs[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in nodes.items())


def made(seed, n, words, longest):
    """Conversations over few texts, so that prefixes are shared; copies, null fields, repeated turns, null ids."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        c = rng.choice([k, k, 100 * rng.randrange(3) + k % 100, -k])
        for t in range(rng.randint(1, longest)):
            rows.append((c, t if rng.random() > 0.02 else None, rng.choice(["user", "assistant", None][: 1 + words // 2]), rng.choice(["", None, "é", "word", "x" * 90][:words])))
    rows += [(None, 1, "user", "lost"), (100, 0, "user", "word"), (-150, 0, None, None), (2**62, 3, "user", "é")] + rows[:5]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "words", "longest"), [(1, 60, 1, 4), (2, 150, 2, 7), (3, 120, 5, 9), (4, 4, 1, 70)])
def test_against_a_tree(spark, seed, n, words, longest):
    rows = made(seed, n, words, longest)
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], KINDS).repartition(3)
    turns = conversation_trie.turns_of(df)
    got = conversation_trie.trie(conversation_trie.rebuilt(turns), turns).collect()
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == slow_trie(slow_rebuilt(rows))
    assert sum(r["parent_conv_id"] is None for r in got) == 1


def test_one_conversation_holds_most_turns(spark):
    """Its turns are dealt over many ranges, and a chain of conversations each one turn longer hangs from it."""
    rows = [(0, t, "user", f"t{t % 7}") for t in range(700)] + [(c, t, "user", f"t{t % 7}") for c in range(1, 40) for t in range(6, 6 + c)] + [(c, 0, "user", "t6") for c in range(40, 200)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame([(*r, "clash", 5) for r in rows], KINDS)
        turns = conversation_trie.turns_of(df)
        got = conversation_trie.trie(conversation_trie.rebuilt(turns), turns).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in got) == slow_trie(slow_rebuilt(rows))


def test_long_list_of_ends(spark, monkeypatch):
    ids = [*range(20_000), -5]
    ends = spark.range(20_000).select(F.lit(-5).cast("long").alias("owner"), F.lit(2).cast("long").alias("depth"), F.col("id").alias("conv")).union(spark.sql("SELECT -5L, 2L, -5L"))
    got = conversation_trie.ends_digest(ends.repartition(7)).collect()
    assert [tuple(r) for r in got] == [(-5, 2, hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest())]


def test_empty_table(spark):
    df = spark.createDataFrame([], KINDS)
    turns = conversation_trie.turns_of(df)
    assert conversation_trie.trie(conversation_trie.rebuilt(turns), turns).collect() == []
