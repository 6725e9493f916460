import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from assayer.llm import sharding
from assayer.llm.common import crc32_sql

KINDS = "doc_id long, text string, size string, slot int, key string"


def slow_shards(rows, shards, tolerance):
    """(doc_id, text, shard) in order, by cumulative bytes over the sorted rows."""
    order = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest()[: sharding.DIGEST], r[0] is not None, r[0] or 0))
    size = [len((t or "").encode()) + sharding.OVERHEAD for _, t in order]
    total, edges, groups = sum(size), [0], [0]
    for k, n in enumerate(size):
        edges.append(edges[-1] + n)
        if k + 1 == len(size) or (order[k][1] or "") != (order[k + 1][1] or ""):
            groups.append(k + 1)
    bounds = []
    for j in range(1, shards):
        far = lambda k: (abs(edges[k] * shards - j * total), k)
        at = min(groups, key=far)
        bounds.append(at if far(at)[0] <= tolerance * total else min(range(len(edges)), key=far))
    return [(i, t, sum(b <= k for b in bounds)) for k, (i, t) in enumerate(order)]


def made(seed, n, hot):
    """Rows with a text that a share `hot` of them has, small groups, null ids, null texts, and repeated rows."""
    rng = random.Random(seed)
    rows = [(k, "copied " * 20 if rng.random() < hot else "x" * rng.randint(0, 400) + str(rng.randrange(n // 2))) for k in range(n)]
    rows += [(None, "copied " * 20)] * 5 + [(None, None), (7, None), (-(2**63), ""), (2**63 - 1, "é" * 3000), (3, "copied " * 20), (3, "copied " * 20), (3, "copied " * 20)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "hot", "shards", "probes"), [(1, 300, 0.4, 7, 1024), (2, 300, 0.0, 40, 16), (3, 200, 0.9, 5, 8), (4, 3, 0.5, 40, 64)])
def test_against_cumulative_bytes(spark, seed, n, hot, shards, probes):
    rows = made(seed, n, hot)
    df = spark.createDataFrame([(*r, "a", 1, "b") for r in rows], KINDS).repartition(4)
    got = sharding.shard(df, shards, probes=probes, rows_a_range=37).collect()
    want = slow_shards(rows, shards, sharding.TOLERANCE)
    kind = lambda i, t: (i is not None, i or 0, t is not None, t or "")
    # Rows of one id whose texts are null and empty are alike to the order.
    assert Counter((kind(r["doc_id"], r["text"] or ""), r["shard"]) for r in got) == Counter((kind(i, t or ""), s) for i, t, s in want)
    assert Counter(kind(r["doc_id"], r["text"]) for r in got) == Counter(kind(*r) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot_"])
        assert (r["size"], r["slot"], r["key"]) == ("a", 1, "b")
        assert (r["size_"], r["text_crc32"]) == (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))


def test_bytes_are_near_equal_and_small_groups_stay_whole(spark):
    rng = random.Random(9)
    rows = [(k, f"{rng.randrange(1500)} " * 10) for k in range(3000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 10).collect()
    load, homes = Counter(), defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        homes[r["text"]].add(r["shard"])
    mean = sum(load.values()) / 10
    assert all(abs(x - mean) <= 0.02 * mean for x in load.values())
    assert all(len(x) == 1 for x in homes.values())


@pytest.mark.parametrize("shards", [3, 40])
def test_twin(spark, shards):
    rows = [(k, t) for k, (_, t) in enumerate(made(5, 250, 0.3))]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards, carry=["doc_id"])
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    want = con.sql(sharding.twin(shards)).df()
    names = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(map(tuple, want[names].values.tolist()))


def test_crc32_in_sql():
    words = ["", "a", "0", "Ünï 😀", "x" * 1000]
    con = duckdb.connect()
    con.register("words", pd.DataFrame({"x": words}))
    assert dict(con.sql(f"WITH {crc32_sql('words')} SELECT x, crc FROM crcs").fetchall()) == {w: zlib.crc32(w.encode()) for w in words}


def test_empty_table_and_folders(spark, no_docs, docs, tmp_path):
    assert sharding.shard(no_docs).collect() == []
    sharding.write_shards(sharding.shard(docs, 4), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}


def test_binary_search(spark):
    bounds = ["1", "3", "3", "7"]
    df = spark.createDataFrame([(c,) for c in "012345678~"], "key string")
    assert [r[0] for r in df.select(sharding.below(df["key"], bounds)).collect()] == [sum(b <= c for b in bounds) for c in "012345678~"]
