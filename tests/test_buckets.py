import json
import random
import time

import pytest
from pyspark.sql import functions as F

from assayer.operators import store
from assayer.sources.buckets import Buckets
from assayer.streaming import ingest as stream

KINDS = "word string, n int, told string"


def added_up(old, new):
    return (new if old is None else old.unionByName(new)).groupBy("word").agg(F.sum("n").cast("int").alias("n"), F.max("told").alias("told"))


def table(spark, rows):
    return spark.createDataFrame([(w, n, "x") for w, n in rows], KINDS)


def held(buckets):
    _, rows, warnings = buckets.load()
    return {r["word"]: r["n"] for r in rows.collect()}, warnings


def files(path, name=None):
    return {str(f.relative_to(path)) for f in path.glob(f"data/{name or '*'}/*/*.parquet")}


def test_batches_against_a_dictionary(spark, tmp_path):
    """Random batches, repeated keys and new ones; buckets double when they are full."""
    rng, want = random.Random(1), {}
    buckets = Buckets(spark, str(tmp_path / "t"), ["word"], buckets=2, rows_a_bucket=20)
    for _ in range(4):
        batch = [(f"w{rng.randrange(120)}", rng.randint(1, 9)) for _ in range(40)]
        for w, n in batch:
            want[w] = want.get(w, 0) + n
        buckets.merge(table(spark, batch), added_up)
        assert held(buckets) == (want, [])
    assert buckets._manifest(buckets.names()[-1])["buckets"] >= 4
    # What no kept snapshot names is gone.
    named = {r["file"] for n in buckets.names() for r in buckets.files(n).collect()}
    assert files(tmp_path / "t") == named


def test_one_row_rewrites_one_bucket(spark, tmp_path):
    buckets = Buckets(spark, str(tmp_path / "t"), ["word"], buckets=8)
    first, _ = buckets.merge(table(spark, [(f"w{k}", 1) for k in range(200)]), added_up)
    before = {r["file"]: r["sha256"] for r in buckets.files(first).collect()}
    second, _ = buckets.merge(table(spark, [("w7", 5)]), added_up)
    after = {r["file"]: r["sha256"] for r in buckets.files(second).collect()}
    assert len(before) == len(after) == 8 and len(before.items() & after.items()) == 7
    assert len(files(tmp_path / "t", second)) == 1
    assert buckets.merge(table(spark, []), added_up) == (None, [])
    assert buckets.names() == [first, second] and held(buckets)[0]["w7"] == 6


def test_damage_falls_back(spark, tmp_path):
    path = tmp_path / "t"
    buckets = Buckets(spark, str(path), ["word"], buckets=4)
    buckets.merge(table(spark, [(f"w{k}", 1) for k in range(40)]), added_up)
    second, _ = buckets.merge(table(spark, [("w7", 5)]), added_up)
    (own,) = (path / f for f in files(path, second))
    whole = own.read_bytes()
    for crc in own.parent.glob(".*.crc"):
        crc.unlink()
    own.write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    rows, warnings = held(buckets)
    assert rows["w7"] == 1 and len(warnings) == 1
    # A batch goes on from the whole snapshot, and counts what the damaged one had lost no more.
    buckets.merge(table(spark, [("w7", 2), ("new", 1)]), added_up)
    assert held(buckets)[0]["w7"] == 3
    assert (path / "CURRENT").read_text() == "gen-3"
    manifest = path / "gen-3/manifest.json"
    manifest.write_text(json.dumps(json.loads(manifest.read_text()) | {"rows": 1}))
    for crc in (path / "gen-3").glob(".manifest*.crc"):
        crc.unlink()
    _, rows, warnings = buckets.load()
    assert rows is None and len(warnings) == 2


def test_save_that_did_not_end(spark, tmp_path):
    path = tmp_path / "t"
    buckets = Buckets(spark, str(path), ["word"])
    buckets.merge(table(spark, [("a", 1)]), added_up)
    (path / "data/gen-2/bucket=1").mkdir(parents=True)
    (path / "data/gen-2/bucket=1/part-left.parquet").write_bytes(b"left over")
    (path / "gen-2.tmp").mkdir()
    buckets.merge(table(spark, [("a", 1)]), added_up)
    assert held(buckets) == ({"a": 2}, []) and "data/gen-2/bucket=1/part-left.parquet" not in files(path)


def said(k, added, trust):
    return json.dumps({"subject": f"s{k}", "predicate": "improve", "object": "focus", "source": "a.example.org/x", "added": added, "trust_q": trust})


def run(spark, path, **more):
    attempts = spark.readStream.schema(stream.SAID).option("maxFilesPerTrigger", 1).json(str(path / "in"))
    stream.start(attempts, str(path / "memory"), str(path / "state"), **more).awaitTermination()
    _, rows, _ = stream.memory_at(spark, str(path / "memory")).load()
    return {r["subject"]: (r["added"], r["trust_q"]) for r in rows.collect()}


def test_keyed_state_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([said(1, 1.0, 9), said(2, 5.0, 1), said(1, 3.0, 2), *[said(3, 1.0, 1)] * 500, said("<b>", 1.0, 1)]))
    assert run(spark, tmp_path) == {"s1": (3.0, 9), "s2": (5.0, 1), "s3": (1.0, 1)}
    names = stream.memory_at(spark, str(tmp_path / "memory")).names()
    (tmp_path / "in/2.json").write_text("\n".join([said(1, 2.0, 9), said(2, 5.0, 0)]))  # nothing new: the state ends it
    assert run(spark, tmp_path) == {"s1": (3.0, 9), "s2": (5.0, 1), "s3": (1.0, 1)}
    assert stream.memory_at(spark, str(tmp_path / "memory")).names() == names
    (tmp_path / "in/3.json").write_text("\n".join([said(2, 4.0, 7), said(4, 1.0, 1)]))
    assert run(spark, tmp_path) == {"s1": (3.0, 9), "s2": (5.0, 7), "s3": (1.0, 1), "s4": (1.0, 1)}


def test_a_state_that_forgets_changes_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with pytest.raises(ValueError):
        run(spark, tmp_path, forget=1.0)
    for k, (added, trust) in enumerate([(5.0, 5), (4.0, 4), (6.0, 1)]):
        (tmp_path / f"in/{k}.json").write_text(said(1, added, trust))
    attempts = spark.readStream.schema(stream.SAID).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    query = stream.start(attempts, str(tmp_path / "memory"), str(tmp_path / "state"), {"processingTime": "1 second"}, forget=1.0)
    until = time.time() + 60
    try:  # such a query is never idle, as time alone makes batches
        while sum(p.numInputRows for p in query.recentProgress) < 3 and time.time() < until:
            time.sleep(0.5)
    finally:
        query.stop()
    _, rows, _ = stream.memory_at(spark, str(tmp_path / "memory")).load()
    assert [tuple(r) for r in rows.select("subject", "added", "trust_q").collect()] == [("s1", 6.0, 5)]


def test_cap(spark, tmp_path):
    memory = stream.memory_at(spark, str(tmp_path / "memory"))
    rows = [(f"s{k}", "improve", "focus", "a.example.org/x", float(k), k) for k in range(100)]
    stream.upsert_batch(memory, spark.createDataFrame(rows, stream.SAID), cap=1500, now=100.0)
    _, left, _ = memory.load()
    assert 0 < left.count() < 100 and store.logical_size(left).first()["bytes"] <= 1500
    assert left.agg({"trust_q": "max"}).first()[0] == 99
