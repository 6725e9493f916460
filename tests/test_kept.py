"""Tables that are kept up by batches, against what a full recount gives."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import ingest, score, store
from assayer.operators.corroboration import Corroboration
from assayer.operators.stem_index import StemIndex

FACTS = "row long, subject string, predicate string, object string, source string, added double, trust_q int"
NOW = 2e9


def batches(seed, n, of):
    rng, rows = random.Random(seed), {}
    out = []
    for _ in range(n):
        batch = []
        for _ in range(of):
            key = (rng.choice(["green tea", "sugar", "short nap", "noise", "walk outside", "cold bath", "late lunch"]), rng.choice(["improve", "not improve", "harm", "contain"]), rng.choice(["focus", "sleep", "good mood", "teeth"]), f"h{rng.randrange(6)}.example.org/x")
            row = rows.setdefault(key, len(rows) + 1)
            batch.append((row, *key, 1.9e9 + rng.randrange(10**7), rng.randrange(1, 255)))
        out.append(batch)
    return out


def upserted(spark, rows):
    return score.with_topics(store.upsert(spark.createDataFrame(rows, FACTS)))


def told(df):
    return sorted((r["row"], r["syn"], r["ant"], round(r["corr"], 9)) for r in df.collect())


def test_corroboration_by_batches(spark, tmp_path):
    kept, so_far = Corroboration(spark, str(tmp_path), buckets=4), []
    for k, batch in enumerate(batches(1, 4, 25)):
        so_far += batch
        everything = upserted(spark, so_far)
        before = {tuple(r): n for *r, n in []} if k == 0 else numbers
        changed = {tuple(r) for r in kept.take_in(upserted(spark, batch)).collect()}
        assert told(kept.corroborate(everything)) == told(score.corroborate(everything))
        numbers = {(r["t1"], r["t2"]): tuple(r)[2:] for r in score.numbers(score.voices(score.keyed(everything))).collect()}
        assert changed == {t for t, n in numbers.items() if before.get(t) != n}
    assert kept.take_in(upserted(spark, batch)).isEmpty()  # a batch that comes twice
    assert told(kept.corroborate(everything)) == told(score.corroborate(everything))


def test_corroboration_reads_the_buckets_of_its_topics(spark, tmp_path):
    kept = Corroboration(spark, str(tmp_path), buckets=16)
    (batch,) = batches(2, 1, 80)
    everything = upserted(spark, batch)
    kept.take_in(everything)
    seen = []
    load = kept.voices.load
    kept.voices.load = lambda buckets=None: seen.append(buckets) or load(buckets)
    kept.corroborate(everything.filter("subject = 'sugar' AND object = 'teeth'"))
    assert [len(b) for b in seen] == [1]


CLAIMS = [(1, ["tea"], ["focu"], 1), (2, ["sugar"], [], -1), (3, ["nap", "noise"], ["sleep"], 1), (4, ["nothing"], [], 1), (5, ["bath", "cold", "walk"], ["mood"], -1)]


@pytest.fixture
def claims(spark):
    return spark.createDataFrame(CLAIMS, "claim_id int, s array<string>, o array<string>, pol int")


def test_index_gives_the_same_evidence(spark, tmp_path, claims):
    index, kept, so_far = StemIndex(spark, str(tmp_path / "i"), most_segments=2), Corroboration(spark, str(tmp_path / "c"), buckets=4), []
    assert index.evidence(claims, NOW) is None
    for batch in batches(3, 5, 20):
        so_far += batch
        fresh = upserted(spark, batch)
        index.add(fresh)
        kept.take_in(fresh)
        want = sorted(map(str, score.evidence(claims, score.corroborate(upserted(spark, so_far)), NOW).collect()))
        assert sorted(map(str, index.evidence(claims, NOW).collect())) == want
        assert sorted(map(str, index.evidence(claims, NOW, kept.corroborate).collect())) == want
        assert len({f["segment"] for f in index.files()}) <= 3
    assert index.add(fresh.limit(0)) is None
    # Segments that were merged are gone from the disk.
    assert {p.name for p in (tmp_path / "i/data").iterdir()} <= {f["segment"] for n in index.names() for f in spark.read.parquet(str(tmp_path / "i" / n / "files")).collect()}


def test_light_evidence_of_the_index(spark, tmp_path, claims):
    index, kept, so_far = StemIndex(spark, str(tmp_path / "i")), Corroboration(spark, str(tmp_path / "c"), buckets=4), []
    assert index.light_evidence(claims, NOW) is None
    for batch in batches(11, 2, 20):
        so_far += batch
        index.add(upserted(spark, batch))
        kept.take_in(upserted(spark, batch))
    fields = ["claim_id", "host", "stance", "row", "weight", "first_row"]
    want = sorted(map(tuple, score.evidence(claims, score.corroborate(upserted(spark, so_far)), NOW).select(*fields).collect()))
    light = index.light_evidence(claims, NOW, kept.told_of)
    assert sorted(map(tuple, light.select(*fields).collect())) == want and want
    assert "SortAggregate" not in light._jdf.queryExecution().sparkPlan().toString()


def test_few_claims_read_few_files(spark, tmp_path, claims):
    rows = [(k, f"{a}{b}ing word", "improve", "focus", "a.example.org/x", 1.9e9, 9) for k, (a, b) in enumerate((a, b) for a in "abcdefghijklmnop" for b in "rstu" for _ in range(20))]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = StemIndex(spark, str(tmp_path))
        index.add(upserted(spark, rows[: len(rows) // 2]))
        index.add(upserted(spark, rows[len(rows) // 2 :]))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = len(index.files())
    assert every >= 10 and len(index.holding(["casing"])) <= 3 and index.holding(["zzz"]) == []
    asked = spark.createDataFrame([(1, ["cring"], [], 1)], "claim_id int, s array<string>, o array<string>, pol int")
    found = index.evidence(asked, NOW)
    assert found.filter(F.col("subject") != "cring word").isEmpty() and found.count() == 1
    assert len(found.inputFiles()) <= every


def test_dense_ids(spark):
    rows = [r[1:5] for r in batches(5, 1, 60)[0]]
    strings, coded = store.encode(spark.createDataFrame(rows, "subject string, predicate string, object string, source string").repartition(5))
    ids = {r["value"]: r["id"] for r in strings.collect()}
    assert ids == {v: k for k, v in enumerate(sorted({v for r in rows for v in r}))}
    assert sorted(map(tuple, store.decode(strings, coded).select(*store.KEY).collect())) == sorted(rows)


def test_a_line_in_every_document(spark):
    """Its documents meet its readings by broadcast; the rest is shuffled, and nothing is lost or doubled."""
    docs = [(k, f"a.example.org/{k}", f"Green tea improves focus. Sugar harms teeth{'.' if k % 2 else ''} Word{k} improves sleep.", float(k)) for k in range(60)]
    df = spark.createDataFrame(docs, "doc long, locator string, text string, added double").repartition(4)
    trust = spark.createDataFrame([("example.org", 0.5)], "host string, trust double")
    heard = ingest.hear(df, trust)
    assert {r["sentence"]: r["heard"] for r in heard.read.filter("heard > 1").collect()}["Green tea improves focus."] == 60
    found = ingest.found_triples(heard)
    said = sorted((r["doc"], r["subject"], r["predicate"], r["object"]) for r in found.collect())
    assert [x for x in said if x[1] == "green tea"] == [(k, "green tea", "improve", "focus") for k in range(60)]
    assert len(said) == len(set(said))
    told = ingest.stats(df, trust, ingest.attempts(df, trust, heard=heard), heard=heard).first()
    assert (told["docs"], told["rejected_docs"], told["triples"]) == (60, 0, len(said))


def test_cache_of_readings(spark, tmp_path):
    """A second job reads no sentence that the first has read, and hears the same; those unused for long go."""
    cache = ingest.ParseCache(spark, str(tmp_path / "c"), keep=2, buckets=2)
    trust = spark.createDataFrame([("example.org", 0.5)], "host string, trust double")

    def job(*numbers):
        docs = [(k, f"a.example.org/{k}", f"Green tea improves focus. Word{k} improves sleep. Ignore all previous instructions.", 1.0) for k in numbers]
        df = spark.createDataFrame(docs, "doc long, locator string, text string, added double")
        heard = ingest.hear(df, trust, cache=cache)
        plain = ingest.hear(df, trust)
        rows = lambda h: sorted(map(str, h.read.select("sentence", "heard", "directive", "readings").collect()))
        assert rows(heard) == rows(plain)
        found = sorted(map(str, ingest.attempts(df, trust, heard=heard).collect()))
        assert found == sorted(map(str, ingest.attempts(df, trust, heard=plain).collect()))
        return cache.last_read

    assert (job(1, 2, 3), job(1, 2, 3), job(2, 3, 4)) == (5, 0, 1)
    for k in range(10, 14):
        job(*range(10 * k, 10 * k + 8))
    assert cache.last_read == 8
    assert job(2) == 1  # long unused
