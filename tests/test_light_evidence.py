"""Evidence without its triples, against evidence with them."""

import random

from pyspark.sql import functions as F

from assayer.operators import score, store, topics

FACTS = "row long, subject string, predicate string, object string, source string, added double, trust_q int"
CLAIMS = [(1, ["nap", "tea"], ["focus", "sleep"], 1, "tea"), (2, ["sugar"], [], -1, "sugar"), (3, ["nap"], ["mood"], 0, "nap"), (4, ["absent"], ["focus"], 1, "absent")]
NOW = 2e9


def weighed(spark, seed):
    rng = random.Random(seed)
    subjects, objects = ["green tea", "sugar", "short nap", "tea nap"], ["focus", "good sleep", "sleep focus", "mood", "bad mood"]
    keys = sorted({(rng.choice(subjects), rng.choice(["improve", "not improve", "harm", "contain"]), rng.choice(objects), f"h{rng.randrange(9)}.example.org/{rng.randrange(3)}") for _ in range(400)})
    rows = [(k + 1, *key, 1.9e9 + rng.randrange(2), 100 + rng.randrange(2)) for k, key in enumerate(keys)]  # many equal weights
    triples = score.with_topics(spark.createDataFrame(rows, FACTS))
    claims = spark.createDataFrame([(k, s, o, p, n, (o or [""])[0]) for k, s, o, p, n in CLAIMS], "claim_id int, s array<string>, o array<string>, pol int, subject string, object string")
    return claims, triples


def test_same_as_with_the_triples(spark):
    for seed in range(3):
        claims, triples = weighed(spark, seed)
        fields = ["claim_id", "host", "stance", "row", "weight", "first_row"]
        whole, light = score.evidence(claims, score.corroborate(triples), NOW), score.light_evidence(claims, triples, NOW)
        want = sorted(map(tuple, whole.select(*fields).collect()))
        assert sorted(map(tuple, light.select(*fields).collect())) == want and len(want) > 40
        places = lambda df: sorted(map(tuple, df.select("claim_id", "place", "row").collect()))
        assert places(score.ranked_by_ranges(light)) == places(score.ranked(whole))
        told = score.keyed(triples.select("ss", "os").distinct())
        heats = lambda df: sorted((r["claim_id"], r["place"], r["stem"], round(r["heat"], 6)) for r in df.collect())
        assert heats(topics.topic_heat(claims, light, told)) == heats(topics.entity_heat(claims, whole))


def test_nothing_is_sorted_to_be_aggregated(spark):
    claims, triples = weighed(spark, 7)
    light = score.light_evidence(claims, triples, NOW)
    plan = light._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
    assert not {*store.KEY, "ss", "os"} & set(light.columns)
    assert light.filter(F.col("row").isNull()).isEmpty()
