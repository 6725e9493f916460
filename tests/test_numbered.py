"""Places in an order of all rows, and topics, without a shuffle or an expression more a row than they need."""

from pyspark.sql import functions as F

from assayer.functions import nlp, ranges, shared
from assayer.operators import score


def test_places_of_many_ranges(spark):
    rows = shared.stored(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.lit("kept").alias("y")))
    for order, back in ((F.col("x"), False), (F.desc("x"), True)):
        got = [tuple(r) for r in ranges.numbered(rows.repartition(7), [order], "n").collect()]
        want = sorted((r["x"] for r in rows.collect()), reverse=back)
        assert sorted((n, x) for x, _, n in got) == list(enumerate(want, 1)) and {y for _, y, _ in got} == {"kept"}
    assert ranges.numbered(rows.limit(0), [F.col("x")], "n").collect() == []


def test_a_place_needs_no_further_shuffle(spark):
    plan = ranges.numbered(shared.stored(spark.range(100)), [F.col("id")], "n")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


def test_objects_are_valued_once_a_name(spark):
    rows = [(1, "tea", p, o, "a.example.org/x", 1.9e9, 100) for p in ("improve", "not improve", "harm", "not ", "not not harm", "is", "x") for o in ("safe drink", "a toxic safe thing", "focus", "")]
    triples = spark.createDataFrame(rows, "row long, subject string, predicate string, object string, source string, added double, trust_q int")
    told = score.with_topics(triples)
    assert told.columns == [*triples.columns, "ss", "os", "pol", "host", "trust"]
    assert "toxic" not in told._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df, pol: sorted(map(tuple, df.select("predicate", "object", pol).collect()))
    assert key(told, "pol") == key(triples.withColumn("p", nlp.polarity("predicate", "object")), "p")
    assert dict(((p, o), v) for p, o, v in key(told, "pol"))[("harm", "a toxic safe thing")] == 1
