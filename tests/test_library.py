"""Searching a library: which documents are read, and when."""

from pyspark.sql import functions as F

from assayer.operators import claims, ingest, resolve, search
from assayer.plans import library


def test_only_documents_that_searches_find_are_read_and_once(spark, monkeypatch):
    small = library.docs(spark)
    others = spark.range(1000, 1500).select(F.col("id").alias("doc"), F.concat(F.lit("review.example.org/d"), F.col("id")).alias("locator"), F.concat(F.lit("Basalt number "), F.col("id"), F.lit(" improves walls.")).alias("text"), F.lit(library.NOW).alias("added"))
    kept, split = [], ingest.split
    monkeypatch.setattr(ingest, "split", lambda docs: kept.append(split(docs)) or kept[-1])
    asked = claims.parse(spark.createDataFrame([(1, "Walks improve mood."), (2, "Stone circles improve weather.")], "request_id int, text string")).withColumn("claim_id", F.col("request_id"))
    alone = resolve.resolve(asked, resolve.Library.of(small, library.trust(spark)), resolve.empty_memory(spark), library.NOW)
    read = [r["doc"] for t in kept for r in t.select("doc").collect()]
    assert len(kept) > 1 and len(read) == len(set(read))
    kept.clear()
    found = resolve.Library.of(small.unionByName(others), library.trust(spark))
    assert not kept
    beside = resolve.resolve(asked, found, resolve.empty_memory(spark), library.NOW)
    read = [r["doc"] for t in kept for r in t.select("doc").collect()]
    assert read and len(read) == len(set(read)) < 200
    verdict = lambda out: [r["verdict"] for r in out.verdicts.filter("claim_id = 1").collect()]
    assert verdict(alone) == verdict(beside) == ["for"]


def test_the_shelf_shuffles_stems_of_ids_with_several_texts_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"green tea {k}") for k in range(40)] + [(7, "black tea")], "doc long, text string")
    kept, stored = [], search.stored
    monkeypatch.setattr(search, "stored", lambda df: kept.append(df) or stored(df))
    shelf = search.Shelf.of(docs)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in kept]
    assert ["regexp_extract_all" in p and "Aggregate" in p for p in plans].count(True) == 0
    assert {r["doc"]: sorted(r["stems"]) for r in shelf.docs.collect()}[7] == ["black", "green", "tea", "tea"]
    assert shelf.docs.count() == 40
