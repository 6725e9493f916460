"""How texts are dealt before they are cleaned, and what is read of them."""

from pyspark.sql import functions as F

from assayer.operators import ingest
from assayer.plans import texts


def test_texts_of_one_host_are_dealt_to_all_tasks_and_not_read(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc"), F.concat(F.lit("one.example.org/d"), F.col("id").cast("string")).alias("locator"), F.concat(F.lit("Green tea improves focus number "), F.col("id").cast("string"), F.lit(".")).alias("text"), F.lit(1.6e9).alias("added"))
    trust = spark.createDataFrame([("one.example.org", 0.5)], "host string, trust double")
    split = ingest.listened(docs, trust)
    per = [r["n"] for r in split.groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(per) == 400 and len(per) >= 4 and max(per) <= 200
    monkeypatch.setattr(ingest, "parse", lambda *a, **k: 1 / 0)
    assert texts.heard(spark, "/root/testdata/sf0.001").count() > 0
