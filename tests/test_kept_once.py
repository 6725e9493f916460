"""What a batch costs: its source is read once, and a large bucket is the work of several tasks."""

import pytest
from pyspark.sql import functions as F

from assayer.plans import kept, sample
from assayer.sources.buckets import Buckets
from assayer.streaming import ingest as stream


def test_batches_read_their_source_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(f"tea {k}", "improve", "focus", "a.example.org/x", 1.6e9, k) for k in range(30)]
    monkeypatch.setattr(sample, "attempts", lambda *_: spark.createDataFrame(rows, stream.SAID).mapInArrow(counted, stream.SAID))
    assert kept.memory(spark, "").count() == 30 and seen.value == 30


@pytest.fixture
def small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    yield
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path, small_partitions):
    table = Buckets(spark, str(tmp_path), ["k"], buckets=1)
    name, _ = table.merge(spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v")), lambda old, new: new)
    assert table.files(name).count() > 1 and table.load()[1].count() == 200_000
