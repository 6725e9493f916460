"""Continual ingestion: streams of attempts or documents are merged into a versioned memory.

What is known of each triple is keyed state of the stream, so that a batch costs what it brings: rows that say nothing new
end there, the others rewrite the buckets of their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from assayer.operators import ingest, store
from assayer.sources.buckets import Buckets

SAID = "subject string, predicate string, object string, source string, added double, trust_q int"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def memory_at(spark: SparkSession, folder: str, **sizes) -> Buckets:
    """The memory below a folder: rows of (subject, predicate, object, source, added, trust_q, hits), a row a key."""
    return Buckets(spark, folder, store.KEY, **sizes)


def _taken_in(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
    return fresh.withColumn("hits", F.lit(0)) if old is None else store.merge(old, fresh)


def upsert_batch(memory: Buckets, found: DataFrame, cap: int | None = None, now: float = 0.0) -> None:
    """Merges the valid rows of a batch into the memory; the same batch again changes nothing.

    With a cap, a memory that has outgrown it is evicted from, which reads and rewrites all of it.
    """
    fresh = store.upsert(found.filter(store.is_valid()).select(*store.KEY, "added", "trust_q"))
    name, _ = memory.merge(fresh, _taken_in)
    if cap is None or name is None:
        return
    _, whole, _ = memory.load()
    if store.logical_size(whole).first()["bytes"] > cap:
        left = store.evict(whole.withColumn("row", F.xxhash64(*store.KEY)), cap, now)
        memory.replace(left.select(*store.KEY, "added", "trust_q", "hits"))


class Strongest(StatefulProcessor):
    """The latest `added` and the highest `trust_q` of a triple; a row comes out where one of them has grown."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "added double, trust_q int", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = tuple(self.held.get()) if self.held.exists() else None
        now = before
        for r in rows:
            now = (r["added"], r["trust_q"]) if now is None else (max(now[0], r["added"]), max(now[1], r["trust_q"]))
        if now != before:
            self.held.update(now)
            yield Row(**dict(zip(store.KEY, key, strict=True)), added=now[0], trust_q=now[1])

    def close(self) -> None:
        pass


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a key in each batch, so that a triple that a third of all rows repeat reaches its state as a few rows."""
    for batch in batches:
        best = pa.Table.from_batches([batch]).group_by(store.KEY).aggregate([("added", "max"), ("trust_q", "max")])
        yield from best.select([*store.KEY, "added_max", "trust_q_max"]).rename_columns([*store.KEY, "added", "trust_q"]).to_batches()


def grown(attempts: DataFrame, forget: float | None = None) -> DataFrame:
    """Of a stream of attempts, the valid triples that are new or whose `added` or `trust_q` has grown, as they stand now.

    State is one value a triple, in RocksDB. With `forget`, a triple that nothing changes for so many seconds leaves the state;
    when it comes again it passes as new, which the memory's merge makes harmless.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    valid = attempts.filter(store.is_valid() & F.col("added").isNotNull() & F.col("trust_q").isNotNull()).select(*store.KEY, F.col("added").cast("double").alias("added"), F.col("trust_q").cast("int").alias("trust_q"))
    keyed = valid.mapInArrow(_reduced, SAID).groupBy(*store.KEY)
    forget_ms = None if forget is None else int(forget * 1000)
    return keyed.transformWithState(Strongest(forget_ms), outputStructType=SAID, outputMode="Update", timeMode="None" if forget is None else "ProcessingTime")


def start(attempts: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, forget: float | None = None, **limits):
    """Starts merging a stream of attempts (subject, predicate, object, source, added, trust_q) into the memory below folder.

    The trigger's default takes all that is there and ends; `forget` needs one that goes on, as time passes without rows too.
    A batch that is repeated after a failure is harmless; a stream that is started again with its checkpoint goes on with its state.
    """
    if forget is not None and "processingTime" not in (trigger or {}):
        raise ValueError("forget needs a trigger by processing time")
    memory = memory_at(attempts.sparkSession, folder)
    writer = grown(attempts, forget).writeStream.outputMode("update").foreachBatch(lambda batch, _: upsert_batch(memory, batch, **limits)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def start_documents(docs: DataFrame, trust: DataFrame, folder: str, checkpoint: str, trigger: dict | None = None, cache: str | None = None, **limits):
    """The same for a stream of documents (doc, locator, text, added), which each batch parses; without keyed state.

    With a folder for a cache, sentences that an earlier batch or job has read aren't read again.
    """
    memory = memory_at(docs.sparkSession, folder)
    known = None if cache is None else ingest.ParseCache(docs.sparkSession, cache)

    def run(batch: DataFrame, _: int) -> None:
        upsert_batch(memory, ingest.attempts(batch, trust, heard=ingest.hear(batch, trust, cache=known)), **limits)

    return docs.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
