"""Queries over tables that are kept up by batches: each takes the derived triples in as three batches, and gives what one recount does."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import shared
from assayer.operators import score, store
from assayer.operators.corroboration import Corroboration
from assayer.operators.stem_index import StemIndex
from assayer.plans import sample, weighing
from assayer.streaming import ingest as stream

BATCHES = 3


def _folder(spark) -> str:
    return f"{shared.shared_dir(spark)}/kept-{uuid.uuid4().hex}"


def _topical(spark, sf_dir) -> DataFrame:
    return shared.stored(score.with_topics(sample.triples(spark, sf_dir)))


def corroboration(spark, sf_dir):
    triples, kept = _topical(spark, sf_dir), Corroboration(spark, _folder(spark))
    for k in range(BATCHES):
        kept.take_in(triples.filter(F.col("row") % BATCHES == k))
    return kept.corroborate(triples).select("row", "syn", "ant", F.round("corr", 6).alias("corr"))


def evidence(spark, sf_dir):
    """Evidence by the stem index and kept corroboration; the claims read the postings of their stems alone."""
    triples, folder = _topical(spark, sf_dir), _folder(spark)
    index, kept = StemIndex(spark, f"{folder}/stems"), Corroboration(spark, f"{folder}/corroboration")
    for k in range(BATCHES):
        batch = triples.filter(F.col("row") % BATCHES == k)
        index.add(batch)
        kept.take_in(batch)
    found = index.light_evidence(sample.claims(spark), sample.NOW, kept.told_of).drop(*score.TOPIC)
    return score.ranked_by_ranges(found).select("claim_id", "place", "row", "stance", F.round("weight", 9).alias("weight"))


def memory(spark, sf_dir):
    attempts, held = shared.stored(sample.attempts(spark, sf_dir)), stream.memory_at(spark, _folder(spark))
    for k in range(BATCHES):
        stream.upsert_batch(held, attempts.filter(F.col("trust_q") % BATCHES == k))
    return held.load()[1].select(*store.KEY, "added", "trust_q")


def dense_ids(spark, sf_dir):
    return store.encode(sample.triples(spark, sf_dir).select(*store.KEY))[0].select("id", "value")


QUERIES = {"corroboration_kept": corroboration, "evidence_from_index": evidence, "memory_by_batches": memory, "dictionary_ids": dense_ids}
SQL = {
    "corroboration_kept": weighing.SQL["corroboration_by_topic"],
    "evidence_from_index": weighing.SQL["evidence_ranked"],
    "memory_by_batches": weighing.SQL["triple_upsert"],
    "dictionary_ids": f"WITH {sample.TRIPLES_SQL}, strings AS (SELECT DISTINCT unnest([subject, predicate, object, source]) AS value FROM triples) SELECT row_number() OVER (ORDER BY value) - 1 AS id, value FROM strings",
}
