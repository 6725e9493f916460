"""Which topics to look up next for a claim."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import nlp
from assayer.functions.lexicon import STANCE_PHRASES, STANCES
from assayer.operators.score import TOPIC, ahead, ranked, verdicts

LAYERS = (32, 16, 8, 4)
DOCS_PER_TOPIC, MOST_EXTRA = 3, 5


def _base() -> Column:
    return F.trim(F.concat_ws(" ", "subject", "object"))


def seeds(claims: DataFrame, most: int = LAYERS[0]) -> DataFrame:
    """(claim_id, place, topic): the claim, its subject and object, then phrases for, against and neutral in turn."""
    ways = [F.concat_ws(" ", _base(), F.lit(STANCE_PHRASES[s][k])) for k in range(10) for s in STANCES]
    every = F.slice(F.array_distinct(F.array(_base(), F.col("subject"), F.col("object"), *ways)), 1, most)
    return claims.select("claim_id", F.posexplode(every).alias("place", "topic")).withColumn("place", F.col("place") + 1)


def entity_heat(claims: DataFrame, found: DataFrame, searched: DataFrame | None = None) -> DataFrame:
    """(claim_id, stem, heat, place): stems that the evidence mentions, by its weight, without the claim's and the searched topics'.

    Ties go to what the heaviest evidence mentions first, stems of one item in order.
    """
    known = claims.select("claim_id", F.explode(F.array_union("s", "o")).alias("stem"))
    if searched is not None:
        known = known.unionByName(searched.select("claim_id", F.explode("stems" if "stems" in searched.columns else nlp.stems("topic")).alias("stem")))
    items = ranked(found).select("claim_id", "place", "weight", F.explode(F.array_union(nlp.stems("subject"), nlp.stems("object"))).alias("stem"))
    fresh = items.join(known.distinct(), ["claim_id", "stem"], "left_anti")
    heat = fresh.groupBy("claim_id", "stem").agg(F.round(F.sum("weight"), 9).alias("heat"), F.min("place").alias("first"))
    return heat.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("heat"), "first", "stem"))).drop("first")


def topic_heat(claims: DataFrame, found: DataFrame, told: DataFrame) -> DataFrame:
    """entity_heat of light evidence, whose weights are summed by topic before a topic (told: t1, t2, ss, os) meets its stems."""
    known = claims.select("claim_id", F.explode(F.array_union("s", "o")).alias("stem"))
    summed = found.withColumn("ahead", ahead("weight", "first_row")).groupBy("claim_id", *TOPIC).agg(F.sum("weight").alias("weight"), F.max("ahead").alias("ahead"))
    items = summed.join(told, TOPIC).select("claim_id", "weight", "ahead", F.explode(F.array_union("ss", "os")).alias("stem"))
    fresh = items.join(known.distinct(), ["claim_id", "stem"], "left_anti")
    heat = fresh.groupBy("claim_id", "stem").agg(F.round(F.sum("weight"), 9).alias("heat"), F.max("ahead").alias("first"))
    return heat.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("heat"), F.desc("first"), "stem"))).drop("first")


def entities(claims: DataFrame, found: DataFrame, searched: DataFrame | None, most: int) -> DataFrame:
    """(claim_id, place, topic): the subject with the hottest stems."""
    return hottest(claims, entity_heat(claims, found, searched), most)


def hottest(claims: DataFrame, heat: DataFrame, most: int) -> DataFrame:
    """(claim_id, place, topic): the subject with each of the first stems by heat."""
    hot = heat.filter(F.col("place") <= most)
    return hot.join(claims.select("claim_id", "subject"), "claim_id").select("claim_id", "place", F.concat_ws(" ", "subject", "stem").alias("topic"))


def consolidation(claims: DataFrame, tallies: DataFrame) -> DataFrame:
    """(claim_id, place, topic): one to four phrases for the thinnest sides, more where no side leads clearly."""
    lead = F.greatest(*[F.col(f"{s}_share") for s in STANCES])
    n = F.when(lead >= 0.5, 1).when(lead >= 0.4, 2).when(lead >= 0.35, 3).otherwise(4)
    sides = F.array_sort(F.array(*[F.struct(F.col(f"{s}_share").alias("share"), F.lit(k).alias("k"), F.array(*[F.lit(w) for w in reversed(STANCE_PHRASES[s])]).alias("phrases")) for k, s in enumerate(STANCES)]))
    joined = claims.join(tallies, "claim_id").withColumns({"n": n, "sides": sides})
    each = joined.select("claim_id", "subject", "object", "sides", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    phrase = F.get(F.get("sides", F.col("i") % 3)["phrases"], F.floor(F.col("i") / 3).cast("int"))
    return each.select("claim_id", (F.col("i") + 1).alias("place"), F.concat_ws(" ", _base(), phrase).alias("topic"))


def probes(claims: DataFrame, found: DataFrame, tallies: DataFrame, searched: DataFrame | None, cycle: int, most: int = 8) -> DataFrame:
    """(claim_id, place, topic) of a round of reflection.

    Two uncorroborated items, two phrases of the side that lacks, one neutral phrase and three entities, without what was searched.
    """
    alone = ranked(found.filter((F.col("stance") != "neutral") & (F.col("corr") <= 1.0))).filter("place <= 2")
    doubts = alone.select("claim_id", F.col("place").alias("at"), F.concat_ws(" ", "subject", F.regexp_replace("predicate", "^not ", ""), "object").alias("topic"))
    led = claims.join(verdicts(tallies).select("claim_id", "leader"), "claim_id")
    pick = lambda s, k: F.lit(STANCE_PHRASES[s][k % 10])
    other = [F.when(F.col("leader") == "for", pick("against", 2 * cycle + k)).otherwise(pick("for", 2 * cycle + k)) for k in (0, 1)]
    phrases = F.array(*[F.concat_ws(" ", _base(), w) for w in (*other, pick("neutral", cycle))])
    asked = led.select("claim_id", F.posexplode(phrases).alias("at", "topic")).withColumn("at", F.col("at") + 10)
    more = entities(claims, found, searched, 3).select("claim_id", (F.col("place") + 20).alias("at"), "topic")
    every = doubts.unionByName(asked).unionByName(more).groupBy("claim_id", "topic").agg(F.min("at").alias("at"))
    if searched is not None:
        every = every.join(searched.select("claim_id", "topic"), ["claim_id", "topic"], "left_anti")
    return every.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy("at"))).filter(F.col("place") <= most).drop("at")


def unsearched(topics: DataFrame, searched: DataFrame | None, most: int) -> DataFrame:
    """The first `most` distinct topics of each claim that weren't searched yet, in their order."""
    fresh = topics.groupBy("claim_id", "topic").agg(F.min("place").alias("at"))
    if searched is not None:
        fresh = fresh.join(searched.select("claim_id", "topic").distinct(), ["claim_id", "topic"], "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy("at"))).filter(F.col("place") <= most).drop("at")


def count_topics(counts: DataFrame, searched: DataFrame) -> DataFrame:
    """(topic, count) with one more for each time a topic was searched."""
    return counts.select("topic", "count").unionByName(searched.select("topic", F.lit(1).cast("long").alias("count"))).groupBy("topic").agg(F.sum("count").alias("count"))


def with_limits(topics: DataFrame, counts: DataFrame) -> DataFrame:
    """topics with n_docs: three documents, and one more for each earlier search up to five."""
    return topics.join(counts, "topic", "left").withColumn("n_docs", (DOCS_PER_TOPIC + F.least(F.coalesce("count", F.lit(0)), F.lit(MOST_EXTRA))).cast("int")).drop("count")
