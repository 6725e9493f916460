"""Answering claims: weigh what is known, search for what lacks in layers and reflection, weigh again.

All claims of a job move together; those that are resolved rest. A layer's searches see the same memory, and what they
find is merged in the order of claims and topics, so results don't depend on timing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import nlp
from assayer.functions.ranges import numbered
from assayer.functions.shared import ONE_TASK, Parts, stored
from assayer.operators import ingest, score, search, store, topics

#: A share's least move in a cycle of reflection, and the cycles without any that end it.
LEAST_MOVE, CALM_CYCLES = 1e-3, 2
#: What holds of a triple for any claim.
TOPIC = ["ss", "os", "pol", "host"]
MEMORY = "subject string, predicate string, object string, source string, added double, trust_q int, hits int, row long"


@dataclass
class Library:
    """What can be searched: the shelf of all docs, and the texts of those that the gate admits, which are read once a search finds them."""

    shelf: search.Shelf
    admitted: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, trust: DataFrame) -> Library:
        """The library of docs (doc, locator, text, added), gated by trust (host, trust)."""
        return cls(search.Shelf.of(docs, locator_col="locator"), ingest.admitted(docs, trust))

    def hear(self, found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Of the docs found (written, with columns of their own): the admitted ones (doc, source), and, written, their valid triples with topics and the columns of their doc.

        Where nothing is found, no text is read, and there are no triples.
        """
        if found.isEmpty():
            return ingest.split(self.admitted.limit(0)).select("doc", "source"), None
        heard = ingest.heard_of_few(ingest.split(self.admitted.join(found.select("doc"), "doc", "left_semi")))
        valid = ingest.found_triples(heard).filter(store.is_valid()).join(found, "doc")
        return heard.docs.select("doc", "source"), stored(score.with_topics_of_few(valid))


@dataclass
class Outcome:
    """verdicts and ranked evidence by claim, the first layer's steps, the memory with hits, topic counts, rounds of search and cycles of reflection by claim."""

    verdicts: DataFrame
    evidence: DataFrame
    steps: DataFrame
    memory: DataFrame
    counts: DataFrame
    rounds: DataFrame
    cycles: DataFrame


def _no_topics(memory: DataFrame) -> DataFrame:
    return memory.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in zip(TOPIC, ("array<string>", "array<string>", "int", "string"), strict=True)])


def empty_memory(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MEMORY)


def weigh(claims: DataFrame, memory: DataFrame, now: float) -> DataFrame:
    """The evidence, written, over a memory with topics."""
    facts = memory.withColumn("trust", F.col("trust_q") / 255.0)
    return stored(score.evidence(claims, score.corroborate(facts), now))


@dataclass
class Search:
    """What the searches of a job have done so far: the memory with topics and its last row, topics asked (claim_id, place, topic, stems, turn, n_docs; each time), and documents taken.

    A search ends with what it has met: the admitted ones (doc, source) of the documents that it took, and whether any said something.
    """

    memory: DataFrame
    before: DataFrame
    last_row: int
    asked: Parts = field(default_factory=Parts)
    taken: Parts = field(default_factory=Parts)
    sources: DataFrame | None = None
    told: bool = False

    def counts(self, asked: DataFrame | None) -> DataFrame:
        """(topic, count) of topics asked, with what was searched before this job."""
        return topics.count_topics(self.before, asked) if asked is not None else self.before

    def ask(self, wanted: DataFrame, earlier: DataFrame | None, turn: int) -> DataFrame:
        """The topics wanted (claim_id, place, topic) as asked in this turn, behind what was asked earlier."""
        self.told = False
        told = wanted.select("claim_id", "place", "topic", nlp.stems("topic").alias("stems"), F.lit(turn).alias("turn"))
        return self.asked.add(topics.with_limits(told, self.counts(earlier)).select("claim_id", "place", "topic", "stems", "turn", "n_docs"))

    def look_up(self, library: Library, asked: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Searches asked, takes in what new documents say, and returns the hits (claim_id, place, topic, doc, k) and the docs with fresh triples, if any.

        Only documents that no search has met before are read, by all tasks: the others have nothing new. A new
        triple's row is its place in the order of (claim, place, hit, place in the document) behind those known. Where
        nothing is said, the memory stays as it is.
        """
        queries = asked.select(F.struct("claim_id", "place", "topic").alias("query_id"), "stems", "n_docs")
        hits = library.shelf.top(queries, "n_docs").select("query_id.*", "doc", F.col("place").alias("k"))
        order = hits.groupBy("doc").agg(F.min(F.struct("claim_id", "place", "k")).alias("o"))
        taken = self.taken.all(asked.sparkSession)
        new = self.taken.add(order if taken is None else order.join(taken, "doc", "left_anti"))
        self.sources, said = library.hear(new)
        n, last = 0 if said is None else said.count(), self.last_row
        if not n:
            return hits, None
        self.told, self.memory = True, self._merged(said, n)
        self.last_row = self.memory.agg(F.max("row")).first()[0]
        fresh = self.memory.filter(F.col("row") > last).select(*store.KEY)
        return hits, said.join(fresh, store.KEY, "left_semi").select("doc").distinct()

    def _merged(self, said: DataFrame, n: int) -> DataFrame:
        """The memory with n triples said, written: known ones are refreshed, the others numbered on."""
        said = said.withColumn("o", F.struct("o", "at")).select(*store.KEY, "added", "trust_q", F.lit(0).alias("hits"), F.lit(None).cast("long").alias("row"), *TOPIC, "o")
        known = self.memory.withColumn("o", F.lit(None).cast(said.schema["o"].dataType))
        most = [F.max(c).alias(c) for c in ("added", "trust_q", "hits")]
        both = known.unionByName(said).groupBy(*store.KEY).agg(*most, F.min("row").alias("row"), *[F.first(c).alias(c) for c in TOPIC], F.min("o").alias("o"))
        if n > ONE_TASK:
            both = stored(both)
            fresh = numbered(both.filter("row IS NULL"), [F.col("o")], "n")
            both = both.filter("row IS NOT NULL").withColumn("n", F.lit(0).cast("long")).unionByName(fresh)
        else:  # rows that are known are groups of their own
            both = both.withColumn("n", F.row_number().over(Window.partitionBy(F.coalesce("row", F.lit(-1))).orderBy("o")))
        return stored(both.withColumn("row", F.coalesce("row", F.lit(self.last_row) + F.col("n"))).select(*self.memory.columns))


def _of(rows: DataFrame, claims: DataFrame) -> DataFrame:
    return rows.join(claims.select("claim_id"), "claim_id", "left_semi")


def _links(sources: DataFrame, asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(claim_id, place, topic, links): what each topic asked has met, in order."""
    met = hits.join(sources, "doc").groupBy("claim_id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "source"))), lambda x: x["source"]).alias("links"))  # eight links at most
    return asked.join(met, ["claim_id", "place"], "left").select("claim_id", "place", "topic", F.coalesce("links", F.array().cast("array<string>")).alias("links"))


def resolve(claims: DataFrame, library: Library, memory: DataFrame, now: float, counts: DataFrame | None = None, routes: DataFrame | None = None, cycles: int = 0) -> Outcome:
    """Verdicts of claims (claim_id, subject, object, s, o, pol, key): up to four layers of search, then up to `cycles` of reflection.

    A claim with a saved route (routes with key) that memory resolves is answered at once. Reflection ends for a claim,
    whatever the others do, where two cycles of its own find nothing new and move none of its shares by 0.001, or where it
    has nothing left to ask.
    """
    spark = claims.sparkSession
    claims = stored(claims)
    counts = stored(counts) if counts is not None else spark.createDataFrame([], "topic string, count long")
    columns, began = memory.columns, memory.agg(F.max("row").alias("last"), F.count(F.lit(1)).alias("n")).first()
    topical = score.with_topics(memory).select(*columns, *TOPIC) if began["n"] else _no_topics(memory)
    held = Search(stored(topical), counts, began["last"] or 0)
    found, state = None, None
    if began["n"]:  # an empty memory has nothing to weigh
        found = weigh(claims, held.memory, now)
        state = stored(score.tally(claims, found))
    replayed = claims.limit(0).select("claim_id")
    if routes is not None and began["n"]:
        replayed = stored(claims.join(routes.select("key").distinct(), "key", "left_semi").join(score.verdicts(state).filter("resolved").select("claim_id"), "claim_id", "left_semi").select("claim_id"))
    unanswered = active = claims.join(replayed, "claim_id", "left_anti")
    first = None
    for layer, size in enumerate(topics.LAYERS):
        earlier = held.asked.all(spark)
        if layer == 0:
            wanted = topics.seeds(active, size)
        elif layer < len(topics.LAYERS) - 1:
            wanted = topics.entities(active, _of(found, active), earlier, size)
        else:
            wanted = topics.consolidation(active, state)
        asked = held.ask(topics.unsearched(wanted, earlier, size), earlier, layer)
        if not asked.isEmpty():
            hits, _ = held.look_up(library, asked)
            first = stored(_links(held.sources, asked, hits)) if layer == 0 else first
        if held.told or found is None:
            found = weigh(claims, held.memory, now)
            state = stored(score.tally(claims, found))
        if held.told or layer == 0:
            active = stored(active.join(score.verdicts(state).filter("NOT resolved").select("claim_id"), "claim_id", "left_semi"))
    thinking, tallied = unanswered.select("claim_id", F.lit(0).alias("calm")), state.columns
    for cycle in range(cycles):
        earlier = held.asked.all(spark)
        asked = held.ask(topics.probes(_of(claims, thinking), _of(found, thinking), state, earlier, cycle), earlier, len(topics.LAYERS) + cycle)
        if asked.isEmpty():
            break
        hits, by_doc = held.look_up(library, asked)
        thinking = thinking.join(asked.select("claim_id"), "claim_id", "left_semi")
        stirred = F.lit(False)
        if held.told:
            found = weigh(claims, held.memory, now)
            lucky = hits.join(by_doc, "doc", "left_semi").select("claim_id").distinct().withColumn("lucky", F.lit(True))
            stirred = F.coalesce("lucky", F.lit(False)) | (F.greatest(*[F.abs(F.col(f"{s}_share") - F.col(f"{s}_before")) for s in score.STANCES]) >= LEAST_MOVE)
            before = state.select("claim_id", *[F.col(f"{s}_share").alias(f"{s}_before") for s in score.STANCES])
            state, thinking = score.tally(claims, found).join(before, "claim_id"), thinking.join(lucky, "claim_id", "left")
        calm = F.when(F.col("calm").isNotNull(), F.when(stirred, 0).otherwise(F.col("calm") + 1))
        state = stored(state.drop("calm").join(thinking, "claim_id", "left").select(*tallied, calm.alias("calm")))
        thinking = state.filter(F.col("calm") < CALM_CYCLES).select("claim_id", "calm")
    ranked = score.ranked(found)
    used = ranked.filter("place <= 12").groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("more"))
    touched = held.memory.join(used, "row", "left").withColumn("hits", (F.col("hits") + F.coalesce("more", F.lit(0))).cast("int")).drop("more")
    every = held.asked.all(spark)
    turns = claims.select("claim_id", F.lit(None).cast("int").alias("turn")).unionByName(every.select("claim_id", "turn").distinct()).groupBy("claim_id")
    rounds, thought = (turns.agg(F.count(F.when(when, 1)).alias(name)) for name, when in (("rounds", F.col("turn") < len(topics.LAYERS)), ("cycles", F.col("turn") >= len(topics.LAYERS))))
    first = first if first is not None else spark.createDataFrame([], "claim_id int, place int, topic string, links array<string>")
    return Outcome(score.verdicts(state.select(*tallied)), ranked, first.withColumnRenamed("place", "step"), touched.select(*columns), stored(held.counts(every)), rounds, thought)
