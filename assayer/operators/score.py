"""Weighing triples for and against claims: corroboration, evidence, shares and verdicts, for many claims at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.functions import nlp
from assayer.functions.lexicon import STANCES
from assayer.functions.ranges import running
from assayer.functions.shared import stored

PRIOR, PARTIAL, THRESHOLD, LEAST_HOSTS = 0.15, 0.25, 0.60, 2
#: What one more independent voice adds, and up to how many count.
VOICE_GAIN, MOST_VOICES = 0.25, 3
SIGNS, TOPIC = (1, -1, 0), ["t1", "t2"]


def with_topics(triples: DataFrame) -> DataFrame:
    """triples with ss and os (stems of subject and object), pol, host and trust, which hold for any claim.

    Each distinct name is reduced to stems, and valued as an object, once; the verb's polarity, host and trust are expressions over the row.
    """
    names = stored(triples.select(F.explode(F.array("subject", "object")).alias("name")).distinct().withColumns({"stems": nlp.stems("name"), "worth_": nlp.worth("name")}))
    out = triples.join(names.select(F.col("name").alias("subject"), F.col("stems").alias("ss")), "subject").join(names.select(F.col("name").alias("object"), F.col("stems").alias("os"), "worth_"), "object")
    told = {"pol": nlp.spoken_polarity("predicate", F.col("worth_")), "host": nlp.host("source"), "trust": F.col("trust_q") / 255.0}
    return out.select(*triples.columns, "ss", "os", "worth_").withColumns(told).drop("worth_")


def with_topics_of_few(triples: DataFrame) -> DataFrame:
    """with_topics of rows so few that no name is worth a shuffle to be reduced once."""
    return triples.withColumns({"ss": nlp.stems("subject"), "os": nlp.stems("object"), "pol": nlp.polarity("predicate", "object"), "host": nlp.host("source"), "trust": F.col("trust_q") / 255.0})


def _side(pol: Column, prefix: str, sign: int) -> Column:
    return F.when(pol == 1, F.col(f"{prefix}{sign}")).when(pol == -1, F.col(f"{prefix}{-sign}"))


def keyed(triples: DataFrame) -> DataFrame:
    """triples with their topic: 128 bits for both stem sets."""
    return triples.withColumns({"t1": F.xxhash64("ss", "os"), "t2": F.xxhash64(F.lit(1), "ss", "os")})


def voices(triples: DataFrame) -> DataFrame:
    """(topic, host, h1, h-1, h0): whether a host says each sign about a topic."""
    return triples.groupBy(*TOPIC, "host").agg(*[F.max((F.col("pol") == s).cast("int")).alias(f"h{s}") for s in SIGNS])


def numbers(heard: DataFrame) -> DataFrame:
    """(topic, n1, n-1, n0): how many hosts say each sign about a topic."""
    return heard.groupBy(*TOPIC).agg(*[F.sum(f"h{s}").alias(f"n{s}") for s in SIGNS])


def told_of(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """voices and numbers of rows with their topic."""
    heard = voices(own)
    return heard, numbers(heard)


def corroborate(triples: DataFrame, heard: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """triples with syn, ant and corr.

    syn counts the other hosts that say the same about the same topic (both stem sets), ant those that say the opposite.
    Hosts are first reduced to one row a topic, and topics to three numbers, so a hot topic meets its rows as numbers; both
    can be given where they are kept (voices and numbers of all triples).
    """
    own = keyed(triples)
    heard = voices(own) if heard is None else heard
    return _corroborated(own, heard, numbers(heard) if counted is None else counted).drop(*TOPIC)


def _corroborated(own: DataFrame, heard: DataFrame, counted: DataFrame) -> DataFrame:
    """Rows with a topic, host and pol, with syn, ant and corr."""
    joined = own.join(heard.join(counted, TOPIC), [*TOPIC, "host"])
    pol = F.col("pol")
    syn = (F.coalesce(_side(pol, "n", 1), F.col("n0")) - 1).cast("int")
    ant = F.coalesce(_side(pol, "n", -1) - _side(pol, "h", -1), F.lit(0)).cast("int")
    numbered = joined.withColumns({"syn": syn, "ant": ant}).drop(*[f"{x}{s}" for x in "hn" for s in SIGNS])
    return numbered.withColumn("corr", (F.col("syn") + 1) / (F.col("syn") + F.col("ant") + 1) * (1 + VOICE_GAIN * F.least("syn", F.lit(MOST_VOICES))))


def candidates(claims: DataFrame, triples: DataFrame) -> DataFrame:
    """Pairs of a claim (claim_id, cs, co, cpol) and a triple whose subject shares a stem with the claim's.

    Each pair meets once: at the first stem that both have.
    """
    return met(claims, triples.withColumn("stem", F.explode("ss")))


def met(claims: DataFrame, postings: DataFrame) -> DataFrame:
    """The same of triples that stand once for each stem of their subject (`stem`), as an index has them."""
    asked = claims.select("claim_id", F.col("s").alias("cs"), F.col("o").alias("co"), F.col("pol").alias("cpol"), F.explode("s").alias("stem"))
    return asked.join(postings, "stem").filter(F.col("stem") == F.get(F.array_intersect("cs", "ss"), F.lit(0))).drop("stem")


def evidence(claims: DataFrame, triples: DataFrame, now: float) -> DataFrame:
    """The best triple of each voice (claim, host, topic, stance): claim_id, row, the triple, stance, weight, corr, first_row.

    Weights have 12 places. Ties keep the triple with the least row; first_row is the least row of the voice, which orders evidence of equal weight.
    triples need topics and corr.
    """
    return weighed(candidates(claims, triples), now)


def _graded(found: DataFrame, now: float) -> DataFrame:
    """Candidates with stance, topic, recency and part, what a weight is made of beside trust and corr."""
    none = F.size("co") == 0
    full = none | F.arrays_overlap("co", F.array_union("os", "ss"))
    stance = F.when(~full | (F.col("pol") == 0) | (F.col("cpol") == 0), "neutral").when(F.col("pol") == F.col("cpol"), "for").otherwise("against")
    topic = F.when(full & ~none, F.array_sort(F.array_intersect("os", "co"))).otherwise(F.col("os"))
    return found.withColumns({"stance": stance, "topic": topic, "recency": nlp.recency("added", now), "part": F.when(full, 1.0).otherwise(PARTIAL)})


def _weight() -> Column:
    return F.round(F.col("trust") * F.col("corr") * F.col("recency") * F.col("part"), 12)


def _whole(weight: str) -> Column:
    """The 12 places of a weight above those of any row."""
    return F.round(F.col(weight) * 1e12).cast("decimal(18,0)").cast("decimal(38,0)") * F.lit("1" + "0" * 19).cast("decimal(20,0)")


def ahead(weight: str, row: str) -> Column:
    """A number that is larger for the heavier, then for the lesser row (not negative), and that hash aggregates hold, as they can't a struct."""
    return (_whole(weight) - F.col(row).cast("decimal(20,0)")).cast("decimal(38,0)")


def light_evidence(claims: DataFrame, triples: DataFrame, now: float) -> DataFrame:
    """evidence of triples with topics, without the triple: claim_id, host, stance, row, weight, first_row, and the topic of the row.

    Rows that no claim meets aren't corroborated, and a voice is named by 128 bits, so what is sorted and held for a
    candidate is of fixed width but for its host, and no aggregate needs a sort.
    """
    own = keyed(triples)
    return lightest(candidates(claims, own), *told_of(own), now)


def lightest(found: DataFrame, heard: DataFrame, counted: DataFrame, now: float) -> DataFrame:
    """The same of candidates with their topic, by voices and numbers."""
    voice = {"v1": F.xxhash64("ss", "topic"), "v2": F.xxhash64(F.lit(1), "ss", "topic")}
    pairs = _graded(found, now).withColumns(voice).select("claim_id", "host", *TOPIC, *voice, "stance", "pol", "trust", "recency", "part", "row")
    given = _corroborated(pairs, heard, counted).withColumn("weight", _weight()).withColumn("ahead", ahead("weight", "row"))
    firsts = [F.max_by(t, "ahead").alias(t) for t in TOPIC]
    best = given.groupBy("claim_id", "host", *voice, "stance").agg(F.max("weight").alias("weight"), F.max("ahead").alias("ahead"), F.min("row").alias("first_row"), *firsts)
    return best.select("claim_id", "host", "stance", (_whole("weight") - F.col("ahead")).cast("long").alias("row"), "weight", "first_row", *TOPIC)


def weighed(found: DataFrame, now: float) -> DataFrame:
    """The evidence that candidates (with corr) come to."""
    graded = _graded(found, now).withColumn("weight", _weight())
    fields = ["row", "subject", "predicate", "object", "source", "added", "trust", "pol", "corr", "weight"]
    best = graded.groupBy("claim_id", "host", "ss", "topic", "stance").agg(F.max_by(F.struct(*fields), F.struct("weight", -F.col("row"))).alias("best"), F.min("row").alias("first_row"))
    return best.select("claim_id", *[F.col(f"best.{f}").alias(f) for f in fields], "host", "stance", "first_row")


def ranked_by_ranges(found: DataFrame) -> DataFrame:
    """ranked of evidence of any size: no task orders all of a claim's."""
    return running(stored(found), ["claim_id"], [F.desc("weight"), F.asc("first_row")], {"place": F.lit(1).cast("long")})


def ranked(found: DataFrame) -> DataFrame:
    """Evidence with place, from 1 for the heaviest of its claim, where a claim's evidence is one task's."""
    return found.withColumn("place", F.row_number().over(Window.partitionBy("claim_id").orderBy(F.desc("weight"), "first_row")))


def tally(claims: DataFrame, found: DataFrame) -> DataFrame:
    """One row per claim: the three shares, n_full (items that aren't neutral), hosts and items.

    Each stance starts from a prior of 0.15, so a claim without evidence has a third each.
    """
    sums = [F.sum(F.when(F.col("stance") == s, F.col("weight")).otherwise(0.0)).alias(f"w_{s}") for s in STANCES]
    per = found.groupBy("claim_id").agg(*sums, F.sum((F.col("stance") != "neutral").cast("long")).alias("n_full"), F.countDistinct("host").alias("hosts"), F.count(F.lit(1)).alias("items"))
    full = claims.select("claim_id").join(per, "claim_id", "left")
    bucket = {s: F.lit(PRIOR) + F.coalesce(f"w_{s}", F.lit(0.0)) for s in STANCES}
    total = bucket["for"] + bucket["against"] + bucket["neutral"]
    return full.select("claim_id", *[(bucket[s] / total).alias(f"{s}_share") for s in STANCES], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_full", "hosts", "items")])


def verdicts(tallies: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_HOSTS) -> DataFrame:
    """tallies with leader, leader_share, resolved and verdict.

    Ties go to for, then against. Resolved are leaders with the threshold's share where enough hosts, those of neutral
    items included, and enough items that aren't neutral speak.
    """
    a, b, c = (F.col(f"{s}_share") for s in STANCES)
    leader = F.when((a >= b) & (a >= c), "for").when(b >= c, "against").otherwise("neutral")
    out = tallies.withColumns({"leader": leader, "leader_share": F.greatest(a, b, c)})
    out = out.withColumn("resolved", (F.col("leader_share") >= threshold) & (F.col("hosts") >= least) & (F.col("n_full") >= least))
    return out.withColumn("verdict", F.when(F.col("resolved"), F.col("leader")).otherwise("unresolved"))


def evaluate(claims: DataFrame, triples: DataFrame, now: float) -> DataFrame:
    """Verdicts of claims (claim_id, s, o, pol) over triples (row, subject, predicate, object, source, added, trust_q)."""
    return verdicts(tally(claims, evidence(claims, corroborate(with_topics(triples)), now)))
