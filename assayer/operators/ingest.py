"""From documents to triples: the gate, sentences, readings, answered questions, and a cap for each document."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions import readings, text
from assayer.functions.shared import hot_join, stored
from assayer.operators import gate, store
from assayer.sources.buckets import Buckets

MOST_PER_DOC = 200


def sentence_ids() -> list:
    """128 bits that stand for a sentence, so that no shuffle but the first carries it."""
    return [F.xxhash64("sentence").alias("s1"), F.xxhash64(F.lit(1), "sentence").alias("s2")]


class Heard(NamedTuple):
    """What the admitted docs say, cleaned once: docs (doc, source, added, trust_q, parts, pairs), and their distinct sentences, read once.

    few: the docs are few, so their sentences aren't written, but read where found_triples names them, once.
    """

    docs: DataFrame
    read: DataFrame
    few: bool = False


def counted(sentences: DataFrame) -> DataFrame:
    """(s1, s2, sentence, heard): the distinct sentences and how often each stands."""
    return sentences.groupBy("sentence").agg(F.count(F.lit(1)).alias("heard")).select(*sentence_ids(), "sentence", "heard")


def read(told: DataFrame) -> DataFrame:
    """told (with sentence) with directive and readings; directive ones have no readings.

    They are dealt anew, as reading costs more than their size tells.
    """
    n = int(told.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = told.repartition(n).withColumn("directive", text.is_directive("sentence"))
    return marked.withColumn("readings", readings.voted_readings(F.when(~F.col("directive"), F.col("sentence"))))


def parse(sentences: DataFrame, cache: ParseCache | None = None) -> DataFrame:
    """(s1, s2, sentence, heard, directive, readings) of the distinct sentences, written, so that each is read once; of a cache, those that it knows aren't read."""
    told = counted(sentences)
    return stored(read(told)) if cache is None else cache.parse(told)


class ParseCache:
    """Readings kept from job to job below a folder, in buckets of the sentence's 128 bits.

    A job reads the buckets of its sentences and the sentences that aren't there; sentences that no job has met for `keep`
    generations leave when their bucket is next rewritten. `last_read` tells how many sentences the last job read itself.
    """

    KEPT = ["s1", "s2", "directive", "readings", "used"]

    def __init__(self, spark: SparkSession, folder: str, keep: int = 8, **sizes):
        self.table, self.keep, self.last_read = Buckets(spark, folder, ["s1", "s2"], **sizes), keep, 0

    def parse(self, told: DataFrame) -> DataFrame:
        told = stored(told)
        names = self.table.newest_first()
        now = 1 + max((int(n[4:]) for n in names), default=0)
        held = None
        if names:
            _, held, _ = self.table.load(self.table.touched(told, names[0]))
        if held is None:
            fresh = stored(read(told))
            met = fresh
        else:
            known = stored(told.join(held, ["s1", "s2"]))  # a row a sentence of this job
            fresh = stored(read(told.join(known.select("s1", "s2"), ["s1", "s2"], "left_anti")))
            met = known.select(*fresh.columns).unionByName(fresh)
        self.last_read = fresh.count()
        kept = fresh.withColumn("used", F.lit(now))
        if held is not None:  # those in use for half their time are told anew
            kept = kept.select(*self.KEPT).unionByName(known.filter(F.col("used") <= now - max(1, self.keep // 2)).withColumn("used", F.lit(now)).select(*self.KEPT))

        def combine(old: DataFrame | None, new: DataFrame) -> DataFrame:
            return new if old is None else new.unionByName(old.join(new.select("s1", "s2"), ["s1", "s2"], "left_anti").filter(F.col("used") > now - self.keep))

        self.table.merge(kept.select(*self.KEPT), combine)
        return met


def hear(docs: DataFrame, trust: DataFrame, doc_col: str = "doc", cache: ParseCache | None = None) -> Heard:
    """The docs (doc, locator, text, added) that the gate admits: their sentences (parts) and the questions that they answer (pairs).

    Of a text, text.LONGEST characters are read.
    """
    return heard(listened(docs, trust, doc_col), cache)


def heard(split: DataFrame, cache: ParseCache | None = None) -> Heard:
    """What docs say that are split already."""
    return Heard(split, parse(split.select(F.explode("parts").alias("sentence")), cache))


def heard_of_few(split: DataFrame) -> Heard:
    """The same of docs whose number doesn't follow the table's, to be read by found_triples alone."""
    return Heard(split, read(counted(split.select(F.explode("parts").alias("sentence")))), few=True)


def listened(docs: DataFrame, trust: DataFrame, doc_col: str = "doc") -> DataFrame:
    """The docs of hear, written, before their sentences are read."""
    return split(admitted(docs, trust, doc_col))


def admitted(docs: DataFrame, trust: DataFrame, doc_col: str = "doc") -> DataFrame:
    """(doc, locator, added, trust, text) of the docs that the gate admits."""
    return gate.admit(docs, trust).filter("admitted").select(F.col(doc_col).alias("doc"), "locator", "added", "trust", "text")


def split(admitted: DataFrame) -> DataFrame:
    """Admitted docs, written: (doc, source, added, trust_q, parts, pairs). Texts are dealt anew, as cleaning costs more than moving them."""
    n = int(admitted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = admitted.repartition(n).select("doc", F.col("locator").alias("source"), "added", store.trust_q("trust").alias("trust_q"), text.clean("text", text.LONGEST).alias("cleaned"))
    return stored(clean.select("doc", "source", "added", "trust_q", text.sentence_parts("cleaned").alias("parts"), readings.answered_questions("cleaned").alias("pairs")))


def found_triples(heard: Heard) -> DataFrame:
    """(doc, at, subject, predicate, object, source, added, trust_q): what the docs heard say, in order and up to 200 each.

    Sentences come first, each with its readings, then the questions that the text answers. A sentence that many documents
    have meets them by broadcast.
    """
    facts = ["doc", "source", "added", "trust_q"]
    said = heard.docs.select(*facts, F.posexplode("parts").alias("k", "sentence"))
    read = heard.read.filter(F.size("readings") > 0).select("s1", "s2", "heard", "readings")
    told = said.select(*facts, "k", *sentence_ids())
    met = told.join(read.drop("heard"), ["s1", "s2"]) if heard.few else hot_join(told, read, ["s1", "s2"], "heard")
    spoken = met.select(*facts, F.lit(0).alias("part"), "k", F.posexplode("readings").alias("i", "r"))
    pairs = heard.docs.select(*facts, F.posexplode("pairs").alias("k", "pair")).filter(~text.is_directive(F.col("pair.question")))
    answers = pairs.select(*facts, F.lit(1).alias("part"), "k", F.col("pair.denied").alias("denied"), F.posexplode(readings.question_readings(F.col("pair.question"))).alias("i", "r"))
    p = F.col("r.predicate")
    turned = F.when(p.startswith("not "), F.regexp_replace(p, "^not ", "")).otherwise(F.concat(F.lit("not "), p))
    order = [*facts, "part", "k", "i"]
    spoken = spoken.select(*order, "r.subject", "r.predicate", "r.object")
    spoken = spoken.unionByName(answers.select(*order, "r.subject", F.when(F.col("denied"), turned).otherwise(p).alias("predicate"), "r.object"))
    numbered = spoken.withColumn("at", F.row_number().over(Window.partitionBy("doc").orderBy("part", "k", "i")))
    return numbered.filter(F.col("at") <= MOST_PER_DOC).drop("part", "k", "i")


def attempts(docs: DataFrame, trust: DataFrame, doc_col: str = "doc", heard: Heard | None = None) -> DataFrame:
    """(doc, at, subject, predicate, object, source, added, trust_q, valid) of the docs (doc, locator, text, added) that the gate admits."""
    return found_triples(hear(docs, trust, doc_col) if heard is None else heard).withColumn("valid", store.is_valid())


def stats(docs: DataFrame, trust: DataFrame, tried: DataFrame, memory: DataFrame | None = None, heard: Heard | None = None) -> DataFrame:
    """One row: docs, rejected_docs, dropped (directive sentences), triples (attempts), new_triples."""
    heard = hear(docs, trust) if heard is None else heard
    keys = tried.filter("valid").select(*store.KEY).distinct()
    fresh = keys if memory is None else keys.join(memory.select(*store.KEY), store.KEY, "left_anti")
    one = lambda df, name, n=F.count(F.lit(1)): df.agg(F.lit(name).alias("name"), F.coalesce(n, F.lit(0)).cast("long").alias("n"))
    # Directive sentences were counted as they were read.
    counts = one(docs, "all").unionAll(one(heard.docs, "docs")).unionAll(one(heard.read.filter("directive"), "dropped", F.sum("heard"))).unionAll(one(tried, "triples")).unionAll(one(fresh, "new_triples"))
    named = counts.agg(*[F.sum(F.when(F.col("name") == c, F.col("n"))).alias(c) for c in ("all", "docs", "dropped", "triples", "new_triples")])
    return named.select("docs", (F.col("all") - F.col("docs")).alias("rejected_docs"), "dropped", "triples", "new_triples")
