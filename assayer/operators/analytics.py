"""Analytics over stored triples and saved routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import nlp


def with_polarity(triples: DataFrame) -> DataFrame:
    return triples.withColumn("polarity", nlp.polarity("predicate", "object"))


def host_stats(triples: DataFrame) -> DataFrame:
    """By host: triples, mean_trust, newest and oldest."""
    return triples.groupBy("host").agg(F.count(F.lit(1)).alias("triples"), F.avg("trust").alias("mean_trust"), F.max("added").alias("newest"), F.min("added").alias("oldest")).orderBy(F.desc("triples"), "host")


def contested(triples: DataFrame, min_hosts: int = 2) -> DataFrame:
    """Subjects and objects, as they are written, on which hosts take both sides: hosts, for_hosts, against_hosts.

    Rows are first reduced to one a host, so a pair with very many rows is small when its hosts meet.
    """
    sided = with_polarity(triples).filter("polarity <> 0").groupBy("subject", "object", "host").agg(F.max((F.col("polarity") > 0).cast("long")).alias("f"), F.max((F.col("polarity") < 0).cast("long")).alias("a"))
    out = sided.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("hosts"), F.sum("f").alias("for_hosts"), F.sum("a").alias("against_hosts"))
    return out.filter((F.col("for_hosts") > 0) & (F.col("against_hosts") > 0) & (F.col("hosts") >= min_hosts)).orderBy(F.desc("hosts"), "subject", "object")


def trust_weighted_balance(triples: DataFrame) -> DataFrame:
    """By subject and object: trust for less trust against, one vote a host, which votes against where its mean polarity isn't above 0."""
    voted = with_polarity(triples).filter("polarity <> 0").groupBy("subject", "object", "host").agg(F.avg("polarity").alias("mean"), F.max("trust").alias("trust"))
    signed = F.when(F.col("mean") > 0, F.col("trust")).otherwise(-F.col("trust"))
    return voted.groupBy("subject", "object").agg(F.sum(signed).alias("balance"), F.count(F.lit(1)).alias("hosts")).orderBy("balance", "subject", "object")


def age_histogram(triples: DataFrame, now: float) -> DataFrame:
    """Triples by whole years of 365 days of age; what is dated ahead is of age 0."""
    years = F.greatest(F.lit(0), F.floor(F.floor((F.lit(float(now)) - F.col("added")) / 86400) / 365)).cast("long")
    return triples.groupBy(years.alias("years")).agg(F.count(F.lit(1)).alias("triples")).orderBy("years")


def route_summary(routes: DataFrame) -> DataFrame:
    """One row: routes, verdicts (a map of counts), mean_steps, and the keys of the five most replayed routes; ties by key."""
    counts = routes.groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("verdict", "n")))).alias("verdicts"))
    most = routes.orderBy(F.desc("hits"), "key").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("h"), "key"))), lambda x: x["key"]).alias("most_replayed"))
    return routes.agg(F.count(F.lit(1)).alias("routes"), F.avg("n_steps").alias("mean_steps")).crossJoin(counts).crossJoin(most)
