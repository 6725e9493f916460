"""Reports of a memory and of answers as JSON lines and as metrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions.lexicon import STANCES
from assayer.operators import analytics


def memory_report(facts: DataFrame, routes: DataFrame) -> DataFrame:
    """One row with `report`: triples, hosts, contested pairs and the summary of routes, as JSON. facts have host and trust."""
    hosts = analytics.host_stats(facts).agg(F.array_sort(F.collect_list(F.struct((-F.col("triples")).alias("n"), "host", "triples", "mean_trust"))).alias("h"))
    split = analytics.contested(facts).agg(F.array_sort(F.collect_list(F.struct("subject", "object", "hosts", "for_hosts", "against_hosts"))).alias("contested"))
    summary = analytics.route_summary(routes).select(F.struct("routes", "mean_steps", "verdicts", "most_replayed").alias("routes"))
    whole = facts.agg(F.count(F.lit(1)).alias("triples")).crossJoin(hosts).crossJoin(split).crossJoin(summary)
    by_host = F.transform("h", lambda x: F.struct(x["host"].alias("host"), x["triples"].alias("triples"), x["mean_trust"].alias("mean_trust")))
    return whole.select(F.to_json(F.struct("triples", by_host.alias("hosts"), "contested", "routes")).alias("report"))


def answers(verdicts: DataFrame, told: DataFrame, claims: DataFrame) -> DataFrame:
    """(claim_id, answer): claim, verdict, shares and prose of each claim as JSON."""
    joined = claims.select("claim_id", F.col("text").alias("claim")).join(verdicts, "claim_id").join(told, "claim_id", "left")
    shares = F.struct(*[F.col(f"{s}_share").alias(s) for s in STANCES])
    return joined.select("claim_id", F.to_json(F.struct("claim", "verdict", "resolved", shares.alias("shares"), "prose")).alias("answer"))


def metrics(counters: DataFrame) -> DataFrame:
    """One row with `text`: a line for each counter (name, value), by name, with its type."""
    line = F.concat(F.lit("# TYPE "), "name", F.lit(" counter\n"), "name", F.lit(" "), F.col("value").cast("string"), F.lit("\n"))
    return counters.groupBy("name").agg(F.sum("value").alias("value")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda r: r["line"]), "").alias("text"))
