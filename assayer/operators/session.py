"""Answering as a session: saved routes answer at once, what is searched is saved as a route, and memory and counts go on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.shared import stored
from assayer.operators import resolve
from assayer.sources import outline

ROUTES = "key string, verdict string, for_share double, against_share double, neutral_share double, t long, hits int, steps array<struct<topic: string, links: array<string>>>, place int"


@dataclass
class Session:
    """A memory with its topic counts and saved routes, which each answer takes further."""

    memory: DataFrame
    counts: DataFrame
    routes: DataFrame

    @classmethod
    def begin(cls, spark: SparkSession) -> Session:
        return cls(resolve.empty_memory(spark), spark.createDataFrame([], "topic string, count long"), spark.createDataFrame([], ROUTES))

    def answer(self, claims: DataFrame, library: resolve.Library, now: float, cycles: int = 0) -> resolve.Outcome:
        """Resolves claims and keeps what came of it: a replayed route has one more hit, a searched claim's route is saved.

        Claims with the same key have one route, that of the greatest claim_id; one that replaces its like has its hits and one more.
        """
        out = resolve.resolve(claims, library, self.memory, now, self.counts, self.routes.select("key"), cycles)
        told = stored(claims.select("claim_id", "key").join(out.rounds, "claim_id").join(out.verdicts, "claim_id"))
        steps = out.steps.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("step", "topic", "links"))).alias("steps"))  # 32 at most
        new = told.filter("rounds > 0").join(steps, "claim_id", "left").withColumn("steps", F.coalesce(F.transform("steps", lambda s: F.struct(s["topic"].alias("topic"), s["links"].alias("links"))), F.array().cast("array<struct<topic: string, links: array<string>>>")))
        fields = ["verdict", "for_share", "against_share", "neutral_share", "steps"]
        new = new.groupBy("key").agg(F.max_by(F.struct(*fields), "claim_id").alias("r")).select("key", *[F.col(f"r.{f}").alias(f) for f in fields[:-1]], F.lit(int(now)).cast("long").alias("t"), F.lit(0).alias("hits"), "r.steps")
        replayed = told.filter("rounds = 0").select("key").join(self.routes.select("key"), "key", "left_semi")
        self.routes = stored(outline.mark_hits(outline.save_route(self.routes, stored(new)), replayed).select(*self.routes.columns))
        self.memory, self.counts = stored(out.memory), out.counts
        return out
