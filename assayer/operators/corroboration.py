"""Corroboration kept up by batches: which hosts say what about each topic, and how many, as tables beside the memory.

A batch touches the topics of its triples; their hosts are merged and counted anew, other topics stay as they are. Both
tables are copy-on-write buckets of the topic, so a batch costs what the buckets of its topics hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.shared import stored
from assayer.operators import score
from assayer.sources.buckets import Buckets

HEARD = [f"h{s}" for s in score.SIGNS]
COUNTED = [f"n{s}" for s in score.SIGNS]


def _merged(old: DataFrame | None, new: DataFrame) -> DataFrame:
    both = new if old is None else old.unionByName(new)
    return both.groupBy(*score.TOPIC, "host").agg(*[F.max(h).alias(h) for h in HEARD])


def _latest(old: DataFrame | None, new: DataFrame) -> DataFrame:
    return new if old is None else new.unionByName(old.join(new.select(*score.TOPIC), score.TOPIC, "left_anti"))


class Corroboration:
    """The tables below a folder: voices (topic, host, h1, h-1, h0) and numbers (topic, n1, n-1, n0)."""

    def __init__(self, spark: SparkSession, folder: str, **sizes):
        self.voices = Buckets(spark, f"{folder}/voices", score.TOPIC, **sizes)
        self.numbers = Buckets(spark, f"{folder}/numbers", score.TOPIC, **sizes)

    def take_in(self, triples: DataFrame) -> DataFrame:
        """Takes in triples with topics, new ones or all, and returns the topics (t1, t2) whose numbers are others than before.

        The same batch again changes nothing: numbers are counted from the voices of the topics touched, not added to.
        """
        said = stored(score.voices(score.keyed(triples)))
        self.voices.merge(said, _merged)
        touched = stored(said.select(*score.TOPIC).distinct())
        counted = stored(score.numbers(self._of(self.voices, touched)))
        before = self._of(self.numbers, touched)
        changed = counted if before is None else counted.join(before, [*score.TOPIC, *COUNTED], "left_anti")
        changed = stored(changed)
        self.numbers.merge(changed, _latest)
        return changed.select(*score.TOPIC)

    def _of(self, table: Buckets, topics: DataFrame) -> DataFrame | None:
        """What a table has of some topics, read from their buckets alone."""
        names = table.newest_first()
        if not names:
            return None
        _, rows, _ = table.load(table.touched(topics, names[0]))
        return None if rows is None else rows.join(topics, score.TOPIC, "left_semi")

    def corroborate(self, triples: DataFrame) -> DataFrame:
        """triples with syn, ant and corr by the tables, which must have taken in all that the triples say; only the buckets of their topics are read."""
        return score.corroborate(triples, *self.told_of(score.keyed(triples)))

    def told_of(self, own: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The voices and numbers of the topics (t1, t2) of rows, counted from the rows where nothing is kept."""
        topics = stored(own.select(*score.TOPIC).distinct())
        voices, numbers = self._of(self.voices, topics), self._of(self.numbers, topics)
        return score.told_of(own) if voices is None or numbers is None else (voices, numbers)
