"""A kept index from subject stems to triples: sorted segments, each a batch, that are merged as they grow in number.

A posting is a triple with its topics, so that claims are answered from the index alone. The list of files has the first
and last stem of each; a probe reads the files whose range holds one of its stems, and in them the row groups that do.
"""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.functions.shared import stored
from assayer.operators import score, store
from assayer.sources.folder import Folder

VERSION, KEPT = 1, 2
#: Segments beyond which the smaller ones are merged, and what a segment must have over all smaller ones to stay as it is.
MOST_SEGMENTS, FACTOR = 4, 4
#: Stems of a probe that are looked up in the list of files; a probe of more reads all files.
MOST_STEMS = 10_000
FILES = "segment string, file string, rows long, low string, high string"
COLUMNS = ["row", *store.KEY, "added", "trust_q", "ss", "os", "pol", "host"]


class StemIndex(Folder):
    """The index below a folder."""

    def __init__(self, spark: SparkSession, folder: str, most_segments: int = MOST_SEGMENTS):
        super().__init__(spark, folder)
        self.most_segments = most_segments

    def files(self) -> list:
        """(segment, file, rows, low, high) of the current snapshot: a row a file."""
        names = self.newest_first()
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/{names[0]}/files").collect() if names else []

    def _read(self, files: list) -> DataFrame:
        told = json.loads(self._text(f"{self.newest_first()[0]}/manifest.json"))
        return self.spark.read.schema(StructType.fromJson(told["schema"])).parquet(*[f"{self.folder}/{f['file']}" for f in files])

    def add(self, triples: DataFrame) -> str | None:
        """Adds a batch of triples (row, subject, predicate, object, source, added, trust_q, with topics) as a segment, or returns None for none.

        A triple that is there already, with a later `added` or higher `trust_q`, is simply added: probes take the best of its postings.
        triples are read twice, to find the ranges of stems and to deal them, and should be stored if they are costly.
        """
        postings = triples.select(*COLUMNS).withColumn("stem", F.explode("ss"))
        if postings.isEmpty():
            return None
        held = self.files()
        sizes: dict[str, int] = {}
        for f in held:
            sizes[f["segment"]] = sizes.get(f["segment"], 0) + f["rows"]
        merged: set[str] = set()
        if len(sizes) >= self.most_segments:  # from the smallest on, those that don't outweigh all smaller ones
            total = postings.count()
            for name, rows in sorted(sizes.items(), key=lambda x: x[1]):
                if rows > FACTOR * total:
                    break
                merged.add(name)
                total += rows
        if merged:
            postings = _best(postings.unionByName(self._read([f for f in held if f["segment"] in merged]).select(*postings.columns)))
        return self._publish_segment(postings, [f for f in held if f["segment"] not in merged])

    def _publish_segment(self, postings: DataFrame, others: list) -> str:
        name, schema = self._next(), postings.schema.jsonValue()
        data = f"{self.folder}/data/{name}"
        self._fs.delete(self._at(f"data/{name}"), True)  # of a save that did not end
        self._fs.delete(self._at(f"{name}.tmp"), True)
        postings.repartitionByRange("stem", "row").sortWithinPartitions("stem", "row").write.parquet(data)
        new = self.spark.read.schema(postings.schema).parquet(data).groupBy(F.regexp_extract("_metadata.file_path", "(data/gen-[0-9]+/[^/]+)$", 1).alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min("stem").alias("low"), F.max("stem").alias("high"))
        new = new.select(F.lit(name).alias("segment"), "file", "rows", "low", "high")
        self.spark.createDataFrame([tuple(f) for f in others], FILES).unionByName(new).coalesce(1).write.parquet(f"{self.folder}/{name}.tmp/files")  # a row a file
        self._put(f"{name}.tmp/manifest.json", json.dumps({"version": VERSION, "schema": schema}))
        self._publish(name)
        self._collect()
        return name

    def _collect(self) -> None:
        """Deletes all but the newest snapshots, and the segments that only those deleted have named."""
        names = self.names()
        named = {f["segment"] for n in names[-KEPT:] for f in self.spark.read.schema(FILES).parquet(f"{self.folder}/{n}/files").select("segment").distinct().collect()}
        for old in names[:-KEPT]:
            self._fs.delete(self._at(old), True)
        for s in self._fs.listStatus(self._at("data")):
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
        self._sweep()

    def holding(self, stems: list[str] | None) -> list:
        """The files whose range holds one of the sorted stems; all for None."""
        found = self.files()
        if stems is None:
            return found
        return [f for f in found if (at := bisect_left(stems, f["low"])) < len(stems) and stems[at] <= f["high"]]

    def probe(self, claims: DataFrame, light: bool = False) -> DataFrame | None:
        """The postings of the stems of claims (s), each triple once a stem with its latest `added` and highest `trust_q`; None for no files.

        Light ones have 128 bits (k1, k2) in the place of the triple.
        """
        asked = stored(claims.select(F.explode("s").alias("stem")).distinct())
        known = sorted(r["stem"] for r in asked.limit(MOST_STEMS + 1).collect())
        few = len(known) <= MOST_STEMS
        files = self.holding(known if few else None)
        if not files:
            return None
        rows = self._read(files)
        some = rows.filter(F.col("stem").isin(known)) if few and len(known) <= 1000 else rows.join(asked, "stem", "left_semi")
        if light:
            some = some.withColumns({"k1": F.xxhash64(*store.KEY), "k2": F.xxhash64(F.lit(1), *store.KEY)}).drop(*store.KEY)
        return _best(some, ["k1", "k2"] if light else store.KEY)

    def evidence(self, claims: DataFrame, now: float, corroborate=score.corroborate) -> DataFrame | None:
        """score.evidence of claims over the triples of the index, from the postings of their stems; None where no file has any.

        A topic has one set of subject stems, so what claims meet has whole topics; corroborate can be that of kept tables.
        """
        postings = self.probe(claims)
        if postings is None:
            return None
        facts = stored(postings.withColumn("trust", F.col("trust_q") / 255.0))
        return score.weighed(score.met(claims, corroborate(facts)), now)

    def light_evidence(self, claims: DataFrame, now: float, told_of=score.told_of) -> DataFrame | None:
        """score.light_evidence in the same way: what is moved for a posting is of fixed width but for its stems and host, and nothing is sorted.

        told_of can be that of kept tables. Claims (a few) are broadcast, so that no task gets all postings of a stem.
        """
        postings = self.probe(claims, light=True)
        if postings is None:
            return None
        own = stored(score.keyed(postings.withColumn("trust", F.col("trust_q") / 255.0)).drop("trust_q", "k1", "k2"))
        return score.lightest(score.met(F.broadcast(claims), own), *told_of(own), now)


def _best(postings: DataFrame, key: list[str] = store.KEY) -> DataFrame:
    """Postings with each triple once a stem. Its topics follow from it, and are grouped by since hash aggregates can't hold lists as values."""
    best = postings.groupBy("stem", *key, "ss", "os", "pol", "host").agg(F.min("row").alias("row"), F.max("added").alias("added"), F.max("trust_q").alias("trust_q"))
    return best.select("row", *key, *[c for c in COLUMNS[1:] if c not in store.KEY], "stem")
