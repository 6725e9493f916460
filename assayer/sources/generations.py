"""Versioned snapshots of a memory: Parquet tables with the SHA-256 of each of their files, written aside and then pointed to.

Files are renamed through Hadoop's file system, so a snapshot can lie wherever Spark reads and writes. Their digests are
a table beside them, made and compared by tasks.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.operators import store
from assayer.sources.folder import Folder, digested

VERSION, KEPT = 2, 2
TABLES = ("strings", "triples")
#: Rows of a file at most, as a file is digested in one piece.
FILE_ROWS = 4_000_000


class Generations(Folder):
    """The snapshots below a folder."""

    def _digests(self, name: str) -> DataFrame:
        """(file, bytes, sha256) of the Parquet files of a snapshot's tables."""
        files = digested(self.spark, [f"{self.folder}/{name}/{t}" for t in TABLES])
        return files.select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), "bytes", "sha256")

    def _is_whole(self, name: str) -> bool:
        """Whether a snapshot has the files that it was written with, and no others."""
        told = self.spark.read.schema("file string, bytes long, sha256 string").parquet(f"{self.folder}/{name}/files")
        return told.withColumn("told", F.lit(1)).unionByName(self._digests(name).withColumn("told", F.lit(0))).groupBy("file", "bytes", "sha256").agg(F.count(F.lit(1)).alias("n"), F.sum("told").alias("told")).filter("n <> 2 OR told <> 1").isEmpty()

    def save(self, triples: DataFrame, keep: int = KEPT) -> str:
        """Writes a snapshot of triples (subject, predicate, object, source, added, trust_q, hits) and points to it."""
        name = self._next()
        strings, coded = store.encode(triples.select(*store.KEY, "added", "trust_q", "hits"))
        self._fs.delete(self._at(f"{name}.tmp"), True)
        strings.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.folder}/{name}.tmp/strings")
        coded.write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.folder}/{name}.tmp/triples")
        self._digests(f"{name}.tmp").write.parquet(f"{self.folder}/{name}.tmp/files")
        self._put(f"{name}.tmp/manifest.json", json.dumps({"version": VERSION, "tables": list(TABLES)}))
        self._publish(name)
        for old in self.names()[: -max(KEPT, keep)]:
            self._fs.delete(self._at(old), True)
        self._sweep()
        return name

    def load(self, strict: bool = False) -> tuple[DataFrame | None, list[str]]:
        """(triples, warnings) of the current snapshot, or else of the newest that is whole; None where there is none.

        Rows that aren't valid triples are left out; strict: a snapshot with ids that no string has isn't taken, and having
        none at all is an error.
        """
        warnings = []
        for name in self.newest_first():
            try:
                told = json.loads(self._text(f"{name}/manifest.json") or "")
                if told.get("version") != VERSION or told["tables"] != list(TABLES) or not self._is_whole(name):
                    raise ValueError("the tables aren't those of the manifest")
                coded = self.spark.read.parquet(f"{self.folder}/{name}/triples")
                triples = store.decode(self.spark.read.parquet(f"{self.folder}/{name}/strings"), coded)
                if strict and triples.count() != coded.count():
                    raise ValueError("an id has no string")
                return triples if strict else triples.filter(store.is_valid()), warnings
            except Exception as e:  # any damage leads to the next one
                warnings.append(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        if strict:
            raise ValueError(f"no snapshot can be read in {self.folder}: {warnings}")
        return None, warnings
