"""A keyed table that is kept up by copy-on-write: a batch rewrites the buckets of its keys, and a snapshot names the files of all.

Files lie below data/ and are never changed. A snapshot is a table (bucket, file, rows, bytes, sha256) of the files that it
consists of, most of which earlier snapshots have written. The pointer CURRENT is renamed over the old one, so readers see
a whole snapshot before and after a batch; files that no kept snapshot names are deleted behind it.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assayer.functions.shared import stored
from assayer.sources.folder import Folder, digested

VERSION, KEPT = 3, 2
#: Buckets at first, and the mean rows of a bucket beyond which their number doubles.
BUCKETS, ROWS_A_BUCKET = 16, 2_000_000
FILES = "bucket int, file string, rows long, bytes long, sha256 string"


class Damaged(ValueError):
    """A snapshot whose files aren't those that it was written with."""


class Buckets(Folder):
    """The table below a folder with rows of the same key columns in the same bucket."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], buckets: int = BUCKETS, rows_a_bucket: int = ROWS_A_BUCKET):
        super().__init__(spark, folder)
        self.key, self.first_buckets, self.rows_a_bucket = key, buckets, rows_a_bucket

    def bucket(self, n: int) -> Column:
        """The bucket of a row among n; twice as many buckets split each in two."""
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def _manifest(self, name: str) -> dict:
        told = json.loads(self._text(f"{name}/manifest.json") or "")
        if told.get("version") != VERSION or told.get("key") != self.key:
            raise Damaged("the manifest is of another kind")
        return told

    def touched(self, rows: DataFrame, name: str) -> list[int]:
        """The buckets of a snapshot in which the keys of rows lie."""
        return [r[0] for r in rows.select(self.bucket(self._manifest(name)["buckets"])).distinct().collect()]  # a row a bucket at most

    def files(self, name: str) -> DataFrame:
        """(bucket, file, rows, bytes, sha256) of a snapshot."""
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/{name}/files")

    def _read(self, name: str, held: list, schema) -> DataFrame | None:
        """The rows of the listed files, once their digests are those noted; None for no files."""
        if not held:
            return None
        paths = [f"{self.folder}/{r['file']}" for r in held]
        told = self.spark.createDataFrame([(r["file"], r["bytes"], r["sha256"]) for r in held], "file string, bytes long, sha256 string")
        seen = digested(self.spark, paths).select(F.regexp_extract("path", "(data/gen-[0-9]+/bucket=[0-9]+/[^/]+)$", 1).alias("file"), "bytes", "sha256")
        if not told.join(seen, ["file", "bytes", "sha256"], "left_anti").isEmpty():
            raise Damaged("a file isn't the one that was written")
        return self.spark.read.schema(StructType.fromJson(schema)).parquet(*paths)

    def load(self, buckets: list[int] | None = None) -> tuple[str | None, DataFrame | None, list[str]]:
        """(snapshot, rows, warnings) of the newest snapshot whose files are whole; of some buckets only where they are listed.

        Rows are None where there are no snapshots or no files. Only files that are read are digested.
        """
        warnings = []
        for name in self.newest_first():
            try:
                told = self._manifest(name)
                listed = self.files(name)
                if listed.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] != told["rows"]:
                    raise Damaged("the list of files isn't the one that was written")
                held = (listed if buckets is None else listed.filter(F.col("bucket").isin(buckets))).collect()  # some files a bucket
                return name, self._read(name, held, told["schema"]), warnings
            except Exception as e:  # any damage leads to the next one
                warnings.append(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
        return None, None, warnings

    def merge(self, rows: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = KEPT) -> tuple[str | None, list[str]]:
        """Takes rows in and returns (the new snapshot, warnings); no rows, no snapshot.

        combine(old, new) gives the new rows of the buckets that the batch touches, from their old ones (None: none yet)
        and the batch; it must keep keys together. Cost follows the touched buckets, and the list of files.
        """
        names = self.newest_first()
        for name in names:  # the number of buckets is needed before the rows that they hold
            try:
                n = self._manifest(name)["buckets"]
                break
            except Exception:
                continue
        else:
            n = self.first_buckets
        batch = stored(rows)
        touched = [r[0] for r in batch.select(self.bucket(n)).distinct().collect()]  # a row a bucket at most
        if not touched:
            return None, []
        base, old, warnings = self.load(touched)
        if base is not None and (had := self._manifest(base)["buckets"]) != n:  # an older snapshot with fewer buckets stands in
            n, touched = had, [r[0] for r in batch.select(self.bucket(had)).distinct().collect()]
            base, old, warnings = self.load(touched)
        listed = self.files(base) if base is not None else self.spark.createDataFrame([], FILES)
        return self._write(combine(old, batch), listed.filter(~F.col("bucket").isin(touched)), n, keep, warnings), warnings

    def replace(self, rows: DataFrame, keep: int = KEPT) -> str:
        """Writes a snapshot of these rows alone."""
        names = self.names()
        n = self._manifest(names[-1])["buckets"] if names else self.first_buckets
        return self._write(rows, self.spark.createDataFrame([], FILES), n, keep, [])

    def _write(self, rows: DataFrame, others: DataFrame, n: int, keep: int, warnings: list[str]) -> str:
        """Writes rows as buckets of the next snapshot beside the files of the others, doubling the number of buckets where they are full."""
        name, schema = self._next(), rows.schema.jsonValue()
        data = f"{self.folder}/data/{name}"
        self._fs.delete(self._at(f"data/{name}"), True)  # of a save that did not end
        self._fs.delete(self._at(f"{name}.tmp"), True)
        dealt = rows.withColumn("bucket", self.bucket(n)).hint("rebalance", "bucket")  # by size, so a large bucket is written by several tasks
        dealt.write.option("maxRecordsPerFile", self.rows_a_bucket).partitionBy("bucket").parquet(data)
        file = F.regexp_extract("path", "(data/gen-[0-9]+/bucket=[0-9]+/[^/]+)$", 1)
        counted = self.spark.read.schema(rows.schema).parquet(data).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        new = digested(self.spark, [f"{data}/bucket=*"]).withColumn("file", file).join(counted.select(file.alias("file"), "rows"), "file", "left") if not counted.isEmpty() else self.spark.createDataFrame([], FILES + ", path string")
        new = new.withColumn("bucket", F.regexp_extract("file", "bucket=([0-9]+)", 1).cast("int"))
        names = ["bucket", "file", "rows", "bytes", "sha256"]
        both = others.select(*names).unionByName(new.select(*names))
        both.repartition(1).write.parquet(f"{self.folder}/{name}.tmp/files")  # a row a file; digests are taken by as many tasks as there is work for
        total = self.spark.read.schema(FILES).parquet(f"{self.folder}/{name}.tmp/files").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        self._put(f"{name}.tmp/manifest.json", json.dumps({"version": VERSION, "key": self.key, "buckets": n, "rows": total, "schema": schema}))
        self._publish(name)
        self._collect(keep)
        if total > n * self.rows_a_bucket:
            _, whole, found = self.load()
            warnings += found
            if whole is not None:
                return self._write(whole, self.spark.createDataFrame([], FILES), 2 * n, keep, warnings)
        return name

    def _collect(self, keep: int) -> None:
        """Deletes all but the newest snapshots, and the files that only those deleted have named."""
        names = self.names()
        gone, kept = names[: -max(KEPT, keep)], names[-max(KEPT, keep) :]
        for name in gone:
            try:
                lost = self.files(name).select("file")
                for other in kept:
                    lost = lost.join(self.files(other).select("file"), "file", "left_anti")
                for r in lost.collect():  # what one batch has replaced
                    self._fs.delete(self._at(r["file"]), False)
            except Exception:  # a damaged snapshot names nothing
                pass
            self._fs.delete(self._at(name), True)
        self._sweep()
