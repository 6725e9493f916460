"""A folder of snapshots on whatever file system Spark reads and writes: names, small texts, renames, and digests of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Folder:
    """A folder with snapshots gen-1, gen-2, ... in it and a pointer CURRENT to one of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def names(self) -> list[str]:
        """Whole snapshots, oldest first."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted((n for n in found if n.startswith("gen-") and not n.endswith(".tmp")), key=lambda n: int(n[4:]))

    def newest_first(self) -> list[str]:
        """The snapshots in the order in which they are tried: the one that CURRENT names, then from the newest on."""
        names, current = self.names()[::-1], (self._text("CURRENT") or "").strip()
        return [*([current] if current in names else []), *(n for n in names if n != current)]

    def _next(self) -> str:
        names = self.names()
        return f"gen-{int(names[-1][4:]) + 1 if names else 1}"

    def _text(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        rows = self.spark.read.text(f"{self.folder}/{name}", wholetext=True).collect()
        return rows[0][0] if rows else None

    def _put(self, name: str, text: str) -> None:
        """Writes a file aside and renames it over the one that is there, in one step where the file system can."""
        out = self._fs.create(self._at(f"{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        over = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._fs.makeQualified(self._at(f"{name}.tmp")), self._fs.makeQualified(self._at(name)), over)

    def _publish(self, name: str) -> None:
        """The snapshot written as name.tmp becomes the current one."""
        self._fs.rename(self._at(f"{name}.tmp"), self._at(name))
        self._put("CURRENT", name)

    def _sweep(self) -> None:
        """Deletes what unfinished saves have left."""
        for s in self._fs.listStatus(self._path(self.folder)):
            if s.getPath().getName().endswith(".tmp"):
                self._fs.delete(s.getPath(), True)


def digested(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of the Parquet files in or at paths, digested by tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
