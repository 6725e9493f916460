"""Memories written by other programs: Arrow files of a generation, and packed binary files.

Both are read as binary files by Spark and decoded in the tasks that read them; such a file holds at most some megabytes.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.operators import store

STRINGS, CODED = "id long, value string", "s long, p long, o long, src long, added double, trust_q int, hits int"
# The packed format's magic and its little-endian records.
MAGIC, HEADER, RECORD = b"RTV1", struct.Struct("<4sII"), struct.Struct("<IIIIdBI")
# End of the fixed values.


def _decoded(spark: SparkSession, path: str, schema: str, decode: Callable[[bytes], pd.DataFrame]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                yield decode(content)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _arrow(content: bytes) -> pa.Table:
    try:
        return pa.ipc.open_file(io.BytesIO(content)).read_all()
    except pa.ArrowInvalid:
        return pa.ipc.open_stream(io.BytesIO(content)).read_all()


def _arrow_strings(content: bytes) -> pd.DataFrame:
    values = _arrow(content).column("value").to_pylist()
    return pd.DataFrame({"id": range(len(values)), "value": values})


def _arrow_triples(content: bytes) -> pd.DataFrame:
    return _arrow(content).select(["s", "p", "o", "src", "added", "trust_q", "hits"]).to_pandas().astype({"s": "int64", "p": "int64", "o": "int64", "src": "int64", "trust_q": "int32", "hits": "int32"})


def read_arrow(spark: SparkSession, folder: str) -> DataFrame:
    """The valid triples of a generation's strings.arrow and triples.arrow."""
    strings = _decoded(spark, f"{folder}/strings.arrow", STRINGS, _arrow_strings)
    return store.decode(strings, _decoded(spark, f"{folder}/triples.arrow", CODED, _arrow_triples)).filter(store.is_valid())


def _packed(content: bytes) -> tuple[list[str], memoryview]:
    magic, n_strings, n_records = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a file of packed triples")
    at, strings = HEADER.size, []
    for _ in range(n_strings):
        (size,) = struct.unpack_from("<I", content, at)
        strings.append(content[at + 4 : at + 4 + size].decode("utf-8", "replace"))
        at += 4 + size
    return strings, memoryview(content)[at : at + n_records * RECORD.size]


def _packed_strings(content: bytes) -> pd.DataFrame:
    strings, _ = _packed(content)
    return pd.DataFrame({"id": range(len(strings)), "value": strings})


def _packed_triples(content: bytes) -> pd.DataFrame:
    rows = pd.DataFrame(list(RECORD.iter_unpack(_packed(content)[1])), columns=["s", "p", "o", "src", "added", "trust_q", "hits"])
    return rows.astype({"s": "int64", "p": "int64", "o": "int64", "src": "int64", "added": "float64", "trust_q": "int32", "hits": "int32"})


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The valid triples of a packed binary file; records whose ids no string has are left out."""
    return store.decode(_decoded(spark, path, STRINGS, _packed_strings), _decoded(spark, path, CODED, _packed_triples)).filter(store.is_valid())


def is_intact(spark: SparkSession, folder: str) -> bool:
    """Whether the files of a generation have the SHA-256 digests that its MANIFEST.json tells."""
    told = json.loads(spark.read.text(f"{folder}/MANIFEST.json", wholetext=True).first()[0])
    files = spark.read.format("binaryFile").load([f"{folder}/{name}" for name in told["sha256"]])
    found = files.select(F.substring_index("path", "/", -1).alias("name"), F.sha2("content", 256).alias("digest")).collect()
    return told.get("version") == 1 and {r["name"]: r["digest"] for r in found} == told["sha256"]
