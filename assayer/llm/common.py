"""What the corpus operators share: reading tables, shared storage, text as Arrow bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.shared import new_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table_: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again, where later tables are stored themselves."""
    spark = table_.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table_.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, which gives the memory that it has freed back to the system at its end.

    A worker runs tasks of one stage after another, and would hold what its largest task needed, so executors of a job of
    several stages would need the sum of them.
    """

    def run_and_release(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
            trim(0)

    return run_and_release


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: str) -> DataFrame:
    """left joined with right (stored, one row per key; `rows`: how many rows of left have it), so that no task gets all rows of a hot key.

    Keys that hold over a thousandth of the rows, which are fewer than a thousand, are broadcast; the rest is left to Spark.
    """
    total = right.agg(F.sum(rows)).first()[0] or 0
    few = F.broadcast(right.filter(F.col(rows) * 1000 > total).drop(rows))
    return left.join(few, key).unionByName(left.join(few.select(key), key, "left_anti").join(right.drop(rows), key))


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, longer by underscores where df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def as_bytes(text: Column | str) -> Column:
    """The text's UTF-8 bytes; null is the empty text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def keyed_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text as bytes), the input of the Arrow operators; other columns are left out."""
    return df.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))


def rows(batches: Iterator[pa.RecordBatch], *names: str, step: int = 256) -> Iterator[tuple]:
    """Tuples of the named columns; only a slice of each batch is turned into Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def arrow_batches(records: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of up to size rows."""
    held: list[tuple] = []
    for r in records:
        held.append(r)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text has that remainder."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder


def sortable_hex(number: Column) -> Column:
    """A long as 16 hex digits that sort as the numbers do."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def below(key: Column, bounds: list[str]) -> Column:
    """How many of the sorted bounds are at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    held, steps = F.split(F.lit(",".join(bounds)), ","), [2**k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.get(held, at + s - 1) <= key, at + s).otherwise(at))


def crc32_sql(source: str) -> str:
    """CTEs of DuckDB, the last of which is crcs(x, crc): the unsigned CRC-32 of the UTF-8 bytes of each string x of source."""
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
crc_table AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: {step}, b) ORDER BY b) AS crc_of FROM range(256) r(b)),
crcs AS MATERIALIZED (
  SELECT x, xor(list_reduce(list_transform(regexp_extract_all(hex(x), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c >> 8, crc_of[xor(c, b) % 256 + 1]), 4294967295), 4294967295) AS crc
  FROM {source}, crc_table)"""
