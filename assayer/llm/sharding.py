"""Sharding by histogram sort: splitters of a key order are found by counting, then rows are exchanged once.

Rows are ordered by a digest of the text, so that equal texts are neighbours, then by id. Bytes below candidate boundaries
are counted exactly, in all partitions at once; the next probes lie between the boundaries that enclose a target, until
every splitter is settled. Only counts of as many buckets as there are probes reach the driver.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import as_bytes, below, crc32_sql, free_names, sortable_hex, stored, table

SHARDS, OVERHEAD = 40, 16
#: A boundary moves to the edge of a group of equal texts within this share of a shard's bytes.
TOLERANCE = 0.01
#: Candidate boundaries a round, and the rows that a task of the exchange should get at most.
PROBES, ROWS_A_RANGE = 1024, 2_000_000
#: Hex digits of a key: the text's digest; a null flag, the id and the row.
DIGEST, REST = 16, 33
#: Sorts behind every key.
END = "~"


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Columns carried, size, text_crc32 and key of each row; keys are unique, as equal rows differ in the last digits."""
    text, number = as_bytes(text_col), F.col(id_col).cast("long")
    size, crc, key = free_names(docs.select(*carry), "size", "text_crc32", "key")
    parts = F.upper(F.substring(F.md5(text), 1, DIGEST)), F.when(number.isNull(), "0").otherwise("1"), F.coalesce(sortable_hex(number), F.lit("0" * 16)), sortable_hex(F.monotonically_increasing_id())
    return docs.select(*carry, (F.octet_length(text) + OVERHEAD).cast("long").alias(size), F.crc32(text).alias(crc), F.concat(*parts).alias(key))


class _Span(NamedTuple):
    """Rows from one key to another: what lies below them, what they hold, and the key behind them."""

    least: str
    most: str
    bytes_below: int
    rows_below: int
    bytes: int
    rows: int
    behind: str

    def one_text(self) -> bool:
        return self.least[:DIGEST] == self.most[:DIGEST]

    def probes(self, parts: int) -> list[str]:
        """The span's first key and up to parts - 1 evenly spaced ones; between different texts, only starts of texts."""
        wide = DIGEST + REST if self.one_text() else DIGEST
        low, high = int(self.least[:wide], 16), int(self.most[:wide], 16)
        cuts = sorted({low + max(1, (high - low) * k // parts) for k in range(1, parts)})
        return [self.least, *(f"{c:0{wide}X}".ljust(DIGEST + REST, "0") for c in cuts if low < c <= high)]


def splitters(rows: DataFrame, parts: int, tolerance: float = TOLERANCE, probes: int = PROBES, size: str = "size", key: str = "key") -> list[tuple[str, int]]:
    """(first key, rows below it) of each part.

    Boundary j is the edge of a group of equal texts that is nearest to j / parts of all bytes (of two the lower) where it
    is within `tolerance` of a part's bytes, else the nearest edge of a row. A round deals the probes to the open spans,
    counts what lies between them and notes the outermost keys there, which are the next span's ends. When under a quarter
    of the rows lies in open spans, only those rows are kept.
    """
    found: dict[int, tuple[str, int]] = {}

    def settle(x: _Span, targets: list[int], group: bool) -> list[int]:
        """Settles targets in the span if it is a row, or a group with an edge that is near enough; returns the others."""
        rest = []
        for j in targets:
            low, high = j * total - x.bytes_below * parts, (x.bytes_below + x.bytes) * parts - j * total
            if x.rows == 1 or group and min(low, high) <= tolerance * total:
                found[j] = (x.least, x.rows_below) if low <= high else (x.behind, x.rows_below + x.rows)
            else:
                rest.append(j)
        return rest

    whole = rows.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("most")).first()
    total, left = whole["bytes"], whole["rows"]
    spans: list[tuple[_Span, list[int]]] = []
    if left:
        first = _Span(whole["least"], whole["most"], 0, 0, total, left, END)
        if rest := settle(first, list(range(1, parts)), first.one_text()):
            spans = [(first, rest)]
    while spans:
        cuts, owner = [], []
        for k, (x, _) in enumerate(spans):
            own = x.probes(max(2, probes // len(spans)))
            cuts += [*own, x.most + END]
            owner += [k] * len(own) + [-1]  # what lies behind the span is settled
        bucket = (below(F.col(key), cuts) - 1).alias("bucket")
        counts = rows.select(bucket, size, key).groupBy("bucket").agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("most"))
        met: dict[int, list] = {}
        for r in sorted(counts.collect(), key=lambda r: r["bucket"]):  # a row a probe at most
            if r["bucket"] >= 0 and owner[r["bucket"]] >= 0:
                met.setdefault(owner[r["bucket"]], []).append(r)
        following = []
        for k, (x, targets) in enumerate(spans):
            bytes_below, rows_below = x.bytes_below, x.rows_below
            for r, behind in zip(met[k], [*(n["least"] for n in met[k][1:]), x.behind], strict=True):
                part = _Span(r["least"], r["most"], bytes_below, rows_below, r["bytes"], r["rows"], behind)
                bytes_below, rows_below = bytes_below + part.bytes, rows_below + part.rows
                inside = [j for j in targets if part.bytes_below * parts <= j * total < bytes_below * parts]
                if rest := settle(part, inside, part.one_text() and not x.one_text()):
                    following.append((part, rest))
        spans = following
        inside = sum(x.rows for x, _ in spans)
        if spans and inside * 4 < left:
            ends = [e for x, _ in spans for e in (x.least, x.most + END)]
            rows, left = stored(rows.select(size, key).filter(below(F.col(key), ends) % 2 == 1)), inside
    return [("", 0), *(found.get(j, (END, 0)) for j in range(1, parts))]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, tolerance: float = TOLERANCE, probes: int = PROBES, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """docs (the columns in `carry`, else all) with size, text_crc32, shard and slot, so that shards have nearly equal bytes.

    size is the text's UTF-8 bytes and 16 more. Shards are ranges of (digest of the text, id), nulls first: a group of equal texts lies in one shard
    or in neighbouring ones, and is cut only where no edge of it is within `tolerance` of a shard's bytes. slot counts a shard's rows from 0 in
    that order. A null text is the empty text; repeated rows each get a slot, in any order; shards stay empty where there
    are fewer rows or larger texts than bytes to share; columns of docs that have the names of new ones keep them, and
    the new ones get an underscore. No shard is one task: ranges of up to `rows_a_range` rows on average are exchanged once.
    """
    carry = docs.columns if carry is None else carry
    size, crc, key, at, number, slot = free_names(docs.select(*carry), "size", "text_crc32", "key", "range", "shard", "slot")
    rows = stored(keyed(docs, id_col, text_col, carry))
    each = max(1, -(-rows.count() // (shards * rows_a_range)))
    starts = splitters(rows, shards * each, tolerance, probes, size, key)
    ranged = rows.withColumn(at, below(F.col(key), [k for k, _ in starts[1:]]))
    # Rows before the range in its shard are known from the counts.
    ahead = F.split(F.lit(",".join(str(n - starts[k - k % each][1]) if starts[k][0] != END else "0" for k, (_, n) in enumerate(starts))), ",").cast("array<bigint>")
    place = F.row_number().over(Window.partitionBy(at).orderBy(key)) - 1 + F.get(ahead, F.col(at))
    return ranged.select(*carry, size, crc, F.floor(F.col(at) / each).cast("int").alias(number), place.cast("long").alias(slot))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes shards as folders shard=0, shard=1, ... of Parquet files; their rows keep their slot."""
    sharded.write.partitionBy("shard").parquet(path)


def op12(spark, sf_dir):
    found = shard(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def twin(shards: int = SHARDS, tolerance: float = TOLERANCE) -> str:
    """The query in DuckDB's SQL: cumulative bytes over the whole order."""
    return f"""
WITH {crc32_sql("(SELECT DISTINCT coalesce(text, '') AS x FROM documents)")},
docs AS (SELECT doc_id, strlen(coalesce(text, '')) + {OVERHEAD} AS size, substr(md5(coalesce(text, '')), 1, {DIGEST}) AS digest, crc FROM documents JOIN crcs ON x = coalesce(text, '')),
ranked AS (
  SELECT *, row_number() OVER w - 1 AS place, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) - size AS under
  FROM docs WINDOW w AS (ORDER BY digest, doc_id NULLS FIRST)),
texts AS (SELECT min(under) AS under, sum(size) AS size, min(place) AS place, count(*) AS n FROM ranked GROUP BY digest),
targets AS (SELECT j, j * (SELECT sum(size) FROM docs) AS aim, (SELECT sum(size) FROM docs) AS total FROM range(1, {shards}) r(j)),
near AS (
  SELECT j, aim, aim - under * {shards} AS low, (under + size) * {shards} - aim AS high, place, n, least(low, high) <= {tolerance}::DOUBLE * total AS fine
  FROM targets JOIN texts ON under * {shards} <= aim AND aim < (under + size) * {shards}),
bounds AS (
  SELECT j, CASE WHEN low <= high THEN place ELSE place + n END AS bound FROM near WHERE fine
  UNION ALL
  SELECT j, CASE WHEN aim - r.under * {shards} <= (r.under + r.size) * {shards} - aim THEN r.place ELSE r.place + 1 END
  FROM near JOIN ranked r ON r.under * {shards} <= aim AND aim < (r.under + r.size) * {shards} WHERE NOT fine),
dealt AS (SELECT r.*, (SELECT count(*) FROM bounds WHERE bound <= r.place) AS shard FROM ranked r)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM dealt
"""
