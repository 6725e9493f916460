"""Context-triggered piecewise hashing: document fingerprints that stay alike where texts do.

A rolling hash over eight bytes cuts the text where its low bits are zero; each piece gives a character of the
signature. A fingerprint holds the signatures at a block size and at twice that size, and two fingerprints are compared
by the edit distance (insertions and deletions) of signatures at equal block sizes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import arrow_batches, as_bytes, below, rows, sortable_hex, table

WINDOW, PIECES, LEAST_BLOCK, COMMON = 8, 64, 4, 7
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_LETTERS = np.frombuffer(ALPHABET.encode(), np.uint8)
_P, _M = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SPREAD = (np.arange(1, 257, dtype=np.uint64) * _M) ^ (np.arange(1, 257, dtype=np.uint64) << np.uint64(17))


def _rolling(text: bytes) -> np.ndarray:
    """At each byte, a hash of it and the seven bytes before it (fewer at the start)."""
    h = _SPREAD[np.frombuffer(text, np.uint8)]
    step, power = 1, _P
    while step < WINDOW:
        if len(h) > step:
            longer = h.copy()
            longer[step:] += h[:-step] * power
            h = longer
        power, step = power * power, step * 2
    h ^= h >> np.uint64(29)
    return h * _M


def _signature(rolled: np.ndarray, sums: np.ndarray, block: int) -> str:
    cut = np.flatnonzero((rolled >> np.uint64(20)) & np.uint64(block - 1) == 0)
    ends = cut if len(cut) and cut[-1] == len(rolled) - 1 else np.append(cut, len(rolled) - 1)
    if len(ends) > PIECES:  # texts that repeat themselves can cut at every period
        ends = np.append(ends[: PIECES - 1], ends[-1])
    at = sums[ends]
    piece = at - np.concatenate([np.zeros(1, np.uint64), at[:-1]])
    return _LETTERS[((piece * _M) >> np.uint64(58)).astype(np.intp)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """block size:signature:signature at twice the size, of 64 characters at most; '0::' for the empty text. What is behind 63 pieces is the last one."""
    if not text:
        return "0::"
    with np.errstate(over="ignore"):
        rolled = _rolling(text)
        sums = np.cumsum(rolled ^ (rolled >> np.uint64(32)), dtype=np.uint64)
        block = LEAST_BLOCK
        while block * PIECES < len(text):
            block *= 2
        first = _signature(rolled, sums, block)
        while len(first) < PIECES // 2 and block > LEAST_BLOCK:
            block //= 2
            first = _signature(rolled, sums, block)
        return f"{block}:{first}:{_signature(rolled, sums, 2 * block)}"


def _alike(a: str, b: str) -> float:
    """1 - edit distance over the lengths' sum; 0 without a common run of seven characters (all, where there are fewer)."""
    if a == b:
        return 1.0
    k = min(COMMON, len(a), len(b))
    if not k or {a[i : i + k] for i in range(len(a) - k + 1)}.isdisjoint(b[i : i + k] for i in range(len(b) - k + 1)):
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full  # zeros mark the longest common subsequence, bit-parallel
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    common = len(a) - row.bit_count()
    return 2 * common / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints, 0 where no block size is common."""
    if a == b:
        return 1.0
    (ka, a1, a2), (kb, b1, b2) = a.split(":"), b.split(":")
    x, y = int(ka), int(kb)
    if x == y:
        return max(_alike(a1, b1), _alike(a2, b2)) if x else 0.0
    if x == 2 * y:
        return _alike(a1, b2)
    return _alike(a2, b1) if y == 2 * x else 0.0


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (target, ghost, key, id, text) so partitioned and sorted that each row's successor in descending id follows it.

    Rows are dealt by ranges of (id, hash of the text), as many as there are shuffle partitions, so that the rows of one id
    are split too, but for those that are alike; the first row of a range is also sent, as a ghost, behind the range before it,
    and the first of all behind the last. Ties in id go by the text's hash; null ids come last.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text, number = as_bytes(text_col), F.col(id_col).cast("long")
    place = F.concat(F.when(number.isNull(), "1").otherwise("0"), F.coalesce(sortable_hex(F.bitwise_not(number)), F.lit("")), sortable_hex(F.xxhash64(text)))
    ranges = docs.select(place.alias("key")).repartitionByRange(n, "key").withColumn("range", F.spark_partition_id()).groupBy("range").agg(F.min("key").alias("head"))
    heads = sorted(r["head"] for r in ranges.collect())  # as many as there are partitions
    own = docs.select(place.alias("key"), number.alias("id"), text.alias("text")).withColumn("at", below(F.col("key"), heads) - 1)
    here, before = F.col("at"), F.pmod(F.col("at") - 1, F.lit(max(1, len(heads))))
    is_head = F.col("key") == F.get(F.split(F.lit(",".join(heads)), ","), here)
    spread = own.select(F.posexplode(F.when(is_head, F.array(here, before)).otherwise(F.array(here))).alias("ghost", "target"), "key", "id", "text")
    return spread.repartition(n, "target").sortWithinPartitions("target", "ghost", "key")


MADE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _prints(batches):
    def records():
        held = None
        for target, ghost, key, raw in rows(batches, "target", "ghost", "id", "text"):
            text = raw.decode("utf-8", "replace")
            own = fingerprint(raw)
            if held is not None and held[0] == target:
                _, before, was, old = held
                new = edited(was, text).encode()
                mark = fingerprint(new)
                yield before, len(was), hashlib.sha256(new).hexdigest(), old, mark, round(likeness(old, mark), 6), round(likeness(old, own), 6)
            held = None if ghost else (target, key, text, own)

    yield from arrow_batches(records(), MADE)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty, the fingerprint of an empty text is `0::`; the only row of a table is its own next one; null ids
    come last and stay null; repeated rows each get their row; other columns are left out.
    """
    return with_next(docs, id_col, text_col).mapInArrow(_prints, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
