"""Strict JSON (RFC 8259): whether texts are one whole value, found by array operations over the bytes of many texts at once.

Quotes that no backslash escapes toggle a mask, brackets outside strings add up to depths, and tokens sorted by depth put
the members of each array and object side by side, where their places alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

DEEPEST = 64
#: Bytes of texts that are scanned together; a longer text is scanned by itself.
TOGETHER = 8 << 20
SCALAR = r"\A(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\z"
ESCAPED = r"""\A(?:[^\\]|\\["\\/bfnrt]|\\u[0-9A-Fa-f]{4})*\z"""
_SPACE, _PLAIN = 0, 1  # classes of bytes outside strings; marks of structure are classes of their own
_CLASS = np.full(256, _PLAIN, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in '{}[],:"']] = [ord(c) for c in '{}[],:"']
OPEN, CLOSE, VALUE, STRING = (ord("{"), ord("[")), (ord("}"), ord("]")), 2, ord('"')


def _match(whole: np.ndarray, start: np.ndarray, end: np.ndarray, pattern: str) -> np.ndarray:
    """Which of the slices match."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    taken = whole[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
    slices = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(taken.tobytes())])
    return pc.match_substring_regex(slices, pattern).to_numpy(zero_copy_only=False).astype(bool)


def scan(texts: list[bytes], deepest: int = DEEPEST) -> np.ndarray:
    """Of each text, whether it is one JSON value with nothing but white space around, in at most `deepest` brackets."""
    good = np.ones(len(texts), bool)
    if not texts:
        return good
    b = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])

    def bad(at: np.ndarray) -> None:
        good[np.searchsorted(ends, at, "right")] = False

    quoted = b == STRING
    slashes = np.flatnonzero(b == 92)
    if len(slashes):
        last = np.append(np.diff(slashes) != 1, True)
        first = np.concatenate([[True], last[:-1]])
        odd = (slashes[last] - slashes[first]) % 2 == 0
        quoted[slashes[last][odd] + 1] = False
    quotes = np.cumsum(quoted, dtype=np.int32)
    before = np.concatenate([[0], quotes[ends[:-1] - 1]])
    inside = ((quotes - np.repeat(before, np.diff(np.concatenate([[0], ends])))) & 1).astype(bool)  # an opening quote is inside, a closing one isn't
    good[inside[ends - 1]] = False
    control = np.flatnonzero(inside & (b < 32))
    bad(control)
    held = inside | quoted
    kind = np.where(held, 0, _CLASS[b])
    opens, closes = np.flatnonzero(quoted & inside), np.flatnonzero(quoted & ~inside)
    if len(slashes):
        rows = np.searchsorted(ends, opens, "right")
        pairs = np.searchsorted(closes, opens)
        whole = (pairs < len(closes)) & good[rows]
        start, end = opens[whole] + 1, closes[pairs[whole]]
        some = np.searchsorted(slashes, end) > np.searchsorted(slashes, start)
        bad(start[some][~_match(b, start[some], end[some], ESCAPED)])
    plain = kind == _PLAIN
    edge = np.diff(np.concatenate([[False], plain, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bad(start[~_match(b, start, end, SCALAR)])

    kind[opens], kind[start] = STRING, VALUE
    kind[plain & (kind == _PLAIN)] = 0
    at = np.flatnonzero(kind)
    row, kind = np.searchsorted(ends, at, "right"), kind[at]
    opening, closing = np.isin(kind, OPEN), np.isin(kind, CLOSE)
    depth = np.cumsum(opening.astype(np.int32) - closing)
    rows_first = np.searchsorted(row, np.arange(len(texts) + 1))
    total = np.concatenate([[0], depth])
    depth = depth - total[rows_first[:-1]][row]
    level = depth + closing  # brackets are on the level of their members
    good[row[(depth < 0) | (level > deepest)]] = False
    good[total[rows_first[1:]] != total[rows_first[:-1]]] = False
    kept = good[row]
    row, kind, level, opening, closing = row[kept], kind[kept], level[kept], opening[kept], closing[kept]

    # an opening bracket stands on its own level, and as a value on the one around
    place = np.arange(len(row)) * 2
    row, kind, level = np.concatenate([row, row[opening]]), np.concatenate([kind, np.full(opening.sum(), VALUE)]), np.concatenate([level, level[opening] - 1])
    order = np.lexsort((np.concatenate([place, place[opening] + 1]), level, row))
    row, kind, level = row[order], kind[order], level[order]
    top = level == 0
    good &= np.bincount(row[top], minlength=len(texts)) == 1
    good[row[top & (kind != VALUE) & (kind != STRING)]] = False
    row, kind = row[~top], kind[~top]
    begins = np.flatnonzero(np.isin(kind, OPEN))
    if len(begins):
        sizes = np.diff(np.append(begins, len(kind)))
        object_, size, nth = np.repeat(kind[begins] == OPEN[0], sizes), np.repeat(sizes, sizes) - 2, np.arange(len(kind)) - np.repeat(begins, sizes) - 1
        value = (kind == VALUE) | (kind == STRING)
        last = nth == size
        member = np.where(object_, np.select([nth % 4 == 0, nth % 4 == 1, nth % 4 == 2], [kind == STRING, kind == ord(":"), value], kind == ord(",")), np.where(nth % 2 == 0, value, kind == ord(",")))
        full = (size == 0) | np.where(object_, size % 4 == 3, size % 2 == 1)
        fine = np.where(nth < 0, True, np.where(last, full & (kind == np.where(object_, CLOSE[0], CLOSE[1])), member))
        good[row[~fine]] = False
    return good


def _together(texts: list[bytes | None]) -> Iterator[list[bytes | None]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t or b"") > TOGETHER:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or b"")
    if held:
        yield held


@F.arrow_udf(BooleanType())
def _valid(text: pa.Array, deepest: pa.Array) -> pa.Array:
    out, most = [], deepest[0].as_py() if len(deepest) else DEEPEST
    for part in _together(text.cast(pa.large_binary()).to_pylist()):
        out += [None if t is None else bool(g) for t, g in zip(part, scan([t or b"" for t in part], most), strict=True)]
    return pa.array(out, pa.bool_())


def valid_json(text: Column, deepest: int = DEEPEST) -> Column:
    """Whether a text is strict JSON in at most `deepest` brackets; null of null. NaN, comments, trailing commas and data are not JSON."""
    return _valid(text, F.lit(deepest))


def from_strict_json(text: Column, schema: str, deepest: int = DEEPEST) -> Column:
    """The value by a schema, null where the text is not strict JSON; of a key that comes again the last value counts."""
    return F.when(valid_json(text, deepest), F.from_json(text, schema))


def register(spark: SparkSession) -> None:
    """Gives SQL the function valid_json(text, deepest)."""
    spark.udf.register("valid_json", _valid)
