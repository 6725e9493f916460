"""Benchmark decontamination by the q-gram lemma.

A passage within e edits of an item of m characters shares at least m - q + 1 - q*e character q-grams with it, all in a
band of e + 1 diagonals. Shared q-grams are counted in overlapping bands of diagonals; bands that reach that number are
verified by a banded alignment.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import free_names, lean, stored, table

Q, EDIT_SHARE = 8, 0.1
#: An index of q-grams is broadcast for at most so many characters of items; more items go in further blocks.
BLOCK_CHARS = 4_000_000
LEAKS = "array<struct<item_id: long, start: long, end: long, edits: int, similarity: double>>"
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))
_M = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22
_SPAN = np.int64(1) << 40
#: Pairs of equal q-grams that are listed at once; items with more in a text are counted diagonal by diagonal.
PAIRS = 1 << 20


def letters(text: str) -> np.ndarray:
    """Code points, A-Z lower-cased and white space of ASCII as spaces, so that places stay."""
    s = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    s[(s >= 65) & (s <= 90)] += 32
    s[(s >= 9) & (s <= 13)] = 32
    return s


def q_grams(s: np.ndarray) -> np.ndarray:
    """A hash of the q characters from each place on."""
    if len(s) < Q:
        return np.zeros(0, np.uint64)
    h, power, step = s.astype(np.uint64) * _M, 0x100000001B3, 1
    while step < Q:
        h = h[:-step] * np.uint64(power) + h[step:]
        power, step = power * power & (1 << 64) - 1, 2 * step
    h ^= h >> np.uint64(31)
    return h * _M


def edit_budget(m: int, share: float) -> int:
    """Edits allowed in an item of m characters; as many as leave a q-gram to share."""
    return max(0, min(int(m * share), (m - Q) // Q))


class Index:
    """The q-grams of the items with their places."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE):
        known = sorted((i, t) for i, t in items if t)
        self.ids = [i for i, _ in known]
        self.texts = [letters(t) for _, t in known]
        self.edits = np.array([edit_budget(len(t), share) for t in self.texts], np.int64)
        self.least = np.array([len(t) - Q + 1 - Q * e for t, e in zip(self.texts, self.edits, strict=True)], np.int64)
        grams = [q_grams(t) for t in self.texts]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams] or [np.zeros(0, np.int64)])
        code = np.concatenate(grams or [np.zeros(0, np.uint64)])
        order = np.argsort(code, kind="stable")
        code, self.item, self.place = code[order], item[order], place[order]
        self.code, self.first, self.number = np.unique(code, return_index=True, return_counts=True)
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[self.code >> np.uint64(64 - _SLOTS)] = True
        self.short: dict[str, list[int]] = {}
        for k, t in enumerate(self.texts):
            if len(t) < Q:
                self.short.setdefault(_as_text(t), []).append(k)
        self.finder = None

    def bands(self, grams: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, diagonals) of the bands with enough shared q-grams; overlapping ones are merged."""
        at = np.flatnonzero(self.slots[grams >> np.uint64(64 - _SLOTS)])
        if not len(at) or not len(self.code):
            return []
        slot = np.minimum(np.searchsorted(self.code, grams[at]), len(self.code) - 1)
        ok = self.code[slot] == grams[at]
        at, slot = at[ok], slot[ok]
        pairs = int(self.number[slot].sum())
        if pairs < self.least.min(initial=1):
            return []
        strip, count = self._listed(at, slot) if pairs <= PAIRS else self._many(at, slot)
        # Of two neighbouring strips each pair of neighbours is one band, so bands overlap by half.
        following = np.concatenate([np.where(strip[1:] == strip[:-1] + 1, count[1:], 0), [0]]) if len(strip) else count
        rich = np.flatnonzero(count + following >= self.least[strip // _SPAN])
        out: list[tuple[int, int, int]] = []
        for s in strip[rich].tolist():
            k, b = divmod(s, int(_SPAN))
            w = int(self.edits[k]) + 1
            begin = (b - (int(_SPAN) >> 1)) * w
            if out and out[-1][0] == k and begin <= out[-1][1] + out[-1][2]:
                out[-1] = (k, out[-1][1], begin + 2 * w - out[-1][1])
            else:
                out.append((k, begin, 2 * w))
        return out

    def _refs(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index's rows of each slot, and how many each has."""
        n = self.number[slot]
        return np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n

    def _listed(self, at: np.ndarray, slot: np.ndarray, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(strip, count) over all pairs of equal q-grams of the text places and the items, without some of the items."""
        ref, n = self._refs(slot)
        item, diagonal = self.item[ref], np.repeat(at, n) - self.place[ref]
        if but is not None:
            keep = ~but[item]
            item, diagonal = item[keep], diagonal[keep]
        return np.unique(item * _SPAN + diagonal // (self.edits[item] + 1) + (_SPAN >> 1), return_counts=True)

    def _many(self, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same in bounded memory where a text and the items repeat themselves: PAIRS at once, heavy items by counts on all their diagonals."""
        own, times = np.unique(slot, return_counts=True)
        ref, n = self._refs(own)
        pairs = np.bincount(self.item[ref], np.repeat(times, n), len(self.ids))
        heavy = pairs > PAIRS
        parts = []
        order = np.argsort(slot, kind="stable")
        places = np.split(at[order], np.cumsum(times)[:-1])
        where = {int(s): p for s, p in zip(own, places, strict=True)}
        of_ref = np.repeat(own, n)
        for k in np.flatnonzero(heavy).tolist():
            size, mine = len(self.texts[k]), np.flatnonzero(self.item[ref] == k)
            counts = np.zeros(int(at.max()) + size + 1, np.int64)
            for s, place in zip(of_ref[mine].tolist(), self.place[ref[mine]].tolist(), strict=True):
                counts[where[s] + (size - place)] += 1
            met = np.flatnonzero(counts)
            strip, which = np.unique((met - size) // (int(self.edits[k]) + 1), return_inverse=True)
            parts.append((k * _SPAN + strip + (_SPAN >> 1), np.bincount(which, counts[met]).astype(np.int64)))
        sums = np.cumsum(self.number[slot])
        begin = 0
        while begin < len(at):
            end = max(begin + 1, int(np.searchsorted(sums, (sums[begin - 1] if begin else 0) + PAIRS, "right")))
            parts.append(self._listed(at[begin:end], slot[begin:end], heavy))
            if len(parts) >= 16:
                parts = [_summed(parts)]
            begin = end
        return _summed(parts)

    def align(self, k: int, s: np.ndarray, begin: int, diagonals: int) -> list[tuple[int, int, int]]:
        """(edits, start, end) of the passages in s within the band and the budget, none over another, the best first."""
        item, e = self.texts[k], int(self.edits[k])
        low, width = begin - e, diagonals + 2 * e
        one = np.int64(1) << 32
        padded = np.zeros(len(item) + width, np.uint32)
        a, b = max(0, low), min(len(s), low + len(padded))
        if a >= b:
            return []
        padded[a - low : b - low] = s[a:b]
        cell = np.arange(width, dtype=np.int64)
        steps = np.arange(width, dtype=np.int64) * one
        row = cell.copy()  # the edits, and below them the place in the band where the passage starts
        for i in range(len(item)):
            new = row + np.where(padded[i : i + width] == item[i], 0, one)
            new[:-1] = np.minimum(new[:-1], row[1:] + one)
            row = np.minimum.accumulate(new - steps) + steps
        edits = row >> 32
        ok = np.flatnonzero(edits <= e)
        return _apart(edits[ok], np.maximum(0, (row[ok] & 0xFFFFFFFF) + low), np.minimum(len(s), ok + low + len(item)))

    def leaks(self, text: str) -> list[dict]:
        """The items that stand in the text, each with its places, by item and start."""
        s = letters(text)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for k, begin, diagonals in self.bands(q_grams(s)):
            if hits := self.align(k, s, begin, diagonals):
                found.setdefault(k, []).extend(hits)
        if self.short:
            if self.finder is None:
                self.finder = ahocorasick.Automaton()
                for t in self.short:
                    self.finder.add_word(t, t)
                self.finder.make_automaton()
            for last, t in self.finder.iter(_as_text(s)):
                for k in self.short[t]:
                    found.setdefault(k, []).append((0, last + 1 - len(t), last + 1))
        out = []
        for k, hits in found.items():
            for edits, start, end in _apart(*np.array(hits, np.int64).T):
                out.append({"item_id": self.ids[k], "start": start, "end": end, "edits": edits, "similarity": round(1 - edits / len(self.texts[k]), 6)})
        return sorted(out, key=lambda x: (x["item_id"], x["start"]))


def _as_text(s: np.ndarray) -> str:
    return s.tobytes().decode("utf-32-le", "surrogatepass")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    strip, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return strip, np.bincount(which, np.concatenate([p[1] for p in parts]), len(strip)).astype(np.int64)


def _apart(edits: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Of passages, those with the fewest edits first (ties: by start), none over one taken before."""
    left, out = np.lexsort((end, start, edits)), []
    while len(left):
        k = left[0]
        out.append((int(edits[k]), int(start[k]), int(end[k])))
        left = left[1:]
        left = left[(start[left] >= end[k]) | (end[left] <= start[k])]
    return out


def _marked(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 256):
                part = batch.slice(at, 256)
                out = [index.leaks(t) if t else [] for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, _LEAK)], names=[*part.schema.names[:-1], "leaks"])

    return lean(run)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _by_blocks(out: DataFrame, text_col: str, blocks: Iterable[list[tuple[int, str]]], share: float) -> DataFrame:
    """out with `leaks` behind, one block's index in memory at a time: what it finds is written, then its index is taken from all workers."""
    row, block = free_names(out, "row", "block")
    kept, found = stored(out.withColumn(row, F.monotonically_increasing_id())), []
    for k, items in enumerate(blocks):
        index = out.sparkSession.sparkContext.broadcast(Index(items, share))
        leaks = kept.select(row, F.col(text_col).cast("string").alias("text")).mapInArrow(_marked(index), f"`{row}` long, leaks {LEAKS}")
        found.append(stored(leaks.filter(F.size("leaks") > 0).withColumn(block, F.lit(k))))
        index.destroy()
    parts = F.transform(F.array_sort(F.collect_list(F.struct(block, "leaks"))), lambda part: part["leaks"])
    leaks = reduce(DataFrame.unionByName, found).groupBy(row).agg(F.flatten(parts).alias("leaks"))
    return kept.join(leaks, row, "left").drop(row).withColumn("leaks", F.coalesce("leaks", F.array().cast(LEAKS)))


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", share: float = EDIT_SHARE, most: int = BLOCK_CHARS) -> DataFrame:
    """docs with `leaks` behind: an array of (item_id, start, end, edits, similarity), places in code points.

    An item stands where a passage is within a tenth (`share`) of its length in edits, A-Z and white space compared as
    their lower case and as spaces. Items shorter than q must stand as they are; null and empty items stand nowhere; null
    and empty texts have no leaks. Rows stay one for one; a column called leaks is replaced. The items are taken in
    blocks of 4 million characters; the index of a block is broadcast. Of several blocks, one is in memory at a time, and
    each reads the texts once; the documents are stored first, so that their rows keep their numbers.
    """
    out = docs.drop("leaks")
    blocks = _blocks(benchmark, item_col, "text", most)
    first = list(islice(blocks, 2))
    if not first:
        return out.withColumn("leaks", F.array().cast(LEAKS))
    if len(first) > 1:
        return _by_blocks(out, text_col, chain(first, blocks), share)
    (copy,) = free_names(out, "copy")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    index = docs.sparkSession.sparkContext.broadcast(Index(first[0], share))
    return out.withColumn(copy, F.col(text_col).cast("string")).mapInArrow(_marked(index), f"{fields}, leaks {LEAKS}")


def op6(spark, sf_dir):
    found = mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") > 0).select("doc_id", F.inline("leaks"))
