"""SimHash near-duplicates by one hierarchical index over all fingerprints in Gray order.

The distinct fingerprints are sorted by their place in the Gray sequence, where neighbours share most bits, and dealt to
tasks by ranges of it: a range is a node, and below it stand leaves of 64 neighbours. Each group keeps the bits that its
members share; what a group above shares already isn't kept again. A leaf goes down the tree as a whole and adds up the
bits in which it differs from each group; groups that differ in more than two are pruned with all that they hold. The
tree above the ranges is broadcast (65,536 nodes at most); the leaf is then sent to the ranges that are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import as_bytes, hot_join, lean, stored, table
from assayer.llm.components import components

BITS, SHINGLE, SEED, NEAR = 64, 3, 42, 2
#: Fingerprints of a leaf, groups of a group above; fingerprints of a range at least, ranges at most.
LEAF, RANGE, MOST_RANGES = 64, 16_384, 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Over the word shingles of the text, repeats included: the bits that more than half of their hashes have. 0: no words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - size].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(size: int):
    def run(batches):
        for batch in batches:
            *kept, texts = batch.columns
            out = [fingerprint(t, size) for at in range(0, batch.num_rows, 256) for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(out, np.uint64).view(np.int64))], names=[*batch.schema.names[:-1], "print"])

    return lean(run)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns to carry, print long with the fingerprint's 64 bits); null texts are empty."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), *carry)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return docs.select(F.col(id_col).cast("long").alias("id"), *carry, as_bytes(text_col).alias("text")).mapInArrow(_fingerprints(size), f"{fields}, print long")


def gray_rank(v: np.ndarray) -> np.ndarray:
    """Places of the codes v in the binary reflected Gray sequence."""
    out = v.copy()
    for k in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(k)
    return out


def gray_order(print_: Column) -> Column:
    """A column that orders fingerprints by their places in the Gray sequence."""
    out = print_
    for k in (1, 2, 4, 8, 16, 32):
        out = out.bitwiseXOR(F.shiftrightunsigned(out, k))
    return out.bitwiseXOR(F.lit(-(1 << 63)))  # as unsigned numbers


class Tree:
    """Groups in order, LEAF of which make a group above; low and high: the AND and the OR of what each holds."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.bits, self.shared = [low], [~(low ^ high)]
        while len(low) > LEAF:
            at = np.arange(0, len(low), LEAF)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            self.bits.append(low)
            self.shared.append(~(low ^ high))
        # What the group above shares is left out below it.
        self.own = [s & ~np.repeat(up, LEAF)[: len(s)] for s, up in zip(self.shared, self.shared[1:], strict=False)] + [self.shared[-1]]

    def near(self, bits: np.uint64, shared: np.uint64, most: int) -> np.ndarray:
        """The groups that may hold a fingerprint within `most` bits of one with these bits where `shared` has them."""
        at = np.arange(len(self.own[-1]))
        gone = np.zeros(len(at), np.uint8)
        for level in range(len(self.own) - 1, -1, -1):
            gone = gone + np.bitwise_count((self.bits[level][at] ^ bits) & self.own[level][at] & shared)
            keep = gone <= most
            at, gone = at[keep], gone[keep]
            if level:
                at, gone = (at[:, None] * LEAF + np.arange(LEAF)).ravel(), np.repeat(gone, LEAF)
                real = at < len(self.own[level - 1])
                at, gone = at[real], gone[real]
        return at


class Groups(dict):
    """Fingerprints that are linked, by one of each group."""

    def top(self, v: int) -> int:
        up = self.setdefault(v, v)
        while up != self[up]:
            self[v] = self[up]
            v, up = up, self[up]
        return up

    def link(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self[max(a, b)] = min(a, b)


class Range:
    """The leaves of one range; finds what is near to further leaves."""

    def __init__(self, leaves: list[np.ndarray], near: int):
        self.leaves, self.near, self.groups = leaves, near, Groups()
        self.tree = Tree(np.array([np.bitwise_and.reduce(x) for x in leaves]), np.array([np.bitwise_or.reduce(x) for x in leaves]))
        for k in range(len(leaves)):
            self.meet(leaves[k], k)

    def meet(self, leaf: np.ndarray, first: int = 0) -> None:
        """Links a leaf with the own leaves from the first on."""
        low, high = np.bitwise_and.reduce(leaf), np.bitwise_or.reduce(leaf)
        found = self.tree.near(low, ~(low ^ high), self.near)
        found = found[found >= first]
        for at in range(0, len(found), 64):
            other = np.concatenate([self.leaves[k] for k in found[at : at + 64].tolist()])
            a, b = np.nonzero(np.bitwise_count(leaf[:, None] ^ other[None]) <= self.near)
            for x, y in zip(leaf[a].tolist(), other[b].tolist(), strict=True):
                if x != y:
                    self.groups.link(x, y)


LEAVES = pa.schema([("range", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("prints", pa.binary())])
SENT = pa.schema([("target", pa.int32()), ("other", pa.bool_()), ("prints", pa.binary())])
LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _leaves(batches):
    """Of one range's fingerprints in Gray order, the leaves."""
    number, held = TaskContext.get().partitionId(), np.zeros(0, np.uint64)

    def grouped(v: np.ndarray) -> pa.RecordBatch:
        at = np.arange(0, len(v), LEAF)
        low, high = np.bitwise_and.reduceat(v, at), np.bitwise_or.reduceat(v, at)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), number), pa.int32()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), pa.array([v[k : k + LEAF].tobytes() for k in at.tolist()], pa.binary())], schema=LEAVES)

    for batch in batches:
        held = np.concatenate([held, batch.column(0).to_numpy().view(np.uint64)])
        whole = len(held) // LEAF * LEAF
        if whole:
            yield grouped(held[:whole])
            held = held[whole:]
    if len(held):
        yield grouped(held)


def _sent(shared, near: int):
    """Each leaf to its own range and to those behind it that may hold something near."""

    def run(batches):
        numbers, tree = shared.value
        for batch in batches:
            own, low, high = (batch.column(k).to_numpy() for k in range(3))
            low, high = low.view(np.uint64), high.view(np.uint64)
            to = [numbers[tree.near(a, ~(a ^ b), near)] for a, b in zip(low, high, strict=True)]
            to = [x[x >= n] for x, n in zip(to, own.tolist(), strict=True)]
            row = np.repeat(np.arange(len(own)), [len(x) for x in to])
            target = np.concatenate(to) if to else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(target, pa.int32()), pa.array(target != own[row]), batch.column(3).take(pa.array(row))], schema=SENT)

    return lean(run)


def _linked(near: int):
    """Of rows sorted by target, the own leaves first: one link for each fingerprint that isn't its group's first. Only a range's own leaves are held."""

    def run(batches):
        target, own, found = None, [], None

        def ended():
            nonlocal found
            if own and found is None:
                found = Range(own, near)
            if found is not None:
                links = [(v, found.groups.top(v)) for v in list(found.groups)]
                links = np.array([x for x in links if x[0] != x[1]], np.uint64).reshape(-1, 2).view(np.int64)
                if len(links):
                    yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], schema=LINKED)

        for batch in batches:
            for at, (t, other, prints) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)):
                if t != target:
                    yield from ended()
                    target, own, found = t, [], None
                leaf = np.frombuffer(prints.as_py(), np.uint64)
                if not other:
                    own.append(leaf)
                else:
                    if found is None:
                        found = Range(own, near)
                    found.meet(leaf)
        yield from ended()

    return lean(run)


def clusters(distinct: DataFrame, near: int = NEAR) -> DataFrame:
    """(print, root) for those of the distinct fingerprints (print) that have a link with another one; root is one of the group's."""
    size = distinct.count()
    parts = max(1, min(MOST_RANGES, -(-size // RANGE)))
    ordered = distinct.select("print", gray_order(F.col("print")).alias("rank")).repartitionByRange(parts, "rank").sortWithinPartitions("rank")
    leaves = stored(ordered.select("print").mapInArrow(lean(_leaves), "range int, low long, high long, prints binary"))
    upper = leaves.groupBy("range").agg(F.expr("bit_and(low)").alias("low"), F.expr("bit_or(high)").alias("high")).toArrow().sort_by("range")  # MOST_RANGES rows at most
    numbers, low, high = (upper.column(k).to_numpy() for k in ("range", "low", "high"))
    shared = distinct.sparkSession.sparkContext.broadcast((numbers, Tree(low.view(np.uint64), high.view(np.uint64))))
    sent = leaves.mapInArrow(_sent(shared, near), "target int, other boolean, prints binary")
    met = sent.repartition(parts, "target").sortWithinPartitions("target", "other").mapInArrow(_linked(near), "a long, b long")
    return components(met).withColumnsRenamed({"v": "print"})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, near: int = NEAR, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hexadecimal digits), component_id, the smallest id that links reach, root, and the columns to carry.

    Fingerprints that differ in at most `near` bits are linked, also those of texts without words, which are
    0. Equal fingerprints are one vertex, whatever their number. Repeated rows each get their row; null ids stay null and
    aren't the smallest of a group, which has no component_id where all its ids are null, but a root (a fingerprint of the
    group) of its own. Other columns are left out.
    """
    prints = stored(fingerprints(docs, id_col, text_col, size, carry))
    least = stored(prints.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")))
    known = stored(least.join(clusters(least, near), "print", "left").select("print", "least", "rows", F.coalesce("root", "print").alias("root")))
    groups = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(known.join(groups, "root").select("print", "component_id", "rows", "root"))
    digits = F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint")
    return hot_join(prints, named, "print", "rows").select(F.col("id").alias("doc_id"), digits, "component_id", "root", *carry)


def op8(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("root")
