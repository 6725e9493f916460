"""Removal of repeated substrings by a distributed suffix sort over a difference cover that the text itself chooses.

Two equal strings of `length` bytes have an anchor at the same place: the k-gram with the least hash in them. So anchors
are a difference cover of all pairs of equal strings, with one or two hundredths of the suffixes in it, and are named by
the k-gram's hash. Names that occur once end there. An anchor's block holds the strings that it is the anchor of; blocks
that occur again repeat as a whole. Where names repeat and blocks don't, the blocks of a name meet in one task, their
suffixes are sorted by the difference cover mod 3 (sorted triples, recursion on names, merge), and neighbours are
compared by their first `length` bytes. Names with very many different blocks have their strings counted by digest instead.

Blocks, strings that are counted and whole texts are told apart by 128 bits (XXH3, or XXH64 with two seeds) of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import as_bytes, rows, stored, table
from assayer.llm.suffix_sort import suffix_order

LENGTH, GRAM = 200, 48
#: Blocks of a name that are sorted in one task, and bytes sorted at once.
MOST_BLOCKS, SORTED_BYTES = 2000, 1 << 20
_PLACE = (1 << 31) - 1
_M = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(text: bytes, *sizes: int) -> list[np.ndarray]:
    """For each size, hashes of the strings of so many bytes from each place on."""
    h = (np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * _M
    out, power, step = {}, 0x100000001B3, 1
    wanted = sorted(sizes)
    while True:
        for n in wanted:
            if step <= n < 2 * step:
                d = n - step
                out[n] = (h * np.uint64(power | 1) if not d else h[:-d] * np.uint64(power | 1) + (h[d:] ^ (h[d:] >> np.uint64(29)))) * _M if len(h) > d else h[:0]
        if 2 * step > wanted[-1] or len(h) <= step:
            break
        h = h[:-step] * np.uint64(power) + h[step:]
        h ^= h >> np.uint64(31)
        power, step = power * power & (1 << 64) - 1, 2 * step
    return [out.get(n, h[:0]) for n in sizes]


def _least(key: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        key, step = np.minimum(key[:-step], key[step:]), 2 * step
    return np.minimum(key[: len(key) - (width - step)], key[width - step :]) if step < width else key


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(name, block, twin, place, first start, last start) of the anchors of a text of `length` bytes at least; block and twin are a digest of the block.

    Starts are those of the strings that have the anchor; equal k-grams in one string give its leftmost.
    """
    (grams,) = window_hashes(text, gram)
    key = (grams >> np.uint64(31) << np.uint64(31)) | np.arange(len(grams), dtype=np.uint64)
    place = (_least(key, length - gram + 1) & np.uint64(_PLACE)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(first[1:], len(place)) - 1
    at = place[first]
    block = _digests(text[a:b] for a, b in zip(first.tolist(), (last + length).tolist(), strict=True))
    return grams[at].view(np.int64), block[:, 0] ^ ((at - first) << 32), block[:, 1], at, first, last


def _digests(parts) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), np.int64).reshape(-1, 2)


_FIELDS = [("name", pa.int64()), ("key", pa.int64()), ("check", pa.int64()), ("place", pa.int64())]
ANCHORS = pa.schema([_FIELDS[0], ("block", pa.int64()), ("twin", pa.int64()), *_FIELDS[1:], ("state", pa.int8()), ("hot", pa.bool_()), ("deal", pa.int64())])
_ANCHORS = "name long, block long, twin long, key long, check long, place long, state byte, hot boolean, deal long"
#: States of a row: one anchor, one of several with its block, or a run of starts that are settled.
SINGLE, SEVERAL, RUN = 0, 1, 2
HELD = 400_000


def _reduced(name, block, twin, key, check, place, hot: np.ndarray) -> pa.RecordBatch:
    """The rows that a task sends for its anchors: one for each block, and the starts of blocks that it has met twice as runs.

    So rows that are alike are dealt by name once a task, and runs by where they are.
    """
    order = np.lexsort((twin, block, name))
    name, block, twin, key, check, place = (x[order] for x in (name, block, twin, key, check, place))
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (block[1:] != block[:-1]) | (twin[1:] != twin[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(name)))
    state = np.where(count > 1, SEVERAL, SINGLE).astype(np.int8)
    busy = np.isin(name[begin], hot)
    own = [x[begin] for x in (name, block, twin, key, check, place)]
    met = np.flatnonzero(np.repeat(count > 1, count))
    at = place[met] >> 16
    first, last = at - (place[met] >> 8 & 255), at - (place[met] & 255)
    order = np.lexsort((first, check[met], key[met]))
    k, n, first, last = key[met][order], check[met][order], first[order], last[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1]) | (first[1:] > last[:-1] + 1)
    start = np.flatnonzero(fresh)
    last = np.maximum.reduceat(last, start) if len(start) else last
    k, n, first = k[start], n[start], first[start]
    with np.errstate(over="ignore"):
        spread = (k ^ (first << 20)) * np.int64(0x5851F42D4C957F2D)
    columns = [np.concatenate(c) for c in zip(own, [spread, np.zeros_like(spread), np.zeros_like(spread), k, n, (first << 31) | last], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in columns] + [pa.array(np.concatenate([state, np.full(len(k), RUN, np.int8)])), pa.array(np.concatenate([busy, np.zeros(len(k), bool)])), pa.array(np.concatenate([np.where(busy, own[1], own[0]), spread]))], schema=ANCHORS
    )


def _found(length: int, gram: int, hot):
    def run(batches):
        held: list[tuple] = []
        size = 0

        def reduced():
            return _reduced(*(np.concatenate(c) for c in zip(*held, strict=True)), hot.value)

        for key, check, text in rows(batches, "key", "check", "text"):
            if len(text) >= length:
                name, block, twin, at, first, last = anchors(text, length, gram)
                held.append((name, block, twin, np.full(len(at), key), np.full(len(at), check), (at << 16) | ((at - first) << 8) | (at - last)))
                size += len(at)
                if size >= HELD:
                    yield reduced()
                    held, size = [], 0
        if held:
            yield reduced()

    return run


def _names(length: int, gram: int):
    def run(batches):
        for (text,) in rows(batches, "text"):
            if len(text) >= length:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(anchors(text, length, gram)[0]))], names=["name"])

    return run


def hot_names(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """Names that a thousandth of a sample of a 64th of the texts has, 64 of them at least. They are dealt by block.

    Which names these are changes no result. The list has at most a thousand times the names of a text on average.
    """
    sample = texts.filter((F.col("size") >= length) & (F.pmod("key", F.lit(64)) == 0))
    least = max(64, sample.count() // 1000)
    named = sample.select("text").mapInArrow(_names(length, gram), "name long")
    return np.sort(named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("name").toArrow().column("name").to_numpy())


REPEATED, ALONE, WITNESS, SETTLED = 1, 2, 3, 4
KINDS = pa.schema([("kind", pa.int32()), *_FIELDS])
_KINDS = "kind int, name long, key long, check long, place long"


def _kinds(batches):
    """Of rows sorted by name and block: blocks that repeat, blocks alone among others of their name, one witness of each repeated block there, settled runs.

    Only the last row and what came before it is held, so a name can have any number of rows. Names that are dealt by
    block count as having others.
    """
    held = None  # the columns of one row; whether the row before has its name, its block; whether its block has others of its name before it

    def told(kind: int, flags: np.ndarray, columns: list) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(flags)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), *(pa.array(columns[k][at]) for k in (0, 3, 4, 5))], schema=KINDS)

    def decided(columns, same_name, same_block, others, upto):
        n = len(same_name)
        ahead_name, ahead_block = np.append(same_name[1:], False), np.append(same_block[1:], False)
        # A block has others before it where its first row stands behind a row of the same name.
        led = same_name & ~same_block
        led[0] |= bool(same_block[0] and others)
        start = np.maximum.accumulate(np.where(~same_block | (np.arange(n) == 0), np.arange(n), 0))
        other = led[start]
        state, hot = columns[6], columns[7]
        settled = state == RUN
        repeats = ~settled & (same_block | ahead_block | (state == SEVERAL))
        alone = ~settled & ~repeats & (hot | same_name | ahead_name)
        witness = repeats & ~ahead_block & (hot | other | ahead_name)
        open_ = np.arange(n) < upto
        for kind, flags in ((REPEATED, repeats), (ALONE, alone), (WITNESS, witness), (SETTLED, settled)):
            yield from told(kind, flags & open_, columns)
        return bool(other[-1])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(8)]
        if held is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(held[0], columns, strict=True)]
        name, block, twin = columns[:3]
        same_name = np.concatenate([[False], name[1:] == name[:-1]])
        same_block = same_name & np.concatenate([[False], (block[1:] == block[:-1]) & (twin[1:] == twin[:-1])])
        others = False
        if held is not None:
            same_name[0], same_block[0], others = held[1:]
        other = yield from decided(columns, same_name, same_block, others, len(name) - 1)
        held = ([x[-1:] for x in columns], bool(same_name[-1]), bool(same_block[-1]), other)
    if held is not None:
        yield from decided(held[0], np.array([held[1]]), np.array([held[2]]), held[3], 1)


BLOCKS = pa.schema([("name", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("check", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])
STARTS = pa.schema([("hash", pa.int64()), ("twin", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("check", pa.int64()), ("start", pa.int64())])


def _span(place: int, length: int) -> tuple[int, int, int]:
    """(anchor, first start, end of the block) of a packed place."""
    at = place >> 16
    return at, at - (place >> 8 & 255), at - (place & 255) + length


def _blocks(length: int):
    def run(batches):
        for key, check, text, marks in rows(batches, "key", "check", "text", "marks", step=64):
            out = []
            for m in marks:
                _, a, b = _span(m["place"], length)
                out.append((m["name"], m["kind"], key, check, m["place"], text[a:b]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BLOCKS, strict=True)], schema=BLOCKS)

    return run


COVERED = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
_COVERED = "key long, check long, first long, last long"


def repeats(blocks: list[bytes], length: int) -> list[np.ndarray]:
    """For each block, whether the string of `length` bytes at each start is also that of another block here or another start.

    Suffixes of all blocks are sorted together; in their order, equal strings are neighbours.
    """
    whole = b"\0".join(blocks)
    s = np.frombuffer(whole, np.uint8).astype(np.int64) + 1
    sizes = np.array([len(b) for b in blocks])
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    s[begins[1:] - 1] = 0
    n_starts = sizes - length + 1
    wanted = np.zeros(len(s), bool)
    for b, n in zip(begins.tolist(), n_starts.tolist(), strict=True):
        wanted[b : b + n] = True
    order = suffix_order(s + 1, length)
    order = order[wanted[order]]
    (prefix,) = window_hashes(whole, length)
    own = prefix[order]
    alike = own[1:] == own[:-1]
    strings = np.lib.stride_tricks.sliding_window_view(np.frombuffer(whole, np.uint8), length)
    met = np.flatnonzero(alike)
    for at in range(0, len(met), 4096):  # the bytes themselves
        part = met[at : at + 4096]
        alike[part] = (strings[order[part]] == strings[order[part + 1]]).all(1)
    again = np.zeros(len(s), bool)
    again[order[1:][alike]] = True
    again[order[:-1][alike]] = True
    return [again[b : b + n] for b, n in zip(begins.tolist(), n_starts.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


def _sorted(length: int):
    def run(batches):
        held: list[tuple] = []
        size = 0

        def covered():
            out = []
            for (_, kind, key, n, place, _), again in zip(held, repeats([h[5] for h in held], length), strict=True):
                if kind == ALONE:
                    _, begin, _ = _span(place, length)
                    out += [(key, n, begin + int(a), begin + int(b)) for a, b in zip(*_runs(again), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), COVERED, strict=True)], schema=COVERED)

        for r in rows(batches, "name", "kind", "key", "check", "place", "bytes"):
            if size >= SORTED_BYTES and r[0] != held[-1][0]:
                yield from covered()
                held, size = [], 0
            held.append(r)
            size += len(r[5]) + 1
        if held:
            yield from covered()

    return run


def _starts(length: int):
    def run(batches):
        for kind, key, check, place, block in rows(batches, "kind", "key", "check", "place", "bytes"):
            n = len(block) - length + 1
            found = _digests(block[k : k + length] for k in range(n))
            _, begin, _ = _span(place, length)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, key)), pa.array(np.full(n, check)), pa.array(begin + np.arange(n))], schema=STARTS)

    return run


def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST_BLOCKS) -> DataFrame:
    """(key, check, first, last): runs of starts of strings that start elsewhere too; texts: (id, key, check, size, text)."""
    spark = texts.sparkSession
    long_ = texts.filter(F.col("size") >= length).select("key", "check", "text")
    hot = spark.sparkContext.broadcast(hot_names(texts, length, gram))
    found = long_.mapInArrow(_found(length, gram, hot), _ANCHORS)
    kinds = stored(found.repartition("deal").sortWithinPartitions("name", "block", "twin", "key", "place").mapInArrow(_kinds, _KINDS))
    at, before, behind = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)), F.col("place").bitwiseAND(F.lit(255))
    whole = kinds.filter(F.col("kind") == REPEATED).select("key", "check", (at - before).alias("first"), (at - behind).alias("last"))
    settled = kinds.filter(F.col("kind") == SETTLED).select("key", "check", F.shiftright("place", 31).alias("first"), F.col("place").bitwiseAND(F.lit(_PLACE)).alias("last"))
    whole = whole.unionByName(settled)
    open_ = kinds.filter(F.col("kind").isin(ALONE, WITNESS))
    crowded = stored(open_.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("name"))
    one = texts.groupBy("key", "check").agg(F.min("id").alias("chosen"))  # of equal texts, one gives the blocks
    marks = open_.groupBy("key", "check").agg(F.collect_list(F.struct("name", "kind", "place")).alias("marks")).join(one, ["key", "check"])
    met = texts.join(marks, ["key", "check"]).filter(F.col("id").eqNullSafe(F.col("chosen")))
    blocks = stored(met.select("key", "check", "text", "marks").mapInArrow(_blocks(length), "name long, kind int, key long, check long, place long, bytes binary"))
    few = blocks.join(crowded, "name", "left_anti").repartition("name").sortWithinPartitions("name")
    own = few.select(*BLOCKS.names).mapInArrow(_sorted(length), _COVERED)
    many = blocks.join(crowded, "name", "left_semi").select(*BLOCKS.names).mapInArrow(_starts(length), "hash long, twin long, kind int, key long, check long, start long")
    where = F.struct("key", "check", "start")
    again = many.groupBy("hash", "twin").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter("a <> b").select("hash", "twin")
    rest = many.filter(F.col("kind") == ALONE).join(again, ["hash", "twin"], "left_semi").select("key", "check", F.col("start").alias("first"), F.col("start").alias("last"))
    return whole.unionByName(own).unionByName(rest)


CUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])


def spans(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges (start, end) that strings at the runs' starts cover."""
    out: list[list[int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [(a, b) for a, b in out]


def _cut(length: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    text, gone = r["text"], spans([(x["first"], x["last"]) for x in r["runs"] or []], length)
                    kept = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(text)], strict=True)) if gone else text
                    out.append((r["id"], len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), [list(g) for g in gone]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CUT, strict=True)], schema=CUT)

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST_BLOCKS) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and spans with the removed byte ranges.

    A byte goes where a string of `length` bytes over it also starts elsewhere, in this text or another; matches don't
    cross texts and are judged on the input. A null text is empty; texts shorter than `length` stay whole; repeated rows
    are texts of their own and repeat each other; null ids stay. Other columns are left out.
    """
    if length - gram > 255 or gram > length:
        raise ValueError("an anchor is at most 255 bytes into its string")
    text = as_bytes(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), F.xxhash64(F.lit(1), text).alias("check"), F.octet_length(text).alias("size"), text.alias("text"))
    runs = repeated_starts(texts, length, gram, most).distinct().groupBy("key", "check").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = texts.join(runs, ["key", "check"], "left").select("id", "text", "runs")
    return joined.mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>")


def op1(spark, sf_dir):
    return cut_repeats(table(spark, sf_dir, "documents")).drop("spans")
