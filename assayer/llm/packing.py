"""Lexical retrieval packing: documents are cut into windows of tokens next to documents that share their rare words.

Documents are dealt to shards in the order of two weighted min-hashes of their token sets, so that documents which share
most of their rare tokens meet. Each shard is an inverted index with BM25 weights from the document frequencies of the whole corpus. A window's seed queries
its shard, and the best unused neighbours follow until the window is full; what doesn't fit is the next window's seed.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import as_bytes, lean, rows, stored, table

WINDOW, END = 4096, 2
K1, SLOPE, QUERY_TERMS = 1.2, 0.75, 24
SHARD_TOKENS, TASK_TOKENS = 1_500_000, 8_000_000
#: Tokens of so many parts of text are held by a worker; beyond that, they are met anew.
WORDS = 1_000_000
#: Longer parts aren't held.
LONG_PART = 64

_tokenizers: dict[str, object] = {}
_known: dict[str, Known] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


#: Lower-case Latin letters that composition leaves as they are; a part of them alone is one word to the tokenizer.
_PLAIN = re.compile("[a-zß-öø-ÿœ]+")
#: Texts of such characters alone: each run of marks is a word to the tokenizer, so spaces around it change nothing.
_SIMPLE = re.compile("[a-z0-9ß-öø-ÿœ \\n!-&(-/:-@\\[-`{-~]*")
_PROSE = re.compile("[a-z0-9ß-öø-ÿœ \\n.,]*")
_MARKS = re.compile("([!-&(-/:-@\\[-`{-~]+)")


class Known(dict):
    """The tokens of parts of text that a worker has met, for a tokenizer that drops white space and case."""

    def __init__(self, path: str, kind: str):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.kind, self.whole = kind, tokenizer(path)
        self.word, self.letters = self.whole.model.tokenize, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, part: str) -> bytes:
        if _PLAIN.fullmatch(part):
            ids = [t.id for t in self.word(part if part.isascii() else self.letters(part)[0][0])]
        else:
            ids = self.whole.encode(part, add_special_tokens=False).ids
        found = array(self.kind, ids).tobytes()
        if len(part) <= LONG_PART:
            self[part] = found
        return found


def _parts(text: str) -> list[str]:
    """Parts that the tokenizer takes one by one to the same ids as the whole text."""
    if "<|" in text:  # special tokens are found as they are written
        return [text]
    if "\u0130" not in text and "\u03a3" not in text:  # elsewhere, case doesn't depend on neighbours
        text = text.lower()
    if _PROSE.fullmatch(text) and not any(two in text for two in ("..", ",,", ".,", ",.")):
        return text.replace(".", " . ").replace(",", " , ").split()
    if _SIMPLE.fullmatch(text):
        return _MARKS.sub(r" \1 ", text).split()
    return text.replace("\n", " ").split(" ")


def encode(texts: list[str], path: str, kind: str, by_word: bool = True) -> list[bytes]:
    """The token ids of each text, packed as `kind` ('H' or 'I'); by_word: the tokenizer drops white space and case."""
    if not by_word:
        return [array(kind, e.ids).tobytes() for e in tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    known = _known.get(path + kind)
    if known is None:
        known = _known[path + kind] = Known(path, kind)
    if len(known) > WORDS:
        known.clear()
    return [b"".join(map(known.__getitem__, _parts(t))) for t in texts]


def chances(size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two min-hashes: for each token an exponential draw, the smaller the rarer the token, and a random label.

    Of two sets, the token with the least draw is the same with the chance of their weighted Jaccard similarity. Tokens of a
    merged vocabulary stand in the order of their frequency, so weights grow with the id.
    """
    rng = np.random.default_rng(11)
    weight = np.log(2 + np.maximum(0, np.arange(size) - 512.0))
    return [(-np.log(rng.random(size)) / weight, rng.permutation(size)) for _ in range(2)]


def place(terms: np.ndarray, draws: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """A document's place in the order of shards, by its distinct tokens."""
    first, second = (int(label[terms[draw[terms].argmin()]]) for draw, label in draws)
    return first << 32 | second


ENCODED = pa.schema([("id", pa.int64()), ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])


def _encoded(path: str, kind: str, end: int, size: int, by_word: bool):
    def run(batches):
        draws = chances(size)
        spread = np.zeros(size, np.int64)
        last = array(kind, [end]).tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                out = [x + last for x in encode([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()], path, kind, by_word)]
                places = []
                for x in out:
                    terms = np.unique(np.frombuffer(x, kind))
                    spread[terms] += 1
                    places.append(place(terms, draws))
                width = len(last)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(places, pa.int64()), pa.array([len(x) // width for x in out], pa.int64()), pa.array(out, pa.binary())], schema=ENCODED)
        terms = np.flatnonzero(spread)  # the partition's document frequencies, in rows of their own
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(np.full(len(terms), -1)), pa.array(spread[terms]), pa.nulls(len(terms), pa.binary())], schema=ENCODED)

    return lean(run)


class Shard:
    """A BM25 index over documents that are all at hand; idf: by token, mean: the corpus's tokens a document."""

    def __init__(self, tokens: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(t) for t in tokens])
        key = (np.repeat(np.arange(len(tokens), dtype=np.int64), sizes) << 32) | np.concatenate(tokens).astype(np.int64)
        key, tf = np.unique(key, return_counts=True)
        doc, term = key >> 32, key & 0xFFFFFFFF
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - SLOPE + SLOPE * sizes[doc] / mean))
        self.begin = np.searchsorted(doc, np.arange(len(tokens) + 1))
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.doc, self.posted = doc[order].astype(np.int32), weight[order].astype(np.float32)
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.append(first, len(order))
        self.used = np.zeros(len(tokens), bool)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents, best first; ties and those without a shared term in order."""
        a, b = self.begin[seed], self.begin[seed + 1]
        best = self.term[a:b][np.argsort(-self.weight[a:b], kind="stable")[:QUERY_TERMS]]
        slots = np.searchsorted(self.terms, best)
        parts = [(self.first[s], self.first[s + 1]) for s in slots]
        docs = np.concatenate([self.doc[x:y] for x, y in parts])
        scores = np.bincount(docs, np.concatenate([self.posted[x:y] for x, y in parts]), len(self.used))
        scores[self.used] = -1
        order = np.argsort(-scores, kind="stable")
        return order[: len(order) - int(self.used.sum())]


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


class Windows:
    """Cuts documents into windows, and the last one into sequences at powers of two, which need no padding."""

    def __init__(self, window: int, base: int, with_ids: bool):
        self.window, self.sequence, self.with_ids = window, base, with_ids
        self.open: list[tuple] = []
        self.filled = 0
        self.made: list[tuple] = []

    def add(self, key, tokens: np.ndarray) -> bool:
        """Puts a whole document into the open window and as many more as it needs; whether a window was closed."""
        start, closed = 0, False
        while start < len(tokens):
            n = min(self.window - self.filled, len(tokens) - start)
            self.open.append((key, tokens, start, n))
            self.filled, start = self.filled + n, start + n
            if self.filled == self.window:
                self.close(self.open)
                self.open, self.filled, closed = [], 0, True
        return closed

    def close(self, parts: list[tuple]) -> None:
        offset = 0
        for key, tokens, start, n in parts:
            wide = tokens[start : start + n].astype("<u4")
            self.made.append((key, start, n, zlib.crc32(wide.tobytes()), len(tokens), self.sequence, offset, wide.tolist() if self.with_ids else None))
            offset += n
        self.sequence += 1

    def end(self) -> None:
        for bit in range(self.filled.bit_length() - 1, -1, -1):
            if self.filled >> bit & 1:
                room, parts = 1 << bit, []
                while room:
                    key, tokens, start, n = self.open.pop(0)
                    took = min(room, n)
                    parts.append((key, tokens, start, took))
                    if took < n:
                        self.open.insert(0, (key, tokens, start + took, n - took))
                    room -= took
                self.close(parts)
        self.filled = 0

    def batch(self) -> pa.RecordBatch:
        made, self.made = self.made, []
        columns = list(zip(*made, strict=True)) or [[] for _ in PIECES]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)


def fill(windows: Windows, docs: list[tuple], idf: np.ndarray, mean: float) -> None:
    """Puts all documents (key, tokens) of a shard into windows, each time the best unused neighbour of the window's seed."""
    index = Shard([t for _, t in docs], idf, mean)
    ranked, at = None, 0
    while True:
        k = next((k for k in ranked if not index.used[k]), None) if ranked is not None else None
        if k is None:
            while at < len(docs) and index.used[at]:
                at += 1
            if at == len(docs):
                return
            k = at
        index.used[k] = True
        closed = windows.add(*docs[k])
        if closed and not windows.filled:
            ranked = None
        elif closed or ranked is None:
            ranked = iter(index.neighbours(k).tolist())


def _packed(shared, window: int, kind: str, with_ids: bool):
    def run(batches):
        idf, mean = shared.value
        windows = Windows(window, TaskContext.get().partitionId() << 36, with_ids)
        docs, size = [], 0
        for key, raw in rows(batches, "id", "ids", step=64):
            docs.append((key, np.frombuffer(raw, kind)))
            size += len(docs[-1][1])
            if size >= SHARD_TOKENS:
                fill(windows, docs, idf, mean)
                docs, size = [], 0
                yield windows.batch()
        if docs:
            fill(windows, docs, idf, mean)
        windows.end()
        yield windows.batch()

    return lean(run)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, by_word: bool = True, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids where asked for.

    A seed asks its own shard (SHARD_TOKENS) with its QUERY_TERMS heaviest terms; all unused documents there are ranked.
    A document is its ids by the tokenizer at `path`, then `end`; null and empty texts are the end alone. All sequences
    have `window` ids, but for the last of each task, which are as long as powers of two, so nothing is padded. Repeated
    rows and null ids are documents of their own; other columns are left out; an empty table gives no pieces.
    """
    spark = docs.sparkSession
    size = max(tokenizer(path).get_vocab_size(), end + 1)
    kind = "H" if size <= 1 << 16 else "I"
    own = docs.select(F.col(id_col).cast("long").alias("id"), as_bytes(text_col).alias("text"))
    coded = stored(own.mapInArrow(_encoded(path, kind, end, size, by_word), "id long, place long, n long, ids binary"))
    held = coded.filter("place < 0").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(size, np.int64)
    df[held.column("id").to_numpy()] = held.column("n").to_numpy()
    n, total = coded.filter("place >= 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((idf, (total or 0) / max(1, n)))  # as long as the vocabulary
    tasks = max(1, -(-(total or 0) // TASK_TOKENS))
    dealt = coded.filter("place >= 0").select("id", "place", "ids").repartitionByRange(tasks, "place", "id").sortWithinPartitions("place", "id")
    pieces = dealt.mapInArrow(_packed(shared, window, kind, with_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
    return pieces if with_ids else pieces.drop("ids")


def op4(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
