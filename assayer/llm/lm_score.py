"""Prediction by partial matching: a byte-context trie with escape estimation and symbol exclusion scores documents.

Training counts every symbol after every context of five symbols; shorter contexts are their sums, and every context that
training met is a node of the trie. Orders up to UPPER, which have a fixed largest size, are broadcast. Longer contexts
are dealt to buckets by their last three symbols: chunks of texts ask for their distinct grams, each bucket answers from
its own part of the trie, and the answers return to the chunks. Escapes follow method C (distinct symbols over total plus
distinct), and symbols seen in a longer context are excluded from the shorter ones.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import as_bytes, dropped, held_out, rows, stored, table

ORDER, BITS, EDGE = 5, 9, 256
NODE_SHARE = 2.0**-18
UPPER, BUCKET_BITS = 2, 10
#: Symbols that are counted at once; symbols of the texts that ask together.
CHUNK, ASKING = 1 << 20, 1 << 23
CODED = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("texts", pa.binary()), ("word", pa.string()), ("gram", pa.int64()), ("n", pa.int64()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
TEXT, WORD, LOW, ASKED = range(4)
ANSWERED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("logs", pa.binary())])
SCORED = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())])))])


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as symbols, each behind ORDER edge symbols; the positions of symbols to predict, and each text's first among them."""
    gap = b"\0" * ORDER
    s = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + ORDER)
    for k in range(ORDER):
        s[ends + k] = EDGE
    s[:ORDER] = EDGE
    predicted = np.ones(len(s), bool)
    predicted[:ORDER] = False
    for k in range(1, ORDER):
        predicted[ends + k] = False
    return s, np.flatnonzero(predicted), np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code of ORDER + 1 symbols, the last of them predicted, at each symbol to predict; each text's first."""
    s, at, first = stream(texts)
    code = s[at]
    for k in range(1, ORDER + 1):
        code |= s[at - k] << (BITS * k)
    return code, first


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes and their counts."""
    return np.unique(codes(texts)[0], return_counts=True)


def shorter(code: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes at a lower order and their sums."""
    own, where = np.unique(code & ((1 << (BITS * (order + 1))) - 1), return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, where, n)
    return own, total


def bucket(code: np.ndarray) -> np.ndarray:
    """The bucket of a code, by the last UPPER + 1 symbols of its context."""
    key = (code >> BITS) & ((1 << (BITS * (UPPER + 1))) - 1)
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n, first)


def _chunks(records: Iterator[tuple], at: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[at]) + ORDER
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _record(kind: int, size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind), pa.int32()) if f.name == "kind" else columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in CODED], schema=CODED)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers of one type, byte by byte of all of them, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def widened(held: bytes, n: int, kind) -> np.ndarray:
    """The n numbers that were squeezed."""
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(held, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.array([squeezed(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())


def bundled(records: list[tuple]) -> bytes:
    """(id, held_out, text) of some texts as one compressed piece, behind its length before."""
    ids, held_out, texts = zip(*records, strict=True)
    batch = pa.record_batch([pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(texts, pa.large_binary())], names=["id", "held_out", "text"])
    plain = batch.serialize()
    return plain.size.to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def unbundled(held: bytes) -> list[list]:
    """The ids, held_out and texts that were bundled."""
    plain = pa.decompress(pa.py_buffer(held)[8:], int.from_bytes(held[:8], "little"), codec="zstd")
    schema = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.large_binary())])
    return [c.to_pylist() for c in pa.ipc.read_record_batch(plain, schema).columns]


def _steps(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Codes as differences to the one before, but for the first of each bucket."""
    steps = np.diff(code, prepend=0)
    steps[first] = code[first]
    return steps


def _count(batches):
    """Texts in chunks, each chunk's distinct grams with their counts in training by bucket, and sums of words and of low orders."""
    words: Counter = Counter()
    low: list[tuple[np.ndarray, np.ndarray]] = []
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    own: list[tuple] = []
    ends = size = 0
    chunk = TaskContext.get().partitionId() << 32

    def said():
        if words:
            yield _record(WORD, len(words), word=pa.array([w.decode() for w in words], pa.string()), n=pa.array(list(words.values()), pa.int64()))
        words.clear()

    def asked():
        code, n = _merged(parts)
        parts.clear()
        known = n > 0
        low.append(shorter(code[known], n[known], UPPER))
        if len(low) >= 8:
            low[:] = [_merged(low)]
        at = bucket(code)
        order = np.argsort(at, kind="stable")
        found, first = np.unique(at[order], return_index=True)
        bounds = np.append(first, len(code))
        yield _record(ASKED, len(found), chunk=pa.array(np.full(len(found), chunk)), bucket=pa.array(found), n=pa.array(np.diff(bounds)), grams=_packed(_steps(code[order], first), bounds), counts=_packed(n[order].astype(np.int32), bounds))

    for held in _chunks(rows(batches, "id", "held_out", "train", "text"), 3):
        texts = [r[3].lower() for r in held]
        learnt = [t for t, r in zip(texts, held, strict=True) if r[2]]
        for t in learnt:
            words.update(t.split())
        ends += len(learnt)
        if learnt:
            parts.append(grams(learnt))
        if len(learnt) < len(held):
            code, n = grams([t for t, r in zip(texts, held, strict=True) if not r[2]])
            parts.append((code, np.zeros_like(n)))
        yield _record(TEXT, 1, chunk=pa.array([chunk], pa.int64()), texts=pa.array([bundled([(r[0], r[1], t) for r, t in zip(held, texts, strict=True)])], pa.binary()))
        size += sum(map(len, texts))
        if len(parts) >= 8:
            parts[:] = [_merged(parts)]
        if size >= ASKING:
            yield from asked()
            size, chunk = 0, chunk + 1
        if len(words) > 400_000:
            yield from said()
    if parts:
        yield from asked()
    yield from said()
    if low:
        code, n = _merged(low) if sum(len(c) for c, _ in low) else low[0]
        yield _record(LOW, len(code), gram=pa.array(code), n=pa.array(n))
    if ends:  # the end of a text is the token without a word
        yield _record(WORD, 1, n=pa.array([ends], pa.int64()))


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of wanted in the sorted keys, and their length for what isn't there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))


class Model:
    """Log10 probabilities from counts: for each order from 0, sorted codes (context and symbol) and their numbers.

    What follows a context also follows its shorter ones, so excluding at an order takes the symbols of the next longer
    node, if there is one. upper: a model of the lowest orders, which counts go on from.
    """

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], upper: Model | None = None):
        self.counts, self.nodes = (list(upper.counts), list(upper.nodes)) if upper else ([], [])
        for code, n in counts:
            k = len(self.counts)
            nodes, first = np.unique(code >> BITS, return_index=True)
            below = self._number(k - 1, code) if k else np.zeros(len(code), np.int64)
            total, below = (np.add.reduceat(x, first) if len(code) else np.zeros(0, np.int64) for x in (n, below))
            # nodes, and of each: all its counts, its symbols, and their counts one order lower; 0 where there is no node
            self.nodes.append((nodes, np.append(total, 0), np.append(np.diff(np.append(first, len(code))), 0), np.append(below, 0)))
            self.counts.append((code, np.append(n, 0)))

    def _number(self, k: int, code: np.ndarray) -> np.ndarray:
        own, n = self.counts[k]
        return n[_at(own, code & ((1 << (BITS * (k + 1))) - 1))]

    @property
    def size(self) -> int:
        return len(self.counts[0][0]) + 1

    @property
    def table(self) -> np.ndarray:
        """Of each node of each order, the chances of the symbols of training and of one that it never saw."""
        seen = self.counts[0][0]
        symbols = np.append(seen, np.setdiff1d(np.arange(EDGE + 1), seen)[:1])
        return np.concatenate([self.logs((x[0][:, None] << BITS | symbols).ravel(), k).reshape(len(x[0]), len(symbols)) for k, x in enumerate(self.nodes)])

    def logs(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log10 probability of each code's symbol after its context of `order` symbols."""
        chance, escape, left = np.zeros(len(code)), np.ones(len(code)), np.ones(len(code), bool)
        gone, excluded = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for k in range(order, -1, -1):
            nodes, total, distinct, below = self.nodes[k]
            at = _at(nodes, (code >> BITS) & ((1 << (BITS * k)) - 1))
            n, new = self._number(k, code), distinct[at] - excluded
            whole = np.maximum(total[at] - gone + new, 1)
            chance = np.where(left & (n > 0), escape * n / whole, chance)
            left &= n == 0
            escape = np.where(new > 0, escape * new / whole, escape)
            gone, excluded = below[at], distinct[at]
        return np.log10(np.where(left, escape / np.maximum(EDGE + 1 - excluded, 1), chance))  # at the end, all symbols not yet seen are alike


def train(coded: DataFrame) -> tuple[DataFrame, dict, Model]:
    """Word counts (word, c), the frequent words, and the model of the orders up to UPPER, of a stored table of _count.

    Frequent are words with at least 2^-18 of all tokens, so there are at most 2^18 of them.
    """
    words = stored(coded.filter(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("c")))
    total, distinct, ends = words.agg(F.sum("c"), F.count(F.lit(1)), F.max(F.when(F.col("word").isNull(), F.col("c")))).first()
    words, total = words.filter("word IS NOT NULL"), total or 0
    frequent = words.filter(F.col("c") >= max(1, total * NODE_SHARE)).select("word", "c").toArrow()
    low = coded.filter(F.col("kind") == LOW).groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    code, n = (low.column(name).to_numpy().astype(np.int64) for name in ("gram", "n"))
    return words, {"frequent": frequent, "total": int(total), "distinct": int(distinct or 0), "ends": int(ends or 0)}, Model([shorter(code, n, k) for k in range(UPPER + 1)])


def _answer(shared):
    """The log10 probabilities of the grams that all chunks ask of a bucket."""

    def run(asked: pa.Table) -> pa.Table:
        sizes = asked.column("n").to_pylist()
        wanted = [np.cumsum(widened(x, k, np.int64)) for x, k in zip(asked.column("grams").to_pylist(), sizes, strict=True)]
        code, n = _merged(list(zip(wanted, (widened(x, k, np.int32).astype(np.int64) for x, k in zip(asked.column("counts").to_pylist(), sizes, strict=True)), strict=True)))
        known = n > 0
        model = Model([shorter(code[known], n[known], k) for k in range(UPPER + 1, ORDER + 1)], shared.value)
        logs = model.logs(code).astype(np.float32)
        return pa.table([asked.column("chunk"), asked.column("bucket"), asked.column("n"), pa.chunked_array([pa.array([squeezed(logs[np.searchsorted(code, x)]) for x in wanted], pa.binary())])], schema=ANSWERED)

    return run


def _score(shared):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = shared.value
        below = known["total"] + 0.5 * (known["distinct"] + 1)
        logs = _word_logs(known, below)
        end = float(np.log10((known["ends"] + 0.5) / below))
        asked = [unbundled(x) for x in texts.column("texts").to_pylist()]
        distinct = [np.unique(codes(t)[0]) for _, _, t in asked]
        code = np.unique(np.concatenate(distinct))
        found = np.empty(len(code), np.float32)
        told = answers.sort_by("bucket")
        found[np.argsort(bucket(code), kind="stable")] = np.concatenate([widened(x, k, np.float32) for x, k in zip(told.column("logs").to_pylist(), told.column("n").to_pylist(), strict=True)])
        out = []
        for (ids, held_out, own), part in zip(asked, distinct, strict=True):
            at, first = codes(own)
            scores = np.add.reduceat(found[np.searchsorted(code, part)].astype(np.float64)[np.searchsorted(part, at)], first)
            tokens, sure, base, rare = [], [], [], []
            for t in own:
                words = t.split()
                n_known, sum_, left = int(known["ends"] > 0), end, []
                for w, n in Counter(words).items():
                    log = logs.get(w)
                    if log is None:
                        left.append({"word": w.decode(), "n": n})
                    else:
                        sum_ += n * log
                        n_known += n
                tokens.append(len(words) + 1)
                sure.append(n_known)
                base.append(sum_)
                rare.append(left)
            out.append(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(tokens, pa.int64()), pa.array(sure, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array(rare, SCORED.field("rare").type)], schema=SCORED))
        return pa.Table.from_batches(out, SCORED)

    return run


def _word_logs(known: dict, below: float) -> dict[bytes, float]:
    """Log10 shares of the frequent words, made once a worker."""
    if "logs" not in known:
        known["logs"] = {w: float(np.log10((c + 0.5) / below)) for w, c in zip(known["frequent"].column("word").cast(pa.binary()).to_pylist(), known["frequent"].column("c").to_pylist(), strict=True)}
    return known["logs"]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z) first, and the model predicts their bytes, white space included, and their end. A null
    text is empty; without training rows every symbol is equally likely; repeated rows each get their row; a null id
    trains nothing and isn't held out. Other columns are left out.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out(id_col, modulus, remainder), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    train_col = (~F.col("held_out") & F.col("id").isNotNull()).alias("train")
    coded = stored(own.select("id", "held_out", train_col, as_bytes("text").alias("text")).mapInArrow(_count, "kind int, chunk long, texts binary, word string, gram long, n long, bucket int, grams binary, counts binary"))
    words, known, upper = train(coded)
    context = docs.sparkSession.sparkContext
    asked = coded.filter(F.col("kind") == ASKED).select("chunk", "bucket", "n", "grams", "counts")
    answers = asked.groupBy("bucket").applyInArrow(_answer(context.broadcast(upper)), "chunk long, bucket int, n long, logs binary")
    texts = coded.filter(F.col("kind") == TEXT).select("chunk", "texts")
    schema = "id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word: string, n: int>>"
    scored = stored(texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(context.broadcast(known)), schema).withColumn("at", F.monotonically_increasing_id()))
    dropped(coded)  # what comes next reads the words and the scores, which are stored
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / (known["total"] + 0.5 * (known["distinct"] + 1)))
    rare = scored.select("at", F.inline("rare")).join(words, "word", "left").groupBy("at").agg(F.sum(F.col("n") * log).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("also"))
    return scored.drop("rare").join(rare, "at", "left").select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(known["total"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
    )


def op2(spark, sf_dir):
    return score(table(spark, sf_dir, "documents"))
