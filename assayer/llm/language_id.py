"""Language identification by error-correcting output codes over byte n-grams.

Each language has a codeword of bits. A bit's classifier is linear in n-gram frequencies: the log ratio of the mean
n-gram distributions of the languages with and without the bit. Decoding takes the codeword with the least loss,
summed over bits with each bit weighted by how well it parts its languages.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import as_bytes, free_names, held_out, lean, rows, table

FEATURES, SMOOTHING, SHARP, AMBIGUOUS = 8192, 0.5, 4.0, 0.005
CHUNK = 1 << 19
UNDETERMINED = "und"

#: A-Z to a-z, other ASCII than letters to a space; bytes of other letters stay.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_MULTIPLIER = np.int64(0x9E3779B1)


def features(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte bigrams and trigrams, a row for each text; n-grams of spaces alone don't count."""
    sizes = np.array([len(t) + 2 for t in texts])
    s = _FOLD[np.frombuffer(b"  " + b"  ".join(texts), np.uint8)].astype(np.int64)
    doc = np.repeat(np.arange(len(texts)) * FEATURES, sizes)
    two = s[1:] | (s[:-1] << 8)
    three = two[1:] | (s[:-2] << 16)
    doc3 = doc[2:] if len(doc) > 2 else doc[:0]
    inner = np.ones(len(s), bool)  # n-grams that end in the spaces before a text would hold the end of the text before it
    starts = np.cumsum(sizes) - sizes
    inner[starts] = inner[starts + 1] = False
    keep = (three != 0x202020) & inner[2:]
    out = np.zeros(len(texts) * FEATURES, np.int64)
    for code, ok in ((three, keep), (two[1:] + (1 << 24), keep & (two[1:] != 0x2020))):
        slot = ((code * _MULTIPLIER) >> 15) & (FEATURES - 1)
        out += np.bincount((doc3 + slot)[ok], minlength=len(out))
    return out.reshape(len(texts), FEATURES)


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def _chunks(records, at):
    held, size = [], 0
    for r in records:
        held.append(r)
        size += len(r[at])
        if size >= CHUNK or len(held) >= 256:
            yield held
            held, size = [], 0
    if held:
        yield held


COUNTS = pa.schema([("lang", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])


def _count(batches):
    sums: dict[str, np.ndarray] = {}
    for held in _chunks(rows(batches, "lang", "text"), 1):
        found = features([r[1] for r in held])
        for lang in {r[0] for r in held}:
            own = found[[k for k, r in enumerate(held) if r[0] == lang]].sum(0)
            sums[lang] = sums[lang] + own if lang in sums else own
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at])], schema=COUNTS)


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: all splits in two for up to 6 classes, else random columns that differ."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        columns = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(columns, float).T
    rng, best = np.random.default_rng(7), None
    bits = int(np.ceil(15 * np.log2(n)))
    for _ in range(50):
        code = rng.choice([1.0, -1.0], size=(n, bits))
        near = (code @ code.T - 2 * bits * np.eye(n)).max()
        if best is None or near < best[0]:
            best = (near, code)
    return best[1][:, [len(set(c)) > 1 for c in best[1].T]]


class Coder:
    """langs: the learned languages, sorted; counts: their n-gram counts, a row each."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * FEATURES)
        if len(langs) > 1:
            side = lambda sign: np.stack([share[self.code[:, b] == sign].mean(0) for b in range(self.code.shape[1])], 1)
            self.weights = np.log(side(1)) - np.log(side(-1))
            margins = share @ self.weights * self.code
            self.scale = np.maximum(margins.mean(0), 1e-9)
            self.trust = np.maximum(margins.min(0) / self.scale, 1e-3)
            self.trust /= self.trust.sum()

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        """Language, score and whether two codewords are about as near, for each text."""
        if not self.langs:
            return [(UNDETERMINED, 0.0, False)] * len(texts)
        if len(self.langs) == 1:
            return [(self.langs[0], 1.0, False) if has_letter(t) else (UNDETERMINED, 0.0, False) for t in texts]
        found = features(texts)
        signal = found @ self.weights / np.maximum(found.sum(1, keepdims=True), 1) / self.scale
        loss = (np.logaddexp(0, -SHARP * signal[:, None, :] * self.code[None]) * self.trust).sum(2)
        best, two = loss.argmin(1), np.sort(loss, 1)[:, :2]
        chance = np.exp(-SHARP * (loss - two[:, :1]))
        score = 1 / chance.sum(1)
        return [(self.langs[b], round(float(s), 6), bool(w[1] - w[0] < AMBIGUOUS)) if has_letter(t) else (UNDETERMINED, 0.0, False) for t, b, s, w in zip(texts, best, score, two, strict=True)]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Coder:
    """Learns from all rows with a language and a text. What reaches the driver is a number for each language and feature."""
    sums = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), as_bytes(text_col).alias("text"))
    found = sums.mapInArrow(lean(_count), "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), FEATURES))
    counts[np.searchsorted(langs, found["lang"]) if len(langs) else [], found["feature"].to_numpy(int)] = found["n"].to_numpy(float)
    return Coder(langs, counts)


PREDICTED = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])


def _predict(coder):
    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), 128):
                part = batch.slice(at, 128)
                texts = part.column(part.num_columns - 1).to_pylist()
                out = coder.value.predict(texts) if texts else []
                more = [pa.array([r[k] for r in out], f.type) for k, f in enumerate(PREDICTED)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *more], names=[*part.schema.names[:-1], *PREDICTED.names])

    return lean(run)


def identify(docs: DataFrame, coder: Coder, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous behind; columns of these names are replaced.

    `und` with score 0 stands for null texts, texts without a letter, and all texts where nothing was learned. Rows stay
    one for one, repeated rows too. ambiguous: the two least losses differ by under 0.005.
    """
    shared = docs.sparkSession.sparkContext.broadcast(coder)  # languages by features, whatever the input's size
    own = docs.drop(*PREDICTED.names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "lang_pred string, score double, ambiguous boolean"])
    (copy,) = free_names(own, "bytes")
    return own.withColumn(copy, as_bytes(text_col)).mapInArrow(_predict(shared), schema)


def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out("doc_id", 4, 2), F.lit(False))
    coder = train(docs.filter(~out))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), coder).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
