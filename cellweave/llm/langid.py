"""Language identification by error-correcting output codes.

Each language has a codeword.  For every bit a logistic classifier over hashed byte trigrams says which side a text is on.
Decoding is weighted by loss: a codeword's distance is the sum, over the bits, of the logistic loss of the bit's margin times the
bit's weight (its accuracy on the sample above chance).  The nearest codeword wins; a small lead over the second flags ambiguity.

Fitted on a bounded sample of documents with a language, drawn by language so that rare ones are learned too, ids of crc32 modulo 4 equal
to 2 excepted.  A null text, or one without a letter, is `und` with score 0.  Ties go to the first language in order.  With no labelled row at all, everything is `und`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import crc_mod, read, ship_package, slices, texts_of
from cellweave.llm.samples import by_label

BUCKETS = 4096
SAMPLE_ROWS = 4000
SAMPLE_TEXT_BYTES = 20_000
#: Leads below this mean an ambiguous text.
MARGIN = 0.15
_LETTER = re.compile(r"[^\W\d_]")
_LOWER = bytes(b + 32 if 65 <= b < 91 else 32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in range(256))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))  # word characters hold fractions and powers too


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the text: A-Z lower-cased, runs of other ASCII taken as spaces."""
    b = np.frombuffer(b" " + text.encode().translate(_LOWER) + b" ", np.uint8).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    if len(b) < 3:
        return np.zeros(0, np.int64)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(20)).astype(np.int64)


def codewords(k: int) -> np.ndarray:
    """k rows of +1 and -1: all distinct splits for few languages, else seeded random columns; rows always differ."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        splits = [[1 if (s >> j) & 1 else -1 for j in range(k)] for s in range(1, 2 ** (k - 1))]
        return np.array(splits, float).T
    rng, bits = np.random.default_rng(3), 15 * int(np.ceil(np.log2(k)))
    while True:
        code = rng.choice([-1.0, 1.0], (k, bits))
        if (np.abs(code.sum(0)) < k).all() and len(np.unique(code, axis=0)) == k:
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    bit_weight: np.ndarray

    def margins(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.weights.shape[1]))
        for k, t in enumerate(texts):
            g = trigrams(t)
            if len(g):
                f = np.bincount(g, minlength=BUCKETS).astype(np.float32)
                out[k] = np.sqrt(f) @ self.weights / np.sqrt(f.sum())
        return out + self.bias

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability-like score, ambiguity."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        m = self.margins(texts)
        loss = np.stack([(np.logaddexp(0, -m * c) * self.bit_weight).sum(1) for c in self.code], 1)
        p = np.exp(-(loss - loss.min(1, keepdims=True)))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = p.max(1)
        second = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        letters = np.array([has_letter(t) for t in texts], bool)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, top, 0.0), ~letters | (top - second < MARGIN)


def fit(texts: list[str], langs: list[str], epochs: int = 150, rate: float = 0.05, decay: float = 1e-4) -> Model:
    keep = [k for k, t in enumerate(texts) if has_letter(t)]
    languages = sorted({langs[k] for k in keep})
    code = codewords(len(languages))
    n, bits = len(keep), code.shape[1]
    weights, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if not n:
        return Model([], code, weights, bias, np.ones(bits))
    x = np.zeros((n, BUCKETS), np.float32)
    for r, k in enumerate(keep):
        f = np.bincount(trigrams(texts[k]), minlength=BUCKETS)
        x[r] = np.sqrt(f) / np.sqrt(max(f.sum(), 1))
    y = code[[languages.index(langs[k]) for k in keep]].astype(np.float32)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, epochs + 1):
        z = x @ weights + bias
        e = -y / (1 + np.exp(np.clip(y * z, -60, 60))) / n
        for p, g, a, b in ((weights, x.T @ e + decay * weights, *moments[:2]), (bias, e.sum(0), *moments[2:])):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    right = ((x @ weights + bias) * y > 0).mean(0)
    return Model(languages, code, weights, bias, np.maximum(2 * right - 1, 0.05))


def learn(docs: DataFrame, rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES) -> Model:
    """Fit on at most `rows` documents with a language, an equal share of each, texts of at most `text_bytes` bytes."""
    got = by_label(docs, "lang", rows, text_bytes).toPandas().sort_values(["doc_id", "label", "text"], kind="stable")
    return fit(got["text"].tolist(), got["label"].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, ambiguous) per row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, score, odd = shared.value.decide(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names), pa.array(score), pa.array(odd)], names=[id_col, "lang_pred", "score", "ambiguous"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double, ambiguous boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs)).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")
