"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Random indexing: every word of a bounded vocabulary has a sparse ternary index vector drawn from its hash; a word's context
vector is the sum of the index vectors of its neighbours over the training sample.  The forms of words (upper case, digits,
trailing symbols, the same word again) have index vectors too.  A document is the mean of its words' context vectors beside the
mean of its forms' vectors.  A tanh layer and a logistic layer, fitted in numpy on the driver over a bounded sample of
labelled rows, give a logit, which a temperature fitted on held-back rows of the sample turns into a probability.

Labels come only from ids whose crc32 modulo 4 is not 2.  Null texts are empty; an empty text is scored by its zero vector.  Equal texts have
equal scores.  Without labelled rows every score is 0.5; with one label only, every score is near that label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import crc_mod, lean, read, ship_package, slices, texts_of
from cellweave.llm.samples import SAMPLE_ROWS, SAMPLE_TEXT_BYTES, labelled

WIDTH = 64
VOCABULARY = 20_000
NEAR = 2
HIDDEN = 32
THRESHOLD = 0.7
#: Distinct raw words whose numbers a worker keeps, and distinct forms, before it starts new tables.
TABLE_WORDS = 150_000
TABLE_FORMS = 100_000

_FORM = bytes.maketrans(bytes(range(256)), bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256)))
_AGAIN = re.compile(rb"(.)\1+", re.S)
_EDGE = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def index_vector(name: bytes, width: int = WIDTH) -> np.ndarray:
    """Eight entries of +1 or -1, chosen by the hash."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(name, 7))
    v = np.zeros(width, np.float32)
    v[rng.choice(width, 8, replace=False)] = rng.choice(np.array([-1, 1], np.float32), 8)
    return v


def form(word: bytes) -> bytes:
    """How a word is written: runs of lower case, upper case, digits and the symbols themselves."""
    return _AGAIN.sub(rb"\1", word.translate(_FORM))


def key(word: bytes) -> bytes:
    return word.strip(_EDGE).lower()


@dataclass
class Model:
    words: dict[bytes, int]
    vectors: np.ndarray  # row 0: words outside the vocabulary
    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    rows: int = 0  # labelled rows that it was fitted on
    forms: dict[bytes, int] = field(default_factory=dict)
    form_rows: list[np.ndarray] = field(default_factory=list)
    table: dict[bytes, int] = field(default_factory=dict)
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def __getstate__(self):
        return self.__dict__ | {"forms": {}, "form_rows": [], "table": {}, "pairs": []}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of raw words in this worker's table, which holds vocabulary row and form of each."""
        got = list(map(self.table.get, words))
        if None in got:
            for k, n in enumerate(got):
                if n is None:
                    w = words[k]
                    n = self.table.get(w)
                    if n is None:
                        f = form(w)
                        at = self.forms.setdefault(f, len(self.forms))
                        if at == len(self.form_rows):
                            self.form_rows.append(index_vector(b"form " + f))
                        n = self.table[w] = len(self.pairs)
                        self.pairs.append((self.words.get(key(w), 0), at))
                    got[k] = n
        return np.array(got, np.int64)

    def forget(self) -> None:
        """Drop what a worker has noted about words."""
        for table in (self.table, self.pairs, self.forms, self.form_rows):
            table.clear()

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean context vector beside mean form vector of each text; zero where there is no word."""
        if len(self.table) > TABLE_WORDS or len(self.forms) > TABLE_FORMS:
            self.forget()
        split = [t.encode().split() for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        out = np.zeros((len(texts), 2 * WIDTH), np.float32)
        n = self.numbers([w for s in split for w in s])
        if not len(n):
            return out
        doc = np.repeat(np.arange(len(texts)), counts)
        pairs = np.array(self.pairs, np.int64)
        row, shape = pairs[n, 0], pairs[n, 1]
        full = counts > 0
        starts = (np.cumsum(counts) - counts)[full]
        total = np.zeros((int(full.sum()), WIDTH), np.float32)
        for at in range(0, WIDTH, 16):  # a block of columns at a time keeps the gathered words small
            total[:, at : at + 16] = np.add.reduceat(self.vectors[:, at : at + 16][row], starts)
        # Each text's different forms with their counts; few against its words, and never a row for each form of the worker's table.
        own, many = np.unique(doc * len(self.form_rows) + shape, return_counts=True)
        where, shape = np.divmod(own, len(self.form_rows))
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        for lo in range(0, len(first), 1024):
            a, b = first[lo], first[lo + 1024] if lo + 1024 < len(first) else len(own)
            out[where[first[lo : lo + 1024]], WIDTH:] = np.add.reduceat(np.stack([self.form_rows[k] for k in shape[a:b]]) * many[a:b, None], first[lo : lo + 1024] - a)
        same = (n[1:] == n[:-1]) & (doc[1:] == doc[:-1])
        echo = np.bincount(doc[1:][same], minlength=len(texts)).astype(np.float32)
        out[full, :WIDTH] = total
        out[:, WIDTH:] += echo[:, None] * 4 * index_vector(b"again")
        out[full] /= counts[full, None]
        return out

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.spread @ self.w1 + self.b1)
        return h @ self.w2 + self.b2

    def score(self, texts: list[str]) -> np.ndarray:
        z = self.logit(self.pooled(texts)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -500, 500)))


def context_vectors(texts: list[str]) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary (words of three texts at least, the most frequent first) and a unit context vector for each."""
    split = [[key(w) for w in t.encode().split()] for t in texts]
    seen = Counter(w for s in split for w in set(s) if w)
    chosen = sorted((w for w, c in seen.items() if c >= 3), key=lambda w: (-seen[w], w))[:VOCABULARY]
    words = {w: k + 1 for k, w in enumerate(chosen)}
    index = np.stack([np.zeros(WIDTH, np.float32), *(index_vector(b"word " + w) for w in chosen)])
    # An index vector as its eight places and signs, so that a neighbour adds eight numbers; texts are kept apart by word 0.
    place = np.argsort(index == 0, axis=1, kind="stable")[:, :8]
    sign = np.take_along_axis(index, place, 1)
    ids = np.array([n for s in split for n in (*(words.get(w, 0) for w in s), *[0] * NEAR)], np.int64)
    vectors = np.zeros(index.size)
    for at in range(0, len(ids), 1 << 17):
        part = ids[at : at + (1 << 17) + NEAR]
        for d in range(1, NEAR + 1):
            left, right = part[:-d][: 1 << 17], part[d:][: 1 << 17]
            for a, b in ((left, right), (right, left)):
                both = (a > 0) & (b > 0)
                vectors += np.bincount((a[both, None] * WIDTH + place[b[both]]).ravel(), sign[b[both]].ravel(), index.size)
    vectors = vectors.reshape(index.shape).astype(np.float32)
    return words, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-6)


def fit(texts: list[str], y: np.ndarray, epochs: int = 400, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Adam over the whole sample; every fifth row is held back to choose the epoch and the temperature."""
    rng = np.random.default_rng(11)
    words, vectors = context_vectors(texts)
    m = Model(words, vectors, np.zeros(2 * WIDTH, np.float32), np.ones(2 * WIDTH, np.float32), rng.normal(0, (2 * WIDTH) ** -0.5, (2 * WIDTH, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0, 1.0, len(y))
    if not len(y):
        return m
    x = np.concatenate([m.pooled(texts[k : k + 200]) for k in range(0, len(texts), 200)]).astype(float)
    m.mean, m.spread = x.mean(0), x.std(0) + 1e-3
    if y.min() == y.max():
        m.b2 = 6.0 if y[0] else -6.0
        return m
    x = (x - m.mean) / m.spread
    back = np.arange(len(y)) % 5 == 4
    if y[~back].min() == y[~back].max() or back.sum() < 20:
        back[:] = False
    xt, yt = x[~back], y[~back]
    params = [m.w1, m.b1, rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(0.0)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    loss = lambda z, t: float(np.mean(np.logaddexp(0, z) - t * z))
    best = (np.inf, [p.copy() for p in params])
    for step in range(1, epochs + 1):
        h = np.tanh(xt @ params[0] + params[1])
        z = h @ params[2] + params[3]
        e = (1 / (1 + np.exp(-z)) - yt) / len(yt)
        back_h = np.outer(e, params[2]) * (1 - h * h)
        grads = [xt.T @ back_h + decay * params[0], back_h.sum(0), h.T @ e + decay * params[2], e.sum()]
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        if back.any() and step % 10 == 0:
            now = loss(np.tanh(x[back] @ params[0] + params[1]) @ params[2] + params[3], y[back])
            if now < best[0]:
                best = (now, [p.copy() for p in params])
    if back.any():
        params = best[1]
        z = np.tanh(x[back] @ params[0] + params[1]) @ params[2] + params[3]
        m.temperature = float(min(np.geomspace(0.25, 8, 60), key=lambda t: loss(z / t, y[back])))
    m.w1, m.b1, m.w2, m.b2 = params[0], params[1], params[2], float(params[3])
    return m


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, text_bytes: int = SAMPLE_TEXT_BYTES) -> Model:
    """Fit on at most `rows` labelled documents of at most `text_bytes` bytes each."""
    got = labelled(docs, labels, label, rows, text_bytes).toPandas().sort_values(["doc_id", "label", "text"], kind="stable")
    return fit(got["text"].tolist(), (got["label"].to_numpy(float) > 0).astype(float))


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, score, predicted) per row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            s = m.score(texts_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])
        m.forget()

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(lean(run), f"`{id_col}` {kind}, score double, predicted int")


def filter_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is at least the threshold, with the columns that they came with; all rows if the model saw no labelled row."""
    if not model.rows:
        return docs
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield batch.filter(pa.array(shared.value.score(texts_of(batch.column(at))) >= threshold))
        shared.value.forget()

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = classify(docs, learn(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
