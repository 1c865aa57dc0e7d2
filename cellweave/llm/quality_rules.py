"""Quality rules: counts over a document's words and lines, base rules, and gradient-boosted trees over the statistics.

The trees are fitted with numpy on the driver over the statistics of a bounded sample of labelled rows, by histograms, with
monotonic constraints on chosen features: more symbols, repeated lines or repeated windows can only lower a document's odds.
They are flattened into node arrays and scored for a whole batch at once.

Null texts have no words; a text without words fails the base rules (n_words < 20) and has zero counts.  Repeated rows get equal
results.  Without any labelled row, or with one label only, the verdict of the trees is the same for all: kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import lean, read, ship_package, slices, texts_of
from cellweave.llm.samples import SAMPLE_ROWS, measured

WINDOW = 8
SYMBOLS = "#*$%&|<>"
LINE_SPACE = " \t\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that the trees see, and the sign of the only direction in which the odds of being kept may move.
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "distinct_share": 0,
    "echo_share": -1,
    "bang_share": 0,
    "pipe_share": 0,
    "stop_share": 0,
    "line_words": 0,
}
KEEP_AT = 0.5


def repeated_window_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = WINDOW) -> np.ndarray:
    """Per document, the words that lie in some window of `window` words found at least twice in the same document.

    ids: each word's number, doc: each word's document, ascending.  Windows are first compared by a 64-bit mixed value; documents
    with an apparent repeat are compared exactly, by doubling: pairs of equal pairs are numbered anew.
    """
    out = np.zeros(n_docs, np.int64)
    n = len(ids) - window + 1
    if n < 2:
        return out
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        word = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        word ^= word >> np.uint64(29)
        for k in range(window):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[k : k + n]
            h ^= h >> np.uint64(32)
        h += doc[:n].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(31)
    inside = doc[:n] == doc[window - 1 :]
    s = np.sort(h[inside])
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return out
    starts = np.flatnonzero(inside & np.isin(h, twice))
    suspects = np.unique(doc[starts])
    bounds = np.searchsorted(doc, np.stack([suspects, suspects + 1]))
    for d, a, b in zip(suspects, *bounds, strict=True):
        code, width = ids[a:b].astype(np.int64), 1
        while width < window:
            pair = code[: len(code) - width] * (code.max() + 1) + code[width:]
            _, code = np.unique(pair, return_inverse=True)
            width *= 2
        again = np.bincount(code)[code] > 1
        edge = np.zeros(b - a + 1, np.int64)
        at = np.flatnonzero(again)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        out[d] = int((np.cumsum(edge)[:-1] > 0).sum())
    return out


def statistics(texts: list[str]) -> dict[str, np.ndarray]:
    """BASE counts (long) and FEATURES (double) of each text."""
    n = len(texts)
    table: dict[bytes, int] = {}
    flat: list[int] = []
    counts = np.zeros(n, np.int64)
    out = {k: np.zeros(n, np.int64) for k in BASE}
    rest = {k: np.zeros(n, np.int64) for k in ("upper", "digit", "bang", "pipe", "stop", "lines", "chars")}
    number = table.setdefault
    for k, t in enumerate(texts):
        words = t.encode().split()
        flat += [number(w, len(table)) for w in words]
        counts[k] = len(words)
        rest["chars"][k] = len(t)
        out["word_chars"][k] = len(t) - sum(map(t.count, " \t\n\x0b\x0c\r"))
        out["n_symbols"][k] = sum(map(t.count, SYMBOLS))
        lines = [x for x in t.split("\n") if x.strip(LINE_SPACE)]
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
        rest["lines"][k] = len(lines)
        b = np.frombuffer(t.encode(), np.uint8)
        hist = np.bincount(b, minlength=256)
        rest["upper"][k] = hist[65:91].sum()
        rest["digit"][k] = hist[48:58].sum()
        rest["bang"][k] = hist[33]
        rest["pipe"][k] = hist[124]
        rest["stop"][k] = hist[46] + hist[44]
    ids = np.array(flat, np.int64)
    doc = np.repeat(np.arange(n), counts)
    out["n_words"] = counts
    out["n_repeat_words"] = repeated_window_words(ids, doc, n)
    words, chars = np.maximum(counts, 1), np.maximum(out["word_chars"], 1)
    echo = np.zeros(n, np.int64)
    if len(ids) > 1:
        same = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
        echo = np.bincount(doc[1:][same], minlength=n)
    distinct = np.zeros(n, np.int64)
    if len(ids):
        key = np.sort(doc * (len(table) + 1) + ids)
        first = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount(key[first] // (len(table) + 1), minlength=n)
    return out | {
        "log_words": np.log1p(counts.astype(float)),
        "mean_word": out["word_chars"] / words,
        "symbol_share": out["n_symbols"] / chars,
        "dup_line_share": out["n_dup_lines"] / np.maximum(rest["lines"], 1),
        "repeat_share": out["n_repeat_words"] / words,
        "upper_share": rest["upper"] / chars,
        "digit_share": rest["digit"] / chars,
        "distinct_share": distinct / words,
        "echo_share": echo / words,
        "bang_share": rest["bang"] / words,
        "pipe_share": rest["pipe"] / words,
        "stop_share": rest["stop"] / words,
        "line_words": counts / np.maximum(rest["lines"], 1),
    }


@dataclass
class Trees:
    """Flattened trees: a leaf is its own left and right child."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            z += self.value[node]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 48, least: float = 8.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting for the logistic loss over quantile bins; sign: +1, -1 or 0 per feature."""
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    p0 = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
    base = float(np.log(p0 / (1 - p0)))
    if len(y) and 0 < y.mean() < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
        z = np.full(len(y), base)

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
            me = len(feature)
            weight = lambda a, b: float(np.clip(-a / (b + ridge), low, high))
            for column, v in ((feature, 0), (threshold, 0.0), (left, me), (right, me), (value, rate * weight(g[rows].sum(), h[rows].sum()))):
                column.append(v)
            if level == depth or len(rows) < 2 * least:
                return me
            best = (1e-6, -1, 0, 0.0, 0.0)
            gt, ht = g[rows].sum(), h[rows].sum()
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                b = binned[rows, j]
                gl = np.cumsum(np.bincount(b, g[rows], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                wl, wr = np.clip(-gl / (hl + ridge), low, high), np.clip(-(gt - gl) / (ht - hl + ridge), low, high)
                gain = -(gl * wl + 0.5 * (hl + ridge) * wl**2) - ((gt - gl) * wr + 0.5 * (ht - hl + ridge) * wr**2) - 0.5 * gt**2 / (ht + ridge)
                ok = (nl >= least) & (len(rows) - nl >= least) & (sign[j] * (wr - wl) >= 0)
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k, float(wl[k]), float(wr[k]))
            _, j, k, wl, wr = best
            if j < 0:
                return me
            middle = (wl + wr) / 2
            bound = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(sign[j])]
            go = binned[rows, j] <= k
            feature[me], threshold[me] = j, float(cuts[j][k])
            left[me] = grow(rows[go], g, h, level + 1, *bound[0])
            right[me] = grow(rows[~go], g, h, level + 1, *bound[1])
            return me

        for _ in range(trees):
            p = 1 / (1 + np.exp(-z))
            g, h = p - y, p * (1 - p)
            first = len(feature)
            roots.append(grow(np.arange(len(y)), g, h, 0, -6.0, 6.0))
            one = Trees(*(np.array(c) for c in (feature, threshold, left, right, value)), np.array([first]), 0.0, depth)
            node = np.full(len(y), first)
            for _ in range(depth):
                node = np.where(x[np.arange(len(y)), one.feature[node]] <= one.threshold[node], one.left[node], one.right[node])
            z += one.value[node]
    return Trees(np.array(feature, np.int64), np.array(threshold, float), np.array(left, np.int64), np.array(right, np.int64), np.array(value, float), np.array(roots, np.int64), base, depth)


def matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.asarray(stats[k], float) for k in FEATURES], 1)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """Fit on the statistics of at most `rows` labelled documents, whole texts, whatever their length."""
    names = list(FEATURES)
    got = measured(docs, labels, label, statistics, names, rows).toPandas().sort_values(["label", *names])
    return fit(got[names].to_numpy(), (got["label"].to_numpy() > 0).astype(float), np.array(list(FEATURES.values())))


def apply_rules(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """(id, BASE counts, base_failed, rule_score, kept) per row."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *BASE, "base_failed", "rule_score", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = statistics(texts_of(batch.column(1)))
            score = trees.score(matrix(x))
            failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[k]) for k in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep_at))], names=names)

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{k} long" for k in BASE) + ", base_failed boolean, rule_score double, kept boolean"
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def filter_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """The rows that the rules keep, with the columns that they came with.  One pass, no join: the verdict is made beside the row."""
    ship_package(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            x = statistics(texts_of(batch.column(at)))
            failed = (x["n_words"] < 20) | (100 * x["n_repeat_words"] > 30 * x["n_words"])
            yield batch.filter(pa.array(~failed & (trees.score(matrix(x)) >= KEEP_AT)))

    return docs.mapInArrow(lean(run), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return apply_rules(docs, learn(docs, read(spark, sf_dir, "labels")))
