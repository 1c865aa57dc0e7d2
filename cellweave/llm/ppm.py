"""Language-model scoring by prediction by partial matching, beside a word-count baseline over the whole training part.

The model is a trie of byte contexts, up to `depth` bytes deep, with the counts of all training texts; every context seen is kept.  A
text is its lower-cased bytes and an end symbol (byte 0xFF, which UTF-8 never holds); its first bytes have zero bytes as context.  The
score is log10 of the probability of all of these, so, as in the baseline, that of the whole text and its end.

After a context, a byte that has followed it has probability (1 - e) n / T (n: its count, T: all).  With probability e the model escapes to
the context shorter by one byte, where the bytes that the longer one has seen are excluded, and so on, down to equal shares of the bytes
that no training text holds.  A context that was never seen passes on to the shorter one.  e is estimated per class of contexts
(their length, T and the number q of different bytes, both rounded above a limit), by leaving one out: of all occurrences in the class' contexts, taken
away one at a time, the share that the rest would not have seen; where a class has few, method D's q / 2T prevails.

How it is spread.  A task cuts its input into parts of PART_BYTES of text.  A part sends its distinct words and grams (context and
byte), packed by bucket of their hash, and its texts, compressed; a bucket's task adds up, and a part gets the sums of its own words back.  The distinct grams are
dealt once more by their last three context bytes: a context's bytes are among those of any suffix of it, so these groups hold all that
the probabilities of contexts of three bytes and more depend on, and a group has no more than 256^(depth - 2) grams however large the corpus is.  Only the counts
after contexts of up to two bytes (2^24 by their nature) and the escape classes go to every worker.  Probabilities go back to each part
by the buckets that its grams came in.  No task depends on the frequency of a word or context, and texts are shuffled once, compressed, to
meet the answers for their part.

Null texts are empty (one token, the end).  Rows with equal ids are scored each.  Without training rows N and V are zero and all bytes
are equally likely.  Very long texts are read in blocks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import crc_mod, joined, lean, materialise, packed, read, release, remove, shared_dir, ship_package, slices, texts_of

#: Bytes of the longest context that the query learns.
DEPTH = 5
#: Bytes of text of a part, and the distinct words and grams of one that a worker holds before it sends them on.
PART_BYTES = 32 << 20
PART_WORDS = 400_000
PART_GRAMS = 2_000_000
#: Bytes of text for each bucket of words and of grams.
BUCKET_BYTES = 16 << 20
#: Bytes that are turned into words or grams at once.
BLOCK = 1 << 20
#: Grams of one row that goes to be assessed, if they have more than one group.
ROW_GRAMS = 1_000_000
#: The end of a text, as a byte and as a word: neither is in UTF-8.
END = b"\xff"
#: Classes of totals and of numbers of different bytes; occurrences that method D's estimate counts as.
SIDE = 64
TRUST = 8.0
_SPACE = re.compile(rb"[\t-\r ]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hash(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of each word."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), [("h", "<i8"), ("g", "<i4"), ("rest", "<i4")])
    return raw["h"].copy(), raw["g"].copy()


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes]]]:
    """(text's number, bytes) in groups of about BLOCK bytes; a longer text is cut, in front of white space only."""
    group, size = [], 0
    for k, t in enumerate(texts):
        at = 0
        while at < len(t) or not at:
            cut = len(t)
            if cut - at > BLOCK and (m := _SPACE.search(t, at + BLOCK)):
                cut = m.start()
            group.append((k, t[at:cut]))
            size, at = size + cut - at, max(cut, 1)
            if size >= BLOCK:
                yield group
                group, size = [], 0
    if group:
        yield group


def grams(texts: list[bytes], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (every byte of the texts and their ends with the `depth` bytes before it, at most six, as one number; its text's number)."""
    a = np.frombuffer(b"".join(bytes(depth) + t + END for t in texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + depth + 1 for t in texts)])
    for at in range(depth, len(a), BLOCK):
        stop = min(len(a), at + BLOCK)
        code = np.zeros(stop - at, np.int64)
        for k in range(depth + 1):
            code <<= 8
            code |= a[at - depth + k : stop - depth + k]
        first, last = np.searchsorted(starts, [at, stop - 1], "right") - 1
        owner = np.repeat(np.arange(first, last + 1), np.diff(np.clip(starts[first : last + 2], at, stop)))
        inside = np.arange(at, stop) - starts[owner] >= depth
        yield code[inside], owner[inside]


def bucket_of(code: np.ndarray, n: int) -> np.ndarray:
    return ((code.astype(np.uint64) * _MIX >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def dealt(p: np.ndarray, *columns: np.ndarray, rising: bool = False) -> tuple[np.ndarray, list[list[bytes]]]:
    """The different values of p, and of each column the packed values that go with them.  rising: those of the first column are in order."""
    order = np.argsort(p, kind="stable")
    p = p[order]
    cuts = [0, *(np.flatnonzero(np.diff(p)) + 1), len(p)] if len(p) else [0]
    return p[cuts[:-1]], [[packed(x[order[a:b]], rising and x is columns[0]) for a, b in zip(cuts, cuts[1:], strict=False)] for x in columns]


def added(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes in order, and their counts."""
    own, at = np.unique(code, return_inverse=True)
    return own, np.bincount(at, n, len(own)).astype(np.int64)


def class_of(total: np.ndarray, different: np.ndarray) -> np.ndarray:
    """Class of a context with so many bytes, so many of them different."""
    t = np.maximum(np.asarray(total, float), 1)
    rounded = np.where(t <= 16, t, np.minimum(17 + np.floor(2 * np.log2(t / 16)), SIDE - 1)).astype(np.int64)
    return rounded * SIDE + np.minimum(np.asarray(different), SIDE - 1).astype(np.int64)


def left_out(total: np.ndarray, different: np.ndarray, once: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By class: occurrences that the others of their context would not, and would, have seen.  once: bytes that a context has seen once."""
    some = total > 1
    total, different, once = total[some], different[some], once[some]
    fresh = np.bincount(class_of(total - 1, different - 1), once, SIDE * SIDE)
    return fresh, np.bincount(class_of(total - 1, different), total - once, SIDE * SIDE)


class Model:
    """Counts after contexts of up to two bytes, escapes of all classes, and the probabilities that follow from these and the grams' own counts."""

    def __init__(self, code: np.ndarray, n: np.ndarray, classes: np.ndarray):
        """code: two context bytes and a byte, in order and all that training texts have; n: how often; classes: left_out() by context length, of three bytes and more."""
        self.code, self.n = np.asarray(code, np.int64), np.asarray(n, float)
        self.n1 = np.bincount(self.code & 0xFFFF, self.n, 65536)
        one = self.n1.reshape(256, 256)
        self.n0 = one.sum(0)
        two = self.code >> 8
        # Of each context: all counts, different bytes, and how often these bytes follow the next shorter context.
        self.of0 = np.array([self.n0.sum()]), np.array([(self.n0 > 0).sum()]), np.zeros(1)
        self.of1 = one.sum(1), (one > 0).sum(1), np.where(one > 0, self.n0, 0).sum(1)
        self.of2 = np.bincount(two, self.n, 65536), np.bincount(two, minlength=65536), np.bincount(two, self.n1[self.code & 0xFFFF], 65536)
        once = np.array([(self.n0 == 1).sum()]), (one == 1).sum(1), np.bincount(two, self.n == 1, 65536)
        self.classes = [left_out(of[0], of[1], o) for of, o in zip((self.of0, self.of1, self.of2), once, strict=True)] + list(classes)

    def escape(self, k: int, total: np.ndarray, different: np.ndarray) -> np.ndarray:
        """Probability of an escape from contexts of k bytes."""
        fresh, known = self.classes[k]
        at = class_of(total, different)
        e = (fresh[at] + TRUST * different / (2 * np.maximum(total, 1))) / (fresh[at] + known[at] + TRUST)
        return np.where(different < 256, np.clip(e, 1e-6, 0.999), 0.0)

    def log(self, code: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
        """log10 probability of each gram's byte.  code: different grams, all of some groups of equal last three context bytes; n: training counts."""
        c1, c2 = code & 0xFFFF, code & 0xFFFFFF
        at = np.minimum(np.searchsorted(self.code, c2), max(len(self.code) - 1, 0))
        n2 = np.where(self.code[at] == c2, self.n[at], 0.0) if len(self.code) else np.zeros(len(code))
        zero = np.zeros(len(code), np.int64)
        levels = [(here, *(x[context] for x in of)) for here, of, context in ((self.n0[code & 255], self.of0, zero), (self.n1[c1], self.of1, c1 >> 8), (n2, self.of2, c2 >> 8))]
        for k in range(3, depth + 1):
            here, context, at, m = contexts(code, n, k)
            shorter = np.empty(len(here))
            shorter[at] = levels[-1][0]
            of = np.bincount(context, m), np.bincount(context, m > 0), np.bincount(context, np.where(m > 0, shorter, 0.0))
            levels.append((m[at], *(x[context[at]] for x in of)))
        back = np.full(len(code), 1 / max(256 - int(self.of0[1][0]), 1))
        for k, (up, now) in enumerate(zip(levels, levels[1:], strict=False)):
            back = self.step(k, *up[:3], now[3], back)
        return np.log10(self.step(depth, *levels[-1][:3], np.zeros(len(code)), back))

    def step(self, k: int, n: np.ndarray, total: np.ndarray, different: np.ndarray, excluded: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Probability of a byte in contexts of k bytes, of whose counts `excluded` are out of question; back: after the next escape."""
        e, whole, rest = self.escape(k, total, different), np.maximum(total, 1), total - excluded
        p = np.where(n > 0, (1 - e) * n / whole, e * back) / ((1 - e) * np.maximum(rest, 0) / whole + np.maximum(e, 1e-300))
        return np.where(rest > 0, p, back)


def contexts(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different grams with contexts of k bytes, their contexts' numbers, where each code is among them, and their counts."""
    here, at = np.unique(code & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return here, np.unique(here >> 8, return_inverse=True)[1], at, np.bincount(at, n, len(here))


#: What gather() writes, each in a folder of its own.
WORDS, GRAMS, TEXTS = 0, 1, 2


def gather(docs: DataFrame, depth: int, n_buckets: int) -> DataFrame:
    """(kind, task, nth, bucket, h, g, n) from (doc_id, text, train).

    WORDS and GRAMS: training counts of the distinct words, and of the distinct grams (in h), of a task's nth part, packed by bucket;
    TEXTS: its ids and texts, compressed, in h.
    """
    names = ["kind", "task", "nth", "bucket", "h", "g", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, nth, size = TaskContext.get().partitionId(), 0, 0
        words, held = Counter(), []

        def rows(kind: int, bucket: np.ndarray, blobs: list[list[bytes]]) -> pa.RecordBatch:
            same = [pa.array(np.full(len(bucket), x, np.int32)) for x in (kind, task, nth)]
            return pa.RecordBatch.from_arrays([*same, pa.array(bucket.astype(np.int32)), *(pa.array(x, pa.binary()) for x in blobs)], names=names)

        def send_words():
            if words:
                h, g = word_hash(words)
                yield rows(WORDS, *dealt(bucket_of(h, n_buckets), h, g, np.fromiter(words.values(), np.int64, len(words))))
                words.clear()

        def merge():
            held[:] = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))] if held else []

        def send_grams():
            merge()
            if held:
                code, n = held.pop()
                yield rows(GRAMS, *dealt(bucket_of(code, n_buckets), code, np.zeros(len(code), np.int8), n, rising=True))

        for batch in slices(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.select([0, 1]).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch.select([0, 1]))
            yield rows(TEXTS, np.zeros(1), [[sink.getvalue().to_pybytes()], [b""], [b""]])
            sides: tuple[list[bytes], list[bytes]] = ([], [])
            for t, learn in zip(texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                sides[bool(learn)].append(t.encode().lower())
                size += len(sides[bool(learn)][-1])
            for texts, learn in zip(sides, (0, 1), strict=True):
                if not texts:
                    continue
                words[END] += len(texts) * learn
                for group in pieces(texts):
                    found = [w for _, t in group for w in t.split()]
                    if learn:
                        words.update(found)
                    else:
                        for w in set(found):
                            words.setdefault(w, 0)
                    if len(words) > PART_WORDS:
                        yield from send_words()
                for code, _ in grams(texts, depth):
                    code, n = np.unique(code, return_counts=True)
                    held.append((code, n * learn))
                    if sum(len(c) for c, _ in held) > PART_GRAMS:
                        merge()
                        if len(held[0][0]) > PART_GRAMS * 3 // 4:
                            yield from send_grams()
            if size >= PART_BYTES:
                yield from send_words()
                yield from send_grams()
                nth, size = nth + 1, 0
        yield from send_words()
        yield from send_grams()

    return docs.select("doc_id", "text", "train").mapInArrow(lean(run), "kind int, task int, nth int, bucket int, h binary, g binary, n binary")


def summed(words: DataFrame, grams_: DataFrame, n_buckets: int) -> DataFrame:
    """(kind, to, h, g, n) from rows (part, bucket, h, g, n).  Kind 0: to a part, its words and their sums over all parts; 1: to a group's bucket, distinct grams and their sums; 2 and 3: N and V of
    some words, in `to`."""
    names = ["kind", "to", "h", "g", "n"]

    def rows(kind: int, to: np.ndarray, blobs: list[list[bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(to), kind, np.int32)), pa.array(to), *(pa.array(x, pa.binary()) for x in blobs)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(bucket, []).append(row)
        while held:
            bucket, got = held.popitem()
            part, h, g, n = zip(*got, strict=True)
            count = joined(n, "<i8")
            if bucket >= n_buckets:
                code, count = added(joined(h, "<i8", rising=True), count)
                to, blobs = dealt(bucket_of(code >> 8 & 0xFFFFFF, n_buckets), code, count)
                yield rows(1, to, [blobs[0], [b""] * len(to), blobs[1]])
                continue
            part, code, more = np.repeat(np.array(part, np.int64), [len(x) // 8 for x in h]), joined(h, "<i8"), joined(g, "<i4")
            order = np.lexsort((more, code))
            part, code, more, count = part[order], code[order], more[order], count[order]
            fresh = np.concatenate([[True], (code[1:] != code[:-1]) | (more[1:] != more[:-1])])
            sums = np.add.reduceat(count, np.flatnonzero(fresh))
            yield rows(0, *dealt(part, code, more, sums[np.cumsum(fresh) - 1]))
            for kind, total in ((2, sums.sum()), (3, (sums > 0).sum())):
                yield rows(kind, np.array([total]), [[b""]] * 3)

    sent = words.unionByName(grams_.withColumn("bucket", F.col("bucket") + n_buckets)).select("bucket", "part", "h", "g", "n")
    return sent.repartitionById(2 * n_buckets, F.col("bucket")).mapInArrow(lean(run), "kind int, to long, h binary, g binary, n binary")


#: Tasks that add up the counts of short contexts, and the codes of class counts among theirs.
SHORT_TASKS = 16
_CLASS = 1 << 40


def grouped(sums: DataFrame, n_buckets: int, depth: int) -> DataFrame:
    """(kind, to, h, n).  Kind 1: the grams and sums of whole groups; 3: counts after contexts of two bytes, and of escape classes above _CLASS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for to, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(to, []).append(row)
        while held:
            to, got = held.popitem()
            code, n = (joined(x, "<i8") for x in zip(*got, strict=True))
            order = np.argsort(code >> 8 & 0xFFFFFF, kind="stable")
            code, n = code[order], n[order]
            last = code >> 8 & 0xFFFFFF
            short, count = [code[n > 0] & 0xFFFFFF], [n[n > 0]]
            for k in range(3, depth + 1):
                _, context, _, m = contexts(code, n, k)
                for old, by_class in enumerate(left_out(np.bincount(context, m), np.bincount(context, m > 0), np.bincount(context, m == 1))):
                    at = np.flatnonzero(by_class)
                    short.append(_CLASS + (2 * k + old << 20) + at)
                    count.append(by_class[at].astype(np.int64))
            keys, blobs = dealt(*(lambda s, c: (s % SHORT_TASKS, s, c))(*added(np.concatenate(short), np.concatenate(count))))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), 3, np.int32)), pa.array(keys), *(pa.array(x, pa.binary()) for x in blobs)], names=["kind", "to", "h", "n"])
            ends, a = [*(np.flatnonzero(np.diff(last)) + 1), len(code)], 0
            for k, b in enumerate(ends):
                if k + 1 == len(ends) or ends[k + 1] - a > ROW_GRAMS:
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([to]), pa.array([packed(code[a:b])], pa.binary()), pa.array([packed(n[a:b])], pa.binary())], names=["kind", "to", "h", "n"])
                    a = b

    return sums.where("kind = 1").select("to", "h", "n").repartitionById(n_buckets, F.col("to").cast("int")).mapInArrow(lean(run), "kind int, to long, h binary, n binary")


def fit(groups: DataFrame, depth: int) -> Model:
    """The counts after all contexts of up to two bytes (at most 2^24 by their nature) and of the escape classes come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(tuple(joined([x], "<i8") for x in row))
            if sum(len(c) for c, _ in held) > PART_GRAMS:
                held = [added(*(np.concatenate(x) for x in zip(*held, strict=True)))]
        if held:
            code, n = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    got = groups.where("kind = 3").repartitionById(SHORT_TASKS, F.col("to").cast("int")).select("h", "n").mapInArrow(lean(run), "code long, n long").toPandas().sort_values("code")
    code, n = got["code"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    classes = np.zeros((depth + 1, 2, SIDE * SIDE))
    of = code[code >= _CLASS] - _CLASS
    classes.reshape(2 * depth + 2, -1)[of >> 20, of & (1 << 20) - 1] = n[code >= _CLASS]
    return Model(code[code < _CLASS], n[code < _CLASS], classes[3:])


def answers(grams_: DataFrame, groups: DataFrame, model: Model, n_buckets: int, depth: int) -> DataFrame:
    """(part, h, g): the grams that each part has sent and their log10 probabilities, packed."""
    shared = groups.sparkSession.sparkContext.broadcast(model)

    def assess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code, n = (joined([x], "<i8") for x in row)
                buckets, (h, g) = dealt(bucket_of(code, n_buckets), code, shared.value.log(code, n, depth).astype("<f4"))
                yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(np.full(len(buckets), -1)), pa.array(h, pa.binary()), pa.array(g, pa.binary())], names=["bucket", "part", "h", "g"])

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple]] = {}
        asked: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, part, h, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                (known if part < 0 else asked).setdefault(bucket, []).append((part, h, g))
        while asked:
            bucket, rows = asked.popitem()
            _, code, log = zip(*known.pop(bucket), strict=True)
            code, log = joined(code, "<i8"), joined(log, "<f4")
            order = np.argsort(code)
            code, log = code[order], log[order]
            for part, h, _ in rows:
                own = joined([h], "<i8", rising=True)
                at = np.minimum(np.searchsorted(code, own), len(code) - 1)
                if not (code[at] == own).all():
                    raise RuntimeError("a part asks for a gram that it has not sent")
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([h], pa.binary()), pa.array([packed(log[at])], pa.binary())], names=["part", "h", "g"])

    assessed = groups.where("kind = 1").select("h", "n").mapInArrow(lean(assess), "bucket int, part long, h binary, g binary")
    sent = grams_.select("bucket", "part", "h", F.lit(None).cast("binary").alias("g"))
    return sent.unionByName(assessed).repartitionById(n_buckets, F.col("bucket")).mapInArrow(lean(reply), "part long, h binary, g binary")


class Answers:
    """What a part got back: the counts of its words and the log10 probabilities of its grams."""

    def __init__(self, words: list[tuple], grams_: list[tuple], unit: float):
        h, g, c = (joined(x, t) for x, t in zip(zip(*words, strict=True), ("<i8", "<i4", "<i8"), strict=True))
        order = np.lexsort((g, h))
        self.h, self.g, self.c, self.unit = h[order], g[order], c[order], unit
        code, log = (joined(x, t, t == "<i8") for x, t in zip(zip(*grams_, strict=True), ("<i8", "<f4"), strict=True))
        order = np.argsort(code, kind="stable")
        self.code, self.logs = code[order], log[order]

    def counts(self, words: Iterable[bytes]) -> np.ndarray:
        fh, fg = word_hash(words)
        k = np.searchsorted(self.h, fh, "left")
        while (miss := (self.h[np.minimum(k, len(self.h) - 1)] == fh) & (self.g[np.minimum(k, len(self.h) - 1)] != fg)).any():
            k = k + miss
        k = np.minimum(k, len(self.h) - 1)
        if not ((self.h[k] == fh) & (self.g[k] == fg)).all():
            raise RuntimeError("a part lacks one of its own words")
        return self.c[k]

    def score(self, texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known ones, the baseline's score and the model's, of lower-cased texts."""
        size = len(texts)
        end = float(self.counts([END])[0])
        tokens, known = np.ones(size, np.int64), np.full(size, int(end > 0), np.int64)
        base, score = np.full(size, math.log10(end + 1) - self.unit), np.zeros(size)
        for group in pieces(texts):
            split_up = [t.split() for _, t in group]
            flat = [w for s in split_up for w in s]
            if not flat:
                continue
            table = {w: k for k, w in enumerate(dict.fromkeys(flat))}
            c = self.counts(table)[np.fromiter(map(table.__getitem__, flat), np.int64, len(flat))]
            owner = np.repeat([k for k, _ in group], [len(s) for s in split_up])
            tokens += np.bincount(owner, minlength=size)
            known += np.bincount(owner[c > 0], minlength=size)
            base += np.bincount(owner, np.log10(c + 1.0) - self.unit, size)
        for code, owner in grams(texts, depth):
            seen, at = np.unique(code, return_inverse=True)
            k = np.minimum(np.searchsorted(self.code, seen), len(self.code) - 1)
            if not (self.code[k] == seen).all():
                raise RuntimeError("a part lacks one of its own grams")
            score += np.bincount(owner, self.logs[k][at], size)
        return tokens, known, base, score


def score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) per row; train: a Column that is true for the rows to learn from, depth: bytes of the longest context, 3 to 6."""
    if not 3 <= depth <= 6:
        raise ValueError("depth is 3 to 6")
    spark = docs.sparkSession
    ship_package(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    n_bytes = int(rows.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0])
    n_buckets = max(1, -(-n_bytes // BUCKET_BYTES))
    # Written in one go, so that a text, its words and its grams are of the same part whatever is computed again.
    path = shared_dir(spark, "gathered")
    gather(rows, depth, n_buckets).write.partitionBy("kind").parquet(path)
    every = spark.read.schema("task int, nth int, bucket int, h binary, g binary, n binary, kind int").parquet(path)
    n_tasks, n_nths = (int(x) for x in every.agg(F.coalesce(F.max("task") + 1, F.lit(1)), F.coalesce(F.max("nth") + 1, F.lit(1))).first())
    n_parts = n_tasks * n_nths
    part = (F.col("nth").cast("long") * n_tasks + F.col("task")).alias("part")
    words, grams_, texts = (every.where(F.col("kind") == k).select(part, "bucket", "h", "g", "n") for k in (WORDS, GRAMS, TEXTS))
    sums = materialise(summed(words, grams_, n_buckets), "sums")
    remove(spark, f"{path}/kind={WORDS}")
    release(spark)
    n_all, v_all = (int(x) for x in sums.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("to"))), F.lit(0)) for k in (2, 3))).first())
    groups = materialise(grouped(sums, n_buckets, depth), "groups")
    release(spark)
    # The folder's files are listed anew, as those of the words are gone.
    every = spark.read.schema(every.schema).parquet(path)
    grams_ = every.where(F.col("kind") == GRAMS).select(part, "bucket", "h", "g", "n")
    logs_of = materialise(answers(grams_, groups, fit(groups, depth), n_buckets, depth), "answers")
    remove(spark, f"{path}/kind={GRAMS}")
    remove(spark, groups.scratch)
    release(spark)
    texts = spark.read.schema(every.schema).parquet(path).where(F.col("kind") == TEXTS).select(part, "h")
    none = F.lit(None).cast("binary")
    rows = sums.where("kind = 0").select(F.col("to").alias("part"), F.lit(0).alias("at"), "h", "g", "n")
    rows = rows.unionByName(logs_of.select("part", F.lit(1).alias("at"), "h", "g", none.alias("n")))
    rows = rows.unionByName(texts.select("part", F.lit(2).alias("at"), "h", none.alias("g"), none.alias("n")))
    # One task for each part; parts are of like size, whatever the keys of their rows.
    rows = rows.repartitionById(n_parts, F.col("part").cast("int")).sortWithinPartitions("part", "at")
    names = [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    unit = math.log10(n_all + v_all + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got, held = -1, ([], []), None
        for batch in batches:
            for part, at, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    now, got, held = part, ([], []), None
                if at < 2:
                    got[at].append(blobs[: 3 - at])
                    continue
                if held is None:
                    held, got = Answers(*got, unit), ([], [])
                for one in pa.ipc.open_stream(blobs[0]):
                    n, known, base, model = held.score([t.encode().lower() for t in texts_of(one.column(1))], depth)
                    yield pa.RecordBatch.from_arrays([one.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(model)], names=names)

    return rows.mapInArrow(lean(run), f"`{id_col}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, crc_mod("doc_id", 7) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
