import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import ppm
from tests.llm.slow_model import slow_model


def parts_of(texts, depth):
    """The model and all its grams, without Spark."""
    code, n = np.unique(np.concatenate([c for c, _ in ppm.grams(texts, depth)]), return_counts=True)
    short, count = ppm.added(code & 0xFFFFFF, n)
    classes = []
    for k in range(3, depth + 1):
        _, context, _, m = ppm.contexts(code, n, k)
        classes.append(ppm.left_out(np.bincount(context, m), np.bincount(context, m > 0), np.bincount(context, m == 1)))
    return ppm.Model(short, count, classes), code, n


@pytest.mark.parametrize("depth", [3, 4, 5, 6])
def test_no_context_is_dropped(spark, depth):
    """Over 32,768 contexts of three bytes: the rare ones count as well."""
    rng = np.random.default_rng(depth)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9FFF, 400))) for _ in range(120)] + ["the cat sat on the mat", "the mat", "", "The  Mat\n\nthe cat \x00 sat"]
    train = [t.encode().lower() for k, t in enumerate(texts) if k % 7 != 2]
    assert len({s[k : k + 3] for s in train for k in range(len(s))}) > 1 << 15
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["score"] for r in ppm.score(docs, F.col("doc_id") % 7 != 2, depth=depth).collect()}
    model = slow_model(train, depth)
    assert len(got) == len(texts)
    for k in (0, 2, 9, 50, 100, 120, 121, 122, 123):
        assert math.isclose(got[k], model(texts[k].encode().lower()), rel_tol=1e-5, abs_tol=1e-5), k


def test_probabilities_after_a_context_sum_to_one():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 255, 3000).astype(np.uint8)) for _ in range(3)] + [b"abracadabra" * 40, b"abrac"]
    model, code, n = parts_of(texts, 5)
    seen = dict(zip(code.tolist(), n.tolist(), strict=True))
    contexts = np.unique(np.concatenate([code[::97] >> 8, [int.from_bytes(b"zbrac", "big"), int.from_bytes(b"\xfe\xfd\xfe\xfd\xfe", "big"), 0]]))
    # Whole groups: all contexts that share the last three bytes with one of these.
    more = np.unique(code[np.isin(code >> 8 & 0xFFFFFF, contexts & 0xFFFFFF)] >> 8)
    every = (np.union1d(contexts, more)[:, None] * 256 + np.arange(256)).ravel()
    p = 10.0 ** model.log(every, np.array([seen.get(c, 0) for c in every.tolist()]), 5)
    assert np.allclose(p.reshape(-1, 256).sum(1), 1, atol=1e-9)


def test_no_training_text_means_equal_bytes(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in ppm.score(docs, F.lit(False)).collect()}
    assert math.isclose(got[1]["score"], -4 * math.log10(256), rel_tol=1e-6) and got[2]["train_tokens"] == 0 and got[1]["base_score"] == 0.0


def test_blocks_change_nothing(spark, monkeypatch):
    """Texts longer than a block, cut in front of white space and between grams."""
    texts = [b"one two  three\nfour " * 9, b"x" * 70, b"", b" \t ", b"a b", b" lead and trail "]
    whole = [(c.tolist(), o.tolist()) for c, o in ppm.grams(texts, 5)]
    monkeypatch.setattr(ppm, "BLOCK", 7)
    cut = [(c.tolist(), o.tolist()) for c, o in ppm.grams(texts, 5)]
    assert sum((c for c, _ in cut), []) == whole[0][0] and sum((o for _, o in cut), []) == whole[0][1]
    words = {k: [] for k in range(len(texts))}
    for group in ppm.pieces(texts):
        for k, t in group:
            words[k] += t.split()
    assert [words[k] for k in range(len(texts))] == [t.split() for t in texts]
