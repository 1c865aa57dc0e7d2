import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cellweave.llm import langid, ppm, quality_classifier, quality_rules
from cellweave.llm.runtime import crc_mod, read
from tests.llm.slow_model import slow_model

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """The base statistics by definition."""
    words = WORD.findall(text)
    wins = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    hit = {j for k in range(len(words) - 7) if wins[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts(spark, sf, odd):
    rng = np.random.default_rng(1)
    loops = [" ".join(rng.choice(["a", "b"], 60)) for _ in range(50)] + ["a b c d e f g h " * 2, "a b c d e f g h i " * 5, "x\n\nx\n x\nx \n#$\x0b|<\n"]
    texts = [r["text"] or "" for r in read(spark, sf, "documents").collect()] + [r["text"] or "" for r in odd.collect()] + loops
    got = quality_rules.statistics(texts)
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in quality_rules.BASE) == counts(t), repr(t[:80])


def test_rules_on_odd_rows(odd, none, labels):
    trees = quality_rules.learn(odd, labels)
    got = quality_rules.apply_rules(odd, trees).collect()
    assert len(got) == odd.count() and all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in got)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert quality_rules.filter_documents(odd, trees).columns == odd.columns
    assert quality_rules.apply_rules(none, trees).count() == 0 and quality_rules.filter_documents(none, trees).count() == 0


def test_trees_are_monotonic_and_learn():
    rng = np.random.default_rng(2)
    x = rng.uniform(size=(3000, 3))
    y = ((x[:, 0] < 0.6) & (x[:, 1] > 0.3)).astype(float)
    m = quality_rules.fit(x, y, np.array([-1, 1, 0]), trees=30)
    assert ((m.score(x) > 0.5) == y).mean() > 0.97
    line = np.linspace(0, 1, 200)
    for fixed in rng.uniform(size=(20, 3)):
        for j, sign in ((0, -1), (1, 1)):
            probe = np.tile(fixed, (200, 1))
            probe[:, j] = line
            assert (sign * np.diff(m.score(probe)) >= -1e-12).all()
    one = quality_rules.fit(x, np.ones(3000), np.zeros(3))
    assert (one.score(x) > 0.9).all()


@pytest.fixture(scope="module")
def truth(spark):
    sf = "/root/testdata/sf0.01"
    return sf, {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}


def test_rules_follow_the_labels(spark, truth):
    sf, quality = truth
    got = {r["doc_id"]: r for r in quality_rules.query(spark, sf).collect()}
    assert len(got) == 1000
    held = [i for i in quality if zlib.crc32(str(i).encode()) % 4 == 2 and not got[i]["base_failed"]]
    assert np.mean([got[i]["kept"] == (quality[i] == 1) for i in held]) > 0.95


def test_classifier_on_held_out_rows(spark, truth):
    sf, quality = truth
    got = {r["doc_id"]: r for r in quality_classifier.query(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in got.items())
    held = [i for i in quality if got[i]["held_out"]]
    assert np.mean([(got[i]["score"] >= 0.5) == (quality[i] == 1) for i in held]) > 0.95


def test_classifier_on_odd_rows(odd, none, labels):
    m = quality_classifier.learn(odd, labels)
    rows = quality_classifier.classify(odd, m).collect()
    assert len(rows) == odd.count() and all(r["score"] == 0.5 for r in rows)
    assert quality_classifier.classify(none, m).count() == 0
    assert quality_classifier.filter_documents(odd, m).columns == odd.columns
    sure = quality_classifier.fit(["some words here"] * 5, np.ones(5))
    assert sure.score(["", "other"]).min() > 0.9


def test_equal_texts_have_equal_scores():
    texts = ["one two three four", "FIVE!! SIX!! SEVEN!!", "a | b | c", "the end of it"] * 30
    m = quality_classifier.fit(texts, np.array([1, 0, 0, 1] * 30, float))
    whole = m.score(texts)
    assert np.allclose(whole[:4], m.score(texts[:4])) and ((whole > 0.5) == np.array([1, 0, 0, 1] * 30)).all()


def test_languages(spark, truth):
    sf, _ = truth
    docs = {r["doc_id"]: r["lang"] for r in read(spark, sf, "documents").collect()}
    got = langid.query(spark, sf).collect()
    held = [r for r in got if r["held_out"] and docs[r["doc_id"]]]
    assert len(got) == 1000 and np.mean([r["lang_pred"] == docs[r["doc_id"]] for r in held]) > 0.97


def test_codewords_differ():
    for k in (2, 3, 4, 6, 7, 40):
        code = langid.codewords(k)
        apart = min((code[a] != code[b]).sum() for a in range(k) for b in range(a))
        assert apart >= (2 ** (k - 2) if k <= 6 else 3), k


def test_letters():
    assert [langid.has_letter(t) for t in ("a", "12 é", "漢", "", "12_", "² ½ ٣", "!?")] == [True, True, True, False, False, False, False]


def test_languages_of_odd_rows(odd, none, spark):
    empty = langid.learn(odd)
    assert {r["lang_pred"] for r in langid.identify(odd, empty).collect()} == {"und"}
    m = langid.fit(["the cat and the dog"] * 9 + ["le chat et le chien"] * 9, ["en"] * 9 + ["fr"] * 9)
    names, score, unsure = m.decide(["the dog", "le chien", "", "123 !!", "中文"])
    assert names[:2] == ["en", "fr"] and names[2:4] == ["und", "und"] and score[2] == 0 and unsure[2] and names[4] != "und"
    assert langid.identify(none, m).count() == 0
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd, m).collect()}[4] == "und"


def base_scores(rows):
    """The word-count baseline by definition."""
    tokens = {k: [*(t or "").encode().lower().split(), b"\xff"] for k, (_, t) in enumerate(rows)}
    train = {k for k, (i, _) in enumerate(rows) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2}
    c = Counter(w for k in train for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for k, t in tokens.items()}


def check_scores(docs, rows):
    got = ppm.score(docs, crc_mod("doc_id", 7) != 2).collect()
    want = base_scores(rows)
    train = [(t or "").encode().lower() for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    key = lambda i, r: (-1 if i is None else i, *r[:3], round(r[3], 6))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == sorted(key(rows[k][0], w) for k, w in want.items())
    return {(r["doc_id"], r["n_tokens"]): r["score"] for r in got}, train


def test_scores_on_odd_rows(odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got, train = check_scores(odd, rows)
    model = slow_model(train, ppm.DEPTH)
    for i, t in rows:
        low = (t or "").encode().lower()
        if len(low) < 500:
            assert math.isclose(got[i, len(low.split()) + 1], model(low), rel_tol=1e-5, abs_tol=1e-5), (i, t)
    assert ppm.score(none, crc_mod("doc_id", 7) != 2).count() == 0


def test_scores_of_documents(spark, sf):
    docs = read(spark, sf, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got, train = check_scores(docs, rows)
    model = slow_model(train, ppm.DEPTH)
    short = sorted(rows, key=lambda r: len(r[1] or ""))[:20] + rows[:10]
    assert all(math.isclose(got[i, len((t or "").encode().lower().split()) + 1], model((t or "").encode().lower()), rel_tol=1e-5, abs_tol=1e-4) for i, t in short)
    assert ppm.query(spark, sf).columns[:2] == ["doc_id", "held_out"]
