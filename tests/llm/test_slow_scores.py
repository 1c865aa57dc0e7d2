"""Scores of the three classifiers by a second, slow implementation; what they learn from."""

import math
import random
import re
import tracemalloc

import numpy as np

from cellweave.llm import langid, quality_classifier, quality_rules, samples


def some_texts(n, seed):
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta!", "42", "x-1", "http://a.b/c?d=1", "stop.", "und", "der", "la", "é", "ALL", "|", "#", "$$$"]
    return ["", " \n "] + [rng.choice((" ", "\n", "  ")).join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(n)]


def test_pooled_network_by_word():
    texts = some_texts(300, 1)
    y = np.array([float("$$$" not in t) for t in texts])
    m = quality_classifier.fit(texts, y)
    got = m.score(texts)
    for t, s in zip(texts, got, strict=True):
        words, x = t.encode().split(), np.zeros(2 * quality_classifier.WIDTH)
        for k, w in enumerate(words):
            x[: quality_classifier.WIDTH] += m.vectors[m.words.get(quality_classifier.key(w), 0)]
            x[quality_classifier.WIDTH :] += quality_classifier.index_vector(b"form " + quality_classifier.form(w))
            if k and w == words[k - 1]:
                x[quality_classifier.WIDTH :] += 4 * quality_classifier.index_vector(b"again")
        x = (x / max(len(words), 1) - m.mean) / m.spread
        h = [math.tanh(float(x @ m.w1[:, j] + m.b1[j])) for j in range(quality_classifier.HIDDEN)]
        z = (sum(a * b for a, b in zip(h, m.w2, strict=True)) + m.b2) / m.temperature
        assert abs(1 / (1 + math.exp(-z)) - s) < 1e-5


def test_forms_take_little_memory():
    """10,000 short texts of odd words have some 10,000 forms; a row per text and form would take gigabytes."""
    rng = random.Random(2)
    m = quality_classifier.fit(["a b", "c d"] * 5, np.array([0.0, 1.0] * 5))
    texts = ["".join(rng.choices("aA0-_./:;!?#@$%&*()[]{}", k=36)) for _ in range(10_000)]
    tracemalloc.start()
    m.score(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(m.forms) > 9_000 and peak < 300 << 20


def test_forms_are_whole_and_forgotten_with_the_table(monkeypatch):
    assert quality_classifier.form(b"a-b-c-d-e-f!") != quality_classifier.form(b"a-b-c-d-e-f?")
    monkeypatch.setattr(quality_classifier, "TABLE_FORMS", 3)
    m = quality_classifier.fit(["a b", "c d"] * 5, np.array([0.0, 1.0] * 5))
    texts = ["a A 1 ! ?", "a-b c_d", "x A 1"]
    assert np.allclose([m.score([t])[0] for t in texts], m.score(texts))
    assert len(m.forms) <= 8 and len(m.forms) == len(m.form_rows)


def test_trees_by_node():
    texts = some_texts(300, 3)
    stats = quality_rules.statistics(texts)
    x, y = quality_rules.matrix(stats), np.array([float("$$$" not in t) for t in texts])
    trees = quality_rules.fit(x, y, np.array(list(quality_rules.FEATURES.values())))
    assert len(trees.roots) and 0.2 < y.mean() < 0.95
    for row, s in zip(x, trees.score(x), strict=True):
        z = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            z += trees.value[node]
        assert abs(1 / (1 + math.exp(-z)) - s) < 1e-9


def test_verdict_of_the_rules(spark):
    texts = [*some_texts(60, 4), "one two three " * 30, None]
    trees = quality_rules.fit(*(lambda x: (x, (x[:, 0] > 3).astype(float)))(quality_rules.matrix(quality_rules.statistics(some_texts(200, 5)))), np.array(list(quality_rules.FEATURES.values())))
    rows = quality_rules.apply_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), trees).collect()
    for r in rows:
        x = quality_rules.statistics([texts[r["doc_id"]] or ""])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and trees.score(quality_rules.matrix(x))[0] >= 0.5)
    assert {r["kept"] for r in rows} == {True, False}


def test_codewords_by_bit():
    texts = [t for t in some_texts(200, 6)] + ["漢字", "1 2 3"]
    langs = ["de" if " der" in t else "es" if " la" in t else "en" for t in texts]
    m = langid.fit(texts, langs)
    names, score, odd = m.decide(texts)
    for t, name, s, o in zip(texts, names, score, odd, strict=True):
        count = np.bincount(langid.trigrams(t), minlength=langid.BUCKETS)
        margins = [sum(math.sqrt(c) * float(w) for c, w in zip(count, m.weights[:, b], strict=True) if c) / math.sqrt(max(count.sum(), 1)) + float(m.bias[b]) for b in range(m.code.shape[1])]
        loss = [sum(math.log1p(math.exp(-z * c)) * w for z, c, w in zip(margins, code, m.bit_weight, strict=True)) for code in m.code]
        p = np.exp(-np.array(loss))
        p /= p.sum()
        if not any(ch.isalpha() for ch in t):
            assert (name, s, o) == ("und", 0.0, True)
            continue
        assert name == m.languages[int(p.argmax())] and abs(s - p.max()) < 1e-4


def test_rare_labels_are_in_the_sample(spark):
    rows = [(k, f"text {k}", "en") for k in range(3000)] + [(5000 + k, f"texte {k}", "fr") for k in range(5)] + [(9000, "x" * 30_000, "de"), (9001, None, "it")]
    docs = spark.createDataFrame(rows + [(1, "hot", "en")] * 2000, "doc_id long, text string, lang string")
    got = samples.by_label(docs, "lang", 100)
    n = {r["label"]: r["count"] for r in got.groupBy("label").count().collect()}
    assert set(n) == {"en", "fr"} and n["fr"] >= 2 and n["en"] == 100 - n["fr"]
    assert sorted(got.collect()) == sorted(samples.by_label(docs.repartition(7), "lang", 100).collect())


def test_sample_of_repeated_ids_is_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(3, f"text {k % 50}") for k in range(500)] + [(k, f"other {k}") for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1)] + [(k, k % 2) for k in range(4, 40)], "doc_id long, quality int")
    got = samples.labelled(docs, labels, "quality", 30).collect()
    assert len(got) == 30 and all(r["label"] == 0 for r in got if r["doc_id"] == 3)
    assert sorted(got) == sorted(samples.labelled(docs.repartition(9), labels.repartition(3), "quality", 30).collect())


def test_rules_learn_from_whole_texts_where_they_are_read(spark, monkeypatch):
    """Thousands of long texts would not fit the one task that takes the first rows of the sample: no text may get there."""
    texts = [*some_texts(60, 7), "long words " * 3000, None]
    docs = spark.createDataFrame([*enumerate(texts), (5, texts[5]), (5, "another text"), (None, "no id")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 3) for k in range(len(texts))] + [(None, 1)], "doc_id long, quality int")
    plans, seen, to_pandas, fit = [], [], type(docs).toPandas, quality_rules.fit
    monkeypatch.setattr(type(docs), "toPandas", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or to_pandas(df))
    monkeypatch.setattr(quality_rules, "fit", lambda x, y, sign: seen.append((x, y)) or fit(x, y, sign))
    for rows in (6000, 20):
        quality_rules.learn(docs, labels, rows=rows)
        moved = [x for x in plans.pop().splitlines() if re.search("TakeOrdered|Sort|Aggregate|Exchange", x)]
        assert any("TakeOrdered" in x for x in moved) and not any(re.search(r"\btext#", x) for x in moved)
        want = samples.labelled(docs, labels, "quality", rows, 1 << 30).collect()
        x = quality_rules.matrix(quality_rules.statistics([r["text"] for r in want]))
        got = seen.pop()
        assert 0 < len(want) <= rows and sorted(map(tuple, np.column_stack(got))) == sorted(map(tuple, np.column_stack((x, [float(r["label"] > 0) for r in want]))))
