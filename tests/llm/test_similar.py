import random
from itertools import combinations

import numpy as np

from cellweave.llm import simhash


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_groups(texts):
    """Groups of indices that links of Jaccard similarity >= 0.8 over 5-word shingles connect."""
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        both, all_ = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 5 * both >= 4 * all_:
            parent[root(a)] = root(b)
    groups = {}
    for k in range(len(texts)):
        groups.setdefault(root(k), []).append(k)
    return list(groups.values())


def near_copies():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randrange(30, 200))]
        texts.append(" ".join(base))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    return texts + ["", " \n", "one two", "One  two", "one"]


def test_one_of_each_group_stays(spark):
    texts = near_copies()
    groups = brute_groups(texts)
    assert 40 < len(groups) < 120
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = simhash.drop_similar(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(min(g) for g in groups)


def test_rows_of_repeated_and_null_ids(spark, odd, none):
    """Rows are decided by themselves, not by their id."""
    a, b, c = ("the quick brown fox jumps over it", "one two three four five six seven", "alpha beta gamma delta epsilon zeta")
    rows = [(1, a), (1, a), (1, b), (2, b), (None, b), (None, c), (None, c), (3, None), (None, "")]
    got = simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted([(1, a), (1, b), (0, c), (3, "")])
    kept = simhash.drop_similar(odd)
    texts = [r["text"] for r in odd.collect()]
    assert kept.columns == odd.columns and kept.count() == len(brute_groups(texts))
    assert simhash.drop_similar(none).count() == 0


def hard_cases():
    """Groups around the threshold: copies cut or longer by a part, chains, a passage of most documents, a template with short fillings."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(40):  # the passage is a fifth to nearly all of the document
        own = [word() for _ in range(rng.choice((4, 6, 8, 10, 15, 30, 200)))]
        texts.append(own[: len(own) // 2] + passage + own[len(own) // 2 :])
    for _ in range(8):  # subsets of one text, sizes close to the limit
        base = [word() for _ in range(100)]
        texts += [base, base[: rng.randrange(74, 90)], base[rng.randrange(8, 24) :], base + [word() for _ in range(rng.randrange(12, 32))]]
    for _ in range(4):  # chains: each link changes some words, the ends are far apart
        now = [word() for _ in range(80)]
        for _ in range(12):
            texts.append(list(now))
            for _ in range(rng.choice((1, 2, 3))):
                now[rng.randrange(len(now))] = word()
    template = [word() for _ in range(40)]
    for _ in range(40):
        texts.append(template[:20] + [word()] + template[20:])
    texts += [["a"] * n for n in (4, 5, 6, 50)] + [[w] for w in "xyz"] * 2
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_no_link_is_lost_in_hard_cases(spark):
    texts = hard_cases()
    groups = brute_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(docs).collect()) == sorted(min(g) for g in groups)


def test_shingles_of_long_texts_come_in_blocks(monkeypatch):
    text = "one two three four five six seven eight nine ten " * 5
    whole = simhash.shingle_hashes(text, 5).tolist()
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.shingle_hashes(text, 5).tolist() == whole and len(whole) == 46


def test_groups_of_documents(spark):
    """All documents of a small table, against all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    groups = brute_groups([t for _, t in rows])
    assert len(groups) < len(rows)
    assert sorted(r["doc_id"] for r in simhash.drop_similar(docs).collect()) == sorted(min(rows[k][0] for k in g) for g in groups)


def test_bitmaps_never_rule_out_a_link():
    """Two sets differ in as many shingles at least as their bitmaps do in bits."""
    texts = hard_cases()
    sets = [simhash.shingle_set(t, 5) for t in texts]
    bits = [simhash.flipped(x) for x in sets]
    for a, b in combinations(range(0, len(texts), 3), 2):
        apart = len(sets[a]) + len(sets[b]) - 2 * len(np.intersect1d(sets[a], sets[b]))
        assert int(np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).sum()) <= apart
