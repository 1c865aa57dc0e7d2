import hashlib
import json
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash

from cellweave.llm import media, shards, simhash, warc
from cellweave.llm.queries import ORACLE_SQL
from cellweave.llm.runtime import read, shared_dir


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(items):
    """items: (id, fp); the smallest id reachable over links of at most four bits."""
    fps = sorted({f for _, f in items})
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            parent[root(a)] = root(b)
    least = {}
    for i, f in items:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((-1 if i is None else i), f"{f:016x}", least.get(root(f))) for i, f in items)


def linked(df):
    from pyspark.sql import functions as F

    out = df.withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out.collect())


def test_links_of_documents(spark, sf):
    docs = read(spark, sf, "documents")
    items = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect()]
    want = brute_components(items)
    assert linked(simhash.link(docs)) == want
    got = simhash.query(spark, sf).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.drop_near_duplicates(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in want}) and kept.columns == docs.columns


def test_links_of_odd_rows(odd, none):
    items = [(r["doc_id"], fingerprint(r["text"])) for r in odd.collect()]
    assert linked(simhash.link(odd)) == brute_components(items)
    assert simhash.link(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    kept = [r["doc_id"] for r in simhash.drop_near_duplicates(odd).collect()]
    assert kept.count(None) == 1 and kept.count(2) == 0 and kept.count(1) == 1 and len(kept) == len({c or f for _, f, c in brute_components(items)})


def test_near_duplicates_are_dropped_by_row(spark):
    """Rows of one id with unrelated texts are rows like any other, and the result does not change when run again."""
    a, b = "the quick brown fox jumps over the lazy dog " * 3, "completely different words stand here in a row of their own " * 3
    for rows, want in (([(5, a), (5, b)], [(5, a), (5, b)]), ([(5, a), (5, b), (3, b)], [(3, b), (5, a)]), ([(None, a), (None, a), (4, a), (None, b)], [(-1, b), (4, a)])):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        for _ in range(2):
            assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in simhash.drop_near_duplicates(docs).collect()) == sorted(want)


@pytest.mark.parametrize("size", [2, 3, 4])
def test_tuples_cover_every_match(size):
    tuples = simhash.position_tuples(size)
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in tuples)


def flips(rng, fp, n):
    for b in rng.choice(64, n, replace=False):
        fp ^= 1 << int(b)
    return fp


def components_by_pairs(fps):
    return {(i, c) for i, _, c in brute_components(list(enumerate(fps)))}


@pytest.mark.parametrize("limit", [4, 2048])
def test_forest_connects_what_links_connect(limit):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = sorted({flips(rng, base, int(rng.integers(0, 5))) for _ in range(150)} | {flips(rng, base, 12) for _ in range(50)} | {int(rng.integers(0, 1 << 62)) for _ in range(50)})
    edges = simhash.forest(np.array(fps, np.uint64), limit)
    assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in edges)
    parent = list(range(len(fps)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {(k, root(k)) for k in range(len(fps))} == components_by_pairs(fps)


def test_long_lists_are_sieved():
    """Lists that agree in four bytes and are too long to compare all pairs: few links among many, and a dense group."""
    rng = np.random.default_rng(8)
    wide = np.unique(np.uint64(0x1122334400000000) | rng.integers(0, 1 << 20, 3000).astype(np.uint64))
    base = int(rng.integers(0, 1 << 62))
    dense = np.unique(np.array([flips(rng, base, int(rng.integers(0, 4))) for _ in range(400)], np.uint64))
    for fps, limit in ((wide, 100), (dense, 50)):
        edges = simhash.forest(fps, limit)
        assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 4 for a, b in edges) and len(edges) < len(fps)
        near = [(a, b) for a in range(len(fps)) for b in a + 1 + np.flatnonzero(np.bitwise_count(fps[a + 1 :] ^ fps[a]) <= 4)]
        assert len(edges) == len(simhash.spanning(near)) == len(simhash.spanning(edges + near))


@pytest.mark.parametrize("long_list", [5, 40])
def test_long_lists_are_dealt_anew(spark, long_list):
    rng = np.random.default_rng(6)
    centre = int(rng.integers(0, 1 << 63))
    fps = sorted({flips(rng, centre, int(rng.integers(0, 9))) for _ in range(300)} | {int(rng.integers(0, 1 << 63)) for _ in range(300)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.edges_of(df, 2, long_list)).collect()}
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(roots.get(f, f), []).append(k)
    assert {(k, min(g)) for g in groups.values() for k in g} == components_by_pairs(fps)


@pytest.mark.parametrize("size", [2, 3, 4])
def test_index_finds_all_links(spark, size):
    rng = np.random.default_rng(4)
    fps = {int(rng.integers(0, 1 << 63)) for _ in range(300)}
    fps |= {flips(rng, f, int(rng.integers(1, 5))) for f in list(fps)[:100]}
    centre = int(rng.integers(0, 1 << 63))
    fps |= {flips(rng, centre, int(rng.integers(0, 4))) for _ in range(300)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    roots = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in simhash.components(simhash.edges_of(df, size)).collect()}
    groups = {}
    for k, f in enumerate(fps):
        groups.setdefault(roots.get(f, f), []).append(k)
    assert {(k, min(g)) for g in groups.values() for k in g} == components_by_pairs(fps)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_a_long_chain(spark, monkeypatch, few):
    """Both with files between the joins of a round and without."""
    monkeypatch.setattr(simhash, "FEW_EDGES", few)
    n = 200
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), 500: 500, 501: 500}


def pages(spark):
    same, small = "<html>" + "x" * 1200, "<p>tiny</p>"
    rows = [(1, "http://a/1", same, 0), (9, "http://a/9", same, 0), (9, "http://a/9 b\r\nc", same, 0), (4, None, same, 0), (2, "u", small, 0), (3, "u", small, 0), (5, "u", None, 0), (6, "u", "", 0), (None, "u", same, 0), (None, "v", "only null " * 200, 0), (7, "é", "ü" * 700, 0), (8, "w", "y" * 300_000, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int")


def test_warc_round_trip(spark):
    df = pages(spark)
    path = shared_dir(spark, "warc")
    warc.write(warc.to_records(df), path)
    got = warc.load(spark, path).collect()
    assert len(got) == df.count()
    rows = {}
    for r in got:
        rows.setdefault(r["record_id"], []).append(r)
    assert [rows[f"urn:page:{k}"][0]["record_type"] for k in (1, 4, 2, 3, 5, 6, 7, 8)] == ["revisit", "revisit", *["response"] * 6]
    assert {r["record_type"] for r in rows["urn:page:9"]} == {"response"} and len(rows["urn:page:9"]) == 2
    assert rows["urn:page:1"][0]["refers_to"] == "urn:page:9" and rows["urn:page:1"][0]["payload"] == b"" and rows["urn:page:1"][0]["payload_bytes"] == 1206
    assert sorted(r["record_type"] for r in rows["urn:page:"]) == ["response", "revisit"]
    for r in got:
        if r["record_type"] == "response":
            assert hashlib.sha1(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]


def test_warc_pushdown(spark):
    path = shared_dir(spark, "warc")
    warc.write(warc.to_records(pages(spark)), path)
    df = warc.load(spark, path)
    assert df.where("record_type = 'revisit'").count() == 3 and df.where("record_id in ('urn:page:7', 'urn:page:8')").count() == 2
    assert df.where("target_uri like 'http://a/%' and payload_bytes > 5").count() == 3
    bare = warc.load(spark, path, payload=False)
    assert bare.where("payload is null").count() == df.count()
    empty = shared_dir(spark, "warc")
    warc.write(warc.to_records(pages(spark).where("page_id = -1")), empty)
    assert warc.load(spark, empty).where("record_id is not null").count() == 0


class Counting:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        self.data, self.at, self.read_bytes = data, 0, 0

    def seek(self, at):
        self.at = at

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        self.read_bytes += len(out)
        return out


def test_unwanted_payloads_are_not_decoded():
    rng = np.random.default_rng(1)
    big = bytes(rng.integers(0, 256, 500_000).astype(np.uint8))
    one = lambda k, body: warc.record(f"urn:page:{k}", "response", "u", hashlib.sha1(body).hexdigest(), None, len(body), body)
    blocks = [one(1, big), one(2, b"small"), one(3, big)]
    data = b"".join(map(warc.member, blocks))
    f = Counting(data)
    got = list(warc.records(f, len(data), (("record_id", "in", ("urn:page:2",)),)))
    assert [r["payload"] for r in got] == [b"small"] and f.read_bytes < 20_000
    import gzip

    for plain in (b"".join(map(gzip.compress, blocks)), b"".join(blocks)):  # without the extra field, and without compression
        got = list(warc.records(Counting(plain), len(plain)))
        assert [r["payload"] for r in got] == [big, b"small", big]
    assert gzip.decompress(data) == b"".join(blocks)


def test_warc_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf}/pages.parquet'")
    want = con.execute(ORACLE_SQL["op5_warc"]).fetchall()
    got = [tuple(r) for r in warc.query(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("kind", media.KINDS)
def test_media_round_trip(kind):
    rng = np.random.default_rng(2)
    for n in (64, 640, 64_000):
        payload = bytes(rng.integers(0, 256, n).astype(np.uint8))
        blob = media.encode(payload, kind)
        found = media.sniff(blob)
        assert found[0] == (kind, 0, len(blob)) and media.samples(blob, *found[0]) == payload
        assert not any(f[1] == 0 for f in media.sniff(blob[:-1])) or kind == "bmp" and not media.sniff(blob[:-1])


def test_embedded_media_and_decoys():
    inner, gif = media.encode(b"q" * 64, "png"), b"GIF89a\x01\0\x01\0\0\0\0\x2c\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x02\x12\xff\0\x34\xff\xd9"
    text = b"RIFF BM .snd GIF89a \xff\xd8\xff " + inner + b" tail " + gif + b"BMBM" + jpeg
    payload = media.pad(text)
    blob = media.encode(payload, "wav")
    got = media.sniff(blob)
    assert got[0][0] == "wav" and [f[0] for f in got[1:]] == ["png", "gif", "jpeg"]
    assert [blob[a : a + n] for _, a, n in got[1:]] == [inner, gif, jpeg]


def test_media_frames(odd, none, spark):
    got = media.inspect(media.store(odd)).collect()
    raw = sorted(((r["doc_id"] or -1), (r["text"] or "").encode()) for r in odd.collect())
    assert sorted(((r["doc_id"] or -1), r["n_bytes"], r["payload"]) for r in got) == [(i, len(b), media.pad(b)) for i, b in raw]
    assert all(r["corrected"] == (r["detected"] != "audio/wav") for r in got)
    assert media.inspect(media.store(none)).count() == 0
    bad = spark.createDataFrame([(1, 0, bytearray(b"no media"), "image/png"), (2, 0, None, None)], "doc_id long, n_bytes long, media binary, declared string")
    assert [(r["detected"], r["payload"]) for r in media.inspect(bad).collect()] == [(None, None)] * 2


def test_media_query(spark, sf):
    texts = {r["doc_id"]: media.pad((r["text"] or "").encode()) for r in read(spark, sf, "documents").collect()}
    got = media.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        p = texts[r["doc_id"]]
        blob = media.encode(p, media.KINDS[zlib.crc32(p) % 4])
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(blob), hashlib.sha256(blob).hexdigest())


def test_shards(spark, odd, none):
    store = shards.ShardStore(spark, shared_dir(spark, "shards"), target_bytes=40_000, smallest=1000)
    assert store.version() == 0
    with pytest.raises(ValueError):
        store.read()
    for k in range(6):
        store.append(odd.repartition(2, "doc_id"))
    before = store.manifest()
    assert before["version"] == 6 and sum(s.rows for s in before["shards"]) == 6 * odd.count()
    old = store.read(3).count()
    assert store.compact() == 7 and store.read(3).count() == old == 3 * odd.count()
    after = store.manifest()
    assert len(after["shards"]) < len(before["shards"]) and sum(s.rows for s in after["shards"]) == 6 * odd.count()
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(store.read()) == sorted(rows(odd) * 6)
    store.vacuum()
    assert rows(store.read()) == sorted(rows(odd) * 6)
    store.append(none)
    assert store.version() == 8 and store.read().count() == 6 * odd.count()


def test_shards_of_nothing_and_conflicts(spark, none, odd):
    store = shards.ShardStore(spark, shared_dir(spark, "shards"))
    store.append(none)
    assert store.read().count() == 0 and store.read().columns == none.columns and store.compact() == 1
    base = store.manifest()
    store.append(odd)
    with pytest.raises(shards.Conflict):
        store.commit(base["version"], odd.schema.json(), [])
    assert store.version() == 2 and json.loads(odd.schema.json())["fields"]


def test_shard_query(spark, sf):
    want = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in read(spark, sf, "documents").collect()}
    got = shards.query(spark, sf).collect()
    assert {r["doc_id"]: r["text_sha256"] for r in got} == want and len(got) == len(want) and len({r["shard"] for r in got}) < 4
