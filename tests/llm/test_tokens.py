import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cellweave.llm import packing, sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
BITS = ["a", "b", " ", "  ", "\n", "\t", "▁", "é", "漢", "\U0001f600", "<s>", "<0x41>", "　", "\x00", "the", " the", "\r", "1", "$$$", "́", "▁▁", "'s", "\x1c", "\xa0", "\x85", " \n", "<|endoftext|>"]


def strings(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(n)]


def test_pieces_equal_the_library():
    c = sentencepieces.coder(MODEL)
    assert c.cuttable and c.fence is not None
    for s in strings(3000, 1):
        ids = np.frombuffer(c.encode(s), "<i4")
        assert ids.tolist() == c.whole.encode(s), repr(s)
        assert sentencepieces.decode_ids(ids, MODEL) == c.whole.decode(ids.tolist()), repr(s)


@pytest.mark.parametrize("seed", range(4))
def test_any_ids_decode_like_the_library(seed):
    """Ids of the whole vocabulary, of byte pieces (mostly printable ones) and of marked pieces, in any order."""
    c, rng = sentencepieces.coder(MODEL), np.random.default_rng(seed)
    n = c.whole.get_piece_size()
    octets = [i for i in range(n) if c.whole.is_byte(i)]
    marked = [i for i in range(n) if c.whole.id_to_piece(i)[0] == sentencepieces.MARK]
    pools = [np.arange(n), np.arange(600), np.array(octets), np.array(octets[32:127]), np.array(marked)]
    for _ in range(1500):
        ids = np.array([rng.choice(pools[rng.integers(5)]) for _ in range(rng.integers(0, 9))], np.int64)
        assert sentencepieces.decode_ids(ids, MODEL) == (c.whole.decode(ids.tolist()) if len(ids) else ""), ids
    for first in (octets[32], octets[65], marked[0]):
        for second in (octets[32], marked[5], octets[0xE6]):
            assert sentencepieces.decode_ids(np.array([first, second]), MODEL) == c.whole.decode([first, second])


def test_encode_and_decode_frames(odd, none):
    c = sentencepieces.coder(MODEL)
    got = sentencepieces.decode(sentencepieces.encode(odd, MODEL), MODEL).collect()
    want = sorted((r["doc_id"] or -1, c.whole.encode(r["text"] or "")) for r in odd.collect())
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in got) == want
    assert all(r["decoded"] == (c.whole.decode(r["ids"]) if r["ids"] else "") for r in got)
    assert sentencepieces.encode(none, MODEL).count() == 0


def test_piece_query(spark, sf):
    c = sentencepieces.coder(MODEL)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sentencepieces.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = c.whole.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(c.whole.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_byte_pairs_equal_the_library(ranks):
    t, library = packing.ChunkTokenizer(JSON, ranks), Tokenizer.from_file(JSON)
    long = ["a" * 100_000, " " * 100_000 + "x", "\n" * 50_000, "é" * 20_000, " " * 1_000_000, "a <|endoftext|> b", "<|endoftext|>", "x\n<|endoftext|><|endoftext|>y <|endoftext|", "é" * 300 + "<|endoftext|>"]
    for s in strings(3000, 3) + long:
        assert np.frombuffer(t.encode(s), "<u4").tolist() == library.encode(s, add_special_tokens=False).ids, repr(s[:40])


def check_packed(rows, texts, top=1024):
    """Every id lies in exactly one piece; sequences have no gap and a power of two of tokens, so no padding."""
    library = Tokenizer.from_file(JSON)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    wanted = defaultdict(list)
    for i, s in texts:
        wanted[i].append(np.array([*library.encode(s or "", add_special_tokens=False).ids, 0], "<u4"))
    assert set(by_doc) == set(wanted)
    for i, docs in wanted.items():
        pieces = sorted(by_doc[i], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == sum(map(len, docs))
        if len(docs) == 1:
            at = 0
            for r in pieces:
                part = docs[0][at : at + r["length"]]
                assert r["start"] == at and r["doc_tokens"] == len(docs[0]) and r["ids_crc32"] == zlib.crc32(part.tobytes())
                at += r["length"]
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= top and at & (at - 1) == 0 and all(r["sequence_length"] == at for r in pieces)
        assert len({r["step_group"] for r in pieces}) == 1
    # Step groups are numbered over the whole; in each task all but one hold equally many tokens.
    steps = defaultdict(int)
    for r in rows:
        steps[r["step_group"]] += r["length"]
    assert all(n <= packing.STEP_TOKENS for n in steps.values())
    short = [g >> 33 for g, n in steps.items() if n < packing.STEP_TOKENS]
    assert len(short) == len(set(short)) and {g >> 33 for g in steps} == {r["sequence_id"] >> 33 for r in rows}


def test_packing_query(spark, sf):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packed(packing.query(spark, sf).collect(), texts)


def test_packing_of_odd_rows(odd, none):
    from pyspark.sql import functions as F

    rows = packing.pack(odd, JSON, ranks_file=RANKS).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_packed(rows, [(r["doc_id"], r["text"]) for r in odd.collect()])
    assert packing.pack(none, JSON).count() == 0


def test_packer_tiers_and_groups():
    rng = np.random.default_rng(4)
    p = packing.Packer(0, (64, 32, 16), 128, queue=50)
    docs = [rng.integers(0, 9, rng.integers(1, 200)).astype("<u4").tobytes() for _ in range(400)]
    for k, d in enumerate(docs):
        p.add(k, d)
    p.finish()
    rows = p.drain()
    back = defaultdict(list)
    tokens = defaultdict(int)
    for doc, start, _, ids, _, seq, _, length, group in rows:
        back[doc].append((start, ids))
        tokens[length, group] += len(ids) // 4
    assert all(b"".join(i for _, i in sorted(back[k])) == d for k, d in enumerate(docs))
    assert max(tokens.values()) == 128 and {length for length, _ in tokens} >= {64, 32, 16}
    assert sum(len(v) for v in back.values()) < 400 * 5
