"""WARC archives that are damaged, of other makers, or written by jobs that did not end."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyarrow import fs

from cellweave.llm import warc
from cellweave.llm.runtime import shared_dir
from tests.llm.test_groups_and_files import Counting, pages


def one(k, body, **more):
    return warc.record(f"urn:page:{k}", "response", "u", hashlib.sha1(body).hexdigest(), None, len(body), body)


BIG = bytes(np.random.default_rng(1).integers(0, 256, 700_000).astype(np.uint8))
BLOCKS = [one(1, b"first"), one(2, BIG), one(3, b"third"), one(4, b"")]
FORMS = {"own": lambda b: b"".join(map(warc.member, b)), "gzip": lambda b: b"".join(map(gzip.compress, b)), "plain": b"".join}
PAYLOADS = [b"first", BIG, b"third", b""]


def read(data, **more):
    return list(warc.records(Counting(data), len(data), **more))


@pytest.mark.parametrize("form", FORMS)
def test_records_cut_off_anywhere(form):
    """What precedes the cut comes back whole."""
    data = FORMS[form](BLOCKS)
    ends = np.cumsum([len(FORMS[form]([b])) for b in BLOCKS])
    rng = random.Random(3)
    for cut in [0, 1, 5, 30, *ends[:-1].tolist(), *(rng.randrange(len(data)) for _ in range(40)), len(data) - 1]:
        for payload in (True, False):
            got = read(data[:cut], payload=payload)
            whole = int((ends <= cut + (4 if form == "plain" else 0)).sum())
            assert len(got) == whole and (not payload or [r["payload"] for r in got] == PAYLOADS[:whole]), (form, cut)
    with pytest.raises(warc.Damaged):
        read(data[: int(ends[1]) - 100], strict=True)


def test_headers_that_are_no_headers():
    bad = [b.replace(b"Content-Length: ", b"Content-Length: x", 1) if k == 1 else b for k, b in enumerate(BLOCKS[:1] + BLOCKS[2:])]
    assert b"Length: x" in bad[1]
    assert [r["payload"] for r in read(FORMS["gzip"](bad))] == [r["payload"] for r in read(FORMS["own"](bad))] == [b"first", b""]
    assert [r["payload"] for r in read(FORMS["plain"](bad))] == [b"first"]
    digest = BLOCKS[0].replace(b"sha1:", b"sha1:1", 1)
    assert read(digest)[0]["payload_digest"].startswith("sha1:1")
    assert read(b"no archive at all") == [] and read(gzip.compress(b"none either")) == [] and read(b"\x1f\x8b") == []
    assert read(gzip.compress(b"x" * 5_000_000)) == []


def test_random_damage_raises_nothing():
    rng = random.Random(4)
    for form in FORMS.values():
        whole = form([BLOCKS[0], BLOCKS[2], BLOCKS[3]] * 3)
        for _ in range(300):
            data = bytearray(whole)
            for _ in range(rng.randint(1, 4)):
                data[rng.randrange(len(data))] = rng.randrange(256)
            assert len(read(bytes(data), payload=rng.random() < 0.5)) <= 9


def test_foreign_archives_are_read_once():
    data = FORMS["gzip"](BLOCKS * 3)
    f = Counting(data)
    got = list(warc.records(f, len(data), (("record_id", "in", ("urn:page:3",)),)))
    assert [r["payload"] for r in got] == [b"third"] * 3 and f.read_bytes <= len(data)


def test_one_page_in_nine_of_ten_rows(spark):
    same = "<html>" + "error " * 300
    rows = [(k, "u", same if k % 10 else f"page {k} " * 200) for k in range(600)]
    got = warc.to_records(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sum(r["record_type"] == "revisit" for r in got) == 539 and {r["refers_to"] for r in got} == {None, "urn:page:599"}


def test_only_committed_archives_are_read(spark):
    path = shared_dir(spark, "warc")
    for _ in range(2):
        warc.write(warc.to_records(pages(spark)), path)
    store, root = warc._fs(path)
    whole = warc.load(spark, path).count()
    assert whole == 2 * pages(spark).count()
    # A driver that died while it moved its files, and another job that is still writing.
    some = next(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.path.endswith(".gz"))
    store.copy_file(some, f"{root}/part-unnamed-000000-1.warc.gz")
    store.create_dir(f"{root}/_temporary/other", recursive=True)
    store.copy_file(some, f"{root}/_temporary/other/part-other-000000-1.warc.gz")
    warc.write(warc.to_records(pages(spark).where("page_id = 7")), path)
    assert warc.load(spark, path).count() == whole + 1
    assert store.get_file_info(f"{root}/_temporary/other/part-other-000000-1.warc.gz").is_file
    foreign = shared_dir(spark, "warc")
    store.create_dir(warc._fs(foreign)[1], recursive=True)
    store.copy_file(some, f"{warc._fs(foreign)[1]}/any.warc.gz")
    assert warc.load(spark, foreign).count() > 0
