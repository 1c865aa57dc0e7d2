"""WARC archives as a PySpark Python data source.

Reading: one partition per archive file.  Filters on record_type, record_id, target_uri and payload_digest are pushed down.
Every gzip member carries its own compressed length in an extra field, so a record is judged after its headers alone have been
inflated and, if unwanted, is stepped over without decoding its payload; option payload=false steps over all payloads.
Archives without that field, and plain .warc files, are read too, unwanted payloads without being kept.

Writing: each task writes one archive into a folder of its job under _temporary; the driver moves those of the committed attempts into
place and then names them in a file under _commits, so what a lost executor or driver leaves behind is never read.  In a folder that has
_commits, only the archives named there are read; in any other, all.

Damaged archives: a record that is cut off, does not inflate, or has no readable header ends its archive, as nothing tells where the
next one starts; what precedes it is returned.  A gzip member whose record has no valid Content-Length, or less than that, is left out.
With option mode=failfast each of these is an error.

Null payloads are empty, null URLs give no WARC-Target-URI.  Rows that repeat give a record each.  A null page id is written as an empty
number and read back as null.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from cellweave.llm.runtime import materialise, read, shared_dir, ship_package

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, refers_to string, payload_bytes long, payload binary"
#: Payloads of at least so many bytes are stored once.
REVISIT_BYTES = 1000
_PUSHED = ("record_id", "record_type", "target_uri", "payload_digest")
_ID = "urn:page:"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else re.sub("^file:/*", "file:///", path))


def member(block: bytes) -> bytes:
    """A gzip member whose extra field LX holds its compressed length and its content's length."""
    deflate = zlib.compressobj(4, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    whole = 10 + 2 + 12 + len(body) + 8
    extra = b"LX" + struct.pack("<HII", 8, whole, len(block) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def record(record_id: str, record_type: str, uri: str | None, digest: str, refers_to: str | None, size: int, payload: bytes) -> bytes:
    """One WARC record around an HTTP response; digest: SHA-1 in hex; size: bytes of the full payload, also where it is left out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{refers_to}>")
        payload = b""
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def headers(block: bytes) -> dict[str, str]:
    """Header lines by lower-case name, without the first line."""
    out = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def fields(head: dict[str, str]) -> dict:
    digest = head.get("warc-payload-digest", "")
    algorithm, _, code = digest.partition(":")
    if algorithm.lower() == "sha1" and re.fullmatch("[A-Za-z2-7]{32}", code):
        digest = base64.b32decode(code.upper()).hex()
    bare = lambda k: head[k].strip("<>") if k in head else None
    return {"record_id": bare("warc-record-id"), "record_type": head.get("warc-type"), "target_uri": head.get("warc-target-uri"), "payload_digest": digest or None, "refers_to": bare("warc-refers-to")}


def wanted(got: dict, filters: tuple) -> bool:
    for column, how, values in filters:
        v = got[column]
        if v is None or not (v in values if how == "in" else v.startswith(values)):
            return False
    return True


class Damaged(ValueError):
    """A record that cannot be read, so that what follows it cannot be found."""


class Ahead:
    """An archive's bytes in order; what was read too far is kept."""

    def __init__(self, data, size: int):
        self.data, self.size, self.at, self.held = data, size, 0, b""

    def take(self, n: int = 1 << 18) -> bytes:
        """The next bytes, n at most; none at the end."""
        if not self.held:
            self.held = self.data.read(max(0, min(n, self.size - self.at)))
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def back(self, rest: bytes) -> None:
        self.held, self.at = rest + self.held, self.at - len(rest)

    def go(self, at: int) -> None:
        """Go to an offset, which may lie in what is held."""
        if 0 <= at - self.at <= len(self.held):
            self.held = self.held[at - self.at :]
        else:
            self.held = b""
            self.data.seek(at)
        self.at = at


#: A record's header lines are no longer than this.
HEAD_BYTES = 1 << 20


def _length(raw: dict[str, str]) -> int | None:
    value = raw.get("content-length", "")
    return int(value) if re.fullmatch("[0-9]{1,18}", value) else None


def _zipped(ahead: Ahead, first: bytes, filters: tuple, payload: bool) -> tuple[dict | None, bytes, int]:
    """Fields (None if not wanted), content and its declared length of a gzip member that starts with `first`; goes on behind it."""
    start = ahead.at - len(first)
    length = struct.unpack_from("<I", first, 16)[0] if len(first) >= 20 and first[3] & 4 and first[12:14] == b"LX" else None
    if length is not None and not 0 < length <= ahead.size - start:
        raise Damaged(f"a member at {start} is cut off")
    inflate = zlib.decompressobj(31)
    block, one = inflate.decompress(first), True
    while b"\r\n\r\n" not in block and not inflate.eof:
        piece = ahead.take()
        if not piece or len(block) > HEAD_BYTES:
            raise Damaged(f"the header at {start} has no end")
        block, one = block + inflate.decompress(piece), False
    head, found, rest = block.partition(b"\r\n\r\n")
    got = fields(raw := headers(head))
    need = _length(raw) if found else None
    keep = need is not None and wanted(got, filters)
    if length is None or keep and payload:
        parts, size = [rest], len(rest)
        while not inflate.eof:
            piece = ahead.take()
            if not piece:
                raise Damaged(f"a member at {start} is cut off")
            out = inflate.decompress(piece)
            size += len(out)
            if keep and (payload or size < HEAD_BYTES):
                parts.append(out)
        ahead.back(inflate.unused_data)
        if need is not None and size < need:
            need = None
        rest = b"".join(parts)
    elif one:
        ahead.back(first)
    if length is not None:
        ahead.go(start + length)
    if need is None:
        return {}, b"", 0
    return (got if keep else None), rest[:need], need


def _plain(ahead: Ahead, first: bytes, filters: tuple, payload: bool) -> tuple[dict | None, bytes, int]:
    start = ahead.at - len(first)
    while b"\r\n\r\n" not in first:
        piece = ahead.take(4096)
        if not piece or len(first) > HEAD_BYTES:
            raise Damaged(f"the header at {start} has no end")
        first += piece
    head, _, rest = first.partition(b"\r\n\r\n")
    got = fields(raw := headers(head))
    need, body = _length(raw), start + len(head) + 4
    if need is None or body + need > ahead.size:
        raise Damaged(f"the record at {start} has no valid length or is cut off")
    keep = wanted(got, filters)
    if keep and payload:
        parts, size = [rest], len(rest)
        while size < need:
            parts.append(ahead.take(min(need - size, 1 << 20)))
            size += len(parts[-1])
        rest = b"".join(parts)
    ahead.back(rest[need:])
    ahead.go(min(body + need + 4, ahead.size))
    return (got if keep else None), rest[:need], need


def records(data, size: int, filters: tuple = (), payload: bool = True, strict: bool = False) -> Iterator[dict]:
    """Records of an archive opened for random access: headers first, the rest only if wanted.  strict: damage is an error."""
    ahead = Ahead(data, size)
    while first := ahead.take(4096):
        while len(first) < 24 and (more := ahead.take(4096)):
            first += more
        try:
            got, content, _ = (_zipped if first[:2] == b"\x1f\x8b" else _plain)(ahead, first, filters, payload)
        except (Damaged, zlib.error) as e:
            if strict:
                raise Damaged(str(e)) from e
            return
        if got == {} and strict:
            raise Damaged(f"a record before {ahead.at} has no valid length")
        if not got:
            continue
        http, _, body = content.partition(b"\r\n\r\n")
        declared = headers(http).get("content-length", "")
        got["payload_bytes"] = int(declared) if re.fullmatch("[0-9]{1,18}", declared) else len(body)
        got["payload"] = body if payload else None
        yield got


@dataclass
class Archive(InputPartition):
    path: str
    size: int

    def __init__(self, path: str, size: int):
        super().__init__((path, size))
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, strict: bool = False):
        self.root, self.payload, self.strict, self.filters = path, payload, strict, ()

    def pushFilters(self, filters):
        """Take over equality, membership and prefixes of the header columns; give back the rest."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in _PUSHED and isinstance(f, EqualTo) and isinstance(f.value, str):
                self.filters += ((name, "in", (f.value,)),)
            elif name in _PUSHED and isinstance(f, In) and all(isinstance(v, str) for v in f.value):
                self.filters += ((name, "in", tuple(f.value)),)
            elif name in _PUSHED and isinstance(f, StringStartsWith):
                self.filters += ((name, "prefix", f.value),)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _fs(self.root)
        if store.get_file_info(root).type == fs.FileType.File:
            found = [store.get_file_info(root)]
        else:
            found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
            if store.get_file_info(f"{root}/_commits").type == fs.FileType.Directory:
                named = {n for c in store.get_file_info(fs.FileSelector(f"{root}/_commits")) if c.path.endswith(".json") for n in json.loads(store.open_input_file(c.path).read())}
                found = [f for f in found if f.base_name in named]
        return [Archive(f.path, f.size) for f in sorted(found, key=lambda f: f.path) if f.is_file and re.search(r"\.warc(\.gz)?$", f.path)]

    def read(self, partition):
        store, _ = _fs(self.root)
        names = ["record_id", "record_type", "target_uri", "payload_digest", "refers_to", "payload_bytes", "payload"]
        types = [pa.string()] * 5 + [pa.int64(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

        rows, held = [], 0
        if partition is None:
            return
        with store.open_input_file(partition.path) as data:
            for r in records(data, partition.size, self.filters, self.payload, self.strict):
                rows.append(r)
                held += len(r["payload"] or b"") + 300
                if held > 4 << 20:
                    yield batch(rows)
                    rows, held = [], 0
        if rows:
            yield batch(rows)


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.root, self.job = path, uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        store, root = _fs(self.root)
        task = TaskContext.get()
        name = f"part-{self.job}-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        store.create_dir(f"{root}/_temporary/{self.job}", recursive=True)
        n = 0
        with store.open_output_stream(f"{root}/_temporary/{self.job}/{name}", compression=None, buffer_size=1 << 20) as out:
            for b in iterator:
                for r in b.to_pylist():
                    out.write(member(record(r["record_id"], r["record_type"], r["target_uri"], r["payload_digest"], r["refers_to"], r["payload_bytes"], r["payload"] or b"")))
                    n += 1
        return Written(name, n)

    def commit(self, messages):
        store, root = _fs(self.root)
        store.create_dir(f"{root}/_commits", recursive=True)
        names = [m.name for m in messages if m is not None and m.records]
        for name in names:
            store.move(f"{root}/_temporary/{self.job}/{name}", f"{root}/{name}")
        draft = f"{root}/_commits/{self.job}.draft"
        with store.open_output_stream(draft) as out:
            out.write(json.dumps(names).encode())
        store.move(draft, f"{root}/_commits/{self.job}.json")
        self.clean()

    def abort(self, messages):
        self.clean()

    def clean(self):
        """Delete this job's folder; other jobs may be writing to theirs."""
        from pyarrow import fs

        store, root = _fs(self.root)
        if store.get_file_info(f"{root}/_temporary/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary/{self.job}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() != "false", self.options.get("mode", "").lower() == "failfast")

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make format("warc") known to the session, with filter pushdown for Python sources."""
    ship_package(spark)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def to_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages (page_id, url, html) as records: of equal payloads of `least` bytes or more the page with the largest id is the response,
    the others revisit it.  Rows with that same id are responses too; where no page of a group has an id, all are.

    Only digests and ids are shuffled to find the groups, which are written.  Smaller payloads take no part in the join, and as both
    its sides are plain exchanges, Spark can split the part of a page that is there very often.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large, small = full.where(F.col("payload_bytes") >= least), full.where(F.col("payload_bytes") < least)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    both = large.join(materialise(groups, "groups"), "payload_digest", "left").unionByName(small.withColumn("first_id", F.lit(None).cast(pages.schema["page_id"].dataType)))
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    named = lambda c: F.concat(F.lit(_ID), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return both.select(
        named("page_id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        "payload_digest",
        F.when(again, named("first_id")).alias("refers_to"),
        "payload_bytes",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def write(recs: DataFrame, path: str) -> None:
    register(recs.sparkSession)
    recs.write.format("warc").mode("append").save(path)


def load(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives under path; a record without a WARC-Type is none.

    The predicate is no mere check: Spark keeps the reader of a relation with the filters pushed last, and plans it anew only where a scan
    has filters.  As every scan has this one, a frame can be used again with others.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path).where("record_type is not null")


def query(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write(to_records(read(spark, sf_dir, "pages")), path)
    back = load(spark, path)
    number = lambda c: F.expr(f"try_cast(substring({c}, {len(_ID) + 1}) as bigint)")
    stored = F.col("record_type") == "response"
    return back.select(
        number("record_id").alias("page_id"),
        F.when(stored, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(stored, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (
  SELECT payload_digest, max(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.n > 1 AND g.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM g.first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.n > 1 AND g.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM g.first_id THEN g.first_id END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
