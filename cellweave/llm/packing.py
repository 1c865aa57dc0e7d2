"""Hierarchical multi-length packing of token sequences.

Every document becomes ids (byte-level BPE) and an end id.  A document's full windows of the longest tier leave at once.
What remains is routed to the smallest context tier that holds it, and each tier packs its own queue.  A window that is
short of tokens is filled from the longest piece that fits among the shorter tiers, and the last gap by cutting a piece
of a shorter tier in two.  At the end of a task, what is left in the queues is joined, longest first, and cut into powers of two,
which need no padding.  Sequences of one tier go into step groups of STEP_TOKENS tokens; what each tier has left at the end of a task
goes into groups of mixed lengths, so that all groups of a task but one hold equally many tokens.  Group numbers carry the
partition's number as sequence ids do.

Each task packs the documents of its own input partition and holds a bounded queue, so a task that is run again gives the same
sequences, and nothing is shuffled.  Sequence ids carry the partition's number in their upper bits.

Null texts are empty: such a document has one id, the end.  Rows that repeat are packed each for itself.  Other columns do
not take part.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import lean, read, ship_package, slices, texts_of

#: Context tiers, powers of two, longest first.
TIERS = (1024, 512, 256, 128)
#: Tokens of a step group.
STEP_TOKENS = 65_536
#: Pieces that wait in all queues before windows are filled.
QUEUE = 4096
#: Distinct chunks that a worker keeps before it starts a new table, and the longest that it keeps.
TABLE_CHUNKS = 150_000
KEEP_CHARS = 200

#: Fixed: how this family of tokenizers cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space in Unicode, as a part of a character class.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word with the one space or line feed before it; white space up to its last character; other white space.
_CHUNKS = re.compile(f"[ \n]?[^{_WS}]+|[{_WS}]+(?=[{_WS}][^{_WS}])|[{_WS}]+").findall


#: Up to here the two tokenizer libraries are known to class characters alike.
_BEYOND_LATIN = re.compile("[^\x00-\u024f]").search


class ChunkTokenizer:
    """Ids of texts: texts of Latin letters by tiktoken, which has the same vocabulary and is several times faster; others by a
    table of distinct chunks, each tokenized once by tokenizers.

    The pre-tokenizer of a byte-level BPE never joins a word with what stands before its leading space, so chunks cut there
    have the same ids alone as in the text.  A text that holds a special token's text goes to tokenizers as a whole, which gives
    that token's id there.
    """

    def __init__(self, path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.quick = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("quick", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.tokenizer = Tokenizer.from_file(path)
        added = [a.content for a in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.table: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian uint32."""
        if self.special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.quick is not None and (text.isascii() or not _BEYOND_LATIN(text)):
            try:
                return self.quick.encode_to_numpy(text).astype("<u4", copy=False).tobytes()
            except ValueError:  # tiktoken's limit on backtracking, met by several 100,000 blanks in a row; the table below has none
                pass
        chunks = _CHUNKS(text)
        table = self.table
        parts = list(map(table.get, chunks))
        if None in parts:
            fresh = list({c for c, p in zip(chunks, parts, strict=True) if p is None})
            ids = self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)
            here = {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(fresh, ids, strict=True)}
            parts = [here[c] if p is None else p for c, p in zip(chunks, parts, strict=True)]
            if len(table) > TABLE_CHUNKS:
                table.clear()
            table.update((c, i) for c, i in here.items() if len(c) <= KEEP_CHARS)
        return b"".join(parts)


@lru_cache(maxsize=2)
def tokenizer(path: str, ranks_path: str | None = None) -> ChunkTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkTokenizer(path, ranks_path)


class Packer:
    """Packs pieces (document, start, ids, document's tokens) into the rows of sequences."""

    def __init__(self, first_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, queue: int = QUEUE):
        assert all(t & (t - 1) == 0 for t in tiers) and list(tiers) == sorted(tiers, reverse=True)
        self.tiers, self.step_tokens, self.limit = tiers, step_tokens, queue
        self.queues: dict[int, deque] = {t: deque() for t in tiers}
        self.waiting = 0
        self.next_id, self.first_id = first_id, first_id
        self.open: dict[int, list[list[tuple]]] = {}
        self.groups = 0
        self.rows: list[tuple] = []

    def add(self, doc, ids: bytes) -> None:
        """ids: little-endian uint32, with the end id."""
        total, top, start = len(ids) // 4, self.tiers[0], 0
        while total - start >= top:
            self.close([(doc, start, ids[4 * start : 4 * (start + top)], total)], top)
            start += top
        if start < total:
            self.put((doc, start, ids[4 * start :], total))
            if self.waiting >= self.limit:
                self.fill(self.limit // 2)

    def put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.queues[min(t for t in self.tiers if t >= n)].append(piece)
        self.waiting += 1

    def close(self, pieces: list[tuple], length: int) -> None:
        """One sequence; it waits until step_tokens tokens of this length make a step group."""
        at, out = 0, []
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            out.append((doc, start, n, ids, total, self.next_id, at, length))
            at += n
        self.next_id += 1
        held = self.open.setdefault(length, [])
        held.append(out)
        if len(held) * length >= self.step_tokens:
            self.step(held)
            self.open[length] = []

    def step(self, sequences: list[list[tuple]]) -> None:
        self.rows += [(*row, self.first_id + self.groups) for rows in sequences for row in rows]
        self.groups += 1

    def finish(self) -> None:
        """Pack all that waits; sequences that are in no step group yet make groups of mixed lengths, longest first, the last one maybe short."""
        self.fill(0)
        waiting = [(length, rows) for length in sorted(self.open, reverse=True) for rows in self.open[length]]
        self.open, group, tokens = {}, [], 0
        for length, rows in waiting:
            group.append(rows)
            tokens += length
            if tokens >= self.step_tokens:
                self.step(group)
                group, tokens = [], 0
        if group:
            self.step(group)

    def take(self, room: int) -> tuple | None:
        """The first piece of the longest tier that fits as a whole, else a cut from the next shorter queue."""
        for t in self.tiers:
            q = self.queues[t]
            for k in range(min(len(q), 16)):
                if len(q[k][2]) // 4 <= room:
                    piece = q[k]
                    del q[k]
                    self.waiting -= 1
                    return piece
        for t in reversed(self.tiers):
            if self.queues[t]:
                doc, start, ids, total = self.queues[t].popleft()
                self.waiting -= 1
                self.put((doc, start + room, ids[4 * room :], total))
                return doc, start, ids[: 4 * room], total
        return None

    def fill(self, leave: int) -> None:
        """Fill windows, each tier in turn, until `leave` pieces wait."""
        while self.waiting > leave:
            # The tier whose queue holds the most tokens' worth of windows is packed next.
            t = max(self.tiers, key=lambda x: len(self.queues[x]) * x)
            pieces, room = [], t
            while room:
                piece = self.take(room)
                if piece is None:
                    self.flush(pieces)
                    return
                pieces.append(piece)
                room -= len(piece[2]) // 4
            self.close(pieces, t)

    def flush(self, pieces: list[tuple]) -> None:
        """The last tokens, cut into powers of two."""
        left = sum(len(p[2]) // 4 for p in pieces)
        q = deque(pieces)
        while left:
            room = length = min(self.tiers[0], 1 << (left.bit_length() - 1))
            out = []
            while room:
                doc, start, ids, total = q.popleft()
                n = len(ids) // 4
                if n > room:
                    q.appendleft((doc, start + room, ids[4 * room :], total))
                    ids, n = ids[: 4 * room], room
                out.append((doc, start, ids, total))
                room -= n
            self.close(out, length)
            left -= length

    def drain(self) -> list[tuple]:
        out, self.rows = self.rows, []
        return out


def pack(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, tiers: tuple[int, ...] = TIERS, ranks_file: str | None = None) -> DataFrame:
    """A row per piece: id, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset, sequence_length, step_group."""
    ship_package(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, end = tokenizer(tokenizer_file, ranks_file), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 33, tiers)
        ids_type = None

        def rows():
            cols = list(zip(*packer.drain(), strict=True))
            types = [ids_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types, strict=True)], names=names)

        for batch in slices(batches):
            ids_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                packer.add(doc, t.encode(text) + end)
            if packer.rows:
                yield rows()
        packer.finish()
        if packer.rows:
            yield rows()

    schema = f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long"
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(lean(run), schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ranks_file=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_length", "step_group")
