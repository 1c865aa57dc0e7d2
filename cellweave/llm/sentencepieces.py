"""SentencePiece encoding and decoding with a distinct-chunk table.

In a BPE vocabulary where no piece holds a whitespace marker after another character, no merge ever crosses from a
word into the next marker.  A text then falls into marked words that can be segmented alone.  Each worker keeps a table
of the distinct marked words it has met, segments each once with the library, and joins the ids back by position.
Characters that occur in no piece of several characters (line feeds, tabs) are cut off too.

Null texts are empty; an empty text has no ids and decodes to the empty text.  Repeated rows and ids are kept as they
are; other columns do not take part.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import read, ship_package, slices, texts_of

#: Distinct chunks that a worker keeps before it starts a new table.
TABLE_CHUNKS = 500_000
#: Longer chunks are segmented but not kept.
KEEP_CHARS = 200
MARK = "▁"


class ChunkCoder:
    """The library's encode() and decode() over chunks."""

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.whole = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        pieces = [p.piece for p in proto.pieces if p.type in (1, 4, 5)]
        self.cuttable = (
            proto.trainer_spec.model_type == 2
            and spec.name == "identity"
            and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces
            and proto.trainer_spec.byte_fallback
            and not any(p.type == 4 for p in proto.pieces)
            and not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        )
        inner = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\t" if c not in inner)
        self.chunks = re.compile(f" *[^ {alone}]+| +" + "".join(f"|{c}" for c in alone)).findall
        spec.add_dummy_prefix = False
        self.part = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        fence = self.part.encode("\n")
        self.fence = fence[0] if "\n" in alone and len(fence) == 1 else None
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        if not text:
            return b""
        if not self.cuttable:
            return np.asarray(self.whole.encode(text), "<i4").tobytes()
        text = text.replace(MARK, " ")
        if self.fence is not None:
            # A line feed stands alone, so a chunk is a word with its one marker, or a line feed and the word after it.
            chunks = text.replace("\n", " \n").split(" ")
            if "" not in chunks:
                return self.joined(self.words, chunks, lambda c: c if c[0] == "\n" else MARK + c)
        return self.joined(self.runs, self.chunks(" " + text), lambda c: c.replace(" ", MARK))

    def joined(self, table: dict[str, bytes], chunks: list[str], marked: Callable[[str], str]) -> bytes:
        """The ids of all chunks in order; those that the table lacks are segmented once."""
        parts = list(map(table.get, chunks))
        if None in parts:
            fresh = list({c for c, p in zip(chunks, parts, strict=True) if p is None})
            here = dict(zip(fresh, self.segment([marked(c) for c in fresh]), strict=True))
            parts = [here[c] if p is None else p for c, p in zip(chunks, parts, strict=True)]
            if len(table) > TABLE_CHUNKS:
                table.clear()
            table.update((c, i) for c, i in here.items() if len(c) <= KEEP_CHARS)
        return b"".join(parts)

    def segment(self, fresh: list[str]) -> list[bytes]:
        """Ids of each marked chunk.  Many go into one call, kept apart by the line feed, which no piece holds."""
        if self.fence is None:
            return [np.asarray(self.part.encode(c), "<i4").tobytes() for c in fresh]
        out: list[bytes] = []
        first = np.asarray([self.fence], "<i4").tobytes()
        for at in range(0, len(fresh), 256):
            group = fresh[at : at + 256]
            ids = np.asarray(self.part.encode("\n".join([c[1:] if c[0] == "\n" else c for c in group])), "<i4")
            cut = (np.flatnonzero(ids == self.fence) * 4).tolist()
            raw = ids.tobytes()
            out += [first + raw[a:b] if c[0] == "\n" else raw[a:b] for c, a, b in zip(group, [0, *(x + 4 for x in cut)], [*cut, len(raw)], strict=True)]
        return out

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if ids else ""


@lru_cache(maxsize=2)
def coder(model_file: str) -> ChunkCoder:
    return ChunkCoder(model_file)


@lru_cache(maxsize=2)
def surfaces(model_file: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all pieces end to end, start and length of each, and which ids this table can stand for."""
    sp = coder(model_file).whole
    n = sp.get_piece_size()
    plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
    parts = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths, plain


def decode_ids(ids: np.ndarray, model_file: str) -> str:
    """The library's decode(ids), by gathering piece bytes; what that cannot stand for goes to the library itself."""
    if not len(ids):
        return ""
    data, start, length, plain = surfaces(model_file)
    if ids.min() < 0 or ids.max() >= len(plain) or not plain[ids].all():
        return coder(model_file).decode(ids.tolist())
    n = length[ids]
    ends = np.cumsum(n)
    at = np.repeat(start[ids] - (ends - n), n) + np.arange(ends[-1])
    try:
        text = data[at].tobytes().decode()
    except UnicodeDecodeError:
        return coder(model_file).decode(ids.tolist())
    # The library drops the marker that opens the first piece, but not a space that is a byte piece.
    return text[1:] if text[:1] == " " and not coder(model_file).whole.is_byte(int(ids[0])) else text


def encode(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row's whole text: the library's encode() without begin or end ids."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_file)
        for batch in slices(batches):
            parts = [c.encode(t) for t in texts_of(batch.column(1))]
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, decoded string): the library's decode() of every row's ids; null ids decode to the empty text."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column(1)
                flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
                out = [decode_ids(flat[a:b], model_file) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(out, pa.string())], names=[id_col, ids_col, "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, `{ids_col}` array<int>, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    both = decode(encode(read(spark, sf_dir, "documents"), model), model)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
