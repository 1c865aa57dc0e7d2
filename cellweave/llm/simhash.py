"""SimHash near-duplicates over word shingles, found through an inverted index of fingerprint bytes.

A fingerprint is eight bytes.  Two fingerprints that differ in at most four bits differ in at most four bytes, so at least four
byte positions agree: that is the guaranteed minimum of matches.  Postings of single bytes would grow with the square of the
corpus, so the index holds tuples of positions, chosen so that any four agreeing positions contain a tuple whole (positions are
dealt into groups; a tuple lies in one group).  The tuple's length follows the number of distinct fingerprints, so that a
posting list stays short at any size.  Within a posting list the shared bytes of each pair are tallied, pairs with four or more are
retained and verified by their bits.  A long list (a group of near copies) is split further by one more byte: by then enough
matches are still guaranteed to be found in some part.  Only the edges of a spanning forest leave a long list, never all its pairs.

Lists of up to 64 are compared all at once.  Equal fingerprints meet before the index, so copies cost one aggregation row each.  Components come from alternating large-star
and small-star rounds over distinct fingerprints, every round written to the shared folder.

Null texts are empty.  Texts without a word have fingerprint zero and are linked like any other.  Rows with equal ids are kept each.
Null ids take part by their text and never are a component's id unless nothing else is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.runtime import joined, lean, materialise, packed, read, release, remove, ship_package, slices, texts_of

WORDS = 4
MOST_BITS = 4
SEED = 42
#: Fingerprints of a posting list that are compared pairwise at once; longer lists are split by another byte, then by half bytes.
LIST = 2048
#: Longer posting lists are dealt anew over the tasks, by longer tuples.
LONG_LIST = 50_000
#: Up to so many edges, the rounds of components() write nothing but their result.
FEW_EDGES = 200_000
#: While lists hold more pairs of sets in different groups than this for each set, such sets are tried with single ones first, so many times.
PAIRS_A_SET = 8
TURNS = 2
#: Bits of a set in which each shingle flips one.
FLIPS = 1024
#: Shingles that are hashed at once.
BLOCK = 1 << 18


_COLUMN = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """Unsigned hash of each shingle in order, repeats included."""
    parts = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)] if parts else [], np.uint64)
    out = np.empty(len(parts) - words + 1, np.uint64)
    for at in range(0, len(out), BLOCK):
        own = parts[at : at + BLOCK + words - 1]
        line = b" ".join(own)
        ends = np.cumsum([len(p) + 1 for p in own])
        starts, stops = [0, *ends[:-1].tolist()], (ends - 1)[words - 1 :].tolist()
        out[at : at + BLOCK] = [digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)]
    return out


def majority(h: np.ndarray) -> np.uint64:
    """SimHash of shingle hashes: a bit is set where over half of them have it."""
    # How often each value occurs at each byte position, times the bits of the value.
    seen = np.bincount((np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8) + _COLUMN).ravel(), minlength=2048).reshape(8, 256)
    return np.packbits(2 * (seen @ _BITS).ravel() > len(h), bitorder="little").view("<u8")[0]


def fingerprints(texts: list[str], words: int = WORDS) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: a bit is set where over half of the shingles' hashes have it."""
    out = np.zeros(len(texts), np.uint64)
    for k, t in enumerate(texts):
        h = shingle_hashes(t, words)
        if len(h):
            out[k] = majority(h)
    return out


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp long) per row; fp holds the 64 bits."""
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints(texts_of(batch.column(1)), words).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(lean(run), f"`{id_col}` {kind}, fp long")


def position_tuples(size: int, least: int = 8 - MOST_BITS, positions: int = 8) -> list[tuple[int, ...]]:
    """Tuples of `size` positions such that any `least` positions contain one whole.

    Positions are dealt into so many groups that `least` positions put `size` into one of them.
    """
    if size >= least:
        return list(combinations(range(positions), least))
    groups = (least - 1) // (size - 1) if size > 1 else 1
    if size == 1:
        return [(p,) for p in range(positions - least + 1)]
    dealt = [list(range(positions))[g::groups] for g in range(groups)]
    return [c for g in dealt for c in combinations(g, size)]


def tuple_size(distinct: int, most: int = 64) -> int:
    """The shortest tuple for which `distinct` spread fingerprints give posting lists of `most` on average."""
    return next((s for s in (2, 3) if distinct <= most * 256**s), 4)


def linked(x: np.ndarray) -> np.ndarray:
    """Which differences x of two fingerprints are links: tally the equal bytes, retain enough matches, verify the bits."""
    enough = np.flatnonzero((np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8) == 0).sum(1) >= 8 - MOST_BITS)
    return enough[np.bitwise_count(x[enough]) <= MOST_BITS]


def forest(fps: np.ndarray, limit: int = LIST) -> list[tuple[int, int]]:
    """Index pairs that connect what the links among these distinct fingerprints connect, fewer than there are links."""
    octets = fps.astype("<u8").view(np.uint8).reshape(-1, 8)
    edges: list[tuple[int, int]] = []

    def search(rest: np.ndarray) -> None:
        """Breadth-first: every fingerprint is compared with those not reached yet."""
        while len(rest) > 1:
            ahead, rest = [rest[0]], rest[1:]
            while ahead and len(rest):
                a = ahead.pop()
                near = linked(fps[rest] ^ fps[a])
                edges.extend((int(a), int(b)) for b in rest[near])
                ahead.extend(rest[near])
                rest = np.delete(rest, near)

    def sieve(at: np.ndarray, used: tuple[int, ...]) -> None:
        """A long list that agrees in four bytes: of the eight half bytes of the others, at least four agree as well."""
        halves = [(fps[at] >> np.uint64(8 * p + 4 * half)) & np.uint64(15) for p in range(8) if p not in used[: 8 - MOST_BITS] for half in (0, 1)]
        top = np.arange(len(at))  # who leads each fingerprint's group so far
        for four in combinations(range(2 * MOST_BITS), MOST_BITS):
            key = np.zeros(len(at), np.uint64)
            for k in four:
                key = key << np.uint64(4) | halves[k]
            order = np.argsort(key, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(key[order])) + 1), len(at)]
            last = np.repeat(cuts[1:], np.diff(cuts))
            long = np.repeat(np.diff(cuts) > 64, np.diff(cuts))
            found = []
            for d in range(1, 64):
                here = np.flatnonzero((np.arange(len(at)) + d < last) & ~long)
                if not len(here):
                    break
                here = here[top[order[here]] != top[order[here + d]]]
                near = here[linked(fps[at[order[here]]] ^ fps[at[order[here + d]]])]
                found += zip(order[near].tolist(), order[near + d].tolist(), strict=True)
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo > 64 and len(np.unique(top[order[lo:hi]])) > 1:
                    before = len(edges)
                    search(at[order[lo:hi]])
                    where = {int(at[k]): int(k) for k in order[lo:hi]}
                    found += [(where[a], where[b]) for a, b in edges[before:]]
                    del edges[before:]
            for a, b in found:
                while top[a] != a:
                    a = top[a]
                while top[b] != b:
                    b = top[b]
                if a != b:
                    top[max(a, b)] = min(a, b)
            while (top[top] != top).any():
                top = top[top]
            joining.extend((int(at[a]), int(at[b])) for a, b in found)

    joining: list[tuple[int, int]] = []

    def split(at: np.ndarray, used: tuple[int, ...]) -> None:
        """used: positions in which all of the list agree."""
        if len(at) <= limit:
            search(at)
            return
        if len(used) >= 8 - MOST_BITS:
            sieve(at, used)
            return
        free = [p for p in range(8) if p not in used]
        # Of the free positions so many agree at least, so one of the first len(free) - missing + 1 does.
        missing = 8 - MOST_BITS - len(used)
        for p in free[: len(free) - missing + 1]:
            order = at[np.argsort(octets[at, p], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(octets[order, p])) + 1):
                if len(part) > 1:
                    split(part, (*used, p))

    split(np.arange(len(fps)), tuple(p for p in range(8) if len(fps) and (octets[:, p] == octets[0, p]).all()))
    return spanning(edges + joining)


def spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As many of the pairs as connect what all of them connect."""
    parent: dict[int, int] = {}

    def root(a: int) -> int:
        while (b := parent.setdefault(a, a)) != a:
            parent[a] = parent.setdefault(b, b)
            a = b
        return a

    out = []
    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def edges_of(distinct: DataFrame, size: int, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): a spanning forest of the links of each posting list, over distinct fingerprints.

    Fingerprints of lists over `long_list` are dealt again by tuples of four positions, each into 70 lists, so that no task has to go
    through such a list alone; any link's ends agree in four positions, and so meet again there.
    """
    ship_package(distinct.sparkSession)
    if size >= 8 - MOST_BITS:
        return _listed(postings_of(distinct, size))
    lists = postings_of(distinct, size)
    counts = materialise(lists.groupBy("posting").agg(F.count("*").alias("n")).where(F.col("n") > long_list).select("posting"), "long")
    if counts.isEmpty():
        return _listed(lists)
    again = lists.join(counts, "posting", "left_semi").select("fp").distinct()
    return _listed(lists.join(counts, "posting", "left_anti")).unionByName(_listed(postings_of(again, 8 - MOST_BITS)))


def postings_of(distinct: DataFrame, size: int) -> DataFrame:
    """(fp, posting): a posting for each tuple of positions."""
    tuples = position_tuples(size)
    octet = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))

    def posting(k: int, t: tuple[int, ...]):
        code = F.lit(k).cast("long")
        for p in t:
            code = F.shiftleft(code, 8).bitwiseOR(octet(p))
        return code

    return distinct.select("fp", F.explode(F.array(*(posting(k, t) for k, t in enumerate(tuples)))).alias("posting"))


def _listed(lists: DataFrame) -> DataFrame:
    lists = lists.select("fp", "posting").repartition("posting").sortWithinPartitions("posting")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_p, held_f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            p = np.concatenate([held_p, batch.column("posting").to_numpy()])
            f = np.concatenate([held_f, batch.column("fp").to_numpy()])
            cut = int(np.searchsorted(p, p[-1], "left")) if len(p) else 0
            yield from whole(p[:cut], f[:cut])
            held_p, held_f = p[cut:], f[cut:]
        yield from whole(held_p, held_f)

    def whole(p: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Short lists all together, by their distance in the order; long ones one by one."""
        if len(p) < 2:
            return
        fu = f.view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1])
        lengths = np.diff(np.concatenate([starts, [len(p)]]))
        out_a, out_b = [], []
        small = np.repeat(lengths <= 64, lengths)
        last = np.repeat(starts + lengths, lengths)
        for d in range(1, int(min(64, lengths.max()))):
            at = np.flatnonzero(small & (np.arange(len(p)) + d < last))
            if not len(at):
                break
            x = fu[at] ^ fu[at + d]
            near = at[linked(x)]
            out_a.append(f[near])
            out_b.append(f[near + d])
        for s, n in zip(starts[lengths > 64], lengths[lengths > 64], strict=True):
            pairs = np.array(forest(fu[s : s + n]), np.int64).reshape(-1, 2) + s
            out_a.append(f[pairs[:, 0]])
            out_b.append(f[pairs[:, 1]])
        a, b = np.concatenate(out_a or [f[:0]]), np.concatenate(out_b or [f[:0]])
        if len(a):
            pairs = np.unique(np.stack([a, b], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return lists.mapInArrow(lean(run), "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's smallest node.

    Large-star then small-star until nothing changes.  Neighbours are folded by min() and written before they are joined back, so no
    node's neighbours are gathered in one place: both sides of the joins are plain exchanges, of which Spark can split a hub's part.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    # A few edges need neither files between the joins nor many tasks.
    few = now.count() <= FEW_EDGES
    gathered, written = (lambda df: df.coalesce(4), lambda df, _: df) if few else (lambda df: df, materialise)
    mark = None
    for _ in range(most_rounds):
        # Large-star: neighbours above u go to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        big = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small-star: u and its neighbours below go to the least of them.
        big = written(big, "big")
        low = written(big.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = big.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        before, now = now, materialise(gathered(small), "stars")
        for df in (before,) if few else (before, least, big, low):
            remove(now.sparkSession, df.scratch)
        # Sums of hashes tell whether the set of edges is the same as before.
        got = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (got["n"], got["s"]) == mark:
            break
        mark = (got["n"], got["s"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, fp, component_id) per row."""
    marked = materialise(fingerprint(docs, id_col, text_col, words), "fingerprints")
    distinct = materialise(marked.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    edges = edges_of(distinct, tuple_size(distinct.count()))
    roots = components(edges)
    labelled = materialise(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "labelled")
    # Both sides are written first: a join of two plain exchanges is one whose large keys Spark can split, so a huge component is no hot task.
    least = materialise(labelled.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = labelled.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(id_col, "fp", "component_id")


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number for each row, written with it, and that column's name; its upper bits are the part (input partition)."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def one_of_each(numbered_docs: DataFrame, row: str, grouped: DataFrame) -> DataFrame:
    """Of each group (row, root) the row with the smallest doc_id, nulls last, then by the text's hash and the row's number."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("hash"), F.col(row).alias("row"))
    ranked = numbered_docs.select(F.col(row).alias("row"), order.alias("order")).join(grouped, "row")
    stay = materialise(ranked.groupBy("root").agg(F.min("order")["row"].alias("_stay")).select("_stay"), "stay")
    # The rows that stay grow with the corpus, so they are never broadcast.
    kept = numbered_docs.join(stay.hint("merge"), numbered_docs[row] == stay["_stay"], "left_semi")
    return kept.select(*(numbered_docs[c] for c in numbered_docs.columns if c != row))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of each component of fingerprints, with its columns.  Rows are told apart by a number, so repeated and null ids are rows like any other."""
    keyed, row = numbered(docs)
    marked = link(keyed.select(F.col(row).alias("row"), "text"), "row", words=words)
    return one_of_each(keyed, row, marked.select("row", F.col("component_id").alias("root")))


def shingle_set(text: str, words: int) -> np.ndarray:
    """Different shingle hashes in order."""
    return np.unique(shingle_hashes(text, words))


def ceil_share(share: float, size: np.ndarray) -> np.ndarray:
    """The least whole number that is no less than that share."""
    return np.ceil(share * size - 1e-9).astype(np.int64)


def marked_sets(keyed: DataFrame, row: str, words: int, n_parts: int) -> DataFrame:
    """Kind 0: (row, key, size, fp, bits) of each row's shingle set; kind 1: (bucket, part, h, n), a part's distinct shingles and how many of its different sets hold them.

    Of a hash, the bucket is one part and the 32 bits in h another; n is left out where it is always one.
    """
    names = ["kind", "part", "bucket", "row", "key", "size", "fp", "bits", "h", "n"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]

    def batch_of(rows_: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows_, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, known = -1, [], set()

        def send():
            if not held:
                return
            all_, count = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            bucket, low = bucket_and_low(all_, n_parts)
            for some in (count == 1, count > 1):
                order = np.lexsort((low[some], bucket[some]))
                b, h, n = bucket[some][order], low[some][order], count[some][order].astype("<u4")
                cuts = [0, *(np.flatnonzero(np.diff(b)) + 1), len(b)] if len(b) else [0]
                ends = list(zip(cuts, cuts[1:], strict=False))
                if ends:
                    yield batch_of(len(ends), kind=[1] * len(ends), part=[part] * len(ends), bucket=b[cuts[:-1]].astype(np.int32), h=[packed(h[x:y], rising=True) for x, y in ends], n=[b"" if n[x] == 1 else packed(n[x:y]) for x, y in ends])

        for batch in slices(batches):
            rows = batch.column(0).to_numpy()
            keys, sizes, fps, bits = [], [], [], []
            for r, t in zip(rows.tolist(), texts_of(batch.column(1)), strict=True):
                x = shingle_set(t, words)
                keys.append(xxhash.xxh3_128_digest(x.tobytes()))
                sizes.append(len(x))
                fps.append(majority(x) if len(x) else np.uint64(0))
                bits.append(flipped(x))
                if r >> 33 != part or sum(map(len, held)) > PART_SHINGLES:
                    yield from send()
                    part, known = r >> 33, known if r >> 33 == part else set()
                if keys[-1] not in known and len(x):
                    known.add(keys[-1])
                    held.append(x)
            n = len(rows)
            yield batch_of(n, kind=[0] * n, part=rows >> 33, row=rows, key=keys, size=sizes, fp=np.array(fps, np.uint64).view(np.int64), bits=bits)
        yield from send()

    schema = "kind int, part long, bucket int, row long, key binary, size long, fp long, bits array<long>, h binary, n binary"
    return keyed.select(F.col(row).alias("row"), F.col("text").cast("string")).mapInArrow(lean(run), schema)


def flipped(x: np.ndarray) -> np.ndarray:
    """FLIPS bits as longs, each flipped by every shingle that falls on it.  Two sets differ in as many shingles at least as they do in bits."""
    odd = np.bincount((x & np.uint64(FLIPS - 1)).astype(np.int64), minlength=FLIPS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


#: Shingles of a part that a worker holds before it sends them on.
PART_SHINGLES = 1_500_000


def bucket_and_low(h: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash's bucket, by its upper 24 bits, and its lower 32 bits."""
    return ((h >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64), h.astype(np.uint32)


def shared_shingles(marked: DataFrame, n_parts: int) -> DataFrame:
    """(part, bucket, h, n): those of a part's shingles that two sets or more hold, packed, and how many do.

    Two shingles may share bucket and bits; both then count for more, which costs time and changes no result, as the counts only order shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for bucket, part, h, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = joined([h], "<u4", rising=True)
                held.setdefault(bucket, []).append((part, h, joined([n], "<u4") if n else np.ones(len(h), np.uint32)))
        while held:
            bucket, rows = held.popitem()
            own, at = np.unique(np.concatenate([h for _, h, _ in rows]), return_inverse=True)
            total = np.bincount(at, np.concatenate([n for _, _, n in rows]), len(own)).astype("<u4")[at]
            ends = np.cumsum([len(h) for _, h, _ in rows])
            for (part, h, _), end in zip(rows, ends, strict=True):
                n = total[end - len(h) : end]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([bucket], pa.int32()), pa.array([packed(h[n > 1], rising=True)], pa.binary()), pa.array([packed(n[n > 1])], pa.binary())], names=["part", "bucket", "h", "n"])

    return marked.where("kind = 1").select("bucket", "part", "h", "n").repartitionById(n_parts, F.col("bucket")).mapInArrow(lean(run), "part long, bucket int, h binary, n binary")


def rare_postings(keyed: DataFrame, row: str, sets: DataFrame, shared: DataFrame, words: int, similarity: float, n_parts: int) -> DataFrame:
    """(posting, row, size, pos, short): the shingles of each set, rarest first, among which it shares one with any similar set.

    With t the similarity: sets x and y, x no larger, that are similar share t (x + y) / (1 + t) shingles, so the first that they share, in
    any order that is the same for all, is among the first |y| - ceil(t |y|) + 1 of y and (short) the first
    |x| - ceil(2t |x| / (1 + t)) + 1 of x.  Shingles of one set only are not posted.
    """
    nulls = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    rows = shared.select("part", F.lit(0).alias("at"), *nulls(row="long", text="string"), "bucket", "h", "n")
    rows = rows.unionByName(sets.select(F.shiftright("row", 33).alias("part"), F.lit(1).alias("at"), "row", *nulls(text="string", bucket="int", h="binary", n="binary")))
    texts = keyed.select(F.shiftright(row, 33).alias("part"), F.lit(2).alias("at"), F.col(row).alias("row"), F.col("text").cast("string").alias("text"), *nulls(bucket="int", h="binary", n="binary"))
    rows = rows.unionByName(texts).repartitionById(n_parts, F.col("part").cast("int")).sortWithinPartitions("part", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got, firsts, table = -1, [], set(), None
        for batch in slices(batches, 3):
            p_all, at_all = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(p_all) != 0) | (np.diff(at_all) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(p_all)], strict=True):
                one = batch.slice(lo, hi - lo)
                if p_all[lo] != part:
                    part, got, firsts, table = int(p_all[lo]), [], set(), None
                if at_all[lo] == 0:
                    got += [(joined([h], "<u4", rising=True).astype(np.int64) + (b << 32), joined([n], "<u4")) for b, h, n in zip(*(one.column(k).to_pylist() for k in (4, 5, 6)), strict=True)]
                elif at_all[lo] == 1:
                    firsts.update(one.column(2).to_pylist())
                else:
                    if table is None:
                        code, many = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
                        code, at = np.unique(code, return_index=True)
                        table, got = (np.append(code, -1), np.append(many[at], 1).astype(np.int64)), []
                    pairs = [(r, t) for r, t in zip(one.column(2).to_pylist(), texts_of(one.column(3)), strict=True) if r in firsts]
                    if pairs:
                        yield posted([r for r, _ in pairs], [shingle_set(t, words) for _, t in pairs], *table)

    def posted(ids: list[int], own: list[np.ndarray], code: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        size = np.array([len(x) for x in own], np.int64)
        h, owner = np.concatenate(own), np.repeat(np.arange(len(own)), size)
        bucket, low = bucket_and_low(h, n_parts)
        k = np.searchsorted(code[:-1], want := (bucket << 32) + low)
        n = np.where(code[k] == want, many[k], 1)
        order = np.lexsort((h, n, owner))
        h, n = h[order], n[order]
        pos = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
        keep = (n > 1) & (pos < (size - ceil_share(similarity, size) + 1)[owner])
        short = pos < (size - ceil_share(2 * similarity / (1 + similarity), size) + 1)[owner]
        return pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64)), pa.array(np.array(ids, np.int64)[owner][keep]), pa.array(size[owner][keep]), pa.array(pos[keep]), pa.array(short[keep])], names=["posting", "row", "size", "pos", "short"])

    return rows.mapInArrow(lean(run), "posting long, row long, size long, pos long, short boolean")


def drop_similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group that links of Jaccard similarity >= `similarity` over shingle sets connect, with its columns.

    Rows of equal sets meet by their hash.  Other links come in three steps, each of which only looks for what the ones before have not
    connected; every candidate is compared by its whole sets before it is linked.
    1. The SimHash index: sets whose fingerprints differ in at most four bits.  It finds most near copies, but cannot promise all
       at this similarity.
    2. Lists of the rarest shingles of each set (rare_postings), which any two similar sets share: each set with the first of its lists.
    3. In lists that still hold several groups, sets outside the largest: while that leaves many pairs, first with one set of the largest
       group, another one in each list and turn; then with all sets of other groups.  Sizes, places in the order and a bitmap of each
       set, all of them exact bounds, rule out nearly all pairs that are not similar, inside the join.  As shingles go rarest first, a passage of many documents is in a document's list only where
       little else is in that document; the work of a list is its length times the sets that belong to none of its largest group.

    Texts without words are one group.  Rows are told apart by a number written with them; of a group stays the row with the smallest doc_id, nulls last, then
    by the text's hash and the row's number.  So repeated and null ids are rows like any other.
    """
    spark = docs.sparkSession
    ship_package(spark)
    keyed, row = numbered(docs)
    n_parts = int(keyed.agg(F.coalesce(F.max(F.shiftright(row, 33)) + 1, F.lit(1))).first()[0])
    marked = materialise(marked_sets(keyed, row, words, n_parts), "marked")
    info = materialise(marked.where("kind = 0").select("row", "key", "size", "fp", "bits"), "info")
    sets = materialise(info.groupBy("key").agg(F.min("row").alias("row"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.min("bits").alias("bits")), "sets")
    shared = materialise(shared_shingles(marked, n_parts), "shared")
    remove(spark, marked.scratch)
    release(spark)
    lists = materialise(rare_postings(keyed, row, sets, shared, words, similarity, n_parts), "lists")
    remove(spark, shared.scratch)
    release(spark)
    all_lists = lists
    some = materialise(lists.groupBy("posting").agg(F.count("*").alias("n"), F.max("short").alias("any")).where("n > 1 and any").select("posting"), "some")
    lists = materialise(lists.join(some, "posting"), "lists")
    remove(spark, all_lists.scratch)

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose shingle sets are similar."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, x = None, None
            for batch in slices(batches, 2):
                keep = []
                for a, s, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True):
                    if a != last:
                        last, x = a, shingle_set(s, words)
                    y = shingle_set(t, words)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

        pairs = materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
        ends = pairs.select(F.explode(F.array("a", "b")).alias("_r")).distinct()
        texts = keyed.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
        texts = materialise(texts.join(ends, F.col("row") == F.col("_r"), "left_semi"), "texts")
        of = lambda c, t: texts.select(F.col("row").alias(c), F.col("text").alias(t))
        out = materialise(pairs.join(of("b", "t"), "b").join(of("a", "s"), "a").select("a", "b", "s", "t").mapInArrow(lean(run), "a long, b long"), "verified")
        remove(spark, texts.scratch)
        release(spark)
        return out

    def near(x: str, y: str) -> Column:
        """Whether the sizes and places of two sets in a list let them be similar, this being the first shingle that they share."""
        c = lambda side, name: F.col(f"{side}.{name}")
        shorter = F.when(c(x, "size") < c(y, "size"), c(x, "short")).when(c(x, "size") > c(y, "size"), c(y, "short")).otherwise(c(x, "short") & c(y, "short"))
        sizes = F.least(c(x, "size"), c(y, "size")) >= F.greatest(c(x, "size"), c(y, "size")) * similarity - 1e-9
        most = F.least(c(x, "size") - c(x, "pos"), c(y, "size") - c(y, "pos"))
        return shorter & sizes & (most >= (c(x, "size") + c(y, "size")) * (similarity / (1 + similarity)) - 1e-9)

    def of_groups(links: DataFrame) -> DataFrame:
        """The lists with the group of each set."""
        roots = materialise(components(links), "roots")
        return materialise(lists.join(roots, lists["row"] == roots["node"], "left").select("posting", F.struct("row", "size", "pos", "short").alias("m"), F.coalesce("root", "row").alias("root")), "rooted")

    heads = materialise(sets.groupBy("fp").agg(F.min(F.struct("row", "size")).alias("h")).select("fp", "h.row", "h.size"), "heads")
    alike = edges_of(heads.select("fp"), tuple_size(heads.count()))
    side = lambda c, k: heads.select(F.col("fp").alias(k), F.col("row").alias(c), F.col("size").alias(f"size_{c}"))
    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9
    pairs = alike.toDF("fp_a", "fp_b").join(side("a", "fp_a"), "fp_a").join(side("b", "fp_b"), "fp_b").where(fits).select("a", "b")
    same = sets.select("fp", F.col("row").alias("b"), F.col("size").alias("size_b")).join(side("a", "fp"), "fp").where((F.col("a") != F.col("b")) & fits).select("a", "b")
    links = verified(pairs.unionByName(same))

    rooted = of_groups(links)
    first = F.min(F.struct(~F.col("m.short"), F.col("m.size"), F.col("m.row"), F.col("m"), F.col("root"))).alias("f")
    mixed = rooted.groupBy("posting").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), first).where("lo <> hi")
    mixed = materialise(mixed.select("posting", F.col("f.m").alias("h"), F.col("f.root").alias("head_root")), "mixed")
    stars = rooted.join(mixed, "posting").where((F.col("root") != F.col("head_root")) & near("h", "m"))
    links = links.unionByName(verified(stars.select(F.col("h.row").alias("a"), F.col("m.row").alias("b"))))

    for turn in range(TURNS + 1):
        rooted = of_groups(links)
        any_ = F.min(F.struct(F.xxhash64("posting", F.lit(turn), "m.row"), F.col("m")))["m"]
        counts = rooted.groupBy("posting", "root").agg(F.count("*").alias("n"), any_.alias("h"))
        most = F.max_by(F.struct("root", "h", "n"), F.struct("n", "root"))
        mixed = counts.groupBy("posting").agg(F.count("*").alias("k"), F.sum("n").alias("n"), most.alias("most")).where("k > 1")
        mixed = materialise(mixed.select("posting", F.col("n").alias("sets"), (F.col("n") - F.col("most.n")).alias("others"), F.col("most.root").alias("most"), F.col("most.h").alias("h")), "mixed")
        size = mixed.agg(F.coalesce(F.sum("sets"), F.lit(0)).alias("sets"), F.coalesce(F.sum(F.col("sets") * F.col("others")), F.lit(0)).alias("pairs")).first()
        if turn == TURNS or size["pairs"] <= PAIRS_A_SET * size["sets"]:
            break
        tried = rooted.join(mixed, "posting").where((F.col("root") != F.col("most")) & near("h", "m"))
        links = links.unionByName(verified(tried.select(F.col("h.row").alias("a"), F.col("m.row").alias("b"))))
    mixed = mixed.select("posting", "most")
    bits = sets.select(F.col("row").alias("_r"), "bits")
    open_ = rooted.join(mixed, "posting").join(bits, F.col("m.row") == F.col("_r")).drop("_r")
    open_ = materialise(open_, "open")
    few = materialise(open_.where("root <> most").select("posting", F.col("m").alias("h"), F.col("root").alias("head_root"), F.col("bits").alias("h_bits")), "few")
    # Sets of that similarity differ in (1 - t) / (1 + t) of their shingles together at most.
    apart = sum((F.bit_count(F.col("bits")[k].bitwiseXOR(F.col("h_bits")[k])) for k in range(1, FLIPS // 64)), F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("h_bits")[0])))
    close = apart <= (F.col("h.size") + F.col("m.size")) * ((1 - similarity) / (1 + similarity)) + 1e-9
    rest = open_.join(few, "posting").where((F.col("root") != F.col("head_root")) & near("h", "m") & close)
    links = links.unionByName(verified(rest.select(F.col("h.row").alias("a"), F.col("m.row").alias("b"))))

    roots = materialise(components(links), "roots")
    named = materialise(sets.join(roots, sets["row"] == roots["node"], "left").select("key", F.coalesce("root", sets["row"]).alias("root")), "named")
    return one_of_each(keyed, row, info.select("row", "key").join(named, "key").select("row", "root"))


def query(spark, sf_dir: str) -> DataFrame:
    out = link(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
