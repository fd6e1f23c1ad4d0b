"""Operator 6 at a Jaccard similarity: the byte-position index and its count filter over a longer, min-wise signature.

Texts whose sets of five-word shingles are 0.8 alike differ in about ten bits of a 64-bit SimHash, give or take three
(an angle of arccos(8/9)), and any ten bits can touch all eight bytes: no number of matching bytes is guaranteed, so no
inverted index over them finds such pairs.  This mode therefore takes ``BYTES`` positional bytes, each a byte of the
least of the shingles' hashes under its own permutation; a byte agrees with the probability of the sets' similarity.
The search stays the operator's:

1. *Index.*  Lists are kept for ``BYTES / LISTED`` disjoint sets of ``LISTED`` byte positions, 32 bits each, so a list
   of texts that aren't alike holds a 2^32nd of all.  A pair at 0.8 meets in no list with probability
   (1 - 0.8^4)^16 = 0.0002.
2. *Count filter.*  A candidate pair's shared positional bytes are tallied; fewer than ``MATCHES`` drop it (a pair at
   0.8 has fewer with probability 0.0001; one at 0.5 has as many with 0.09).
3. *Verification* by the whole shingle sets.

Candidates don't grow with the square of a group.  Each node first meets two nodes of each of its lists, picked by a
hash; that joins most of a large group.  After ``ROUNDS`` such rounds the lists that still hold several components are
compared whole, in blocks of ``BLOCK_ROWS``: nodes of different components are tallied over more positional bytes, each
pair in the first of its common lists only, and kept if they reach the counts of ``LONG`` (all but 0.00002 of the pairs
at 0.8 do, few below 0.75).  The best pair of each node and component is verified first, then whatever pairs still lie
in different components.  So what is verified grows with the pairs near the threshold that don't join, not with the
square of a group; no candidate pair that could join two components is left out, and no list is capped.  Texts of equal
shingle sets are one node.

Results: null counts as the empty text; a text of fewer than five words is one shingle, and texts without words link
with one another.  Rows alike in id and text, ties and empty tables need no care of the caller's; only the id and the
text column are read here, and ``near_deduplicated`` passes all others on, whatever their names.  A text of any length
is read whole; its set, eight bytes a shingle, must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.shared import HOT, lean, materialize, on_key, partitions_of

SHINGLE = 5
SIMILAR = 0.8
BYTES, LISTED = 64, 4
MATCHES = 38
#: Positional bytes and least matches of the long count, a cheap one first.
LONG = ((256, 176), (1024, 764))
ROUNDS = 1
BLOCK_ROWS = 4096
SEED = 42

_random = np.random.default_rng(SEED)
_TIMES = _random.integers(0, 1 << 63, LONG[-1][0], np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _random.integers(0, 1 << 63, LONG[-1][0], np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    words = (text or b"").lower().split()
    n = len(words)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = n - SHINGLE + 1
    cut = map(joined.__getitem__, map(slice, starts[:total].tolist(), ends[SHINGLE - 1 :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, total))


def signature(hashes: np.ndarray, size: int = BYTES) -> bytes:
    """A byte for each position: the last of the least hash, scrambled, under the position's permutation."""
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, ((hashes[None, at : at + 2048] ^ _FLIP[:size, None]) * _TIMES[:size, None]).min(axis=1))
    mixed = (least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(56)).astype(np.uint8).tobytes()


def list_keys(sig: bytes) -> list[int]:
    """The lists of a signature: the number of the set of positions above its bytes."""
    return [(k << 32) + int(v) for k, v in enumerate(np.frombuffer(sig, "<u4"))]


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_node(h) for h in sets], pa.int64()), pa.array([signature(h) for h in sets], pa.binary())], ["doc_id", "node", "sig"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [list_keys(s) for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.list_(pa.int64()))], ["node", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(1).cast(pa.binary())]
        own = pa.array([_node(h) == n for h, n in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())  # rows may share a doc_id
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "hashes"]).filter(own)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with ``MATCHES`` shared positional bytes or more."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BYTES) for c in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= MATCHES))


def _lengthened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = [signature(np.frombuffer(h, np.uint64), LONG[-1][0]) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sigs, pa.binary())], ["node", "long"])


def _across(best: bool):
    """Rows come by list, or by pair of a list's blocks: pairs of different components that pass the long counts.

    With ``best`` a node leaves one pair for each other component in the block, that of the most matches.
    """

    def pairs(key: int, ca: int, cb: int, rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        chunk, node, root = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[:3])
        sig = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
        left, right = np.flatnonzero(chunk == ca), np.flatnonzero(chunk == cb)
        for n, i in enumerate(left):
            other = right[n + 1 :] if ca == cb else right
            other = other[root[other] != root[i]]
            for size, least in LONG:
                if not len(other):
                    break
                same = sig[other, :size] == sig[i, :size]
                tally = same.sum(axis=1)
                first = same[:, :BYTES].reshape(-1, BYTES // LISTED, LISTED).all(axis=2).argmax(axis=1)
                kept = (first == key >> 32) & (tally >= least)
                other, tally = other[kept], tally[kept]
            if best and len(other):
                other = other[np.lexsort((node[other], -tally, root[other]))]
                other = other[np.flatnonzero(np.concatenate([[True], root[other[1:]] != root[other[:-1]]]))]
            if len(other):
                yield np.full(len(other), node[i]), node[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0

        def out() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        at, rows = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("key", "ca", "cb", "chunk", "node", "root", "long")]
            for key, ca, cb, *row in zip(*cols, strict=True):
                if (key, ca, cb) != at:
                    for some in pairs(*at, rows) if at else ():
                        found.append(some)
                        n += len(some[0])
                        if n >= 10_000:
                            yield out()
                            found, n = [], 0
                    at, rows = (key, ca, cb), []
                rows.append(row)
        found += pairs(*at, rows) if at else ()
        if found:
            yield out()

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            short, long = sorted((len(x) // 8, len(y) // 8))
            if short < SIMILAR * long:
                good.append(False)
                continue
            both = np.sort(np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)]))
            common = int((both[1:] == both[:-1]).sum())
            good.append(common >= SIMILAR * (short + long - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, component_id (the least doc_id of its component) of every row."""
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    signed = materialize(picked.mapInArrow(lean(_signed), f"doc_id {kind}, node long, sig binary"), "near-signatures")
    total = signed.count()

    def table(df: DataFrame, name: str, rows: int, each: int = 200_000) -> DataFrame:
        """``df``, of at most so many rows, as a table: small ones in few tasks and files, large ones in all of theirs."""
        return materialize(df.coalesce(1 + rows // each), name)

    nodes = table(signed.groupBy("node").agg(F.min("sig").alias("sig"), F.min("doc_id").alias("doc_id")), "near-nodes", total, 20_000)
    lists = table(nodes.select("node", "sig").mapInArrow(lean(_listed), "node long, keys array<long>").select("node", F.explode("keys").alias("key")), "near-postings", total, 20_000)
    count = lists.count()
    sizes = table(lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-sizes", count)  # lists of one node are gone
    hot = table(sizes.where(F.col("n") * HOT > count).select("key"), "near-hot", HOT)
    lists = table(on_key(lists, sizes.select("key"), hot, ["key"]), "near-lists", count)
    count = lists.count()

    # One text of each listed node, for its set.
    rows = lists.select("node").distinct().join(nodes, "node").select("node", "sig", "doc_id")
    found = picked.join(rows, picked["doc_id"].eqNullSafe(rows["doc_id"])).select("node", "text")
    sets = table(found.mapInArrow(lean(_sets), "node long, hashes binary").dropDuplicates(["node"]), "near-sets", count, 10_000)
    sigs = nodes.select("node", "sig")

    def verify(pairs: DataFrame, counted: bool = False) -> DataFrame:
        """Links among the pairs; ``counted`` ones have passed a tally."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if not counted:
            both = pairs.join(sigs.toDF("a", "x"), "a").join(sigs.toDF("b", "y"), "b").select("a", "b", "x", "y")
            pairs = table(both.mapInArrow(lean(_counted), "a long, b long"), "near-counted", 2 * count, 20_000)
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return table(both.mapInArrow(lean(_verified), "a long, b long"), "near-links", 2 * count, 10_000)

    def join_up(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Components, and the rows of the lists that hold several."""
        roots = components(links)
        now = lists.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
        return roots, on_key(now, mixed, hot, ["key"])

    links, placed = None, lists.withColumn("root", F.col("node"))
    for k in range(rounds):
        placed = table(placed, "near-placed", count) if k else placed
        spun = F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "root")
        ends = placed.groupBy("key").agg(F.min(spun).alias("low"), F.max(spun).alias("high"))
        met = on_key(placed, ends, hot, ["key"]).select("node", "root", F.explode(F.array("low", "high")).alias("end")).where("root <> end.root")
        new = verify(met.select(F.col("node").alias("a"), F.col("end.node").alias("b")))
        links = new if links is None else links.union(new)
        roots, placed = join_up(links)
    longs = None
    for best in (True, False):
        placed = table(placed, "near-placed", count)
        if longs is None:
            new = placed.select("node").distinct().join(sets, "node").select("node", "hashes").mapInArrow(lean(_lengthened), "node long, long binary")
            longs = table(new, "near-long", count, 10_000)
        parts = placed.groupBy("key").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
        among = on_key(placed, parts, hot, ["key"]).join(longs, "node")
        among = among.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        met = among.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("chunk", "o").alias("ca"), F.greatest("chunk", "o").alias("cb"), "chunk", "node", "root", "long")
        met = met.repartition(partitions_of(docs.sparkSession), "key", "ca", "cb").sortWithinPartitions("key", "ca", "cb")
        rest = table(met.mapInArrow(lean(_across(best)), "a long, b long"), "near-rest", count, 10_000)
        links = links.union(verify(rest, counted=True))
        roots, placed = join_up(links)
    named = signed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    named = table(named, "near-roots", total)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "component_id")


def near_deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns unchanged, of one document of each component: that of the smallest doc_id.

    Rows of the staying doc_id all stay, and so do rows without a doc_id, which can't be told apart.
    """
    gone = near_groups(docs, id_col, text_col).where("doc_id <> component_id").select("doc_id").distinct()
    rows = docs.select(docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(gone, rows["id"] == gone["doc_id"], "left_anti").select("row.*")
