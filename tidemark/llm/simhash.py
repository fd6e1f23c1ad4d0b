"""SimHash near-duplicates through an inverted index over byte positions, with count filtering.

A fingerprint's eight bytes are its positional terms.  Fingerprints that differ in four bits or fewer share at least
four of the eight, so a pair must reach four matches before it is verified.  A list for a single positional byte would
hold one 256th of all fingerprints and its pairs grow with the square of the input; the index therefore lists the 70
*sets* of four positions, 32 bits each.  Any pair with four matches meets in a list, no list is capped, nothing is
lost, and lists stay short up to billions of fingerprints: the index is the same at every size.

The members of a list are compared in blocks: matches are tallied by the zero bytes of the exclusive or, pairs with
fewer than four are dropped, the rest verified by their differing bits.  A list leaves only a spanning forest of its
links, never all pairs.  Lists above ``LIST_ROWS`` are cut into chunks and each pair of chunks is a list of its own,
so every pair is still compared and no task holds more than two chunks.  Links run between distinct fingerprints;
documents join their fingerprint's component at the end.

A stage that asks for a similarity of word sets instead of bits takes ``near_deduplicated``, whose signature is longer
(see ``near_dedup``).

Results: null counts as the empty text; texts without words have fingerprint 0 and link like any other.  Component ids
are the smallest doc_id (nulls are passed over).  Repeated rows have a row each; equal texts have one fingerprint, so
ties need no rule.  An empty table gives an empty result.  Only the id and text column are read, so others can't
clash.  Very long texts are read whole, their bits tallied some thousand shingles at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.near_dedup import near_deduplicated
from tidemark.llm.shared import materialize, partitions_for

SHINGLE = 4
SEED = 42
MAX_BITS = 4
MATCHES = 8 - MAX_BITS
LIST_ROWS = 4096
#: Prints of a partition at most, each of 70 postings.
PRINTS = 50_000
#: Every four of the eight byte positions.
SETS = list(combinations(range(8), MATCHES))


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros(64, np.int64)
    total = n - width + 1
    for at in range(0, total, 32_768):
        upto = min(total, at + 32_768)
        cut = map(joined.__getitem__, map(slice, starts[at:upto].tolist(), ends[at + width - 1 : upto + width - 1].tolist()))
        h = np.fromiter(map(xxhash.xxh64_intdigest, cut, repeat(SEED)), np.uint64, upto - at)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1).cast(pa.binary())], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], ["doc_id", "fp"])


def _key(fp: Column, positions: tuple[int, ...]) -> Column:
    mask = sum(0xFF << (8 * p) for p in positions)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def _forest(prints: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, as stars, of the links between the members ``left`` and ``right`` of a list."""
    rows, cols = np.flatnonzero(left), np.flatnonzero(right)
    hit = np.zeros((len(rows), len(cols)), bool)
    for at in range(0, len(rows), 256):
        x = prints[rows[at : at + 256], None] ^ prints[None, cols]
        tally = (x.view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
        enough = tally >= MATCHES
        hit[at : at + 256][enough] = np.bitwise_count(x[enough]) <= MAX_BITS
    label = np.arange(len(prints))
    while True:  # the least label among the linked, and its label
        old = label.copy()
        far = np.where(hit, label[cols][None, :], len(prints)).min(axis=1, initial=len(prints))
        label[rows] = np.minimum(label[rows], far)
        far = np.where(hit, label[rows][:, None], len(prints)).min(axis=0, initial=len(prints))
        label[cols] = np.minimum(label[cols], far)
        label = label[label]
        if (label == old).all():
            break
    return [(int(prints[i]), int(prints[k])) for i, k in enumerate(label) if i != k]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by list, in order; a list is one chunk, or a pair of chunks."""

    def close(prints: list[int], chunks: list[int], pair: tuple) -> list[tuple[int, int]]:
        if len(prints) < 2:
            return []
        if len(prints) == 2:
            x = prints[0] ^ prints[1]
            tally = sum(not (x >> s) & 0xFF for s in range(0, 64, 8))
            return [(prints[0], prints[1])] if tally >= MATCHES and x.bit_count() <= MAX_BITS else []
        c = np.array(chunks)
        return _forest(np.array(prints, np.uint64), c == pair[0], c == pair[1])

    key, prints, chunks, links = None, [], [], []

    def out() -> pa.RecordBatch:
        a, b = (np.array(x, np.uint64).view(np.int64) for x in zip(*links, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("s", "k", "ca", "cb", "chunk")]
        fps = batch.column("fp").to_numpy().view(np.uint64).tolist()
        for s, k, ca, cb, chunk, fp in zip(*cols, fps, strict=True):
            if (s, k, ca, cb) != key:
                links += close(prints, chunks, key[2:]) if key else []
                key, prints, chunks = (s, k, ca, cb), [], []
                if len(links) >= 10_000:
                    yield out()
                    links = []
            prints.append(fp)
            chunks.append(chunk)
    links += close(prints, chunks, key[2:]) if key else []
    if links:
        yield out()


def links(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """a, b: links between distinct fingerprints ``prints`` (fp), enough to connect all that are connected."""
    terms = F.array(*[F.struct(F.lit(i).alias("s"), _key(F.col("fp"), p).alias("k")) for i, p in enumerate(SETS)])
    # Prints are few bytes and lists many: the prints are dealt out before they are listed.
    parts = partitions_for(prints.sparkSession, prints.count(), PRINTS)
    dealt = prints.select("fp").repartition(parts, "fp")
    postings = dealt.select("fp", F.explode(terms).alias("e")).select("e.s", "e.k", "fp")
    counts = postings.groupBy("s", "k").agg(F.count("*").alias("n")).where("n > 1")
    # Spark takes the 70 postings of a print for one row, so it would send all of them through the driver as a small table.
    posted = postings.join(counts.hint("merge"), ["s", "k"])
    posted = posted.withColumn("parts", F.ceil(F.col("n") / list_rows).cast("int")).withColumn("chunk", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("fp"), F.col("parts"))).otherwise(0).cast("int"))
    single = posted.where("parts = 1").select("s", "k", F.lit(0).alias("ca"), F.lit(0).alias("cb"), "chunk", "fp")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    grid = posted.where("parts > 1").withColumn("o", each).select("s", "k", F.least("chunk", "o").alias("ca"), F.greatest("chunk", "o").alias("cb"), "chunk", "fp")
    lists = single.unionByName(grid).repartition(parts, "s", "k", "ca", "cb").sortWithinPartitions("s", "k", "ca", "cb", "fp")
    return lists.mapInArrow(_links, "a long, b long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return picked.mapInArrow(_fingerprints, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, fp long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), list_rows))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", hexed, "component_id")


__all__ = ["fingerprint", "fingerprints", "links", "near_deduplicated", "near_duplicates"]
