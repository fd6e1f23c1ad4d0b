"""Exact deduplication over an extendible-hash index kept in shared files.

1. *Pre-aggregation.*  A task keeps the first ``HELD_BYTES`` of its distinct texts and counts their rows as they come,
   so a text that a third of all rows share leaves a task as one representative row with a count.  Further texts leave
   each Arrow batch as one row.
2. *Directory.*  A histogram over the leading ``HISTOGRAM_BITS`` bits of the 64-bit keys (at most 65,536 counts,
   whatever the input) drives the directory: it starts with one bucket and doubles whenever an overfull bucket is
   already as deep as the directory; only the overfull bucket splits.
3. *Owners.*  A bucket is a range of keys and has one owner task, which reads its representatives in key order.
   Representatives of one key form a chain: each is compared byte by byte with the chain's texts, so two texts
   that collide in all 64 bits stay apart.  Memory holds the texts of a single key's chain and a number for each of
   their representatives.  The owner's output is the index, files sorted by bucket and key: one entry per
   representative with the surviving row, the size of its group and its place in the chain.
4. *Lookup.*  The directory gives every row's bucket, and the row finds its representative's entry there.  No number
   has more rows than one task.  ``Index.find`` looks up further documents in the same way and compares their bytes.

Results: null counts as the empty text.  Of equal texts the row with the smallest doc_id stays (a null doc_id
comes after all others); of rows that repeat both doc_id and text exactly one stays.  Other columns, whatever their
names, travel inside one struct and never clash.  An empty table gives an empty result.  Very long texts are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import SPACE_RUN, lean, materialize, partitions_for

HISTOGRAM_BITS = 16
BUCKET_ROWS = 2_000
HELD_BYTES = 32_000_000
OWNER_ROWS = 50_000
#: That of Spark's own xxhash64, so that keys are the same in expressions.
SEED = 42

_SPACES = b" \t\n\x0b\x0c\r"


def normalise(text: bytes | None) -> bytes:
    """Each run of white space becomes one space, at the ends too."""
    if not text:
        return b""
    out = b" ".join(text.split())
    if not out:
        return b" "
    head = b" " if text[0] in _SPACES else b""
    tail = b" " if text[-1] in _SPACES else b""
    return head + out + tail if head or tail else out


def _key(norm: bytes) -> int:
    """64-bit key, signed as Spark's long."""
    k = xxhash.xxh64_intdigest(norm, SEED)
    return k - (1 << 64) if k >> 63 else k


def _rank(doc_id, uid: int) -> tuple:
    return (doc_id is None, 0 if doc_id is None else doc_id, uid)


def _pre_aggregate(schema: pa.Schema, id_at: int, text_at: int, room: int = HELD_BYTES):
    kind = schema.field("row").type

    def out(members: list[tuple], groups: list[tuple], rows: pa.Array) -> pa.RecordBatch:
        """``members``: uid, pid, doc_id, sha, key; ``groups``: pid, key, n, uid of the best row, and ``rows`` the best rows."""
        m, none, nones = list(zip(*members, strict=True)) or [()] * 5, [None] * len(members), [None] * len(groups)
        g = list(zip(*groups, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*m[0], *nones], pa.int64()),
                pa.array([*m[1], *g[0]], pa.int64()),
                pa.array([*m[2], *nones], schema.field("member_id").type),
                pa.array([*m[3], *nones], pa.string()),
                pa.array([*m[4], *g[1]], pa.int64()),
                pa.array([*none, *g[2]], pa.int64()),
                pa.array([*none, *g[3]], pa.int64()),
                pa.concat_arrays([pa.nulls(len(members), kind), rows.cast(kind)]),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = (TaskContext.get().partitionId() << 36) if TaskContext.get() else 0
        held: dict[bytes, list] = {}  # normalised text: [number, best rank, its row, count, sha, key]
        free = room
        for batch in batches:
            rows = batch.column(0)
            ids = rows.field(id_at).to_pylist()
            texts = rows.field(text_at).cast(pa.binary())
            groups: dict[bytes, list] = {}  # the same of this batch; the row by its place
            members = []
            for i, doc_id in enumerate(ids):
                norm = normalise(texts[i].as_py())
                rank = _rank(doc_id, uid + i)
                g = held.get(norm)
                if g is None:
                    g = groups.get(norm)
                    if g is None:
                        g = [uid + i, rank, i, 0, hashlib.sha256(norm).hexdigest(), _key(norm)]
                        if len(norm) <= free:
                            free -= len(norm)
                            held[norm] = g
                            g[2] = rows.slice(i, 1)
                        else:
                            groups[norm] = g
                    elif rank < g[1]:
                        g[1], g[2] = rank, i
                elif rank < g[1]:
                    g[1], g[2] = rank, rows.take(pa.array([i]))  # a copy: later batches aren't kept alive
                g[3] += 1
                members.append((uid + i, g[0], doc_id, g[4], g[5]))
            best = list(groups.values())
            yield out(members, [(g[0], g[5], g[3], g[1][2]) for g in best], rows.take(pa.array([g[2] for g in best], pa.int64())))
            uid += len(ids)
        last = list(held.values())
        for at in range(0, len(last), 1000):
            some = last[at : at + 1000]
            yield out([], [(g[0], g[5], g[3], g[1][2]) for g in some], pa.concat_arrays([g[2] for g in some]))

    return run


def directory(histogram: dict[int, int], capacity: int, bits: int = HISTOGRAM_BITS) -> list[int]:
    """Bucket number of each of the ``2 ** bits`` key prefixes, in key order.

    Starts with one bucket of depth 0.  An overfull bucket splits in two; where its depth equals the directory's, the
    directory doubles first.  Buckets of full depth keep what they have and chain.
    """
    slots, depth = [0], 0
    local, todo, at = {0: 0}, [0], {0: (0, 1 << bits)}
    prefix = [0]
    for p in range(1 << bits):
        prefix.append(prefix[-1] + histogram.get(p, 0))
    while todo:
        b = todo.pop()
        lo, hi = at[b]
        if prefix[hi] - prefix[lo] <= capacity or local[b] >= bits:
            continue
        if local[b] == depth:  # double: every slot is repeated
            slots = [s for s in slots for _ in (0, 1)]
            depth += 1
        new, mid = len(local), (lo + hi) // 2
        local[b] += 1
        local[new] = local[b]
        at[b], at[new] = (lo, mid), (mid, hi)
        width = 1 << (bits - depth)
        for s in range(mid // width, hi // width):
            slots[s] = new
        todo += [b, new]
    order = {b: i for i, b in enumerate(sorted(at, key=lambda b: at[b]))}
    repeat = 1 << (bits - depth)
    return [order[s] for s in slots for _ in range(repeat)]


def _own(schema: pa.Schema, id_at: int, text_at: int):
    """Owner of key ranges: rows come in key order; equal keys chain and are compared byte by byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, key, chain = None, None, []  # chain: [text, numbers, total, best rank, its row]

        def entries() -> Iterator[tuple]:
            for place, (_, pids, total, rank, row) in enumerate(chain):
                keep_id, keep_uid = (None if rank[0] else rank[1]), rank[2]
                for k, pid in enumerate(pids):
                    yield bucket, pid, key, place, keep_id, keep_uid, total, None if k else row

        def to_batch(entries: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*entries, strict=True))
            kind = schema.field("row").type
            rows, empty = [], pa.nulls(1, kind)
            for r in cols[7]:
                rows.append(empty if r is None else r)
            arrays = [pa.array(c, f.type) for c, f in zip(cols[:7], schema, strict=False)]
            return pa.RecordBatch.from_arrays([*arrays, pa.concat_arrays(rows)], schema=schema)

        pending: list[tuple] = []
        held = 0
        for batch in batches:
            bucket_, pid_, key_, n_, uid_ = (batch.column(c).to_pylist() for c in ("bucket", "pid", "key", "n", "keep_uid"))
            rows = batch.column("row")
            ids = rows.field(id_at).to_pylist()
            texts = rows.field(text_at).cast(pa.binary())
            for i, k in enumerate(key_):
                if k != key:
                    for entry in entries():
                        pending.append(entry)
                        if len(pending) >= 1000:
                            yield to_batch(pending)
                            pending, held = [], 0
                    if held > 16_000_000:
                        yield to_batch(pending)
                        pending, held = [], 0
                    bucket, key, chain = bucket_[i], k, []
                norm, rank = normalise(texts[i].as_py()), _rank(ids[i], uid_[i])
                for link in chain:
                    if link[0] == norm:
                        link[1].append(pid_[i])
                        link[2] += n_[i]
                        if rank < link[3]:
                            link[3], link[4] = rank, rows.take(pa.array([i]))
                        break
                else:
                    chain.append([norm, [pid_[i]], n_[i], rank, rows.take(pa.array([i]))])
                    held += len(norm)
        pending += entries()
        for at in range(0, len(pending), 1000):
            yield to_batch(pending[at : at + 1000])

    return run


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


@dataclass
class Index:
    """The index: ``entries`` (bucket, pid, key, place in the key's chain, keep_id, keep_uid, total, row) and the directory.

    ``row`` is the surviving row, once per text, null in a text's further entries.
    """

    entries: DataFrame
    buckets: list[int]
    text_col: str

    def bucket(self, df: DataFrame) -> DataFrame:
        """``df`` with the bucket of its ``key``."""
        prefix = F.shiftrightunsigned(F.col("key"), 64 - HISTOGRAM_BITS)
        if self.buckets[-1] == 0:
            return df.withColumn("bucket", F.lit(0))
        # The directory has 65,536 rows of 12 bytes, whatever the input: a proven bound for the broadcast.
        places = df.sparkSession.createDataFrame(list(enumerate(self.buckets)), "prefix long, bucket int")
        return df.withColumn("prefix", prefix).join(F.broadcast(places), "prefix").drop("prefix")

    def find(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size of every row of further ``docs``; nulls where no text of the index is equal."""
        members, reps = _entries(docs.select(id_col, text_col), id_col, text_col)
        norm = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), SPACE_RUN, " ")
        texts = self.entries.where("row is not null").select("bucket", "key", "keep_id", "total", norm(F.col("row")[self.text_col]).alias("known"))
        met = self.bucket(reps.select("pid", "key", norm(F.col("row")[text_col]).alias("norm"))).join(texts, ["bucket", "key"]).where("norm = known")
        return members.join(met.select("pid", "keep_id", "total"), "pid", "left").select(F.col("member_id").alias("doc_id"), "keep_id", F.col("total").alias("group_size"))


def _entries(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(members, representatives): uid, pid, member_id, sha, key of each row; pid, key, n, keep_uid, row of each text of a task."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    first = T.StructType(
        [T.StructField("uid", T.LongType()), T.StructField("pid", T.LongType()), T.StructField("member_id", docs.schema[id_col].dataType), T.StructField("sha", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("key", "n", "keep_uid")]
        + [T.StructField("row", rows.schema["row"].dataType)]
    )
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in first])
    entries = materialize(rows.mapInArrow(lean(_pre_aggregate(arrow, id_at, text_at)), first), "dedup-entries")
    return entries.where("uid is not null").select("uid", "pid", "member_id", "sha", "key"), entries.where("uid is null").select("pid", "key", "n", "keep_uid", "row")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, Index]:
    """(members, index), both in tables of the shared folder; members: uid, pid, member_id, sha, key of each input row."""
    members, reps = _entries(docs, id_col, text_col)
    prefix = F.shiftrightunsigned(F.col("key"), 64 - HISTOGRAM_BITS)
    counted = {r["prefix"]: r["count"] for r in reps.select(prefix.alias("prefix")).groupBy("prefix").count().collect()}  # 65,536 rows at most
    index = Index(reps, directory(counted, bucket_rows), text_col)
    owners = partitions_for(docs.sparkSession, sum(counted.values()), OWNER_ROWS)
    second = T.StructType(
        [T.StructField("bucket", T.IntegerType()), T.StructField("pid", T.LongType()), T.StructField("key", T.LongType()), T.StructField("place", T.LongType())]
        + [T.StructField("keep_id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in ("keep_uid", "total")]
        + [T.StructField("row", reps.schema["row"].dataType)]
    )
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in second])
    owned = index.bucket(reps).repartition(owners, "bucket").sortWithinPartitions("bucket", "key").select("bucket", "pid", "key", "n", "keep_uid", "row")
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    index.entries = materialize(owned.mapInArrow(lean(_own(arrow, id_at, text_at)), second), "dedup-index")
    return members, index


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    members, index = build_index(docs.select(id_col, text_col), id_col, text_col, bucket_rows)
    found = index.bucket(members).join(index.entries.select("bucket", "pid", "keep_id", "keep_uid", "total"), ["bucket", "pid"])
    return found.select(
        F.col("member_id").alias("doc_id"),
        "keep_id",
        F.col("total").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The surviving rows with all their columns, straight from the index."""
    _, index = build_index(docs, id_col, text_col, bucket_rows)
    return index.entries.where("row is not null").select("row.*")
