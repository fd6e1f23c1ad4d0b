"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted and each has a cost, ``c + OVERHEAD + c * c / QUADRATIC``: a fixed part per
sequence and attention's part.  The pieces of a packing group, longest first, go to the open bin that they fit
tightest.  A piece that fits none opens the bin size of least cost per token it can expect to hold: the piece and as
much of the shorter pieces still to come as fits.  At the end every bin is reduced to the smallest permitted length
that holds its contents.  A document longer than the largest length is cut; its full pieces fill bins of their own.

A packing group is one task's share of the rows, dealt out evenly, of about ``GROUP_ROWS`` rows or ``GROUP_BYTES``
bytes of text, so memory and time of a task are bounded and the number of groups grows with the input.  Tightness needs
no more: a group fills thousands of bins.

Items are token ids: texts are encoded whole by ``token_store``'s encoder, an end id follows each, and a task writes
its bins' ids, so a sequence is ready for training and no join brings ids and places together.

Results: one row for each sequence, with the documents, pieces, starts (in the document's ids) and lengths in their
order.  A null or empty text is the end alone.  Repeated rows and equal texts are packed one by one.  An empty table
gives an empty result.  Only the named columns are read, so others can't clash.  A very long text is cut at whole
multiples of the largest length and loses nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import lean, materialize
from tidemark.llm.token_store import END_ID, encoder

LENGTHS = (1024, 2048, 4096, 8192)
OVERHEAD = 64
QUADRATIC = 32_768
GROUP_ROWS = 20_000
GROUP_BYTES = 64_000_000


def cost(length: int) -> float:
    return length + OVERHEAD + length * length / QUADRATIC


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, place in the bin) of each piece and the final length of each bin; no piece is above the largest length."""
    lengths = tuple(sorted(lengths))
    order = np.argsort(-sizes, kind="stable")
    ascending = np.sort(sizes)
    upto = np.concatenate([[0], np.cumsum(ascending)])  # tokens in the k shortest pieces
    remaining = len(sizes)
    bins, places = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    capacity: list[int] = []
    used: list[int] = []
    rooms: list[int] = []  # the distinct free rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    for i in order.tolist():
        s = int(sizes[i])
        remaining -= 1
        k = bisect_left(rooms, s)
        if k < len(rooms):
            room = rooms[k]
            open_ = by_room[room]
            b = open_.pop()
            if not open_:
                del by_room[room], rooms[k]
        else:
            best, room = None, 0
            for c in lengths:
                if c >= s:
                    # Shorter or equal pieces still to come that fit beside this one.
                    fit = min(int(np.searchsorted(ascending, c - s, side="right")), remaining)
                    per_token = cost(c) / (s + min(c - s, int(upto[fit])))
                    if best is None or per_token < best:
                        best, room = per_token, c
            b = len(capacity)
            capacity.append(room)
            used.append(0)
        bins[i], places[i] = b, used[b]
        used[b] += s
        left = room - s
        if left:
            if left not in by_room:
                insort(rooms, left)
                by_room[left] = []
            by_room[left].append(b)
    final = np.array(lengths)[np.searchsorted(lengths, used)] if used else np.zeros(0, np.int64)
    return bins, places, final


def place(sizes: np.ndarray, lengths: tuple[int, ...] = LENGTHS) -> dict[str, np.ndarray]:
    """Pieces of items of any size, in bin order: item, piece, start, length, bin, place and capacity."""
    top = max(lengths)
    full, rest = sizes // top, sizes % top
    # Full pieces have bins of their own; so a very long document costs no packing.
    items = np.repeat(np.arange(len(sizes)), full)
    piece = np.arange(len(items)) - np.repeat(np.cumsum(full) - full, full)
    part = np.flatnonzero(rest)
    bins, places, final = best_fit(rest[part], lengths)
    n, numbers = len(items), np.concatenate([piece, full[part]])
    out = {
        "item": np.concatenate([items, part]),
        "piece": numbers,
        "start": numbers * top,
        "length": np.concatenate([np.full(n, top), rest[part]]),
        "bin": np.concatenate([np.arange(n) + len(final), bins]),
        "place": np.concatenate([np.zeros(n, np.int64), places]),
        "capacity": np.concatenate([np.full(n, top), final[bins] if len(final) else np.zeros(0, np.int64)]),
    }
    order = np.lexsort((out["place"], out["bin"]))
    return {k: v[order].astype(np.int64) for k, v in out.items()}


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids, held, first = [], 0, 0
            for i, raw in enumerate(encode.ids(batch.column(1))):
                ids.append(np.append(np.frombuffer(raw, "<u4"), end_id).astype("<u2").tobytes())
                held += len(ids[-1])
                if held > 16_000_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first : i + 1], pa.array(ids, pa.binary())], ["doc_id", "ids"])
                    ids, held, first = [], 0, i + 1

    return run


def _sequences(lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        texts = [np.frombuffer(x, "<u2") for x in table.column("ids").to_pylist()]
        at = place(np.fromiter(map(len, texts), np.int64, len(texts)), lengths)
        edges = np.flatnonzero(np.diff(at["bin"], prepend=-1, append=-1))
        doc_ids = table.column("doc_id").take(pa.array(at["item"])).combine_chunks()
        doc_ids = doc_ids.chunk(0) if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
        for low in range(0, len(edges) - 1, 256):  # some hundred sequences a batch
            cut = edges[low : low + 257]
            a, b = int(cut[0]), int(cut[-1])
            offsets = pa.array((cut - a).astype(np.int32))
            ids = [texts[i][s : s + n] for i, s, n in zip(at["item"][a:b].tolist(), at["start"][a:b].tolist(), at["length"][a:b].tolist(), strict=True)]
            used = np.add.reduceat(at["length"][a:b], cut[:-1] - a)
            whole = np.concatenate(ids).astype("<u4")
            tokens = [whole[b - n : b].tobytes() for b, n in zip(np.cumsum(used).tolist(), used.tolist(), strict=True)]
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (doc_ids.slice(a, b - a), *(pa.array(at[c][a:b].astype(np.int32)) for c in ("piece", "start", "length")))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(group + at["bin"][cut[:-1]]), pa.array(at["capacity"][cut[:-1]].astype(np.int32)), pa.array(used.astype(np.int32)),
                    *lists, pa.array(tokens, pa.binary()),
                ],
                ["bin_id", "capacity", "n_tokens", "doc_ids", "pieces", "starts", "lengths", "ids"],
            )

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = LENGTHS, end_id: int = END_ID, group_rows: int = GROUP_ROWS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Training sequences: bin_id, capacity, n_tokens, doc_ids, pieces, starts, lengths, ids (little-endian unsigned 32-bit)."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(docs[text_col])), F.lit(0))).first()
    groups = max(1, -(-n // group_rows), -(-size // group_bytes))
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    coded = materialize(picked.mapInArrow(lean(_encode(tokenizer_path, end_id), keeps=True), f"doc_id {kind}, ids binary"), "pack-ids")
    return coded.repartition(groups).mapInArrow(lean(_sequences(tuple(lengths))), f"bin_id long, capacity int, n_tokens int, doc_ids array<{kind}>, pieces array<int>, starts array<int>, lengths array<int>, ids binary")


def pieces(sequences: DataFrame) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, bin_id, place (its order in the bin), capacity."""
    each = sequences.select("bin_id", "capacity", F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts", "lengths")).alias("place", "p"))
    return each.select(F.col("p.doc_ids").alias("doc_id"), F.col("p.pieces").alias("piece"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"), "bin_id", "place", "capacity")
