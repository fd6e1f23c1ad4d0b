"""Token ids in Simple-8b files.

The file format
---------------
A store is a Parquet table (so that it can lie in any store that Spark writes, with Spark's commit) whose rows are
*chunks* of whole documents in ascending doc_id order: shard, chunk, start (ids of the shard before the chunk),
doc_ids, lengths and ``payload``, the packed ids:

    magic    4 bytes  b"S8B1"
    n_ids    uint64   ids in the payload
    n_blocks uint32   blocks of ``BLOCK`` ids, the last one shorter
    offsets  uint32 * (n_blocks + 1)   first word of each block
    words    uint64 * offsets[-1]      selector in the top 4 bits, 60 bits of ids, first id lowest

All integers are little-endian.  A block starts a new word, so blocks decode alone or all at once: the offsets give
every word's block, the selectors every word's first place.  The selector of a word is the one that packs most ids;
the last, one id in 60 bits, is the escape for ids that fit no other.  Zeros pad the last word of a block.  Ids of
2^60 and above have no word and raise.

Results: null counts as the empty text, which has the end id alone.  doc_id must be a whole number, which orders the
store; other types raise.  Rows of equal doc_id (repeated rows too) follow each other by their ids; a null doc_id comes
first.  Only the id and the text column are read, so other columns can't clash.  An empty table gives an empty store.
Very long texts are encoded whole and may make a chunk of their own.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.shared import keep, partitions_for, work_path

BLOCK = 4096
END_ID = 2
MAGIC = b"S8B1"
CHUNK_IDS = 262_144
SHARD_ROWS = 100_000
CACHE_WORDS = 250_000
STEP_BYTES = 16_000_000
_BREAK = b"\xff\xff\xff\xff"

#: Ids and bits per id of a word, by selector.  Fixed values of Simple-8b.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _selectors(ids: np.ndarray) -> np.ndarray:
    """For every place of the (padded) ids the selector of a word that starts there."""
    n = len(ids)
    need = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # bits of each id (above 2 ** 53 perhaps one more)
    best = np.full(n, 15, np.uint8)
    # The largest need in the k ids from each place on, for growing k: from windows of powers of two.
    levels = [need]
    while (1 << len(levels)) <= 240:
        half, w = 1 << (len(levels) - 1), levels[-1].copy()
        np.maximum(w[:-half], levels[-1][half:], out=w[: n - half])
        levels.append(w)
    for s in range(14, -1, -1):
        k = int(COUNTS[s])
        p = k.bit_length() - 1
        w = levels[p].copy()
        if k - (1 << p):
            shift = k - (1 << p)
            np.maximum(w[:-shift], levels[p][shift:], out=w[: n - shift])
        np.copyto(best, np.uint8(s), where=w <= BITS[s])
    return best


def encode(ids: np.ndarray) -> bytes:
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if n and int(ids.max()) >> 60:
        raise ValueError("ids of 60 bits at most have a word")
    n_blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + struct.pack("<QI", 0, 0) + np.zeros(1, "<u4").tobytes()
    wide = np.zeros((n_blocks, BLOCK + 240), np.uint64)  # each block is padded: no word looks into the next block
    flat = np.zeros(n_blocks * BLOCK, np.uint64)
    flat[:n] = ids
    wide[:, :BLOCK] = flat.reshape(n_blocks, BLOCK)
    sel = _selectors(wide.ravel()).reshape(wide.shape)
    ends = np.full(n_blocks, BLOCK)
    ends[-1] = n - (n_blocks - 1) * BLOCK
    steps, width, starts = COUNTS.astype(np.uint8)[sel].tobytes(), wide.shape[1], []
    for first, end in zip(range(0, n_blocks * width, width), ends.tolist(), strict=True):
        place, end = first, first + end
        while place < end:  # bytes step faster than arrays of a few blocks
            starts.append(place)
            place += steps[place]
    at = np.array(starts)
    block, packed = at // width, wide.ravel()
    chosen = sel.ravel()[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in np.unique(chosen):
        if BITS[s]:
            k = np.flatnonzero(chosen == s)
            for j in range(int(COUNTS[s])):
                words[k] |= packed[at[k] + j] << np.uint64(j * int(BITS[s]))
    offsets = np.searchsorted(block, np.arange(n_blocks + 1)).astype("<u4")
    return MAGIC + struct.pack("<QI", n, n_blocks) + offsets.tobytes() + words.astype("<u8").tobytes()


def decode(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b payload")
    n, n_blocks = struct.unpack_from("<QI", payload, 4)
    offsets = np.frombuffer(payload, "<u4", n_blocks + 1, 16)
    words = np.frombuffer(payload, "<u8", int(offsets[-1]), 16 + 4 * (n_blocks + 1))
    if not n:
        return np.zeros(0, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(COUNTS[sel])])
    block = np.repeat(np.arange(n_blocks), np.diff(offsets.astype(np.int64)))
    place = before[:-1] - before[offsets[:-1].astype(np.int64)][block]  # in the word's block
    out = np.zeros((n_blocks, BLOCK + 240), np.uint64)
    for s in np.unique(sel):
        bits = int(BITS[s])
        if bits:
            k = np.flatnonzero(sel == s)
            some, to = words[k], block[k] * out.shape[1] + place[k]
            for j in range(int(COUNTS[s])):
                out.ravel()[to + j] = (some >> np.uint64(j * bits)) & np.uint64((1 << bits) - 1)
    return out[:, :BLOCK].ravel()[:n]


class WordEncoder:
    """Encodes texts word by word: this tokenizer's pre-tokens never cross white space, so the bytes of a word's ids
    can be kept.  Most words are new only as a whole, so the pre-tokens of a new word of plain Latin characters are
    kept too, and only new pre-tokens reach the library's merges, many at once, past its normaliser and splitter.
    Words with any other character take the library's whole path.  Both caches are of bounded size: when one is full
    it stays as it is, with the frequent words that came first."""

    #: Graphic characters below U+0250 but U+0130, which alone lower-cases to two: normal form C leaves them alone.
    _plain = regex.compile(r"[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+").fullmatch
    _all_plain = regex.compile(r"[\n!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+").fullmatch

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        kinds = [[step["type"] for step in spec[part][steps]] for part, steps in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        if kinds != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or spec["model"]["type"] != "BPE" or spec["post_processor"]:
            raise ValueError("a BPE tokenizer of normal form C, lower case and dropped white space is expected")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._pieces = regex.compile(rf"(?:{split})|\n").findall
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = spec["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        for token, i in self.whole.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith(suffix)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {"\n": _BREAK}
        if self.whole.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits at most are expected")

    def _merge(self, parts: list[str], into: dict[str, bytes]) -> None:
        for at in range(0, len(parts), 5_000):
            some = parts[at : at + 5_000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
            raw, start = ids.tobytes(), 0
            for part, end in zip(some, cuts.tolist(), strict=True):
                into[part] = raw[start:end]
                start = end

    def _encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some new words: all plain ones are split, looked up and cut apart again as one text."""
        text = b"\n".join(words).decode()
        plain, odd = words, []
        if not self._all_plain(text) or "<|" in text:
            plain = []
            for w in words:
                s = w.decode()
                (plain if self._plain(s) and "<|" not in s else odd).append(w)
            text = b"\n".join(plain).decode()
        pieces = self._pieces(text.lower())
        parts = self.parts
        new = set(pieces).difference(parts)
        if len(parts) + len(new) <= CACHE_WORDS:
            self._merge(list(new), parts)
            raw = b"".join(map(parts.__getitem__, pieces))
        else:
            merged: dict[str, bytes] = {}
            self._merge(list(new), merged)
            raw = b"".join([merged[p] if p in merged else parts[p] for p in pieces])
        # Ids are below 2 ** 16, so a break, all ones, lies across no two of them.
        split = raw.split(_BREAK) if plain else []
        if not odd:
            return split
        out = dict(zip(plain, split, strict=True))
        for w in odd:
            out[w] = np.array(self.whole.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return [out[w] for w in words]

    def ids(self, texts: pa.Array | list[bytes | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers.

        Some megabytes of texts at a time are split into numbered words; each distinct word's ids are looked up or found
        once, and the texts are put together from them by numbers alone.
        """
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        column = column.cast(pa.string()).fill_null("")
        sizes = np.cumsum(pc.binary_length(column).to_numpy())
        first = 0
        while first < len(column):
            before = int(sizes[first - 1]) if first else 0
            upto = max(first + 1, int(np.searchsorted(sizes, before + STEP_BYTES, side="right")))
            split = pc.ascii_split_whitespace(column.slice(first, upto - first))
            coded = split.flatten().dictionary_encode()
            found = self._lookup(coded.dictionary.cast(pa.binary()).to_pylist())
            number = coded.indices.to_numpy()
            lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
            places = np.cumsum(lengths) - lengths
            each = lengths[number]
            ends = np.concatenate([[0], np.cumsum(each)])
            words = split.offsets.to_numpy() - split.offsets[0].as_py()
            pool = np.frombuffer(b"".join(found), "<u4")
            out = pool[np.repeat(places[number] - ends[:-1], each) + np.arange(ends[-1])]
            cuts = ends[words].tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield out[a:b].tobytes()
            first = upto

    def _lookup(self, distinct: list[bytes]) -> list[bytes]:
        """The ids of distinct words; the empty word, which stands at a text's ends, has none."""
        known = self.known
        found = [known.get(w) for w in distinct]
        at = [i for i, x in enumerate(found) if x is None]
        new = [w for i in at if (w := distinct[i])]
        more = self._encode(new) if new else []
        if len(known) + len(more) <= CACHE_WORDS:
            known.update(zip(new, more, strict=True))
        ids = iter(more)
        for i in at:
            found[i] = next(ids) if distinct[i] else b""
        return found


def encoder(path: str) -> WordEncoder:
    """The worker's encoder of a tokenizer file."""
    return keep(("token_store", path), lambda: WordEncoder(path))


def _tokenise(path: str, bounds: list[int], end_id: int):
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        cuts = np.array(bounds, np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            shard = np.searchsorted(cuts, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
            coded, held, first = [], 0, 0
            for i, t in enumerate(encode(texts)):
                coded.append(t + end)
                held += len(coded[-1])
                if held > 16_000_000 or i + 1 == len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array(shard[first : i + 1], pa.int32()), ids[first : i + 1], pa.array(coded, pa.binary())], ["shard", "doc_id", "ids"])
                    coded, held, first = [], 0, i + 1

    return run


_CHUNK = "shard int, chunk int, start long, doc_ids array<long>, lengths array<int>, payload binary"
_CHUNK_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, chunk, start = None, 0, 0
    doc_ids, parts, held = [], [], 0

    def out() -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(parts), "<u4")
        return pa.RecordBatch.from_pylist([{"shard": shard, "chunk": chunk, "start": start, "doc_ids": doc_ids, "lengths": [len(p) // 4 for p in parts], "payload": encode(ids)}], schema=_CHUNK_ARROW)

    for batch in batches:
        for s, d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            p = p.as_py()
            if parts and (s != shard or held + len(p) // 4 > CHUNK_IDS):
                yield out()
                chunk, start = (chunk + 1, start + held) if s == shard else (0, 0)
                doc_ids, parts, held = [], [], 0
            shard = s
            doc_ids.append(d)
            parts.append(p)
            held += len(p) // 4
    if parts:
        yield out()


def write_store(docs: DataFrame, tokenizer_path: str, store: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> None:
    """Encode, sort by doc_id into shards of like row counts, and write the files."""
    spark = docs.sparkSession
    shards = shards or partitions_for(spark, docs.count(), SHARD_ROWS)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be a whole number")
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    at = [i / shards for i in range(1, shards)]
    # One number a shard comes to the driver.
    bounds = picked.agg(F.percentile_approx("doc_id", at, 10_000)).first()[0] if at else None
    coded = picked.mapInArrow(_tokenise(tokenizer_path, sorted(set(bounds or [])), end_id), "shard int, doc_id long, ids binary")
    ordered = coded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    ordered.mapInArrow(_pack, _CHUNK).write.option("compression", "uncompressed").parquet(store)


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, start, doc_ids, lengths, payload in zip(*(batch.column(c).to_pylist() for c in ("shard", "start", "doc_ids", "lengths", "payload")), strict=True):
            ids = decode(payload).astype("<u4")
            ends = np.cumsum(lengths)
            cut = np.split(ids, ends[:-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard] * len(cut), pa.int32()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(start + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array([x.tobytes() for x in cut], pa.binary()),
                ],
                ["shard", "doc_id", "place", "n_tokens", "ids"],
            )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _unpack(batches):
        crc = pa.array([zlib.crc32(x) for x in batch.column(4).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc], ["shard", "doc_id", "place", "n_tokens", "ids_crc32"])


def _with_start(store: DataFrame, read: DataFrame) -> DataFrame:
    sizes = store.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    # A running sum over a row a shard: as many as tasks, never as many as documents.
    earlier = sizes.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return read.join(F.broadcast(earlier), "shard").withColumn("start", F.col("before") + F.col("place"))


def read_store(spark, store: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every document."""
    files = spark.read.schema(_CHUNK).parquet(store)
    read = files.mapInArrow(_unpack, "shard int, doc_id long, place long, n_tokens long, ids binary")
    return _with_start(files, read).select("doc_id", "start", "n_tokens", "ids")


def store_digest(spark, store: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    files = spark.read.schema(_CHUNK).parquet(store)
    read = files.mapInArrow(_digest, "shard int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return _with_start(files, read).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write a store to the shared folder and return its digest."""
    spark = docs.sparkSession
    store = work_path(spark, "tokens")
    write_store(docs, tokenizer_path, store, **options)
    return store_digest(spark, store)
