"""Language identification by cross-parsing against suffix automata of labelled text.

A language is learned from a bounded sample of its labelled rows: whole texts are cut into segments of
``SEGMENT_CHARS`` code points, every one of them with the same chance, and the ``SEGMENTS`` of least hash (of doc_id and
place) are taken.  Their letter runs, lower-cased and joined by blanks, make a suffix automaton.  A text is parsed into phrases, each the longest match that the automaton has from there on; a
phrase ends at a word's end at the latest, so a text's phrases are the sum over its words and each distinct word is
parsed once.  With c phrases over n letters and boundaries, against a sample of m characters, a language needs
``c * log2(m) / n`` bits a character, the estimate of the cross entropy; the language that needs least wins, ties go
to the smaller name.

At most ``LANGUAGES`` labels can be learned, which bounds what is broadcast; more raise.

Results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned.  The score is
s / (b + s) for the best language's bits b and the second's s (1 with one language): 0.5 is a tie.  Null labels and
null doc_ids aren't learned from (a null doc_id counts as an empty string in the split).  Repeated rows have a row each;
of rows that share label, doc_id and place the least segment counts.  Very long texts are parsed whole.  An empty table
gives an empty result.  Only the named columns are read, so others can't clash; ``recognised`` passes all of them on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import keep, lean

SEGMENTS = 64
SEGMENT_CHARS = 1_000
LANGUAGES = 256
CACHE_WORDS = 250_000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


class SuffixAutomaton:
    """All substrings of a text; each state has a dictionary from character to state."""

    def __init__(self, text: str) -> None:
        step: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for ch in text:
            cur = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and ch not in step[p]:
                step[p][ch] = cur
                p = link[p]
            if p >= 0:
                q = step[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    twin = len(step)
                    step.append(step[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and step[p].get(ch) == q:
                        step[p][ch] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.step, self.size = step, len(text)

    def phrases(self, text: str) -> int:
        """Greedy longest matches that cover the text; an unknown character is a phrase of its own."""
        step, count = self.step, 0
        start = at = step[0]
        for ch in text:
            to = at.get(ch)
            if to is None:  # a phrase ends before this character, unless none was begun
                count += at is not start
                to = start.get(ch)
                if to is None:
                    count += 1
                    at = start
                    continue
            at = step[to]
        return count + (at is not start)


def runs(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


class Parser:
    def __init__(self, samples: dict[str, str]) -> None:
        self.names = sorted(samples)
        self.automata = [SuffixAutomaton(samples[k]) for k in self.names]
        self.scale = np.array([math.log2(max(2, a.size)) for a in self.automata])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((1024, len(self.names) + 1))

    def learn(self, word: bytes) -> None:
        k = len(self.known)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        row = self.table[k]
        row[:] = 0
        for run in runs(word.decode()):
            bounded = f" {run} "
            row[-1] += len(bounded)
            for j, a in enumerate(self.automata):
                row[j] += a.phrases(bounded)
        self.known[word] = k

    def bits(self, text: bytes | None) -> np.ndarray | None:
        """Bits a character by language; None without a letter."""
        words = (text or b"").lower().split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.clear()
            new = set(words)
        for w in new:
            self.learn(w)
        total = self.table[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return total[:-1] * self.scale / total[-1] if total[-1] else None

    def predict(self, text: bytes | None) -> tuple[str, float, float | None]:
        b = self.bits(text)
        if b is None or not len(b):
            return UNKNOWN, 0.0, None
        best = int(np.argmin(b))
        if len(b) == 1:
            return self.names[best], 1.0, float(b[best])
        second = float(np.partition(b, 1)[1])
        return self.names[best], second / (float(b[best]) + second), float(b[best])


def held_out(doc_id: Column, mod: int = 3, rest: int = 1) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod == rest


def collect_samples(train: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", segments: int = SEGMENTS, chars: int = SEGMENT_CHARS) -> dict[str, str]:
    """Letter runs of a bounded sample by language: ``segments`` of ``chars`` code points at most."""
    named = train.select(train[lang_col].alias("l"), train[id_col].cast("string").alias("d"), train[text_col].alias("t"))
    usable = named.where(F.col("l").isNotNull() & F.col("d").isNotNull() & F.rlike("t", F.lit(r"\p{L}")))
    cut = usable.select("l", "d", F.explode(F.sequence(F.lit(0), F.ceil(F.length("t") / chars).cast("int") - 1)).alias("k")).withColumn("u", F.xxhash64("d", "k", F.lit("sample")))
    # Spark keeps the first rows of each language in every task before it shuffles them (WindowGroupLimit).
    first = cut.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("u", "d", "k"))).where(F.col("n") <= segments)
    chosen = first.select("l", "d", "k").distinct().limit(segments * LANGUAGES + 1).collect()
    if len({r["l"] for r in chosen}) > LANGUAGES or len(chosen) > segments * LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not chosen:
        return {}
    picks = F.broadcast(train.sparkSession.createDataFrame(chosen, "l string, d string, k int"))  # as many rows at most
    found = usable.join(picks, ["l", "d"]).groupBy("l", "d", "k").agg(F.min(F.substring(F.col("t"), F.col("k") * chars + 1, F.lit(chars))).alias("t"))
    texts: dict[str, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["l"], r["d"], r["k"])):
        texts.setdefault(r["l"], []).append(" ".join(runs(r["t"])))
    return {k: " " + " ".join(v) + " " for k, v in texts.items() if any(v)}


def _parser(samples: dict[str, str]) -> Parser:
    return keep(("language_id", tuple(sorted(samples.items()))), lambda: Parser(samples))


def _predict(samples):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(samples.value)
        for batch in batches:
            got = [parser.predict(t.as_py()) for t in batch.column(batch.num_columns - 1).cast(pa.binary())]
            names, scores, bits = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score", "bits_per_char"])

    return run


def identify(docs: DataFrame, samples: dict[str, str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, bits_per_char of every row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # bounded by the sample's parameters
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(lean(_predict(shared), keeps=True), f"doc_id {kind}, lang_pred string, score double, bits_per_char double")


def language_id(docs: DataFrame, **sizes) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char; learned from the rows that aren't held out."""
    samples = collect_samples(docs.where(~held_out(F.col("doc_id"))), **sizes)
    return identify(docs, samples).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "bits_per_char")


def recognised(docs: DataFrame, **sizes) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose language isn't ``und``."""
    samples = collect_samples(docs.where(~held_out(F.col("doc_id"))), **sizes)
    shared = docs.sparkSession.sparkContext.broadcast(samples)
    schema, text_at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            keep = [parser.predict(t.as_py())[0] != UNKNOWN for t in batch.column(text_at).cast(pa.binary())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run, keeps=True), schema)
