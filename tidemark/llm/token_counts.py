"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

Texts are cut into pre-tokens by the vocabulary's pattern.  Of every Arrow batch the distinct pre-tokens that aren't
known yet are put in order and inserted once each into a trie, whose nodes keep the forward state of their prefix: the
best score of any segmentation of the prefix, its number of tokens, and the vocabulary pieces begun and not ended.
Pre-tokens with a common prefix share those states, so a prefix is scored once; where a pre-token ends its count is
stored.  Texts then add up the stored counts of their pre-tokens.  Trie and counts belong to one worker, which keeps
them from batch to batch, and hold ``MAX_NODES`` nodes at most; a full trie stays as it is, with the frequent prefixes
that came first, and further pre-tokens are scored from where they leave it.  So nothing is shuffled and memory is
bounded: one trie over all pre-tokens of the input would need each (text, pre-token) pair to cross the network twice.

The score of a piece of rank r is -ln(r + 1) - ln(H), a Zipf law over the public vocabulary's order: scores fitted to a
corpus would be a trained tokenizer, and tokenizers are never trained here.  Counts are this model's own.
Best is the highest score; of equal scores (to 1e-9) the fewer tokens.

Results: null and empty texts have 0 tokens.  Repeated rows have a row each, and an empty table gives an empty result.
Pre-tokens and texts of any length are scored whole.  A vocabulary without a piece for each single byte raises, for it
leaves some texts without a segmentation.  Only the id and the text column are read, so others can't clash.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.llm.shared import keep

MAX_NODES = 400_000
PORTION = 1_000_000
TIE = 1e-9


def load_pieces(path: str) -> dict[bytes, float]:
    """Piece to log-probability, from a rank file."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    if missing := 256 - len({p for p in ranks if len(p) == 1}):
        raise ValueError(f"{missing} single bytes have no piece")
    total = math.log(sum(1 / (r + 1) for r in ranks.values()))
    return {p: -math.log(r + 1) - total for p, r in ranks.items()}


class Node:
    """A prefix: its best score and count, and the pieces begun in it that can go on, as (subtree, score, count)."""

    __slots__ = ("children", "score", "count", "begun")

    def __init__(self, score: float, count: int, begun: list) -> None:
        self.children: dict[int, Node] = {}
        self.score, self.count, self.begun = score, count, begun


class PrefixCounter:
    def __init__(self, pieces: dict[bytes, float], max_nodes: int = MAX_NODES) -> None:
        self.first: list = [None] * 256  # subtree by first byte; a subtree is [subtree by next byte, score of the piece that ends here]
        for piece, score in pieces.items():
            at = self.first[piece[0]] = self.first[piece[0]] or [{}, None]
            for b in piece[1:]:
                at = at[0].setdefault(b, [{}, None])
            at[1] = score
        self.max_nodes = max_nodes
        self.root, self.nodes, self.scored = Node(0.0, 0, []), 1, 0
        self.counts: dict[str, int] = {}

    def _extend(self, node: Node, b: int) -> Node:
        best, count, begun = -math.inf, 0, []
        for at, score, n in node.begun:
            below = at[0].get(b)
            if below is not None:
                if below[0]:
                    begun.append((below, score, n))
                if below[1] is not None:
                    score += below[1]
                    if score > best + TIE or score > best - TIE and n + 1 < count:
                        best, count = score, n + 1
        below = self.first[b]
        if below is not None:
            score, n = node.score, node.count
            if below[0]:
                begun.append((below, score, n))
            if below[1] is not None:
                score += below[1]
                if score > best + TIE or score > best - TIE and n + 1 < count:
                    best, count = score, n + 1
        self.scored += 1
        return Node(best, count, begun)

    def insert(self, pre_token: str) -> int:
        """The pre-token's number of tokens; states of a prefix that is in the trie aren't scored again."""
        node, raw = self.root, pre_token.encode()
        at = 0
        for b in raw:
            child = node.children.get(b)
            if child is None:
                break
            node, at = child, at + 1
        keep = self.nodes + len(raw) - at <= self.max_nodes
        for b in raw[at:]:
            child = self._extend(node, b)
            if keep:
                node.children[b] = child
            node = child
        if keep:
            self.nodes += len(raw) - at
        return node.count

    def learn(self, distinct: set[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens, each new one inserted once."""
        counts, new = self.counts, sorted(distinct.difference(self.counts))
        found = {p: self.insert(p) for p in new}
        if len(counts) + len(found) <= self.max_nodes:
            counts.update(found)
            return counts
        return {p: found[p] if p in found else counts[p] for p in distinct}


def _portions(texts: pa.Array) -> Iterator[list[str]]:
    """Texts of about ``PORTION`` characters at a time."""
    some, size = [], 0
    for t in texts:
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= PORTION:
            yield some
            some, size = [], 0
    if some:
        yield some


def _count(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = keep(("token_counts", path), lambda: PrefixCounter(load_pieces(path)))
        find = regex.compile(pattern).findall
        for batch in batches:
            n_tokens, n_pre, n_bytes = [], [], []
            for some in _portions(batch.column(1)):
                cut = [find(t) for t in some]
                counts = counter.learn(set().union(*cut))
                n_tokens += [sum(map(counts.__getitem__, pre)) for pre in cut]
                n_pre += map(len, cut)
                n_bytes += [len(t.encode()) for t in some]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_tokens, n_pre, n_bytes))], ["doc_id", "n_tokens", "n_pre_tokens", "n_bytes"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_pre_tokens, n_bytes of every row."""
    picked = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(_count(vocabulary_path, pattern), f"doc_id {kind}, n_tokens long, n_pre_tokens long, n_bytes long")
