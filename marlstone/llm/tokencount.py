"""Token counts under a unigram vocabulary by dynamic programming shared along a trie of distinct pre-tokens.

A pre-token is a white-space-free word with the word mark before it. Its segmentation is the one with the highest sum
of piece scores (ties: fewer tokens); forward scores depend on the prefix alone. Distinct pre-tokens are inserted in a
trie in sorted order: a node holds its forward score and the vocabulary prefixes that are still alive there, so a new
node looks only at pieces that may end in it. Nodes of the first KEPT characters stay from slice to slice; below them a
word goes on from the path of the word before, so what two words of a slice share is scored once. Each terminal stores
its token count, so a document's count is the sum of its words' terminals. Kept nodes and terminals are started anew
when they reach their bounds, which changes no result. No shuffle: one pass over whole texts.

The vocabulary file is a parameter; nothing is trained. The file's ids are in order of merge rank, and piece scores
follow Zipf's rule on them: -log(id + 2). A character outside the vocabulary is spelled in its UTF-8 bytes, each one
token with the score of `byte_score`.

Defined cases: null or blank text has 0 words and 0 tokens; repeated rows and null doc_ids keep their rows; an empty
table gives no rows; of a word of any length only the path of its first STACK characters is held.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, pick, slices

MARK, BYTE_SCORE = "▁", -20.0
#: Words whose counts, and trie nodes whose scores, a worker keeps.
TABLE, NODES = 400_000, 200_000
#: Characters of a prefix up to which its node is kept from slice to slice.
KEPT = 6
#: Characters of a word up to which its path is remembered for the next word.
STACK = 64


def load_pieces(path: str) -> dict[str, float]:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    own = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
    return {p.id_to_piece(i): -math.log(i + 2) for i in own}


class TrieCounter:
    """Token counts of distinct pre-tokens, forward scores shared by prefix.

    A node is [best score, fewest tokens, pieces begun, children or None]; a piece begun is (its vocabulary state, score
    and tokens before it), the longest first; a vocabulary state is (next states, score of the piece that ends here).
    """

    def __init__(self, pieces: dict[str, float], byte_score: float = BYTE_SCORE, table: int = TABLE, most_nodes: int = NODES):
        self.pieces, self.byte_score, self.table, self.most_nodes = pieces, byte_score, table, most_nodes
        self.begin: dict = {}
        for piece in sorted(pieces):
            at = self.begin
            for c in piece[:-1]:
                at = at.setdefault(c, ({}, None))[0]
            at[piece[-1]] = (at.get(piece[-1], ({},))[0], pieces[piece])
        self.root: list = [0.0, 0, [], None]
        self.terminal: dict[bytes, int] = {}
        self.nodes = self.held = 0

    def _child(self, node: list, c: str) -> list:
        top, fewest, live = -math.inf, 0, []
        for states, best, count in node[2]:
            state = states.get(c)
            if state is not None:
                further, score = state
                if further:
                    live.append((further, best, count))
                if score is not None:
                    score += best
                    if score > top or score == top and count + 1 < fewest:
                        top, fewest = score, count + 1
        state = self.begin.get(c)
        if state is not None:
            further, score = state
            if further:
                live.append((further, node[0], node[1]))
            if score is not None:
                score += node[0]
                if score > top or score == top and node[1] + 1 < fewest:
                    top, fewest = score, node[1] + 1
        if c not in self.pieces:
            n = len(c.encode())
            score = node[0] + n * self.byte_score
            if score > top or score == top and node[1] + n <= fewest:
                top, fewest = score, node[1] + n
        self.nodes += 1
        return [top, fewest, live, None]

    def learn(self, words: set[bytes]) -> None:
        if self.held > self.most_nodes:
            self.root, self.held = [0.0, 0, [], None], 0
        path, nodes = "", [self.root]
        for word, raw in sorted((MARK + w.decode(), w) for w in words):
            shared = 0
            for a, b in zip(path, word):  # noqa: B905
                if a != b:
                    break
                shared += 1
            del nodes[shared + 1 :]
            node = nodes[shared]
            for i in range(shared, len(word)):
                c = word[i]
                if i < KEPT:
                    children = node[3]
                    if children is None:
                        children = node[3] = {}
                    child = children.get(c)
                    if child is None:
                        child = children[c] = self._child(node, c)
                        self.held += 1
                else:
                    child = self._child(node, c)
                node = child
                if i < STACK:
                    nodes.append(node)
            path = word[:STACK]
            self.terminal[raw] = node[1]

    def totals(self, texts: list[bytes]) -> Iterator[tuple[int, int]]:
        """(words, tokens) of each text."""
        parts = [t.split() for t in texts]
        if len(self.terminal) > self.table:
            self.terminal.clear()
        fresh = set()
        for p in parts:
            fresh.update(p)
        self.learn(fresh.difference(self.terminal))
        look = self.terminal.__getitem__
        for p in parts:
            yield len(p), sum(map(look, p))


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words, n_tokens for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(load_pieces(vocabulary))
        for b in slices(batches):
            rows = list(counter.totals(as_bytes(b.column(1))))
            yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
