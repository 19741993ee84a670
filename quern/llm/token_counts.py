"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word between white space, with the mark that opens words in the vocabulary before it. Its tokens are the
segmentation of the largest sum of piece scores; at equal sums the one of fewer tokens counts. The distinct pre-tokens of a
block of texts are inserted in a trie: a node is a prefix that they share. Forward scores and counts are computed once at each
node, from the nodes above it, and the count of a word is stored at its terminal node. Which pieces end at a node is read
from a second trie, of the vocabulary's pieces spelt backwards.

The vocabulary's file has no chances: it lists merges. Pieces score by their rank (Zipf's law), so counts are those of this
model and of no other tokenizer.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches
from .token_store import pieces

MARK = "▁"
#: Words whose counts a worker remembers.
MEMORY_WORDS = 1_000_000


class Trie:
    """Words as paths: for each node its character, its parent, its children and, for the end of a word, that word's tokens."""

    def __init__(self) -> None:
        self.letter, self.parent, self.children = [""], [-1], [{}]
        self.tokens: dict[int, int] = {}

    def insert(self, word: str) -> int:
        """The word's terminal node."""
        node = 0
        for c in word:
            to = self.children[node].get(c)
            if to is None:
                to = self.children[node][c] = len(self.letter)
                self.letter.append(c)
                self.parent.append(node)
                self.children.append({})
            node = to
        return node


class Unigram:
    """Piece scores: the log of a piece's chance by its rank among n (Zipf's law); a character that no piece has costs a token for each of its bytes."""

    def __init__(self, vocabulary: list[str]):
        norm = math.log(sum(1 / (r + 1) for r in range(len(vocabulary))) or 1)
        self.scores: dict[str, float] = {}
        for rank, piece in enumerate(vocabulary):
            self.scores.setdefault(piece, -math.log(rank + 1) - norm)
        self.byte_score = -math.log(len(vocabulary) + 1) - norm - 1
        # Pieces backwards: for each node its children and the score of the piece that begins there.
        self.backwards: list = [{}, None]
        for piece, score in self.scores.items():
            node = self.backwards
            for c in reversed(piece):
                node = node[0].setdefault(c, [{}, None])
            node[1] = score

    @classmethod
    def from_sentencepiece(cls, path: str) -> Unigram:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each word; each shared prefix is scored once."""
        trie = Trie()
        ends = {word: trie.insert(MARK + word) for word in words}
        terminal = set(ends.values())
        letter, parent = trie.letter, trie.parent
        best, count = [0.0] * len(letter), [0] * len(letter)
        for node in range(1, len(letter)):  # a node's parent comes before it
            above = parent[node]
            size = len(letter[node].encode())
            top, n = best[above] + self.byte_score * size, count[above] + size
            piece, at = self.backwards, node
            while at and (piece := piece[0].get(letter[at])) is not None:
                at = parent[at]
                if piece[1] is not None:
                    s = best[at] + piece[1]
                    if s > top or s == top and count[at] + 1 < n:
                        top, n = s, count[at] + 1
            best[node], count[node] = top, n
            if node in terminal:
                trie.tokens[node] = n
        return {word: trie.tokens[node] for word, node in ends.items()}


_MODELS: dict[str, tuple[Unigram, dict[str, int]]] = {}


def token_count(text: Column | str, model: str, most: int = MEMORY_WORDS) -> Column:
    """bigint: tokens of each whole text; a null or blank text has none."""

    @F.pandas_udf("bigint")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if model not in _MODELS:
            _MODELS[model] = Unigram.from_sentencepiece(model), {}
        unigram, known = _MODELS[model]
        for part in parts:
            out = []
            for some in batches(part):
                cut = [[p.split() for p in pieces(t)] for t in some]
                new = {w for t in cut for p in t for w in p} - known.keys()
                fresh = unigram.counts([*new])
                if len(known) < most:
                    known.update(fresh)
                    fresh = known
                    out += [sum(sum(map(fresh.__getitem__, p)) for p in t) for t in cut]
                else:
                    out += [sum(known[w] if w in known else fresh[w] for p in t for w in p) for t in cut]
            yield pd.Series(out, dtype="int64")

    return of(text)


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and n_tokens of every whole text; null or blank: 0. Repeated rows give repeated results, an empty table none; other columns are left out."""
    return docs.select("doc_id", token_count(F.col("text"), model).alias("n_tokens"))
