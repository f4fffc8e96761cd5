"""Token counts: greedy word-piece lengths in one pass over each word, without building pieces.

The vocabulary is a trie. Where a word can't go on in the trie, the longest piece so far ends; a failure link leads to the
node of what is left of the word, and the number of pieces that end on the way is stored with it. So each byte is looked
at once, besides links that are paid for by pieces counted (the linear longest-match automaton of fast word-piece
tokenization). A worker keeps the counts of words it has met.

Pieces are bytes, those of a tokenizer's vocabulary; A to Z are lower-cased; words are split at spaces and the characters
9 to 13. A word that greedy matching can't finish counts as one unknown piece, as word-piece tokenizers have it.

Defined cases: null and empty texts and texts of spaces have no words and no pieces; a very long text is split whole, in
its own row's memory; repeated rows, rows that tie and null ids are counted each; an empty table gives an empty result; only
the id and text columns are read, so others can have any names.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .tokens import LONGEST, MOST_WORDS, byte_of_sign, default_tokenizer


class Automaton:
    """Node 0 is a word's start, node 1 the start of each further piece."""

    def __init__(self, first: Iterable[bytes], inner: Iterable[bytes] | None = None):
        self.go: dict[int, int] = {}  # by node * 256 + byte
        self.fail: list[int] = [-1, -1]  # -1: there is no way on
        self.popped: list[int] = [0, 0]
        first = set(first)
        parent, byte, ends = [-1, -1], [-1, -1], [False, False]
        for root, pieces in ((0, first), (1, first if inner is None else inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    to = self.go.get(node << 8 | c)
                    if to is None:
                        to = self.go[node << 8 | c] = len(ends)
                        parent.append(node)
                        byte.append(c)
                        ends.append(False)
                    node = to
                if piece:
                    ends[node] = True
        depth = [0] * len(ends)
        for v in range(2, len(ends)):  # parents come before their children
            depth[v] = depth[parent[v]] + 1
        self.fail += [-1] * (len(ends) - 2)
        self.popped += [0] * (len(ends) - 2)
        for v in sorted(range(2, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            node, count = self.fail[parent[v]], self.popped[parent[v]]
            while node >= 0 and (node << 8 | byte[v]) not in self.go:
                count += self.popped[node]
                node = self.fail[node]
            if node >= 0:
                self.fail[v], self.popped[v] = self.go[node << 8 | byte[v]], count

    def count(self, word: bytes) -> int:
        """Pieces of the word; one if it can't be matched to its end."""
        go, fail, popped, node, n = self.go, self.fail, self.popped, 0, 0
        for c in word:
            while (to := go.get(node << 8 | c)) is None:
                n += popped[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 1:
            n += popped[node]
            node = fail[node]
        return n if node >= 0 else 1


def vocabulary(path: str, word_end: str = "</w>") -> set[bytes]:
    """The pieces of a byte-level tokenizer file as bytes, without its special tokens and marks of a word's end."""
    with open(path) as f:
        config = json.load(f)
    special, to_byte = {x["content"] for x in config["added_tokens"]}, byte_of_sign()
    return {bytes(map(to_byte.__getitem__, x.removesuffix(word_end))) for x in config["model"]["vocab"] if x not in special} - {b""}


class Counter(dict):
    """Words to their numbers of pieces."""

    def __init__(self, path: str):
        self.automaton = Automaton(vocabulary(path))

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(self) < MOST_WORDS and len(word) <= LONGEST:
            self[word] = n
        return n


_counters: dict[str, Counter] = {}


def count_pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_words and n_pieces of every whole text."""
    tokenizer = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = Counter(tokenizer)
        counter = _counters[tokenizer]
        for b in batches:
            words, pieces = [], []
            for x in b.column(1):
                found = (x.as_py() or "").encode().lower().split()
                words.append(len(found))
                pieces.append(sum(map(counter.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(pieces, pa.int64())], ["doc_id", "n_words", "n_pieces"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_pieces long")


def op3_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_pieces(table(spark, sf_dir, "documents"))
