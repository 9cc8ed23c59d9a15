"""Token counts: greedy longest-match piece counts by a linear automaton, without building the pieces."""

from __future__ import annotations

import json
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a text is parted into before pieces are matched: runs of letters, single digits, runs of other signs.
WORD_PATTERN = r"[^\W\d_]+|\d|(?:[^\w\s]|_)+"
#: Space-separated words whose counts a task keeps, at most; when full it starts anew.
KEPT_WORDS = 1_000_000
#: Mark of pieces that end a word in the vocabulary.  Such a piece matches only at the end of a word, any other only
#: before it, so the last letter of a word or piece is a letter of its own.
WORD_END = "</w>"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free one from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


def ended(word: str) -> str:
    """A word whose last letter is the one that ends words, which lies above all letters of bytes."""
    return word[:-1] + chr(ord(word[-1]) + 512) if word else ""


class Automaton:
    """A trie of the vocabulary; every node has a failure link and the number of pieces popped on taking it.

    For the text of a node, the popped pieces are what greedy longest match has for certain settled once
    no longer match can follow, and the link leads to the node of what is left.  Every letter of a word
    then costs a constant number of steps on average.
    """

    def __init__(self, vocabulary: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        piece = [False]
        for word in vocabulary:
            at = 0
            for letter in word:
                to = self.next[at].get(letter)
                if to is None:
                    to = self.next[at][letter] = len(self.next)
                    self.next.append({})
                    piece.append(False)
                at = to
            piece[at] = piece[at] or bool(word)
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for letter, node in self.next[parent].items():
                queue.append(node)
                if piece[node]:
                    self.fail[node], self.popped[node] = 0, 1
                    continue
                link, pops = self.fail[parent], self.popped[parent]
                while link >= 0 and letter not in self.next[link]:
                    pops += self.popped[link]
                    link = self.fail[link]
                if link >= 0:
                    self.fail[node], self.popped[node] = self.next[link][letter], pops

    def count(self, word: str) -> int:
        """Pieces of greedy longest match; 1 (the unknown piece) where some rest matches nothing; 0 for the empty word."""
        at, n = 0, 0
        for letter in word:
            while letter not in self.next[at]:
                n += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return 1
            at = self.next[at][letter]
        while at:
            n += self.popped[at]
            at = self.fail[at]
            if at < 0:
                return 1
        return n


def read_vocabulary(path: str) -> list[str]:
    """Pieces of a tokenizer file, those with the word-end mark with a last letter that ends words."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)["model"]["vocab"]
    return sorted({ended(p.removesuffix(WORD_END)) if p.endswith(WORD_END) else p for p in found} - {""})


def token_counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n_chunks, n_words, n_pieces) of every whole text, in lower case.

    n_chunks counts space-separated words, n_words the parts of WORD_PATTERN, n_pieces their pieces over
    the UTF-8 bytes, greedily the longest at each place; the vocabulary marks ends of words as ``ended`` does.  Null, empty and blank texts count 0; a null doc_id stays null; rows repeat as given; other
    columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        automaton, pattern = Automaton(shared.value), re.compile(WORD_PATTERN)
        letters, seen = byte_letters(), {}

        def measure(chunk: str) -> tuple[int, int]:
            words = pattern.findall(chunk)
            return len(words), sum(automaton.count(ended("".join([letters[b] for b in w.encode()]))) for w in words)

        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for i in range(batch.num_rows):
                chunks = (batch.column(1)[i].as_py() or "").lower().split()
                for new in [c for c in set(chunks) if c not in seen]:
                    if len(seen) >= KEPT_WORDS:
                        seen.clear()
                    seen[new] = measure(new)
                got = [seen.get(c) or measure(c) for c in chunks]
                out[i] = len(chunks), sum(g[0] for g in got), sum(g[1] for g in got)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, k]) for k in range(3))], names=["doc_id", "n_chunks", "n_words", "n_pieces"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_chunks long, n_words long, n_pieces long")
