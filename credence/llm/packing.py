"""Packing by vector bins: tokens, segments and loss-bearing tokens are limited at once."""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of a sequence: tokens, segments, loss-bearing tokens.
MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS_TOKENS = 4096
#: Token that ends every document.
END_ID = 2
#: A task packs its rows in groups of at most so many pieces or tokens, which bounds its memory.
GROUP_PIECES = 4096
GROUP_TOKENS = 4_000_000
#: Words whose ids a task keeps, at most; when full it starts anew.
KEPT_WORDS = 800_000

#: What the white-space-wise fast path leaves to the tokenizer: its special tokens, and characters whose
#: class as white space differs between regular-expression engines.
#: A word of letters with one run of signs after it that can not be part of a contraction.
_ENDED = re.compile(r"([^\W\d_]+)([.,;:!?*#%&$|]+)$")
_ODD = re.compile("<\\||[\x1c-\x1f\x85᠎​﻿]")


def place(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin of every item: the dot-product heuristic.

    One bin is open at a time.  Among the items that fit in all dimensions, the one with the greatest
    sum over dimensions of (weight * size * room left) goes in; the weight of a dimension is its share
    of demand.  Ties fall to the larger item, then to the first.  A bin is closed when nothing fits.  An
    item over a limit raises ValueError.
    """
    n, dims = sizes.shape
    if not n:
        return np.zeros(0, np.int64)
    share = sizes / limits
    if (share > 1).any():
        raise ValueError("an item is over a limit of an empty bin")
    weight = share.sum(0) / max(share.sum(), 1e-12)
    order = np.lexsort((np.arange(n), -(share @ weight)))
    columns = [np.ascontiguousarray(sizes[order, d]) for d in range(dims)]
    scale = weight / limits.astype(float) ** 2
    bins, current = np.full(n, -1, np.int64), 0
    waiting = np.arange(n)
    while len(waiting):
        room = [int(x) for x in limits]
        left, sizes_left = waiting, [c[waiting] for c in columns]
        while True:
            score = sum(sizes_left[d] * (scale[d] * room[d]) for d in range(dims))
            best = int(score.argmax())
            bins[left[best]] = current
            room = [room[d] - int(sizes_left[d][best]) for d in range(dims)]
            fits = sizes_left[0] <= room[0]
            for d in range(1, dims):
                fits &= sizes_left[d] <= room[d]
            fits[best] = False
            left = left[fits]
            if not len(left):
                break
            sizes_left = [c[fits] for c in sizes_left]
        current += 1
        waiting = waiting[bins[waiting] < 0]
    out = np.empty(n, np.int64)
    out[order] = bins
    return out


def pack_examples(examples: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS_TOKENS) -> DataFrame:
    """Whole examples (example_id, n_tokens, n_loss) into sequences: (example_id, sequence_id, offset).

    For instruction data, where n_loss counts the tokens of the answers.  Every partition packs its
    rows in bounded groups, so nothing is shuffled; sequence ids are unique over the table.  An
    example over a limit stands alone (nothing is dropped); null sizes count as 0; rows repeat as given;
    other columns are not read.
    """
    limits = np.array([max_tokens, max_segments, max_loss])

    def pack(batches):
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_PIECES):
                part = batch.slice(at, GROUP_PIECES)
                tokens, loss = (np.asarray(part.column(i).fill_null(0)).astype(np.int64) for i in (1, 2))
                sizes = np.stack([tokens, np.ones_like(tokens), loss], 1)
                bins = place(np.minimum(sizes, limits), limits)
                offsets = _offsets(bins, tokens)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bins + sequence), pa.array(offsets)], names=["example_id", "sequence_id", "offset"])
                sequence += int(bins.max(initial=-1)) + 1

    rows = examples.select("example_id", F.col("n_tokens").cast("long"), F.col("n_loss").cast("long"))
    return rows.mapInArrow(pack, f"example_id {dict(rows.dtypes)['example_id']}, sequence_id long, offset long")


def _offsets(bins: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Tokens before each item in its bin, in item order."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(tokens[order]) - tokens[order]
    first = np.flatnonzero(np.diff(bins[order], prepend=-1))
    base = np.repeat(before[first], np.diff(np.append(first, len(order))))
    out = np.empty(len(bins), np.int64)
    out[order] = before - base
    return out


def _odd(text: str) -> bool:
    if text.isascii():
        return any(sign in text for sign in ("<|", "\x1c", "\x1d", "\x1e", "\x1f"))
    return _ODD.search(text) is not None


class WordIds:
    """Token ids of texts through a bounded store of the ids of their words.

    White space always parts tokens in this kind of tokenizer, so a text's ids are those of its
    space-separated, lower-cased words one after another; each new word is tokenized once.  The store
    outlives a task: the next task of the same worker finds it filled.
    """

    _known: dict[str, WordIds] = {}

    @classmethod
    def of(cls, tokenizer_json: str) -> WordIds:
        if tokenizer_json not in cls._known:
            cls._known.clear()
            cls._known[tokenizer_json] = cls(tokenizer_json)
        return cls._known[tokenizer_json]

    def __init__(self, tokenizer_json: str, kept: int = KEPT_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.kept, self.store = kept, {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that end a word
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _add(self, new: list[str], parted: dict[str, re.Match]) -> None:
        plain = [w for w in new if w.isalpha()]  # one word-end piece closes each, so one call serves many
        for start in range(0, len(plain), 512):
            run = plain[start : start + 512]
            ids = self._ids(" ".join(run))
            ends = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist()
            if len(ends) == len(run):
                whole = ids.tobytes()
                self.store.update(zip(run, [whole[x:y] for x, y in zip([0, *ends], ends)]))
        for word in new:
            if word not in self.store:
                ended = parted.get(word)
                if ended and ended[1] in self.store:  # letters, then one run of signs: two words to the tokenizer
                    if ended[2] not in self.store:
                        self.store[ended[2]] = self._encode(ended[2])
                    self.store[word] = self.store[ended[1]] + self.store[ended[2]]
                else:
                    self.store[word] = self._encode(word)

    def _words(self, text: str) -> list[str]:
        simple = "Σ" not in text and unicodedata.is_normalized("NFC", text)  # the sigma's small form depends on its place for str.lower
        return (text.lower() if simple else self.tokenizer.normalizer.normalize_str(text)).split()

    def __call__(self, texts: list[str]) -> list[bytes]:
        parts = [None if _odd(t) else self._words(t) for t in texts]
        needed = set().union(*(p for p in parts if p))
        if 2 * len(needed) > self.kept:
            return [self._encode(t) for t in texts]
        new = [w for w in needed if w not in self.store]
        if len(self.store) + 2 * len(new) > self.kept:
            self.store, new = {}, list(needed)
        parted = {w: m for w, m in zip(new, map(_ENDED.match, new)) if m}
        stems = {m[1] for m in parted.values()}
        self._add(list(dict.fromkeys([*(w for w in stems if w not in self.store), *new])), parted)
        find = self.store.__getitem__
        return [self._encode(t) if p is None else b"".join(map(find, p)) for t, p in zip(texts, parts)]


def pack_documents(
    docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS_TOKENS, end_id: int = END_ID,
) -> DataFrame:
    """Every token of every document in one sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``.  It is cut only into runs of ``max_tokens``; the rest, or a
    shorter document, is one piece.  All its tokens bear loss but the first, which nothing precedes.
    Tokenizing, cutting and packing happen in one pass over each partition, in bounded groups, without
    a shuffle; a lost task is simply run again.  ``pad_to`` of a sequence is its own length where that
    is a power of two, else ``max_tokens``.

    Null and empty texts are documents of one token; a null doc_id is kept as null; repeated rows are
    packed each; an empty table gives no rows; other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:  # a file of the driver; its content goes to the tasks
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    limits = np.array([max_tokens, max_segments, max_loss])
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, pad_to long"

    def flush(pieces: list[tuple], sequence: int) -> tuple[pa.RecordBatch, int]:
        cols = np.array([p[1:] for p in pieces], np.int64).reshape(-1, 4)
        length = cols[:, 1]
        bins = place(np.stack([length, np.ones_like(length), length - (cols[:, 0] == 0)], 1), limits)
        total = np.bincount(bins, length).astype(np.int64)
        pad = np.where(total & (total - 1) == 0, total, max_tokens)[bins]
        arrays = [pa.array([p[0] for p in pieces], pa.int64()), *(pa.array(cols[:, i]) for i in range(4)), pa.array(bins + sequence), pa.array(_offsets(bins, length)), pa.array(pad)]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")]), sequence + int(bins.max()) + 1

    def pack(batches):
        ids_of = WordIds.of(shared.value)
        sequence, pieces, tokens = TaskContext.get().partitionId() << 33, [], 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 256):
                texts = batch.column(1).slice(at, 256).fill_null("").to_pylist()
                for doc_id, body in zip(ids[at : at + 256], ids_of(texts)):
                    whole = memoryview(body + end)
                    n = len(whole) // 4
                    for start in range(0, n, max_tokens):
                        length = min(max_tokens, n - start)
                        pieces.append((doc_id, start, length, zlib.crc32(whole[4 * start : 4 * (start + length)]), n))
                    tokens += n
                    if len(pieces) >= GROUP_PIECES or tokens >= GROUP_TOKENS:
                        done, sequence = flush(pieces, sequence)
                        yield done
                        pieces, tokens = [], 0
        if pieces:
            yield flush(pieces, sequence)[0]

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(pack, schema)
