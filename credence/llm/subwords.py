"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch's distinct units (a run of word marks and what follows up to the next mark) are laid out as one
flat symbol array.  A round finds the best pair rank of every segment by a segmented minimum, merges its
leftmost occurrences at once, and compacts the array, until no pair remains anywhere.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The letter that stands for a space, as the model format fixes it.
MARK = "▁"
#: Kinds of pieces, as the model format numbers them.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: What the unknown piece decodes to.
UNKNOWN_TEXT = " ⁇ "
#: Units whose ids a task keeps, at most, and the longest that is kept; when full it starts anew.
KEPT_UNITS = 400_000
KEPT_CHARS = 64
#: Texts that are parted into units together.
ROWS_AT_ONCE = 256
_NONE = np.iinfo(np.int32).max
_UNIT = re.compile(f"{MARK}+[^{MARK}]*")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: (number, whole number or bytes)."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = number() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
        yield tag >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, pair ranks and byte pieces of a SentencePiece BPE model with byte fallback and no character map.

    A symbol is a piece's id, or a number from ``len(pieces)`` for a character that only occurs inside pieces.
    ``pair_keys`` holds, sorted, every pair of symbols that together is a piece; ``pair_piece`` and the rank of
    that piece (equal scores have equal ranks; the lower the better) stand beside it.
    """

    _known: dict[bytes, Model] = {}

    @classmethod
    def of(cls, data: bytes) -> Model:
        """The model of a file's content; a worker builds it once."""
        if data not in cls._known:
            cls._known.clear()
            cls._known[data] = cls(data)
        return cls._known[data]

    def __init__(self, data: bytes) -> None:
        pieces, settings, normal = [], {}, {}
        for field, value in _fields(data):
            if field == 1:
                part = dict(_fields(value))
                pieces.append((part[1].decode(), struct.unpack("<f", part.get(2, bytes(4)))[0], part.get(3, NORMAL)))
            elif field == 2:
                settings = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        kinds = {kind for _, _, kind in pieces}
        # white space at the front, kept as it is and written as the mark; characters as they are
        if settings.get(3) != 2 or not settings.get(35) or settings.get(24) or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only BPE models with byte fallback, a mark before the text and unchanged characters are supported")
        if kinds & {USER_DEFINED, UNUSED} or BYTE not in kinds:
            raise ValueError("user-defined or unused pieces, or missing byte pieces, are not supported")
        self.size = len(pieces)
        whole = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        symbols = dict(whole)
        for text in whole:
            for letter in text:
                symbols.setdefault(letter, len(symbols) - len(whole) + self.size)
        scores = sorted({pieces[i][1] for i in whole.values()}, reverse=True)
        place = {score: rank for rank, score in enumerate(scores)}
        self.rank = np.full(self.size, _NONE, np.int32)
        self.rank[list(whole.values())] = [place[pieces[i][1]] for i in whole.values()]
        self.base = self.size + len(symbols)
        pairs = {}
        for text, i in whole.items():
            for cut in range(1, len(text)):
                left, right = symbols.get(text[:cut]), symbols.get(text[cut:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_piece = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int32)
        self.pair_rank = self.rank[self.pair_piece]
        # pieces that a better or equal one can grow out of
        grows = np.zeros(self.size, bool)
        for part in (self.pair_keys // self.base, self.pair_keys % self.base):
            real = part < self.size
            grows[part[real][self.pair_rank[real] <= self.rank[part[real]]]] = True
        self.grows = grows
        letters = sorted((ord(text), i) for text, i in symbols.items() if len(text) == 1)
        self.letter_codes = np.array([c for c, _ in letters], np.int64)
        self.letter_symbols = np.array([i for _, i in letters], np.int32)
        self.beside = np.array(sorted({ord(a) << 21 | ord(b) for text in whole for a, b in zip(text, text[1:])}), np.int64)
        self.byte_ids = np.zeros(256, np.int32)
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(text[3:5], 16)] = i
        self.mark = whole[MARK]
        # where pieces with two marks or more are runs of marks of the worst rank, runs are merged after all else
        runs = [i for text, i in whole.items() if text.count(MARK) > 1]
        worst = min((pieces[i][1] for i in runs), default=0.0)
        if any(pieces[i][0].strip(MARK) or pieces[i][1] != worst for i in runs) or any(s <= worst and len(t) > 1 and t.strip(MARK) for t, s, k in pieces if k == NORMAL) or any(MARK in text[1:] and text.strip(MARK) for text in whole):
            raise ValueError("marks inside pieces are not supported")
        self.longest_run = max((len(pieces[i][0]) for i in runs), default=1)
        meanings = [self._meaning(text, kind) for text, _, kind in pieces]
        self.decoded = pa.array([*meanings, *(m[1:] for m in meanings)], pa.binary())  # the second half without the mark before a text
        self.leads = np.array([kind == NORMAL and text.startswith(MARK) for text, _, kind in pieces])
        self.silent = np.array([kind == CONTROL for _, _, kind in pieces])
        self._runs: dict[int, np.ndarray] = {}

    @staticmethod
    def _meaning(text: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(text[3:5], 16)])
        if kind == CONTROL:
            return b""
        return UNKNOWN_TEXT.encode() if kind == UNKNOWN else text.replace(MARK, " ").encode()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and place in the pair table of each pair of symbols; _NONE where they are no piece."""
        keys = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.base + right, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], _NONE), at

    def merge(self, symbols: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of ``symbols`` when no pair within a ``segment`` (numbers that never fall) can merge.

        Returns the symbols, their segments, and the place of each symbol's first input symbol.  In a
        segment the pair of best rank goes first, the leftmost of equal ones.  All its occurrences of one
        round merge together, from the left up to the first whose piece can at once go on to a pair
        that is as good or better: that one has to come before the occurrences to its right.
        """
        symbols, segment, first = symbols.astype(np.int32), segment, np.arange(len(symbols))
        rank, at = np.full(len(symbols), _NONE, np.int32), np.zeros(len(symbols), np.int64)

        def look(where: np.ndarray) -> None:
            inside = where[(where >= 0) & (where + 1 < len(symbols))]
            inside = inside[segment[inside] == segment[inside + 1]]
            rank[inside], at[inside] = self._pairs(symbols[inside], symbols[inside + 1])

        look(np.arange(len(symbols)))
        done = []
        while len(symbols):
            starts = np.flatnonzero(np.diff(segment, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            over = best == _NONE
            if over.any():
                out = np.repeat(over, sizes)
                done.append((symbols[out], segment[out], first[out]))
                symbols, segment, first, rank, at = symbols[~out], segment[~out], first[~out], rank[~out], at[~out]
                starts, best, sizes = None, best[~over], sizes[~over]
                if not len(symbols):
                    break
            goal = np.repeat(best, sizes)
            hit = np.flatnonzero(rank == goal)
            # of pairs that overlap, every other one from the left
            run = np.diff(hit, prepend=-2) != 1
            begin = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - begin) % 2 == 0]
            new = self.pair_piece[at[hit]]
            stop = np.zeros(len(hit), bool)
            risky = np.flatnonzero(self.grows[new])
            if len(risky):
                stop[risky] = self._goes_on(symbols, segment, hit, new, risky, goal)
            if stop.any():
                head = np.diff(segment[hit], prepend=-1) != 0
                count = np.cumsum(stop) - stop
                hit_keep = count == np.repeat(count[head], np.diff(np.append(np.flatnonzero(head), len(hit))))
                hit, new = hit[hit_keep], new[hit_keep]
            symbols[hit] = new
            rank[hit] = _NONE
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            symbols, segment, first, rank, at = symbols[stay], segment[stay], first[stay], rank[stay], at[stay]
            now = hit - np.arange(len(hit))
            before = now - 1
            rank[before[before >= 0]] = _NONE
            look(np.concatenate([before, now]))
        if not done:
            return symbols, segment, first
        symbols, segment, first = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(first, kind="stable")
        return symbols[order], segment[order], first[order]

    def _goes_on(self, symbols, segment, hit, new, risky, goal) -> np.ndarray:
        """Whether the piece of each ``risky`` hit makes a pair as good as its own with what stands beside it, merged or not."""
        n, out = len(symbols), np.zeros(len(risky), bool)
        place, piece = hit[risky], new[risky]
        left, right = place - 1, place + 2
        left_in = (left >= 0) & (segment[np.maximum(left, 0)] == segment[place])
        right_in = (right < n) & (segment[np.minimum(right, n - 1)] == segment[place])
        before = np.where(left_in, symbols[np.maximum(left, 0)], -1)
        after = np.where(right_in, symbols[np.minimum(right, n - 1)], -1)
        prior = np.maximum(risky - 1, 0)
        next_one = np.minimum(risky + 1, len(hit) - 1)
        before_merged = np.where(left_in & (risky > 0) & (hit[prior] + 2 == place), new[prior], -1)
        after_merged = np.where(right_in & (next_one > risky) & (hit[next_one] == right), new[next_one], -1)
        for a, b in ((before, piece), (before_merged, piece), (piece, after), (piece, after_merged)):
            out |= self._pairs(a, b)[0] <= goal[place]
        return out

    def _mark_run(self, n: int) -> np.ndarray:
        """Ids of ``n`` marks in a row; runs grow from the left, so a long one starts with longest runs."""
        twice = 2 * self.longest_run
        if n <= 2 * twice:
            if n not in self._runs:
                self._runs[n] = self.merge(np.full(n, self.mark), np.zeros(n, np.int64))[0]
            return self._runs[n]
        whole = (n - twice) // self.longest_run
        return np.concatenate([np.repeat(self._mark_run(self.longest_run), whole), self._mark_run(n - whole * self.longest_run)])

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every unit: marks, then other characters."""
        marks = [len(u) - len(u.lstrip(MARK)) for u in units]
        text = "".join([u[m - 1 :] for u, m in zip(units, marks)])  # one mark and the rest
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.array([len(u) - m + 1 for u, m in zip(units, marks)], np.int64)
        unit = np.repeat(np.arange(len(units)), lengths)
        spot = np.minimum(np.searchsorted(self.letter_codes, codes), len(self.letter_codes) - 1)
        symbols = np.where(self.letter_codes[spot] == codes, self.letter_symbols[spot], -1)
        # a segment ends where no piece has the two characters side by side
        pair = codes[:-1] << 21 | codes[1:]
        seen = np.minimum(np.searchsorted(self.beside, pair), len(self.beside) - 1)
        apart = (self.beside[seen] != pair) | (unit[:-1] != unit[1:])
        segment = np.concatenate([[0], np.cumsum(apart)]) if len(codes) else np.zeros(0, np.int64)
        left, _, first = self.merge(symbols, segment)
        # symbols that are no piece are written as the bytes of their character
        bare = (left < 0) | (left >= self.size)
        spell = [chr(c).encode() for c in codes[first[bare]].tolist()]
        size = np.ones(len(left), np.int64)
        size[bare] = [len(s) for s in spell]
        ids = np.repeat(np.where(bare, 0, left), size).astype(np.int32)
        ids[np.repeat(bare, size)] = self.byte_ids[np.frombuffer(b"".join(spell), np.uint8)]
        counts = np.bincount(np.repeat(unit[first], size), minlength=len(units))
        whole, ends = ids.astype("<i4").tobytes(), (4 * np.cumsum(counts)).tolist()
        parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
        # further marks before the first one; it joins them where it has merged with nothing
        alone = int(self.mark).to_bytes(4, "little")
        for i in [i for i, m in enumerate(marks) if m > 1]:
            joins = parts[i].startswith(alone)
            parts[i] = self._mark_run(marks[i] if joins else marks[i] - 1).astype("<i4").tobytes() + parts[i][4 if joins else 0 :]
        return parts

    def decode_rows(self, ids: pa.ListArray) -> pa.Array:
        """Text of every row of ids."""
        flat = ids.flatten()
        numbers = flat.to_numpy(zero_copy_only=False)
        if len(numbers) and (numbers.min() < 0 or numbers.max() >= self.size):
            raise ValueError("an id is outside the vocabulary")
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
        # the mark before a text is no part of it; control ids before it do not count
        loud = np.flatnonzero(~self.silent[numbers])
        head = np.searchsorted(loud, offsets[:-1])
        some = head < np.searchsorted(loud, offsets[1:])
        opening = loud[head[some]]
        opening = opening[self.leads[numbers[opening]]]
        spelled = numbers.astype(np.int32)
        spelled[opening] += self.size
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), self.decoded.take(pa.array(spelled))), b"")
        try:
            return whole.cast(pa.string())
        except pa.ArrowInvalid:  # byte pieces that are no character
            return pa.array([b.decode("utf-8", "credence-each-byte") for b in whole.to_pylist()], pa.string())


codecs.register_error("credence-each-byte", lambda error: ("�", error.start + 1))


class Encoder:
    """Ids of texts through a bounded store of the ids of their units."""

    def __init__(self, model: Model, kept: int = KEPT_UNITS) -> None:
        self.model, self.kept, self.store = model, kept, {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        parts = [_UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        needed = set().union(*parts)
        new = [u for u in needed if u not in self.store]
        if len(self.store) + len(new) > self.kept:
            self.store, new = {}, list(needed)
        if new:
            self.store.update(zip(new, self.model.encode_units(new)))
        find = self.store.__getitem__
        out = [b"".join(map(find, p)) for p in parts]
        for unit in new:
            if len(unit) > KEPT_CHARS:
                del self.store[unit]
        return out


def _shared(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:  # a file of the driver; its content goes to the tasks
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, without begin or end ids.

    Null and empty texts have no ids; a null doc_id stays null; rows repeat as given; other columns are not
    read; an empty table gives no rows.  A text is parted before every run of spaces, which no piece
    spans; a run of characters without a space is one unit of any length.
    """
    shared = _shared(docs, model_path)

    def run(batches):
        encoder = Encoder(Model.of(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                rows = encoder(part.column(1).fill_null("").to_pylist())
                offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids).

    Null and empty ids are the empty text; a null id among them is the unknown piece.  Bytes that form no character become the
    replacement character each; an id outside the vocabulary raises ValueError.
    """
    shared = _shared(encoded, model_path)

    def run(batches):
        model = Model.of(shared.value)
        for batch in batches:
            ids = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, model.decode_rows(ids)], names=["doc_id", "ids", "text"])

    whole = F.transform(F.coalesce("ids", F.array().cast("array<int>")), lambda i: F.coalesce(i, F.lit(0)))
    return encoded.select("doc_id", whole.alias("ids")).mapInArrow(run, f"doc_id {dict(encoded.dtypes)['doc_id']}, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of rows (doc_id, ids, text)."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))
