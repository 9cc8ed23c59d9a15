"""Benchmark decontamination: pigeonhole pieces of test items, exact piece hits, Myers bit-parallel distance."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item.
ERROR_RATE = 0.05
#: Characters that a piece must have; an item that is too short for its budget gets a smaller budget.
PIECE_CHARS = 16
#: Characters of items searched in one pass over the documents; more items take more passes.
BLOCK_CHARS = 32_000_000


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, trimmed; null as empty."""
    return " ".join((text or "").lower().split())


def budget(chars: int, error_rate: float = ERROR_RATE, piece_chars: int = PIECE_CHARS) -> int:
    """Edits allowed for an item of so many characters: its share, as long as every piece keeps its size."""
    return max(0, min(math.floor(error_rate * chars), chars // piece_chars - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 nearly equal parts: after so many edits at least one is still whole."""
    n = errors + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' bit-parallel search of one item in a window of text: least edits, and where the match ends."""

    def __init__(self, item: str) -> None:
        self.length = len(item)
        self.masks: dict[str, int] = {}
        for i, c in enumerate(item):
            self.masks[c] = self.masks.get(c, 0) | 1 << i
        self.full, self.top = (1 << self.length) - 1, 1 << (self.length - 1)

    def search(self, text: str) -> tuple[int, int]:
        """(distance, end) of the best match of the whole item with any stretch of ``text``; the first end among equals."""
        plus, minus, score, best, end = self.full, 0, self.length, self.length, 0
        full, top, masks = self.full, self.top, self.masks
        for i, c in enumerate(text):
            eq = masks.get(c, 0)
            d0 = (((eq & plus) + plus) ^ plus) | eq | minus
            hp = minus | (full & ~(d0 | plus))
            hn = plus & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            hp = hp << 1 & full
            plus = (hn << 1 & full) | (full & ~(d0 | hp))
            minus = hp & d0
        return best, end


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, at): every document and item found in it within the item's edit budget.

    Texts are compared in lower case with white space as single spaces.  An item of n characters may
    differ by ``budget(n)`` edits; it is cut into one piece more, each hit of a piece (one automaton
    over all pieces, once through every whole text) is checked by the bit-parallel distance in the window
    that the whole item can cover.  An item with budget 0 must occur exactly, as whole words.
    ``at`` is the place of the first hit that holds, in code points of the normal text.  Items go through in
    blocks of at most BLOCK_CHARS characters, each a pass over the documents, so the search never
    holds more than one block.

    Empty and null texts and items give no rows; a null doc_id stays null; repeated items (by id and text)
    count once, repeated documents each; other columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * size / BLOCK_CHARS))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance long, at long"
    found = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        wanted = sorted((r["item_id"], normal(r["text"])) for r in part.collect())
        shared = spark.sparkContext.broadcast([w for w in wanted if w[1]])
        hits = rows.mapInArrow(_searcher(shared, error_rate, piece_chars), schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def _searcher(shared, error_rate: float, piece_chars: int):
    def search(batches):
        import ahocorasick

        items = shared.value
        budgets = [budget(len(t), error_rate, piece_chars) for _, t in items]
        by_piece: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text) in enumerate(items):
            for offset, piece in pieces(text, budgets[i]):
                by_piece.setdefault(piece, []).append((i, offset))
        automaton = ahocorasick.Automaton()
        for piece, places in by_piece.items():
            automaton.add_word(piece, (len(piece), places))
        if by_piece:
            automaton.make_automaton()
        patterns: dict[int, Pattern] = {}
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_pylist()
            for row in range(batch.num_rows if by_piece else 0):
                text = normal(batch.column(1)[row].as_py())
                done: set[int] = set()
                tried: set[tuple[int, int]] = set()
                for last, (length, places) in automaton.iter(text):
                    start = last - length + 1
                    for i, offset in places:
                        if i in done:
                            continue
                        errors, whole = budgets[i], len(items[i][1])
                        begin = start - offset
                        if not errors:
                            if (begin == 0 or not text[begin - 1].isalnum()) and (begin + whole == len(text) or not text[begin + whole].isalnum()):
                                done.add(i)
                                out.append((ids[row], items[i][0], 0, begin))
                            continue
                        if (i, begin) in tried:
                            continue
                        tried.add((i, begin))
                        if i not in patterns:
                            patterns[i] = Pattern(items[i][1])
                        low = max(0, begin - errors)
                        distance, _ = patterns[i].search(text[low : begin + whole + errors])
                        if distance <= errors:
                            done.add(i)
                            out.append((ids[row], items[i][0], distance, max(0, begin)))
            columns = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "at"])

    return search
