"""Ranked lexical search: MaxScore whose bounds are tightened by term-pair intersection lists.

The index holds blocks of documents; a block has its postings, and for every query term the greatest
impact.  For pairs of query terms it also has the documents that hold both and their greatest joint impact.
A query bounds what its less telling terms can still add: a pair adds at most the greatest of either
term alone and of both in one document, which is less than the sum of the two.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.llm.common import slices, text_buffer, words, written

#: Documents returned for an item.
TOP = 20
#: Documents and words of a block, at most (one longer text stands alone).
BLOCK_DOCS = 2048
BLOCK_WORDS = 4_000_000
#: Characters of items that go through the index in one pass, about.
ITEM_CHARS = 4_000_000
#: Terms of a text: maximal runs of ASCII letters and digits and of all characters beyond ASCII.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

# each byte, or a space where it is in no term
_PLAIN = np.full(256, 0x20, np.uint8)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _PLAIN[_low:_high] = np.arange(_low, _high)
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})

INDEX = T.StructType([
    T.StructField("docs", T.LongType()), T.StructField("words", T.LongType()), T.StructField("doc_ids", T.BinaryType()), T.StructField("null_ids", T.BinaryType()),
    T.StructField("lengths", T.BinaryType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("places", T.BinaryType()), T.StructField("tfs", T.BinaryType())])
LISTS = T.StructType([
    T.StructField("doc_ids", T.BinaryType()), T.StructField("null_ids", T.BinaryType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("places", T.BinaryType()),
    T.StructField("impacts", T.BinaryType()), T.StructField("most", T.BinaryType()), T.StructField("pairs", T.BinaryType()), T.StructField("pair_counts", T.BinaryType()),
    T.StructField("pair_places", T.BinaryType()), T.StructField("pair_most", T.BinaryType())])
FOUND = "item long, doc_id long, score long"


def terms_of(text: str | None) -> list[str]:
    """Terms of a text in order, A-Z in lower case."""
    return TERM.findall((text or "").translate(_LOWER))


def _hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms of a run of texts, and their number per text."""
    return words(offsets - offsets[0], _PLAIN[data[offsets[0] : offsets[-1]]])


def hash_terms(terms: list[str]) -> np.ndarray:
    offsets, data = text_buffer(pa.array(terms, pa.string()))
    return _hashes(offsets, data)[0] if terms else np.zeros(0, np.uint64)


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each count, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def build_index(docs: DataFrame) -> DataFrame:
    """Postings of all terms of all documents, in blocks of at most BLOCK_DOCS documents, as written by one task each.

    A block has its number of documents with a term and of terms, per document id and number of terms,
    per term (its hash, ascending) the number of documents, and per posting the document's place in the block
    and the term's occurrences.  A document without a term is in no block.
    """

    def block(ids: list, lengths: list, hashes: list) -> pa.RecordBatch:
        size, terms = np.concatenate(lengths), np.concatenate(hashes)
        order = np.argsort(terms, kind="stable")  # documents stay in order within a term
        terms, place = terms[order], np.repeat(np.arange(len(size), dtype=np.int32), size)[order]
        fresh = np.ones(len(terms), bool)
        fresh[1:] = (terms[1:] != terms[:-1]) | (place[1:] != place[:-1])
        at = np.flatnonzero(fresh)
        tf = np.diff(np.append(at, len(terms)))
        terms, place = terms[at], place[at]
        head = np.flatnonzero(np.append(True, terms[1:] != terms[:-1]))
        doc_ids = pa.concat_arrays(ids)
        row = [len(size), int(size.sum()), np.asarray(doc_ids.fill_null(0), "<i8"), np.asarray(doc_ids.is_null(), np.uint8), size.astype("<i4"), terms[head].astype("<u8"),
               np.diff(np.append(head, len(terms))).astype("<i4"), place.astype("<i4"), tf.astype("<i4")]
        return pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, int) else v.tobytes()]) for v in row], names=INDEX.names)

    def run(batches):
        ids, lengths, hashes, n, held = [], [], [], 0, 0
        for batch in batches:
            offsets, data = text_buffer(batch.column(1))
            for start, end in slices(offsets):
                found, sizes = _hashes(offsets[start : end + 1], data)
                with_term = np.flatnonzero(sizes)
                ends = np.cumsum(sizes)
                for low in range(0, len(with_term), BLOCK_DOCS):
                    some = with_term[low : low + BLOCK_DOCS]
                    first, last = some[0], some[-1]
                    if n and (n + len(some) > BLOCK_DOCS or held + int(sizes[some].sum()) > BLOCK_WORDS):
                        yield block(ids, lengths, hashes)
                        ids, lengths, hashes, n, held = [], [], [], 0, 0
                    ids.append(batch.column(0).slice(start, end - start).take(pa.array(some)))
                    lengths.append(sizes[some])
                    hashes.append(found[ends[first] - sizes[first] : ends[last]])
                    n, held = n + len(some), held + len(hashes[-1])
        if n:
            yield block(ids, lengths, hashes)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX)


class Queries:
    """Items of one pass: their terms with repeats, and the pairs of terms whose joint impacts bound them."""

    def __init__(self, texts: list[str | None]) -> None:
        found = [terms_of(t) for t in texts]
        spelled = sorted({t for ts in found for t in ts})
        hashes = hash_terms(spelled)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {spelled[o]: i for i, o in enumerate(order.tolist())}
        self.items = [dict(Counter(number[t] for t in ts)) for ts in found]
        self.weights = np.zeros(len(hashes), np.int64)
        self.pairs: list[tuple[int, int]] = []

    def weigh(self, df: np.ndarray, docs: int) -> None:
        """Weights from the documents of each term; an item's terms of neighbouring weight are its pairs, so that both enter a bound together."""
        self.weights = np.array([weight(int(n), docs) for n in df.tolist()], np.int64)
        self.partners: list[dict[int, int]] = []
        for times in self.items:
            known = sorted((t for t in times if df[t]), key=lambda t: (self.weights[t] * times[t], t))
            couples = list(zip(known[::2], known[1::2]))
            self.partners.append({t: o for a, b in couples for t, o in ((a, b), (b, a))})
        self.pairs = sorted({(min(c), max(c)) for partners in self.partners for c in partners.items()})
        self.pair_number = {p: i for i, p in enumerate(self.pairs)}


def pair_lists(index: DataFrame, queries, total_docs: int, total_words: int) -> DataFrame:
    """The blocks with what queries need: postings of query terms as impacts, the greatest impact of each term, and, for each pair
    of ``queries``, the documents with both terms and their greatest joint impact."""

    def run(batches):
        wanted = queries.value
        pairs = np.array(wanted.pairs, np.int64).reshape(-1, 2)
        for batch in batches:
            for row in batch.to_pylist():
                lengths, terms = np.frombuffer(row["lengths"], "<i4").astype(np.int64), np.frombuffer(row["terms"], "<u8")
                counts, places, tfs = (np.frombuffer(row[c], "<i4").astype(np.int64) for c in ("counts", "places", "tfs"))
                starts = np.cumsum(counts) - counts
                spot = np.searchsorted(terms, wanted.hashes)
                there = np.flatnonzero((spot < len(terms)) & (terms[np.minimum(spot, len(terms) - 1)] == wanted.hashes))
                spot = spot[there]
                at = _ragged(starts[spot], counts[spot])
                counts = counts[spot]
                m = 75 + 25 * lengths * total_docs // total_words  # 100 - 25 + ...
                place, tf = places[at], tfs[at]
                impact = np.repeat(wanted.weights[there], counts) * (1_000_000_000 * tf // (1000 * tf + 12 * m[place]))
                ends = np.cumsum(counts)
                most = np.maximum.reduceat(impact, ends - counts) if len(ends) else impact
                # both terms in a block: a posting of the shorter list is looked up in the longer
                local = np.full(len(wanted.hashes), -1, np.int64)
                local[there] = np.arange(len(there))
                a, b = local[pairs[:, 0]], local[pairs[:, 1]]
                met = np.flatnonzero((a >= 0) & (b >= 0))
                a, b = a[met], b[met]
                swap = counts[a] > counts[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                own = _ragged(ends[a] - counts[a], counts[a])
                keys = np.repeat(np.arange(len(counts)), counts) * len(lengths) + place
                probe = np.repeat(b, counts[a]) * len(lengths) + place[own]
                hit = np.minimum(np.searchsorted(keys, probe), max(len(keys) - 1, 0))
                both = np.flatnonzero(keys[hit] == probe) if len(keys) else np.zeros(0, np.int64)
                of = np.repeat(np.arange(len(met)), counts[a])[both]
                joint = impact[own[both]] + impact[hit[both]]
                head = np.flatnonzero(np.diff(of, prepend=-1))
                values = [row["doc_ids"], row["null_ids"], there.astype("<i4"), counts.astype("<i4"), place.astype("<i4"), impact.astype("<i8"), most.astype("<i8"), met[of[head]].astype("<i4"),
                          np.diff(np.append(head, len(of))).astype("<i4"), place[own[both]].astype("<i4"), (np.maximum.reduceat(joint, head) if len(head) else joint).astype("<i8")]
                yield pa.RecordBatch.from_arrays([pa.array([v if isinstance(v, bytes) else v.tobytes()], pa.binary()) for v in values], names=LISTS.names)

    return index.mapInArrow(run, LISTS)


class Block:
    """One block's lists, ready for queries."""

    def __init__(self, row: dict) -> None:
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.doc_ids, self.null_ids = read("doc_ids", "<i8"), read("null_ids", np.uint8)
        ends = np.cumsum(read("counts", "<i4"))
        places, impacts = read("places", "<i4"), read("impacts", "<i8")
        self.most = dict(zip(read("terms", "<i4").tolist(), read("most", "<i8").tolist()))
        self.lists = {t: (places[a:b], impacts[a:b]) for t, a, b in zip(self.most, [0, *ends.tolist()], ends.tolist())}
        self.pair_most = dict(zip(read("pairs", "<i4").tolist(), read("pair_most", "<i8").tolist()))
        ends, places = np.cumsum(read("pair_counts", "<i4")).tolist(), read("pair_places", "<i4")
        self.pair_lists = {p: places[a:b] for p, a, b in zip(self.pair_most, [0, *ends], ends)}
        self.room = np.zeros(len(self.doc_ids), np.int64)
        self.scored = self.skipped = 0

    def bounds(self, queries: Queries, item: int, paired: bool = True) -> list[tuple[int, int, int]]:
        """(term, repeats, bound) of the item's terms that occur here, the least telling first; the bound is of what all terms up to this one add together.

        A term adds its greatest impact.  Where the other term of its pair is before it, the two add at most the greatest of
        either alone and, if documents hold both, of both together.
        """
        times, partners = queries.items[item], queries.partners[item]
        here = sorted((self.most[t] * n, t, n) for t, n in times.items() if self.most.get(t))
        out, total, alone = [], 0, {}
        for most, t, n in here:
            other = partners.get(t) if paired else None
            if other in alone:
                joint = self.pair_most.get(queries.pair_number[(t, other) if t < other else (other, t)], 0)
                total += min(most, max(most, joint * max(n, times[other])) - alone[other])
            else:
                total += most
            alone[t] = most
            out.append((t, n, total))
        return out

    def _add(self, term: int, times: int, rows: np.ndarray | None, into: np.ndarray) -> None:
        """Adds a term's impacts: to all documents' sums, or to those of ``rows`` (ascending places) only."""
        places, impacts = self.lists[term]
        if rows is None:
            into[places] += times * impacts
            self.scored += len(places)
            return
        at = np.minimum(np.searchsorted(places, rows), len(places) - 1)
        into += np.where(places[at] == rows, times * impacts[at], 0)
        self.scored += len(rows)

    def _first_threshold(self, queries: Queries, item: int, known: list[tuple[int, int, int]], top: int) -> int:
        """The ``top``-th whole score among documents that hold the item's most telling pair; 0 where too few do."""
        partners = queries.partners[item]
        numbers = {queries.pair_number[min(t, o), max(t, o)]: t for t, o in partners.items()}
        leads = max((p for p in numbers if len(self.pair_lists.get(p, ())) >= top), key=lambda p: self.pair_most[p], default=None)
        if leads is None:
            return 0
        rows = self.pair_lists[leads]
        if len(rows) > 4 * top:
            places, impacts = self.lists[numbers[leads]]
            rows = np.sort(rows[np.argsort(-impacts[np.searchsorted(places, rows)], kind="stable")[: 4 * top]])
        sums = np.zeros(len(rows), np.int64)
        for t, n, _ in known:
            self._add(t, n, rows, sums)
        return int(np.partition(sums, len(sums) - top)[-top])

    def search(self, queries: Queries, item: int, least: int, top: int = TOP, paired: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that can be among the ``top`` with a score of ``least`` or more."""
        known = self.bounds(queries, item, paired)
        nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not known or known[-1][2] < least:
            self.skipped += 1
            return nothing
        if least <= 1:
            least = max(1, self._first_threshold(queries, item, known, top))
        bounds = [b for _, _, b in known]
        essential = bisect_left(bounds, least)  # the terms before can not reach it together
        sums = self.room
        for t, n, _ in known[essential:]:
            self._add(t, n, None, sums)
        rest = bounds[essential - 1] if essential else 0
        rows = np.flatnonzero(sums > max(0, least - rest - 1))
        if len(rows) > top:
            least = max(least, int(np.partition(sums[rows], len(rows) - top)[-top]))
            rows = rows[sums[rows] + rest >= least]
        scores = sums[rows]
        sums[:] = 0
        for g in range(essential - 1, -1, -1):
            if not len(rows):
                return nothing
            self._add(known[g][0], known[g][1], rows, scores)
            rest = bounds[g - 1] if g else 0
            if len(rows) > top:
                least = max(least, int(np.partition(scores, len(rows) - top)[-top]))
            stay = scores + rest >= least
            if not stay.all():
                rows, scores = rows[stay], scores[stay]
        return rows, scores


def _searcher(queries, thresholds, top: int):
    def run(batches):
        wanted = queries.value
        n = len(wanted.items)
        least = list(thresholds)
        best: list[list[tuple[int, bool, int]]] = [[] for _ in range(n)]
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                for item in range(n):
                    rows, scores = block.search(wanted, item, least[item], top)
                    if not len(rows):
                        continue
                    order = np.lexsort((block.doc_ids[rows], block.null_ids[rows], -scores))[:top]
                    rows, scores = rows[order], scores[order]
                    new = zip((-scores).tolist(), (block.null_ids[rows] > 0).tolist(), block.doc_ids[rows].tolist())
                    best[item] = sorted([*best[item], *new])[:top]
                    if len(best[item]) == top:
                        least[item] = max(least[item], -best[item][-1][0])
        rows = [(i, None if null else doc_id, -score) for i, found in enumerate(best) for score, null, doc_id in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["item", "doc_id", "score"])

    return run


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _document_counts(index: DataFrame, hashes) -> DataFrame:
    """(term, df): documents that hold each query term, from the blocks' term counts alone."""

    def run(batches):
        wanted = hashes.value
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column(0), batch.column(1)):
                terms, counts = np.frombuffer(terms.as_py(), "<u8"), np.frombuffer(counts.as_py(), "<i4")
                spot = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
                total += np.where(terms[spot] == wanted, counts[spot], 0)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "df"])

    return index.select("terms", "counts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def rank(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of highest score for every row of ``items``.

    The documents are indexed once, in blocks; items go through the index in passes of about ITEM_CHARS
    characters (dealt by hash), which bounds what a pass holds and sends to the tasks.  A pass counts the
    documents of its terms, writes the blocks' impact and pair lists, searches every block with a threshold per
    item that rises as its task goes on, and ranks the few rows per task and item together.

    A null or empty text has no term: such a document is not counted and never found, such an item
    finds nothing.  Repeated documents are each counted and found, repeated items ranked each; a null doc_id
    stands after all others of equal score, a null item_id stays null; equal scores rank by doc_id; other columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    index = written(build_index(docs), "lexical-index")
    total = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    size = rows.agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1)).first()[0] or 0
    passes = max(1, math.ceil(2 * size / ITEM_CHARS))
    result = None
    for number in range(passes):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number) if passes > 1 else rows
        chosen = part.collect()  # at most about ITEM_CHARS characters
        queries = Queries([r["text"] for r in chosen])
        df = np.zeros(len(queries.hashes), np.int64)
        for r in _document_counts(index, spark.sparkContext.broadcast(queries.hashes)).toLocalIterator():
            df[r["term"]] = r["df"]
        queries.weigh(df, int(total[0]))
        shared = spark.sparkContext.broadcast(queries)
        lists = written(pair_lists(index, shared, int(total[0]), max(int(total[1]), 1)), "lexical-lists")
        # what a single block reaches, all blocks together reach
        first = lists.limit(1).mapInArrow(_searcher(shared, [1] * len(chosen), top), FOUND)
        reached = {r["item"]: r["least"] for r in first.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") == top).collect()}
        found = lists.mapInArrow(_searcher(shared, [reached.get(i, 1) for i in range(len(chosen))], top), FOUND)
        place = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(chosen)], "item long, item_id long")
        ranked = ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
        result = ranked if result is None else result.unionByName(ranked)
    return result
