"""Language-model scoring: a hierarchical Pitman-Yor model, its seating sampled by Gibbs, predictions averaged over samples.

Two levels of restaurants over a uniform base.  The dish is a token.  Every context (the token before, or
the start of a text) has a restaurant of its own; every table there is a customer of the one parent
restaurant that all contexts share; tables of the parent draw from the uniform base over the V
training tokens and one for all others.

Tokens are dealt to buckets by token, so all that one token's restaurants entries need is in one
bucket: counts by context, tables, the parent's tables.  Frequent tokens (at most HOT of them can be)
are dealt by token and context instead, and their parent counts meet in one short list.  A restaurant lies in
as many buckets as its tokens: after every sweep the buckets send its tables, by context, to parts, which
add them up and return the sums to the buckets that have the context.  Buckets stay where they are, in a table
that Spark has bucketed; only these sums, as many as there are contexts in buckets, are shuffled.  Scores go back
as one small array per block of documents and bucket.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import mix, text_bytes, text_words, written
from credence.session import run_dir

#: Contexts of buckets that are added up in one part, about: one for 32 bytes of text.
CONTEXTS = 1 << 20
#: Discount and strength of the context restaurants and of the parent.
DISCOUNT, STRENGTH = (0.8, 0.6), (2.0, 2.0)
#: Gibbs sweeps over all seatings, and how many of the last are averaged.
SWEEPS, AVERAGED = 3, 2
#: Customers up to which the weights of table counts are kept in full.
STIRLING_ROWS = 1024
#: Share of all tokens from which a token is dealt by context too; so at most 1 / HOT_SHARE tokens are.
HOT_SHARE = 5e-4
#: Share of all tokens from which a context travels as its place in a list of at most 1 / NAMED_SHARE; others as their hash.
NAMED_SHARE = 1e-5
#: Bytes of text per bucket, which bounds a task; least buckets; documents and tokens per block.
BUCKET_BYTES, LEAST_BUCKETS, BLOCK_DOCS, BLOCK_TOKENS = 16 << 20, 32, 16384, 2 << 20
#: Documents whose crc32 of the id as text leaves this remainder are held out of training.
FOLDS, HELD_OUT = 7, 2

#: A bucket's sums for a document travel as whole numbers of 1 / SCORE_UNIT and 1 / BASE_UNIT; they are added exactly.
SCORE_UNIT, BASE_UNIT = float(1 << 24), float(1 << 32)

#: What buckets tell the driver: of frequent tokens the parent's customers and the count, and sums over the others.
HOT_CUSTOMERS, HOT_COUNT, TOTAL = 0, 1, 2
CUSTOMERS, TABLES, WORDS, TOKENS = range(4)

_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(doc_id: int | None) -> bool:
    """Whether a document is left out of training; a null id counts as the text "null"."""
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers as rows of their low, next, ... bytes (as many as the greatest needs), so that equal high bytes compress to nothing."""
    head, body = [struct.pack("<B", len(arrays))], []
    for values in arrays:
        wide = np.ascontiguousarray(values).astype(np.int64).view(np.uint64)
        size = (int(wide.max()).bit_length() + 7) // 8 if len(wide) else 0
        head.append(struct.pack("<QB", len(wide), size))
        body.append(wide.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = [struct.unpack_from("<QB", raw, 1 + 9 * i) for i in range(raw[0])]
    at, out = 1 + 9 * raw[0], []
    for n, size in sizes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out.append(wide.view(np.int64).ravel())
        at += n * size
    return out


def _steps(ascending: np.ndarray) -> np.ndarray:
    """The first of an ascending list and the steps from each to the next; np.cumsum undoes it."""
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def _steps_in(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Steps within runs that ascend and begin at ``first``, each run's first value as it is."""
    out = np.diff(values, prepend=0)
    out[first] = values[first]
    return out


def _from_steps_in(steps: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.cumsum(steps)
    return sums - np.repeat(sums[first] - steps[first], np.diff(np.append(first, len(steps))))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def bucketed(df: DataFrame, name: str, column: str, n: int) -> DataFrame:
    """The rows as a table in the shared folder that Spark has bucketed by a column, so that grouping by it shuffles none of them again."""
    path = run_dir(df.sparkSession, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.bucketBy(n, column).option("path", path).saveAsTable(table, format="parquet")
    return df.sparkSession.table(table)


def tokens(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a run of texts with one end each, their contexts (the token before, in full), and the row of each."""
    rows = np.repeat(np.arange(len(counts)), counts + 1)
    ends = np.cumsum(counts + 1) - 1
    token = np.empty(len(rows), np.uint64)
    inner = np.ones(len(rows), bool)
    inner[ends] = False
    token[inner], token[ends] = hashes, _END
    before = np.empty(len(rows), np.uint64)
    before[1:] = token[:-1]
    before[ends - counts] = _START
    return token, before, rows


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens that may make up HOT_SHARE and NAMED_SHARE of all: each task sends what reaches half the latter share of its own.

    Only where tokens are dealt to and how contexts are written depends on these lists, never a count.
    """

    def count(batches):
        held, total = [], 0

        def out():
            values, numbers = np.unique(np.concatenate(held), return_counts=True)
            often = numbers >= 0.5 * NAMED_SHARE * numbers.sum()
            return pa.RecordBatch.from_arrays([pa.array(np.append(values[often], 0).view(np.int64)), pa.array(np.append(numbers[often], numbers.sum()).astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for _, _, hashes, counts in text_words(batch.column(0)):
                held += [hashes, np.full(len(counts), _END)]
                total += len(hashes) + len(counts)
                if total > 2_000_000:
                    yield out()
                    held, total = [], 0
        if held:
            yield out()

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = rows.where("token = 0").agg(F.sum("n")).first()[0] or 0
    often = rows.where((F.col("token") != 0) & (F.col("n") >= NAMED_SHARE * total)).select("token", (F.col("n") >= HOT_SHARE * total).alias("hot")).toArrow()  # at most 1 / NAMED_SHARE rows
    token = often["token"].to_numpy().astype(np.int64).view(np.uint64)
    return np.sort(token[often["hot"].to_numpy()]), np.sort(token)


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Place of each value in an ascending list, -1 where it is not there."""
    if not len(ordered):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return np.where(ordered[at] == values, at, -1)


def dealt(docs: DataFrame, hot: np.ndarray, named: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of documents as (block, bucket, payload): per bucket the tokens with context and document, per block its documents (kind 1).

    A block is named by its partition and running number there, so rows must come from a written table, whose partitions a retry reads alike.
    A context is a place in ``named`` or, behind these, in the payload's own list.
    """
    shared = docs.sparkSession.sparkContext.broadcast((hot, named))

    def deal(batches):
        (frequent, listed), running = shared.value, itertools.count()

        def out(ids, counts, hashes):
            # documents in training come first, so a document's number tells whether it is held out
            outside = np.array([held_out(i) for i in ids])
            order = np.argsort(outside, kind="stable")
            number = np.empty(len(ids), np.int64)
            number[order] = np.arange(len(ids))
            token, before, row = tokens(hashes, counts)
            spread = np.where(_among(token, frequent) >= 0, mix(token + mix(before) * np.uint64(0x9E3779B97F4A7C15)), mix(token))
            bucket = (spread % np.uint64(buckets)).astype(np.int64)
            context = _among(before, listed)
            rare = context < 0
            others, place = np.unique(before[rare], return_inverse=True)
            context[rare] = len(listed) + place
            doc = number[row]
            place = np.lexsort((context << 16 | doc, token, bucket))
            token, context, doc, bucket = token[place], context[place], doc[place], bucket[place]
            block = TaskContext.get().partitionId() << 32 | next(running)
            n_train = int((~outside).sum())
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(cuts)):
                x, y = cuts[b], cuts[b + 1]
                first = _runs(token[x:y])
                code = context[x:y].copy()
                own, place = np.unique(code[code >= len(listed)], return_inverse=True)
                code[code >= len(listed)] = len(listed) + place
                rows.append((block, int(b), 0, _pack(_steps(token[x:y][first]), np.diff(np.append(first, y - x)), _steps_in(code, first), _steps(others[own - len(listed)]), doc[x:y], [n_train])))
            ids = [ids[i] for i in order]
            rows.append((block, zlib.crc32(str(block).encode()) % buckets, 1, _pack([0 if i is None else i for i in ids], [i is None for i in ids], outside[order], (counts + 1)[order])))
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.binary())], names=["block", "bucket", "kind", "payload"])

        ids, counts, hashes, size = [], [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for start, end, found, per_text in text_words(batch.column(1)):
                for i in range(start, end, BLOCK_DOCS):
                    n = per_text[i - start : i - start + BLOCK_DOCS]
                    skip = int(per_text[: i - start].sum())
                    ids += names[i : i + len(n)]
                    counts.append(n)
                    hashes.append(found[skip : skip + int(n.sum())])
                    size += len(hashes[-1])
                    if size >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                        yield out(ids, np.concatenate(counts), np.concatenate(hashes))
                        ids, counts, hashes, size = [], [], [], 0
        if ids:
            yield out(ids, np.concatenate(counts), np.concatenate(hashes))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(deal, "block long, bucket int, kind int, payload binary")


def gathered(parts: DataFrame, named: np.ndarray, buckets: int) -> DataFrame:
    """One row per bucket: ``seats`` (what sampling needs), ``names`` (its contexts) and ``full`` (all entries and where they occur), and the blocks' rows."""
    shared = parts.sparkSession.sparkContext.broadcast(named)

    def gather(key, table):
        kinds, payloads, blocks = table["kind"].to_pylist(), table["payload"], table["block"].to_pylist()
        rows = [(key[0].as_py(), b, None, None, p.as_py()) for b, k, p in zip(blocks, kinds, payloads) if k]
        names = sorted(b for b, k in zip(blocks, kinds) if not k)
        at = {b: i for i, (b, k) in enumerate(zip(blocks, kinds)) if not k}
        listed, got = shared.value, []
        used = np.zeros(len(listed), bool)
        for b in names:
            word, times, code, own, doc, n_train = _unpack(payloads[at[b]].as_py())
            code = _from_steps_in(code, np.cumsum(times) - times)
            used[code[code < len(listed)]] = True
            got.append((np.cumsum(word.view(np.uint64)), times, code, np.cumsum(own.view(np.uint64)), doc.astype(np.uint16), int(n_train[0])))
        if got:
            words = np.unique(np.concatenate([g[0] for g in got]))
            contexts = np.unique(np.concatenate([listed[used], *(g[3] for g in got)]))
            known = np.searchsorted(contexts, listed)
            keys, train = [], []
            for word, times, code, own, doc, n_train in got:
                context, rare = np.empty(len(code), np.int64), code >= len(listed)
                context[~rare] = known[code[~rare]]
                context[rare] = np.searchsorted(contexts, own)[code[rare] - len(listed)]
                keys.append(np.repeat(np.searchsorted(words, word), times) * len(contexts) + context)
                train.append(doc < n_train)
            sizes = [len(k) for k in keys]
            entries, where = np.unique(np.concatenate(keys), return_inverse=True)
            count = np.bincount(where[np.concatenate(train)], minlength=len(entries))
            word, context = entries // len(contexts), entries % len(contexts)
            many, one = count > 1, count == 1
            seats = _pack(_steps(words), _steps(word[many]), _steps_in(context[many], _runs(word[many])), count[many], np.bincount(word[one], minlength=len(words)),
                          np.bincount(context[one], minlength=len(contexts)), np.bincount(context, count, len(contexts)))
            entry, doc, start = [], [], 0
            for size, g in zip(sizes, got):
                place = where[start : start + size]
                order = np.argsort(place, kind="stable")
                entry.append(_steps(place[order]))
                doc.append(g[4][order])
                start += size
            full = _pack(_steps(word), _steps_in(context, _runs(word)), count, np.concatenate(entry), np.concatenate(doc), sizes, names)
            rows.append((key[0].as_py(), None, seats, _pack(_steps(contexts)), full))
        columns = list(zip(*rows))
        return pa.table({"bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int64()), "seats": pa.array(columns[2], pa.binary()), "names": pa.array(columns[3], pa.binary()), "full": pa.array(columns[4], pa.binary())})

    return parts.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(gather, "bucket int, block long, seats binary, names binary, full binary")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma of positive values: Stirling's series six steps up."""
    low = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5)
    y = x + 6
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) - np.log(low)


@cache
def _small_stirling(discount: float) -> np.ndarray:
    """ln S(n, t) for n up to STIRLING_ROWS: S(n + 1, t) = S(n, t - 1) + (n - discount * t) S(n, t)."""
    rows = np.full((STIRLING_ROWS + 1, STIRLING_ROWS + 1), -np.inf)
    rows[1, 1] = 0
    t = np.arange(1, STIRLING_ROWS + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, STIRLING_ROWS):
            rows[n + 1, 1:] = np.logaddexp(rows[n, :-1], rows[n, 1:] + np.log(np.maximum(n - discount * t, 0)))
    return rows


@lru_cache(512)
def log_stirling(n: int, most: int, discount: float) -> np.ndarray:
    """ln S(n, t) for t = 1 to ``most``, up to one constant: the summed weight of all ways to seat n customers at t tables.

    S(n, t) t! discount**t / n! is the coefficient of x**n in (1 - (1 - x)**discount)**t.  Beyond STIRLING_ROWS it is summed
    as a series in n**-discount while that converges without cancellation (t <= 2 n**discount), then taken at the
    saddle point, whose error is some thousandths of the probability of a table count there.
    """
    if n <= STIRLING_ROWS:
        return _small_stirling(discount)[n, 1 : most + 1]
    t = np.arange(1, most + 1, dtype=float)
    near = min(most, int(2 * n**discount))
    out = np.empty(most)
    top = _log_gamma(np.array([n + 1.0]))[0]
    for start in range(0, near, 1024):
        x = t[start : min(start + 1024, near), None]
        j = np.arange(1, min(float(x[-1, 0]), 120) + 1)[None, :]
        size = _log_gamma(x + 1) - _log_gamma(j + 1) - _log_gamma(np.maximum(x - j, 0) + 1) + _log_gamma(1 + j * discount) + _log_gamma(n - j * discount) - top
        terms = np.where(j <= x, np.where(j % 2 == 1, 1, -1) * np.sin(np.pi * discount * j), 0)
        high = size[:, :1]
        out[start : start + len(x)] = high[:, 0] + np.log(np.maximum((terms * np.exp(size - high)).sum(axis=1) / np.pi, 1e-300))
    if most > near:
        far = t[near:]
        low, up = np.full(len(far), -700.0), np.full(len(far), -1e-15)  # ln (1 - x) of the saddle point
        for _ in range(70):
            y = (low + up) / 2
            over = far * discount * np.expm1(y) * np.exp((discount - 1) * y) / np.expm1(discount * y) > n
            low, up = np.where(over, y, low), np.where(over, up, y)
        x, g = -np.expm1(y), -np.expm1(discount * y)
        first = discount * x * np.exp((discount - 1) * y)
        second = first + discount * (1 - discount) * x * x * np.exp((discount - 2) * y)
        out[near:] = far * np.log(g) - n * np.log(x) - 0.5 * np.log(2 * np.pi * far * (second / g - (first / g) ** 2))
    return out - _log_gamma(t + 1) - t * np.log(discount)


def seat(count: np.ndarray, new: np.ndarray, discount: float, rng: np.random.Generator, draws: int | None = None) -> np.ndarray:
    """Tables of each dish's customers in its restaurant, drawn given all others.

    A seating weighs ``new`` for every table times what the customers that join one meet, so t tables of n customers have the
    probability S(n, t) new**t over its sum, S the generalized Stirling numbers; t is drawn from just that, and
    what was seated before does not matter.  It is at most one more than a Poisson number of mean new / discount,
    whose tail is left out from 1e-12.  One draw is exact; ``draws`` has no effect.
    """
    tables = np.ones(len(count), np.int64)
    order = np.lexsort((new, count))
    order = order[np.searchsorted(count[order], 2) :]
    values, starts = np.unique(count[order], return_index=True)
    for n, start, end in zip(values.tolist(), starts, np.append(starts[1:], len(order))):
        while start < end:
            mean = float(new[order[min(end, start + (1 << 14)) - 1]]) / discount
            most = int(min(n, np.ceil(mean + 8 * np.sqrt(mean) + 30)))
            part = order[start : min(end, start + min(1 << 14, max(1, (1 << 19) // most)))]
            start += len(part)
            if most > 64:  # so that lengths recur
                most = min(n, 1 << (most - 1).bit_length())
            weight = log_stirling(n, most, discount)[None, :] + np.log(np.maximum(new[part], 1e-300))[:, None] * np.arange(1, most + 1)
            weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[part] = 1 + (weight < (rng.random(len(part)) * weight[:, -1])[:, None]).sum(axis=1)
    return tables


class Shared:
    """What a bucket knows of one sample: tables of its contexts, the parent's customers and tables in all, and the frequent tokens' parent counts."""

    def __init__(self, context: np.ndarray, customers: int, tables: int, hot_customers: np.ndarray, hot_tables: np.ndarray) -> None:
        self.context, self.customers, self.tables = context, customers, tables
        self.hot_customers, self.hot_tables = hot_customers, hot_tables


def parent_share(customers: np.ndarray, tables: np.ndarray, shared: Shared, vocabulary: int, own: np.ndarray | int = 0) -> np.ndarray:
    """The parent's probability of tokens with so many customers and tables there, ``own`` of the customers taken away."""
    left = customers - own
    kept = np.minimum(tables, left)
    base = (STRENGTH[1] + DISCOUNT[1] * (shared.tables - (tables - kept))) / (vocabulary + 1)
    return (np.maximum(left - DISCOUNT[1] * kept, 0) + base) / (STRENGTH[1] + shared.customers - own)


class Bucket:
    """Seatings of one bucket; the draws follow from its number and the sample's, so a task that is run again repeats them."""

    def __init__(self, number: int, blob: bytes, hot: np.ndarray, state: bytes | None = None) -> None:
        words, word, context, self.count, self.single_word, self.single_context, self.in_context = _unpack(blob)
        self.words, self.word = np.cumsum(words.view(np.uint64)), np.cumsum(word)
        self.context = _from_steps_in(context, _runs(self.word))
        self.number, self.hot = number, _among(self.words, hot)
        self.seats, self.parent_tables = _unpack(state) if state is not None else (np.ones(len(self.count), np.int64), None)

    def state(self) -> bytes:
        return _pack(self.seats, self.parent_tables)

    def customers(self) -> np.ndarray:
        return self.single_word + np.bincount(self.word, self.seats, len(self.words)).astype(np.int64)

    def trained(self) -> np.ndarray:
        return self.single_word + np.bincount(self.word, self.count, len(self.words)).astype(np.int64)

    def in_contexts(self) -> np.ndarray:
        """Tables of each context here."""
        return self.single_context + np.bincount(self.context, self.seats, len(self.single_context)).astype(np.int64)

    def totals(self, customers: np.ndarray, shared: Shared | None) -> tuple[np.ndarray, np.ndarray]:
        """The parent's customers and tables of each token, those of frequent tokens from the list."""
        tables = self.parent_tables if self.parent_tables is not None else (customers > 0).astype(np.int64)
        if shared is None or not (self.hot >= 0).any():
            return customers, tables
        often = self.hot >= 0
        customers, tables = customers.copy(), tables.copy()
        customers[often], tables[often] = shared.hot_customers[self.hot[often]], shared.hot_tables[self.hot[often]]
        return customers, tables

    def sweep(self, s: int, shared: Shared, vocabulary: int) -> None:
        """Draws all seatings of the contexts, each given the others of the sample before, then the parent's."""
        rng = np.random.default_rng([self.number, s])
        customers, tables = self.totals(self.customers(), shared)
        share = parent_share(customers[self.word], tables[self.word], shared, vocabulary, self.seats)
        new = (STRENGTH[0] + DISCOUNT[0] * (shared.context[self.context] - self.seats)) * share
        self.seats = seat(self.count, new, DISCOUNT[0], rng)
        base = (STRENGTH[1] + DISCOUNT[1] * shared.tables) / (vocabulary + 1)
        now = self.customers()
        self.parent_tables = np.where(now > 0, seat(now, np.full(len(now), base), DISCOUNT[1], rng), 0)

    def told(self) -> list[tuple[int, int, int]]:
        """(kind, key, value) for the driver: two for each frequent token, and totals."""
        customers, plain, trained = self.customers(), self.hot < 0, self.trained()
        tables = self.totals(customers, None)[1]
        rows = [(HOT_CUSTOMERS, int(self.hot[i]), int(customers[i])) for i in np.flatnonzero(~plain)] + [(HOT_COUNT, int(self.hot[i]), int(trained[i])) for i in np.flatnonzero(~plain)]
        return rows + [(TOTAL, CUSTOMERS, int(customers[plain].sum())), (TOTAL, TABLES, int(tables[plain].sum())), (TOTAL, WORDS, int((trained[plain] > 0).sum())), (TOTAL, TOKENS, int(trained.sum()))]


def _sums(rows: DataFrame) -> dict:
    """Sums over all buckets of what they tell, by (kind, key): at most two for each frequent token, and totals."""
    return {(r["kind"], r["key"]): r["value"] for r in rows.groupBy("kind", "key").agg(F.sum("value").alias("value")).collect()}


def _first(table: DataFrame, hot: np.ndarray) -> DataFrame:
    """What buckets tell before the first sweep, when every entry has one table."""
    shared = table.sparkSession.sparkContext.broadcast(hot)

    def tell(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                kinds, keys, values = zip(*Bucket(number, blob.as_py(), shared.value).told())
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(values, pa.int64())], names=["kind", "key", "value"])

    return table.where("seats is not null").select("bucket", "seats").mapInArrow(tell, "kind int, key long, value long")


def _part(contexts: np.ndarray, parts: int) -> np.ndarray:
    """The part that adds up a context: ranges of the hash, so that ascending contexts have ascending parts."""
    return ((contexts >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices(part: np.ndarray, parts: int) -> list[tuple[int, int, int]]:
    cuts = np.searchsorted(part, np.arange(parts + 1))
    return [(int(p), int(cuts[p]), int(cuts[p + 1])) for p in np.flatnonzero(np.diff(cuts))]


def context_index(table: DataFrame, parts: int) -> DataFrame:
    """(part, bucket, ids, cut, tables, customers): numbers within the part of the contexts a bucket has there, and tables before the first sweep and customers of each over all buckets."""

    def ask(batches):
        for batch in batches:
            for number, seats, names in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                b, contexts = Bucket(number, seats.as_py(), np.zeros(0, np.uint64)), np.cumsum(_unpack(names.as_py())[0].view(np.uint64))
                tables = b.in_contexts()
                rows = [(p, number, _pack(_steps(contexts[x:y]), tables[x:y], b.in_context[x:y])) for p, x, y in _slices(_part(contexts, parts), parts)]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["part", "bucket", "payload"])

    def number(key, group):
        asked = [_unpack(p.as_py()) for p in group["payload"]]
        names = [np.cumsum(a[0].view(np.uint64)) for a in asked]
        known, at = np.unique(np.concatenate(names), return_inverse=True)
        tables, customers = (np.bincount(at, np.concatenate([a[i] for a in asked]), len(known)) for i in (1, 2))
        at = np.split(at, np.cumsum([len(n) for n in names])[:-1])
        return pa.table({
            "part": pa.array([key[0].as_py()] * len(at), pa.int32()), "bucket": group["bucket"], "ids": pa.array([_pack(_steps(a)) for a in at], pa.binary()),
            "tables": pa.array([_pack(tables[a]) for a in at], pa.binary()), "customers": pa.array([_pack(customers[a]) for a in at], pa.binary()),
        })

    asked = table.where("seats is not null").select("bucket", "seats", "names").mapInArrow(ask, "part int, bucket int, payload binary")
    rows = asked.repartition(parts, "part").groupBy("part").applyInArrow(number, "part int, bucket int, ids binary, tables binary, customers binary")
    return bucketed(rows, "contexts", "part", parts)


def _added(index: DataFrame, sent: DataFrame) -> DataFrame:
    """(bucket, part, payload): of the contexts a bucket has in a part, the tables over all buckets."""

    def add(numbers, group):
        ids = dict(zip(numbers["bucket"].to_pylist(), (np.cumsum(_unpack(i.as_py())[0]) for i in numbers["ids"])))
        buckets = group["bucket"].to_pylist()
        tables = np.zeros(max(int(i[-1]) for i in ids.values()) + 1, np.int64)
        for b, p in zip(buckets, group["payload"]):
            tables[ids[b]] += _unpack(p.as_py())[0]
        return pa.table({"bucket": group["bucket"], "part": group["part"], "payload": pa.array([_pack(tables[ids[b]]) for b in buckets], pa.binary())})

    numbers = index.select("part", "bucket", "ids").groupBy("part")
    return numbers.cogroup(sent.where("part is not null").select("part", "bucket", "payload").groupBy("part")).applyInArrow(add, "bucket int, part int, payload binary")


def _news(rows: DataFrame, sample: int, kind: str) -> DataFrame:
    return rows.select("bucket", F.lit(sample).alias("sample"), F.lit(kind).alias("kind"), "part", "payload")


def _by_kind(news: pa.Table) -> dict[tuple[int, str], list[bytes]]:
    """Payloads by (sample, kind), in the order of parts."""
    out: dict[tuple[int, str], list[bytes]] = {}
    for _, s, kind, blob in sorted(zip(news["part"].to_pylist(), news["sample"].to_pylist(), news["kind"].to_pylist(), news["payload"].to_pylist()), key=lambda r: -1 if r[0] is None else r[0]):
        out.setdefault((s, kind), []).append(blob)
    return out


def _whole(blobs: list[bytes]) -> np.ndarray:
    return np.concatenate([_unpack(b)[0] for b in blobs])


def _swept(table: DataFrame, news: DataFrame, hot: np.ndarray, s: int, sample: tuple, vocabulary: int, parts: int) -> DataFrame:
    """One sweep: rows with a part are tables by context to be added up there; without, the bucket's state, or what it tells."""
    shared = table.sparkSession.sparkContext.broadcast((hot, sample, vocabulary))

    def sweep(key, left, right):
        often, before, size = shared.value
        rows = []
        for seats, names in zip(left["seats"], left["names"]):
            got, number = _by_kind(right), key[0].as_py()
            b = Bucket(number, seats.as_py(), often, got[s, "state"][0] if (s, "state") in got else None)
            b.sweep(s, Shared(_whole(got[s, "tables"]), *before), size)
            tables, contexts = b.in_contexts(), np.cumsum(_unpack(names.as_py())[0].view(np.uint64))
            rows += [(number, p, _pack(tables[x:y]), None, None, None) for p, x, y in _slices(_part(contexts, parts), parts)]
            rows += [(number, None, b.state(), None, None, None), *((number, None, None, *told) for told in b.told())]
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [("bucket", pa.int32()), ("part", pa.int32()), ("payload", pa.binary()), ("kind", pa.int32()), ("key", pa.int64()), ("value", pa.int64())]
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(kinds, columns)})

    rows = table.where("seats is not null").select("bucket", "seats", "names").groupBy("bucket").cogroup(news.groupBy("bucket"))
    return written(rows.applyInArrow(sweep, "bucket int, part int, payload binary, kind int, key long, value long"), "sweep")


def _scores(table: DataFrame, news: DataFrame, hot: np.ndarray, samples: list[tuple], facts: dict) -> DataFrame:
    """(block, payload): per bucket and block the documents' sums of -log10 probability, of log10 (count + 1), and known tokens."""
    shared = table.sparkSession.sparkContext.broadcast((hot, samples, facts))

    def score(key, left, right):
        often, before, known = shared.value
        rows = []
        for seats, blob in zip(left["seats"], left["full"]):
            got, number = _by_kind(right), key[0].as_py()
            word, context, count, entry, doc, sizes, names = _unpack(blob.as_py())
            word = np.cumsum(word)
            context = _from_steps_in(context, _runs(word))
            many, total, customers = np.flatnonzero(count > 1), np.zeros(len(word)), _whole(got[0, "customers"])
            averaged = range(len(before) - min(AVERAGED, len(before) - 1), len(before))
            for s in averaged:
                b = Bucket(number, seats.as_py(), often, got[s, "state"][0])
                own = Shared(_whole(got[s, "tables"]), *before[s])
                share = parent_share(*b.totals(b.customers(), own), own, known["vocabulary"])
                tables = (count > 0).astype(np.int64)
                tables[many] = b.seats
                rest = STRENGTH[0] + DISCOUNT[0] * own.context[context]
                total += (count - DISCOUNT[0] * tables + rest * share[word]) / (STRENGTH[0] + customers[context])
            log = -np.log10(total / len(averaged))
            trained = b.trained()
            trained[b.hot >= 0] = known["hot_count"][b.hot[b.hot >= 0]]
            base = np.log10(trained + 1.0)
            at = 0
            for name, size in zip(names.tolist(), sizes.tolist()):
                e, d = np.cumsum(entry[at : at + size]), doc[at : at + size]
                at += size
                docs, place = np.unique(d, return_inverse=True)
                rows.append((name, _pack(_steps(docs), np.rint(np.bincount(place, log[e]) * SCORE_UNIT), np.rint(np.bincount(place, base[word[e]]) * BASE_UNIT), np.bincount(place, trained[word[e]] > 0))))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int64()), "payload": pa.array([r[1] for r in rows], pa.binary())})

    rows = table.where("seats is not null").select("bucket", "seats", "full").groupBy("bucket").cogroup(news.groupBy("bucket"))
    return rows.applyInArrow(score, "block long, payload binary")


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Null and empty texts are one end token; a null doc_id is kept (as the text "null" for the fold); repeated rows
    are learned from and scored each; other columns are not read; an empty table gives no rows.  Without a training
    document all tokens are unknown and the model is the uniform base.
    """
    docs = written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "scored", compression="zstd")
    hot, named = frequent_tokens(docs)
    _, size = text_bytes(docs)
    buckets, parts = max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), max(LEAST_BUCKETS // 4, -(-size // (32 * CONTEXTS)))
    table = bucketed(gathered(dealt(docs, hot, named, buckets), named, buckets), "seats", "bucket", buckets)
    index = context_index(table, parts)
    sums = _sums(_first(table, hot))
    hot_count = np.array([sums.get((HOT_COUNT, i), 0) for i in range(len(hot))], np.int64)
    n, v = sums.get((TOTAL, TOKENS), 0), sums.get((TOTAL, WORDS), 0) + int((hot_count > 0).sum())
    samples: list[tuple] = []
    news = [_news(index.withColumn("payload", F.col("tables")), 0, "tables")]
    for s in range(SWEEPS + 1):
        if s:
            swept = _swept(table, news[-2].unionByName(news[-1]) if s > 1 else news[-1], hot, s - 1, samples[-1], v, parts)
            sums = _sums(swept.where("kind is not null"))
            news += [_news(swept.where("part is null and kind is null"), s, "state"), _news(_added(index, swept), s, "tables")]
        hot_customers = np.array([sums.get((HOT_CUSTOMERS, i), 0) for i in range(len(hot))], np.int64)
        if s:
            base = (STRENGTH[1] + DISCOUNT[1] * samples[-1][1]) / (v + 1)
            drawn = seat(hot_customers, np.full(len(hot), base), DISCOUNT[1], np.random.default_rng([1 << 40, s]))
        else:
            drawn = np.ones(len(hot), np.int64)
        hot_tables = np.where(hot_customers > 0, drawn, 0)
        samples.append((sums.get((TOTAL, CUSTOMERS), 0) + int(hot_customers.sum()), sums.get((TOTAL, TABLES), 0) + int(hot_tables.sum()), hot_customers, hot_tables))
    last = _news(index.withColumn("payload", F.col("customers")), 0, "customers")
    for rows in news[-2 * min(AVERAGED, SWEEPS) :]:
        last = last.unionByName(rows)
    scored = _scores(table, last, hot, samples, {"vocabulary": v, "hot_count": hot_count}).select("block", F.lit(0).alias("kind"), "payload")
    meta = table.where("block is not null").select("block", F.lit(1).alias("kind"), F.col("full").alias("payload"))
    constant = -np.log10(float(n + 1 * (v + 1)))

    def total(group: pa.Table) -> pa.Table:
        kinds = group["kind"].to_pylist()
        ids, null, outside, tokens_in = _unpack(group["payload"][kinds.index(1)].as_py())
        size = len(ids)
        score, base, known = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
        for kind, blob in zip(kinds, group["payload"]):
            if not kind:
                steps, *sums = _unpack(blob.as_py())
                at = np.cumsum(steps)
                for whole, part in zip((score, base, known), sums):
                    whole[at] += part
        return pa.table({
            "doc_id": pa.array(ids, mask=null.astype(bool)), "held_out": pa.array(outside.astype(bool)), "n_tokens": pa.array(tokens_in), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(size, n, np.int64)), "base_score": pa.array(base / BASE_UNIT + tokens_in * constant), "score": pa.array(-score / SCORE_UNIT),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.unionByName(meta).groupBy("block").applyInArrow(total, schema)
