"""Ranked lexical search by pair-bound MaxScore, against scoring every document."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from credence.llm import lexical

DOCS = "doc_id long, text string, rank int, score long, item_id long"
ITEMS = "item_id long, text string, doc_id long"


def brute(docs, items, top=lexical.TOP):
    """(item row, rank, doc_id, score) by scoring every document for every item."""
    split = [(d, Counter(ts), len(ts)) for d, ts in ((d, lexical.terms_of(t)) for d, t in docs) if ts]
    n_docs, total = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, counts, _ in split for t in counts)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts, n in split:
            m = 100 - 25 + (25 * n * n_docs) // total
            score = 0
            for t in lexical.terms_of(text):
                if t in counts:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * counts[t]) // (1000 * counts[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    rows = lexical.rank(spark.createDataFrame([(d, t, 7, 7, 7) for d, t in docs], DOCS), spark.createDataFrame([(i, t, 7) for i, t in items], ITEMS), **options)
    assert rows.columns == ["item_id", "rank", "doc_id", "score"] and dict(rows.dtypes)["rank"] == "int"
    return sorted(map(tuple, rows.collect()), key=str)


def corpus(n, seed, words=400):
    dice = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(dice.choices(vocabulary, weights, k=dice.randint(1, 60)))) for i in range(n)]


def test_terms():
    assert lexical.terms_of("Ab-cÉ_9x\x7f\tÄ ﬁ.Z@[`{") == ["ab", "cÉ", "9x", "Ä", "ﬁ", "z"] and lexical.terms_of(None) == []
    texts = ["Ab-cÉ_9x", "ab CÉ", "é"]
    flat = [t for text in texts for t in lexical.terms_of(text)]
    hashes = lexical.hash_terms(flat)
    assert len(set(hashes.tolist())) == len(set(flat))
    assert lexical.hash_terms(["ab"])[0] == hashes[0]


@pytest.mark.parametrize("block", [7, 100, 2048])
def test_against_scoring_all(spark, monkeypatch, block):
    docs = corpus(600, block)
    items = [(i, t) for i, t in corpus(25, block + 1)] + [(99, "w0 w0 w1 nowhere w399"), (98, "nowhere"), (97, "w1")]
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    assert index.agg({"docs": "max"}).first()[0] <= block and index.agg({"docs": "sum"}).first()[0] == 600
    assert found(spark, docs, items) == brute(docs, items)


def test_pair_bounds_hold_and_skip_more():
    """Blocks built by hand: the pair bound is no less than any sum of impacts, no more than the sum of the terms' own, and leaves fewer postings to read."""
    docs, items = corpus(1500, 5, 120), corpus(40, 6, 120)
    queries = lexical.Queries([t for _, t in items])
    rows = [Counter(lexical.terms_of(t)) for _, t in docs]
    words = sorted({t for r in rows for t in r} & {t for _, text in items for t in lexical.terms_of(text)})
    number = dict(zip(words, np.searchsorted(queries.hashes, lexical.hash_terms(words)).tolist()))
    df = np.zeros(len(queries.hashes), np.int64)
    for t, n in Counter(t for r in rows for t in r if t in number).items():
        df[number[t]] = n
    queries.weigh(df, len(docs))
    weights = {t: lexical.weight(int(df[i]), len(docs)) for t, i in number.items()}
    impacts = [{number[t]: weights[t] * (10**9 * tf // (1000 * tf + 1200)) for t, tf in r.items() if t in number} for r in rows]
    by_term = {t: [(p, r[t]) for p, r in enumerate(impacts) if t in r] for t in number.values()}
    terms = sorted(t for t in by_term if by_term[t])
    pairs = [(k, [(p, r[a] + r[b]) for p, r in enumerate(impacts) if a in r and b in r]) for k, (a, b) in enumerate(queries.pairs)]
    pairs = [(k, rows) for k, rows in pairs if rows]
    pack = lambda values, kind: np.array(list(values), kind).tobytes()
    block = lexical.Block({
        "doc_ids": pack(range(1500), "<i8"), "null_ids": pack([0] * 1500, np.uint8), "terms": pack(terms, "<i4"), "counts": pack([len(by_term[t]) for t in terms], "<i4"),
        "places": pack([p for t in terms for p, _ in by_term[t]], "<i4"), "impacts": pack([v for t in terms for _, v in by_term[t]], "<i8"), "most": pack([max(v for _, v in by_term[t]) for t in terms], "<i8"),
        "pairs": pack([k for k, _ in pairs], "<i4"), "pair_counts": pack([len(r) for _, r in pairs], "<i4"), "pair_places": pack([p for _, r in pairs for p, _ in r], "<i4"), "pair_most": pack([max(v for _, v in r) for _, r in pairs], "<i8")})
    read = {}
    for paired in (True, False):
        block.scored = 0
        for item in range(len(items)):
            known = block.bounds(queries, item, paired)
            for place, row in enumerate(impacts):
                sums = np.cumsum([row.get(t, 0) * n for t, n, _ in known])
                assert all(s <= b for s, (_, _, b) in zip(sums.tolist(), known))
            if paired:
                assert all(b <= a for (_, _, b), (_, _, a) in zip(known, block.bounds(queries, item, False)))
            whole = np.array([sum(row.get(t, 0) * n for t, n, _ in known) for row in impacts])
            least = int(np.sort(whole)[-lexical.TOP])
            places, scores = block.search(queries, item, max(least, 1), paired=paired)
            assert scores.tolist() == whole[places].tolist()
            assert set(np.flatnonzero(whole >= max(least, 1)).tolist()) <= set(places.tolist())
            assert not block.room.any()
        read[paired] = block.scored
    assert read[True] < read[False]


def test_odd_rows(spark):
    same = "alpha beta gamma"
    docs = [(1, None), (2, ""), (3, " .,;\n"), (5, same), (4, same), (4, same), (None, same), (None, same), (6, "alpha " * 50_000), (7, "ÉTÉ alpha-beta"), (-8, "beta ALPHA gamma")]
    items = [(1, same), (1, same), (2, None), (3, ""), (None, "alpha été"), (4, "beta beta"), (5, "...")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, top=2) == brute(docs, items, 2)
    many = [(i % 37, same) for i in range(100)]  # more equal scores than places
    assert found(spark, many, items) == brute(many, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []


def test_items_in_passes(spark, monkeypatch):
    docs, items = corpus(200, 1), corpus(30, 2)
    monkeypatch.setattr(lexical, "ITEM_CHARS", 1500)
    assert found(spark, docs, items) == brute(docs, items)
