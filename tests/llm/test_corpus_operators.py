"""Operators of credence.llm against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import itertools
import json
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from credence.llm import common, decontamination, importance, neardup, packing, pii, pitman_yor, rules, warc, wordpiece, wrappers
from credence.llm.queries import R

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, n int"


def corpus(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 977} and" for i in range(30_000))
    same = "one two three four five six seven eight nine ten"
    return corpus(spark, [(1, None), (2, ""), (3, " \n\t "), (4, same), (5, same), (5, same), (None, same), (6, long), (7, "É ñ 😀 ﬁ Σ\x1c <|endoftext|>"), (8, "x")])


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


# helpers


def test_words_and_grams_agree_with_splitting():
    import pyarrow as pa

    rows = ["Ab cd\tef", "", "x", "ab\x0bCD  ef g ", "\n"]
    offsets, data = common.text_buffer(pa.array([*rows, None]))
    hashes, counts = common.words(offsets, data)
    assert counts.tolist() == [3, 0, 1, 4, 0, 0]
    assert hashes[:3].tolist() == hashes[4:7].tolist() and len(set(hashes.tolist())) == 5
    two, n = common.grams(hashes, counts, 2)
    assert n.tolist() == [2, 0, 1, 3, 0, 0] and two[0] == two[3] and two[1] == two[4]
    assert list(common.slices(np.array([0, 5, 5, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7)], "a long, b long")
    assert sorted(map(tuple, common.components(edges).collect())) == [(1, 1), (3, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
    assert common.components(edges.limit(0)).count() == 0


def test_greatest_with_ties(spark):
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, -1, 3, 2, 3, -7])], "id long, v double")
    for k in range(8):
        got = {r.id for r in common.mark_greatest(rows, F.col("v"), k, F.col("id"), "top").where("top").collect()}
        assert got == {i for _, i in sorted((-v, i) for i, v in enumerate([3, -1, 3, 2, 3, -7]))[:k]}


# 1


def test_scores_base_and_fold(spark, folder):
    docs = {i: [*plain_words(t), None] for i, t in texts(spark, folder).items()}
    counts = Counter(w for i, ws in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = R.queries["op1_pitman_yor"](spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = docs[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_base_probabilities_sum_to_one(spark):
    """The base of every training token and of one token for all others."""
    words = ["a", "b", "a", "c\u00c9", "B"]
    docs = corpus(spark, [(1, " ".join(words)), (2, ""), (3, "a"), (4, "b"), (5, "c\u00c9"), (6, "new"), (7, None)])
    kept = {i: t for i, t in [(1, words), (2, []), (3, ["a"]), (4, ["b"]), (5, ["c\u00c9"]), (6, ["new"]), (7, [])] if zlib.crc32(str(i).encode()) % 7 != 2}
    counts = Counter(w.lower() if w.isascii() else w for ws in kept.values() for w in [*ws, "<end>"])
    n, v = sum(counts.values()), len(counts)
    assert sum((c + 1) / (n + v + 1) for c in counts.values()) + 1 / (n + v + 1) == pytest.approx(1)
    got = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    end = math.log10((counts["<end>"] + 1) / (n + v + 1))
    assert got[2].base_score == got[7].base_score == pytest.approx(end, rel=1e-9)
    assert got[3].base_score == pytest.approx(math.log10((counts["a"] + 1) / (n + v + 1)) + end, rel=1e-9)
    assert {r.train_tokens for r in got.values()} == {n}


def test_seating_follows_the_restaurant():
    rng = np.random.default_rng(1)
    # tables of four customers of one dish: weights of all seatings, by hand
    a, d = 0.7, 0.5
    weight = Counter()
    for path in itertools.product([0, 1], repeat=3):
        t, w = 1, 1.0
        for n, new in enumerate(path, 1):
            w *= a if new else n - d * t
            t += new
        weight[t] += w
    drawn = Counter(pitman_yor.seat(np.full(60_000, 4), np.full(60_000, a), d, rng, draws=8).tolist())
    for t, w in weight.items():
        assert drawn[t] / 60_000 == pytest.approx(w / sum(weight.values()), abs=0.012)


def test_seating_of_many_customers_is_exact():
    for d, n, a in [(0.8, 20, 0.5), (0.8, 100, 1), (0.8, 1000, 5), (0.8, 1000, 50), (0.8, 3000, 5), (0.8, 3000, 900), (0.6, 3000, 0.9), (0.6, 3000, 80), (0.6, 3000, 600)]:
        weight = np.zeros(n + 1)  # of t tables, customer by customer, scaled
        weight[1] = a
        t = np.arange(n + 1)
        for m in range(1, n):
            weight[1:] = weight[:-1] * a + weight[1:] * np.maximum(m - d * t[1:], 0)
            weight /= weight.sum()
        weight /= weight.sum()
        mean, spread = weight @ t, np.sqrt(weight @ t**2 - (weight @ t) ** 2)
        drawn = pitman_yor.seat(np.full(4000, n), np.full(4000, float(a)), d, np.random.default_rng(3))
        assert drawn.mean() == pytest.approx(mean, abs=5 * spread / np.sqrt(4000))
        assert drawn.std() == pytest.approx(spread, rel=0.1)


def test_predictions_sum_to_one():
    shared = pitman_yor.Shared(np.zeros(pitman_yor.CONTEXTS, np.int64), 30, 12, np.zeros(0), np.zeros(0))
    customers, tables = np.array([10, 15, 5]), np.array([4, 6, 2])
    known = pitman_yor.parent_share(customers, tables, shared, 3)
    assert known.sum() + pitman_yor.parent_share(np.array([0]), np.array([0]), shared, 3)[0] == pytest.approx(1)


def test_scorer_on_odd_rows(spark, odd, none):
    got = pitman_yor.score_documents(odd).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 11), (1, 1), (2, 1), (3, 1), (4, 11), (5, 11), (5, 11), (6, 60_001), (7, 7), (8, 2)]
    assert all(r.score < 0 for r in got)
    assert pitman_yor.score_documents(none).count() == 0


def test_repeated_partitions_are_scored_each(spark):
    docs = corpus(spark, [(i, f"a b c{i % 5}") for i in range(1, 200)] + [(None, "x y")]).coalesce(1)
    got = pitman_yor.score_documents(docs.union(docs)).collect()
    assert Counter(r.doc_id for r in got) == Counter({i: 2 for i in [None, *range(1, 200)]})
    assert all(r.n_known <= r.n_tokens for r in got) and len({(r.doc_id, r.score) for r in got}) == 200


def test_every_context_has_its_own_restaurant(spark):
    """One training text in which no token recurs: every seating is one table, so that all scores follow by hand."""
    train = next(i for i in range(100) if not pitman_yor.held_out(i))
    out = next(i for i in range(100) if pitman_yor.held_out(i))
    ws = [f"w{i}" for i in range(6000)]
    n = len(ws) + 1  # tokens, contexts, dishes and tables
    (d, d0), (a, a0) = pitman_yor.DISCOUNT, pitman_yor.STRENGTH
    base = (a0 + d0 * n) / (n + 1)
    seen, unseen = (1 - d0 + base) / (a0 + n), base / (a0 + n)  # the parent's
    after = lambda share, count: (count - d * count + (a + d) * share) / (a + 1)
    got = {r.doc_id: r for r in pitman_yor.score_documents(corpus(spark, [(train, " ".join(ws)), (out, "w7 w9 new w5")])).collect()}
    assert got[train].score == pytest.approx(n * math.log10(after(seen, 1)), rel=1e-6)
    # the start and w7 are contexts of other tokens, w9 of other ones too; "new" was never a context; the end followed the last word alone
    assert got[out].score == pytest.approx(2 * math.log10(after(seen, 0)) + math.log10(after(unseen, 0)) + math.log10(seen) + math.log10(after(seen, 0)), rel=1e-6)


def test_contexts_are_not_merged():
    import pyarrow as pa

    hashes = common.words(*common.text_buffer(pa.array([" ".join(f"w{i}" for i in range(20_000))])))[0]
    token, before, row = pitman_yor.tokens(hashes, np.array([20_000]))
    assert len(set(before.tolist())) == len(before) == 20_001 and before[1:].tolist() == token[:-1].tolist()


def test_packed_numbers_come_back():
    arrays = [np.array([], np.int64), np.array([3, 5, 2**40]), np.array([-1, 0, 2**62]), np.array([2**64 - 1, 7], np.uint64), np.array([True, False])]
    got = pitman_yor._unpack(pitman_yor._pack(*arrays))
    assert [g.tolist() for g in got[:3]] == [a.tolist() for a in arrays[:3]] and got[3].view(np.uint64).tolist() == arrays[3].tolist() and got[4].tolist() == [1, 0]
    values, first = np.array([4, 9, 9, 1, 6, 0]), np.array([0, 3, 5])
    assert pitman_yor._from_steps_in(pitman_yor._steps_in(values, first), first).tolist() == values.tolist()


def test_tables_by_context_equal_a_count_of_all_buckets(spark, folder):
    """What the parts return to the buckets, before the first sweep and after one, against sums over all buckets."""
    docs = common.written(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), "docs")
    hot, named = pitman_yor.frequent_tokens(docs)
    table = pitman_yor.bucketed(pitman_yor.gathered(pitman_yor.dealt(docs, hot, named, 5), named, 5), "seats", "bucket", 5)
    index = pitman_yor.context_index(table, 3)
    names = {r.bucket: np.cumsum(pitman_yor._unpack(r.names)[0].view(np.uint64)).tolist() for r in table.where("names is not null").collect()}
    assert len({c for cs in names.values() for c in cs}) > 4096

    def by_context(payloads):
        return {b: dict(zip(names[b], pitman_yor._whole([p for _, p in sorted(parts)]))) for b, parts in payloads.items()}

    def rows(frame, column):
        out = defaultdict(list)
        for r in frame.collect():
            out[r.bucket].append((r.part, r[column]))
        return by_context(out)

    buckets = [pitman_yor.Bucket(r.bucket, r.seats, hot) for r in table.where("seats is not null").collect()]
    for column, own in (("tables", lambda b: b.in_contexts()), ("customers", lambda b: b.in_context)):
        total = Counter()
        for b in buckets:
            total.update(dict(zip(names[b.number], own(b).tolist())))
        for found in rows(index, column).values():
            assert all(total[c] == v for c, v in found.items())
    sums = pitman_yor._sums(pitman_yor._first(table, hot))
    v = sums[pitman_yor.TOTAL, pitman_yor.WORDS] + len(hot)
    at = [np.array([sums.get((pitman_yor.HOT_CUSTOMERS, i), 0) for i in range(len(hot))]), np.ones(len(hot), np.int64)]
    sample = (sums[pitman_yor.TOTAL, pitman_yor.CUSTOMERS] + int(at[0].sum()), sums[pitman_yor.TOTAL, pitman_yor.TABLES] + len(hot), *at)
    news = pitman_yor._news(index.withColumn("payload", F.col("tables")), 0, "tables")
    swept = pitman_yor._swept(table, news, hot, 0, sample, v, 3)
    sent, total = rows(swept.where("part is not null"), "payload"), Counter()
    for found in sent.values():
        total.update({c: int(n) for c, n in found.items()})
    got = rows(pitman_yor._added(index, swept), "payload")
    assert sent.keys() == got.keys() and all(total[c] == n for found in got.values() for c, n in found.items())


# 2


def test_packing_is_whole(spark, folder):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in R.queries["op2_vector_packing"](spark, folder).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in texts(spark, folder).items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and len(rows) <= packing.MAX_SEGMENTS


def test_place_keeps_all_limits():
    rng = np.random.default_rng(3)
    sizes = np.stack([rng.integers(1, 100, 300), np.ones(300, np.int64), rng.integers(0, 60, 300)], 1)
    limits = np.array([100, 5, 60])
    bins = packing.place(sizes, limits)
    for b in range(bins.max() + 1):
        assert (sizes[bins == b].sum(0) <= limits).all() and (bins == b).any()
    assert bins.max() + 1 <= 1.25 * max(math.ceil(x) for x in sizes.sum(0) / limits)
    with pytest.raises(ValueError):
        packing.place(np.array([[101, 1, 0]]), limits)
    assert len(packing.place(np.zeros((0, 3), int), limits)) == 0


def test_packing_odd_rows(spark, odd, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = packing.pack_documents(odd, P.path("word_bpe_49k.json")).collect()
    want = Counter((i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in odd.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0
    examples = spark.createDataFrame([(1, 5000, 10), (2, None, None), (3, 100, 90)], "example_id long, n_tokens long, n_loss long")
    assert packing.pack_examples(examples).count() == 3


# 3


def test_statistics_by_brute_force(spark, folder):
    rows = texts(spark, folder)
    got = {r.doc_id: r for r in R.queries["op3_decision_lists"](spark, folder).collect()}
    assert got.keys() == rows.keys()
    for i, t in rows.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeated = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_rules_find_a_planted_conjunction(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        x, y = rng.random(), rng.random()
        rows.append((i, *[rng.random()] * 2, x, y, *[rng.random()] * 4, x > 0.7 and y > 0.6))
    labelled = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{f} double" for f in rules.FEATURES) + ", junk boolean")
    found = rules.learn(labelled)
    judged = labelled.select("junk", rules.verdict(found).isNotNull().alias("caught")).groupBy("junk", "caught").count().collect()
    right = sum(r["count"] for r in judged if r.junk == r.caught)
    assert right >= 2900 and all(len(r.conditions) <= rules.MOST_CONDITIONS for r in found)
    assert rules.learn(labelled.where("junk")) == [] and rules.learn(labelled.limit(0)) == []


def test_rules_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = rules.judge(odd, labels).collect()
    assert len(got) == 10 and all(r.base_failed for r in got if r.n_words < 50)
    assert rules.judge(none, labels).count() == 0


# 4


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><div class="cookie-notice">Accept</div>
<nav><ul><li><a>Home</a><li><a>About</a></ul></nav><article class="post"><h1>A &amp; B</h1><p>One <b>two</b>
three<br>four<p>Five &#233;<aside>no</aside><div class="ad">no</div><form><input>no</form><section class="comments"><p>no</p></section></article>
<footer>no</footer></body></html>"""


def test_main_text_leaves_the_rest():
    assert wrappers.main_text(PAGE) == "A & B\n\nOne two three four\n\nFive é"
    assert wrappers.main_text("") == "" and wrappers.main_text("<p>a<p>b") == "a\n\nb"


def test_alignment_finds_optional_and_repeated_groups():
    a = wrappers.infer(wrappers.parse("<body><h1>x</h1><p>a</p><p>b</p></body>"))
    b = wrappers.infer(wrappers.parse("<body><h1>x</h1><img><p>c</p></body>"))
    assert wrappers.expression(wrappers._fold(a, b, False)) == "(<body>(<h1>x</>)(<img></>)?(<p>#TEXT</>)+</>)"


def test_wrappers_against_the_pages_markup(spark, folder):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = R.queries["op4_host_wrappers"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = pages[r.page_id].split("<article>", 1)[1].split("</article>", 1)[0]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_wrappers_odd_rows(spark):
    rows = [(1, "http://h/a", None), (2, None, PAGE), (3, "HTTP://H/b", ""), (3, "http://h/b", "<<p"), (None, "x", "<article><p>" + "w " * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("wrapper", F.lit("x"))
    got = {(r.page_id, r.url): r.n_chars for r in wrappers.extract(pages).collect()}
    assert got[(1, "http://h/a")] == 0 and got[(None, "x")] == 399_999 and len(got) == 5
    assert wrappers.extract(pages.limit(0)).count() == 0


def test_a_page_without_an_article_keeps_its_text(spark):
    rows = [(1, "http://h/1", "<body><article><p>one</article>"), (2, "http://h/2", "<body><article><p>two</article>"), (3, "http://h/3", "<body><div><p>three</div>"), (4, None, "<article><p>four</article>"), (5, None, "<div><p>five</div>")]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one", 2: "two", 3: "three", 4: "four", 5: "five"}


def test_what_all_pages_say_is_template_whatever_its_class(spark):
    page = '<body class="no-sidebar sidebar"><div class="x1"><ul><li><a>Home</a><li><a>About</a></ul></div><p class="x2">We set files.</p><div class="with-comments"><h1>{0}</h1><p>Text <b>always</b> {0}</p><p>more {0}</p></div><div class="share">By {0}</div></body>'
    rows = [(i, "http://h/x", page.format(f"t{i}")) for i in range(5)] + [(9, "http://copy/x", page.format("c")), (10, "http://copy/y", page.format("c"))]
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"t{i}\n\nText always t{i}\n\nmore t{i}" for i in range(5))
    assert "Text always c" in got[9]  # copies alone show no template


def test_deep_pages(spark):
    deep = "<div>" * 20_000 + "<p>end {}</p>"
    rows = [(i, "http://h/x", deep.format(i)) for i in range(2)]
    assert sorted(r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()) == ["end 0", "end 1"]


# 5


def test_spans_by_brute_force(spark, folder):
    def luhn(x):
        return sum(v - 9 * (v > 9) for v in (int(c) * (1 + i % 2) for i, c in enumerate(reversed(x)))) % 10 == 0

    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    rows = texts(spark, folder)
    hard = ["a@b@c.de x@a.b_c@d.e-f 1.2.3.4.5.6.7.8 256.1.1.1 0001.002.3.4", "4111 1111 1111 1111 +49 (0) 30-12345 +1 2 😀 a.b@c.d", "..@x.y %@a-b.c" + "1" * 5000, "@" * 3 + "a" * 20_000]
    hard += ["4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 x", "12 4111-1111-1111-1111 2 4111111111111111--4111111111111111", "x" * 1000 + "é😀" * 60 + " a.b@c.de +49 30 1234567 " * 200]
    rows.update({-1 - i: t for i, t in enumerate(hard)})
    docs = corpus(spark, list(rows.items()))
    for r in pii.digest(docs).collect():
        want = [(k, [m for m in re.finditer(p, rows[r.doc_id]) if ok(m.group())]) for k, p, ok in kinds]
        listed = ",".join(f"{k}:{m.start()}:{m.end()}" for k, ms in want for m in ms)
        assert [r[f"n_{k}"] for k, _ in want] == [len(ms) for _, ms in want]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans.startswith(listed)


def test_checks_context_and_redaction(spark, odd, none):
    text = "Pay to bank account GB82 WEST 1234 5698 7654 32 or GB82 WEST 1234 5698 7654 33. My social security 123-45-6789, part 123-45-6780; mail a@b.c"
    filler = "plain words here and there that keep the number far from anything that it could be taken to mean by its context 987-65-4321 is a part"
    docs = corpus(spark, [(1, text), (2, filler)])
    got = {r.doc_id: r for r in pii.personal_data(docs).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect()}
    assert [(s.kind, s.text) for s in got[1].spans if s.kind in ("iban", "ssn")][:2] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert got[1].clean.startswith("Pay to bank account <iban> or GB82") and got[1].clean.endswith("mail <email>")
    assert got[2].spans == [] and got[2].clean == filler
    assert pii.digest(odd).count() == 10 and pii.digest(none).count() == 0


def test_a_long_text_of_numbers_takes_linear_time(spark):
    numbers = " ".join(f"x{i * 7919 % 10**6} 1.2.3.{i % 300} +49 30 {i:07d}" for i in range(60_000))  # 2 MB
    text = numbers + " ssn 123-45-6789 " + "and " * 9 + "4111 1111 1111 1111"
    began = time.monotonic()
    r = pii.personal_data(corpus(spark, [(1, text)])).withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).first()
    assert time.monotonic() - began < 60
    assert len([s for s in r.spans if s.kind == "ip"]) == sum(i % 300 <= 255 for i in range(60_000))
    assert all(text[s.start : s.end] == s.text for s in r.spans)
    want, at = [], 0
    for s in sorted(r.spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            want += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    assert r.clean == "".join(want) + text[at:]
    assert r.clean.endswith(" ssn <ssn> " + "and " * 9 + "<card>")


# 6


def test_resampling_parts_labelled_junk(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = importance.resample(docs, labels)
    assert got.count() == docs.count()
    rates = {r.quality: r.kept for r in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1] > 0.95 and rates[0] < 0.2


def test_resampling_draws_what_sorting_all_keys_draws(spark, folder):
    """Counts, ratios, cut, keys and the k greatest by loops over all texts, with a Gumbel noise that moves many rows."""
    import pyarrow as pa

    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 300"), spark.read.parquet(f"{folder}/labels.parquet")
    buckets, temperature = 500, 20.0
    rows = [(r.doc_id, r.text, r.noise) for r in docs.select("doc_id", "text", F.xxhash64("doc_id", F.lit(7)).alias("noise")).collect()]
    marks = defaultdict(list)
    for r in labels.collect():
        marks[r.doc_id].append(r.quality)
    good = {d: min(q) == 1 for d, q in marks.items()}
    found = {}
    for d, text, _ in rows:
        hashes, counts = next(common.text_words(pa.array([text])))[2:]
        found[d] = Counter(importance._buckets(hashes, counts, buckets)[0].tolist())
    raw = sum(found.values(), Counter())
    aim = sum((found[d] for d in found if good.get(d)), Counter())
    ratio = [math.log((aim[b] + 1) / (aim.total() + buckets)) - math.log((raw[b] + 1) / (raw.total() + buckets)) for b in range(buckets)]
    total = {d: sum(n * ratio[b] for b, n in c.items()) for d, c in found.items()}
    mean = {d: total[d] / c.total() for d, c in found.items() if c}
    yes, no = sorted(mean[d] for d in mean if good.get(d) is True), sorted(mean[d] for d in mean if good.get(d) is False)
    values = sorted({*yes, *no})
    worth = lambda cut: 4 * sum(v >= cut for v in yes) / len(yes) + sum(v < cut for v in no) / len(no)
    cuts = [(values[0] - 1, 0.0)] + [((x + y) / 2, y - x) for x, y in zip(values, values[1:])]
    cut = max(cuts, key=lambda c: (round(worth(c[0]), 9), c[1]))[0]
    weight = {d: total[d] - cut * found[d].total() for d in found}
    key = {d: weight[d] / temperature - math.log(-math.log((n % ((1 << 52) - 1) + 0.5) / float((1 << 52) - 1))) for d, _, n in rows}
    k = sum(w >= 0 for w in weight.values())
    want = set(sorted(key, key=lambda d: (-key[d], d))[:k])
    got = {r.doc_id: r for r in importance.resample(docs, labels, buckets=buckets, temperature=temperature).collect()}
    assert all(got[d].log_weight == pytest.approx(total[d], abs=1e-6) and got[d].gumbel_key == pytest.approx(key[d], abs=1e-6) for d in found)
    assert {d for d in got if got[d].kept} == want and want != {d for d in weight if weight[d] >= 0}


def test_resampling_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (8, 0), (None, 1)], "doc_id long, quality int")
    assert importance.resample(odd, labels).count() == 10
    assert importance.resample(odd, labels.limit(0)).where("not kept").count() == 0
    assert importance.resample(none, labels).count() == 0


# 7


def test_automaton_counts_like_greedy_matching():
    rng = random.Random(2)
    for _ in range(60):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        automaton = wordpiece.Automaton(sorted(vocabulary))
        for _ in range(60):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))
            rest, n = word, 0
            while rest:
                size = max((k for k in range(1, len(rest) + 1) if rest[:k] in vocabulary), default=0)
                if not size:
                    n = 1
                    break
                rest, n = rest[size:], n + 1
            assert automaton.count(word) == n, (vocabulary, word)


def test_piece_counts_by_brute_force(spark, folder, odd, none):
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = set(json.load(f)["model"]["vocab"])
    letters, longest = wordpiece.byte_letters(), max(map(len, vocabulary))

    def greedy(word):
        rest, n = "".join(letters[b] for b in word.encode()), 0
        while rest:
            fits = lambda k: rest[:k] + ("</w>" if k == len(rest) else "") in vocabulary
            rest = rest[next(k for k in range(min(longest, len(rest)), 0, -1) if fits(k)) :]
            n += 1
        return n

    rows = texts(spark, folder)
    for r in R.queries["op7_wordpiece_counts"](spark, folder).collect():
        words = re.findall(wordpiece.WORD_PATTERN, rows[r.doc_id].lower())
        assert (r.n_words, r.n_pieces) == (len(words), sum(map(greedy, words)))
    pieces = wordpiece.read_vocabulary(P.path("word_bpe_49k.json"))
    assert wordpiece.token_counts(corpus(spark, [(1, "photosynthesis")]), pieces).first().n_pieces == greedy("photosynthesis") == 2
    assert wordpiece.token_counts(odd, pieces).count() == 10 and wordpiece.token_counts(none, pieces).count() == 0


# 8


def test_bit_parallel_distance():
    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            before, row[0] = row[:], i
            for j, x in enumerate(text, 1):
                row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (c != x))
        return min(row)

    rng = random.Random(4)
    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        assert decontamination.Pattern(item).search(text)[0] == least(item, text)


def test_search_equals_the_least_distance_to_any_stretch(spark):
    """All documents against all items: planted with insertions, deletions and changes around the budget, at the start, the end and inside."""

    def least(item, text):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item, 1):
            last, row = row, [i]
            for j, d in enumerate(text, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        return min(row)

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((8, 12, 20, 30))]
    docs = []
    for i, item in items:
        for edits in range(decontamination.budget(len(item)) + 3):
            for kind in ("insert", "delete", "change", "mixed"):
                chars = list(item)
                for _ in range(edits):
                    at, how = rng.randrange(len(chars)), rng.choice(["insert", "delete", "change"]) if kind == "mixed" else kind
                    chars[at : at + (how != "insert")] = [] if how == "delete" else ["z"]
                before, after = (" ".join(word() for _ in range(rng.choice((0, 9)))) for _ in range(2))
                docs.append((len(docs), f"{before} {''.join(chars)} {after}"))
    texts_of = {d: decontamination.normal(t) for d, t in docs}
    want = {(d, i): least(item, t) for d, t in texts_of.items() for i, item in items}
    want = {p: n for p, n in want.items() if n <= decontamination.budget(len(items[p[1]][1]))}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in decontamination.contaminated(corpus(spark, docs), bench).collect()}
    assert set(got) == set(want) and len(want) > 20 and all(want[p] <= got[p] <= decontamination.budget(len(items[p[1]][1])) for p in want)


def test_planted_passages_with_edits(spark, folder):
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").limit(8).collect()]
    rng, rows, want = random.Random(6), [], set()
    filler = "nothing of interest stands in these words at all "
    for i, item in enumerate(items):
        chars = list(" ".join(item.lower().split()))
        allowed = decontamination.budget(len(chars))
        for k, edits in enumerate((0, allowed, len(chars) // 3)):
            changed = chars[:]
            for at in rng.sample(range(len(chars)), edits):
                changed[at] = "#"
            rows.append((10 * i + k, filler + "".join(changed).upper() + "\n " + filler))
            if k < 2:
                want.add((10 * i + k, i))
    docs = corpus(spark, [*rows, (999, filler), (998, None), (None, "")])
    bench = spark.createDataFrame([*enumerate(items), (50, ""), (51, None), (52, "abc"), (0, items[0])], "item_id long, text string")
    got = decontamination.contaminated(docs, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and got.count() == len(want)
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0 and decontamination.contaminated(docs.limit(0), bench).count() == 0
    short = corpus(spark, [(1, "an abc here"), (2, "xabcx"), (3, "ABC")])
    assert sorted(r.doc_id for r in decontamination.contaminated(short, bench).collect()) == [1, 3]


# 9


def test_archive_round_trip(spark, tmp_path):
    forged = "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 1\r\n\r\nx\r\n\r\nWARC/1.0\r\n"
    rows = [(1, "http://a/\r\nb", forged), (2, None, ""), (3, "u", None), (4, "u", forged), (5, "u", "é" * 50_000), (5, "u", "é" * 50_000), (None, "u", "z"), (6, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("x")).withColumn("owner", F.lit(3))
    warc.write_archives(pages, str(tmp_path / "w"), records_per_file=3)
    got = sorted(warc.read_archives(spark, str(tmp_path / "w")).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    groups = defaultdict(list)
    for i, _, t in rows:
        groups[t or ""].append(i)
    for r, (i, _, t) in zip(got, sorted(rows, key=lambda r: r[0] or 0)):
        data = (t or "").encode()
        owner = max((x for x in groups[t or ""] if x is not None), default=None)
        again = owner is not None and owner != i
        assert (r.page_id, r.payload_bytes, r.payload_digest) == (i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("revisit", owner) if again else ("response", None))
    assert len(got) == len(rows)
    warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_small_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    warc.write_archives(pages, str(tmp_path / "w"), least_revisit=3)
    assert {r.page_id: r.refers_to for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == {1: None, 2: None, 3: 4, 4: None}


def test_foreign_archives(spark, tmp_path):
    def record(n, version, body):
        head = f"WARC/1.{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n\r\n"
        return head.encode() + body + b"\r\n\r\n"

    records = [record(n, n % 2, b"WARC/1.1\r\n" * n) for n in range(8)]
    (tmp_path / "per-record.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "broken.warc").write_bytes(b"".join(records[:3]) + b"junk" + b"".join(records[3:]))
    (tmp_path / "short.warc.gz").write_bytes(b"".join(map(gzip.compress, records))[:-20])
    (tmp_path / "_SUCCESS").write_bytes(b"")
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert Counter(r.page_id for r in got) == {n: 4 if n < 3 else 3 if n < 7 else 2 for n in range(8)}
    report = {r.path.rsplit("/", 1)[1]: (r.n_candidates, r.n_records, r.whole) for r in warc.chain_report(spark, str(tmp_path)).collect()}
    assert report == {"per-record.warc.gz": (8, 8, True), "plain.warc": (8, 8, True), "broken.warc": (8, 3, False), "short.warc.gz": (7, 7, False)}


def test_large_payloads_share_files_with_few(spark, tmp_path):
    sizes = [10, 70_000, 70_000, 5_000_000, 5_000_001]
    pages = spark.createDataFrame([(i, "u", chr(97 + i % 2) * n) for i, n in enumerate(sizes)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, str(tmp_path / "w"))
    assert {r.page_id: r.payload_bytes for r in warc.read_archives(spark, str(tmp_path / "w")).collect()} == dict(enumerate(sizes))
    held = [(r.n_bytes, r.n_records) for r in warc.chain_report(spark, str(tmp_path / "w")).collect()]
    assert all(n == 1 for size, n in held if size > 4 << 20) and sum(n for _, n in held) == 5


def test_pointer_jumping_by_walking():
    rng = random.Random(8)
    for _ in range(50):
        offsets = np.array(sorted(rng.sample(range(1, 400), 40)) + [0])
        successors = np.array([rng.choice([x for x in [*offsets, 999] if x > o] or [999]) for o in offsets])
        to, at, want = dict(zip(offsets.tolist(), successors.tolist())), 0, set()
        while at in to:
            want.add(at)
            at = to[at]
        assert set(offsets[warc.reachable(offsets, successors)].tolist()) == want


# 10


def shingle_sets(rows):
    return {i: {tuple(w[k : k + 5]) for w in [plain_words(t)] for k in range(max(1, len(w) - 4))} if plain_words(t) else set() for i, t in rows.items()}


def classes_by_force(rows, least=0.8):
    sets, parent, seen = shingle_sets(rows), {i: i for i in rows}, defaultdict(list)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in sets.items():
        for x in s:
            seen[x].append(i)
    common_ = Counter(p for v in seen.values() for p in itertools.combinations(sorted(v), 2))
    for (a, b), n in common_.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in rows}


def test_classes_by_brute_force(spark, folder):
    got = {r.doc_id: r.class_id for r in R.queries["op10_weighted_minhash"](spark, folder).collect()}
    assert got == classes_by_force(texts(spark, folder))


def test_a_crowd_of_edited_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = {}
    for i in range(120):
        words = base[:]
        for at in rng.sample(range(150), rng.choice([0, 1, 2, 3, 5, 8])):
            words[at] = f"edit{i}x{at}"
        rows[i + 1] = " ".join(words)
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(corpus(spark, list(rows.items()))).collect()}
    assert got == classes_by_force(rows)


def test_repeats_within_a_text_lose_no_link(spark):
    rng = random.Random(4)
    rows = {}
    for i in range(1, 60, 3):
        words = [f"w{rng.randint(0, 9000)}" for _ in range(200)]
        own = [f"own{i}x{k}" for k in range(24)]
        rows |= {i: " ".join(words), i + 1: " ".join(words + words), i + 2: " ".join(words + own * 5)}
    docs = corpus(spark, list(rows.items()))
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == classes_by_force(rows)
    sets = shingle_sets(rows)
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i in range(1, 60, 3) for j in (i + 1, i + 2))


def test_cells_never_hide_a_shared_shingle(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(400)]
    texts = {i: " ".join(w if rng.random() > 0.01 * i else f"x{rng.randrange(40)}" for w in base) for i in range(12)} | {20: "", 21: "alone"}
    rows = corpus(spark, [*texts.items(), (3, texts[3]), (30, "one"), (30, "two")])
    bits = {r.id: np.array(r.cells, np.int64).view(np.uint8) for r in neardup.cells(rows).collect()}
    assert set(bits) == set(texts)  # an id with different texts has none
    sets = {}
    for i, t in texts.items():
        words = t.split()
        sets[i] = {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()
    for a, b in itertools.permutations(texts, 2):
        within = len(sets[a]) - int(np.unpackbits(bits[a] & ~bits[b]).sum())
        assert len(sets[a] & sets[b]) <= within <= len(sets[a] & sets[b]) + 0.15 * len(sets[a])


def test_samples_agree_like_the_weighted_index():
    rng = np.random.default_rng(11)
    x = np.sort(rng.integers(1, 2**62, 300).astype(np.uint64))
    wa, wb = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    drawn = neardup.sample(np.concatenate([x, x]), np.concatenate([wa, wb]), np.array([300, 300]), 4000)
    assert (drawn[0] == drawn[1]).mean() == pytest.approx(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum(), abs=0.03)


def test_near_duplicates_odd_rows(spark, odd, none):
    got = {r.doc_id: (r.exact_id, r.class_id, r.n_links) for r in neardup.near_duplicates(odd).collect()}
    assert got == {1: (1, 1, 0), 2: (2, 2, 0), 3: (3, 3, 0), 4: (4, 4, 0), 5: (4, 4, 0), 6: (6, 6, 0), 7: (7, 7, 0), 8: (8, 8, 0)}
    assert neardup.near_duplicates(none).count() == 0


# pipeline


def test_pipeline_by_brute_force(spark, folder):
    import corpus_pipeline as c

    rows = texts(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in c.quality(spark, docs, folder).select("doc_id").collect()}
    good = [i for i in rows if labels.get(i) == 1]
    assert len(kept.intersection(good)) >= 0.95 * len(good)
    classes = classes_by_force({i: rows[i] for i in kept})
    left = {i for i in kept if classes[i] == i}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = {i for i in left if not any(x in " ".join(rows[i].lower().split()) for x in items)}
    out = c.run(spark, folder).collect()
    assert {r.doc_id for r in out} == left
    for _, whole in itertools.groupby(sorted(out, key=lambda r: (r.doc_id, r.start)), lambda r: r.doc_id):
        whole = list(whole)
        assert sum(r.length for r in whole) == whole[0].doc_tokens


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "decontaminated", "personal_data"])
def test_stages_on_odd_rows(spark, folder, odd, none, name):
    import corpus_pipeline as c

    stage = dict(c.STAGES)[name]
    assert stage(spark, odd, folder).columns == c.COLUMNS and stage(spark, none, folder).count() == 0
    ids = {r.doc_id for r in stage(spark, odd, folder).select("doc_id").collect()}
    assert None in ids and (name != "near_duplicates" or ids == {None, 1, 2, 3, 4, 6, 7, 8})
