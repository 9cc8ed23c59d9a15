"""The prefix trie of conversations, against plain nested counting."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from credence.llm import prefix_trie
from credence.llm.queries import R

SCHEMA = "conv_id long, turn long, role string, text string, depth long, path string, n int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 9, "x", 1) for r in rows], SCHEMA)


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[: prefix_trie.KEY_BYTES]


def brute(rows):
    """Nodes of the rebuilt conversations, every prefix written out."""
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            turns[conv_id].append((turn is not None, turn or 0, key(role or "", text or ""), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        family = c - int(np.fmod(c, 100))
        rebuilt[c] = tuple(turns.get(family, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
        ends[ts].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, cs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(cs) - 1) * len(node[-1][1]) if node else 0
    return sorted((
        min(cs), len(node), min(members[node[:-1]]) if node else -1, len(cs), children[node], leaves[node], saved[node],
        hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()) for node, cs in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_parentheses_close():
    dice = random.Random(2)
    for n in (1, 5, 200, 5000):
        opens, depth = [], 0
        for left in range(2 * n, 0, -1):
            opening = depth == 0 or (depth < left and dice.random() < 0.6)
            opens.append(opening)
            depth += 1 if opening else -1
        stack, match = [], {}
        for i, o in enumerate(opens):
            if o:
                stack.append(i)
            else:
                match[stack.pop()] = i
        at = np.flatnonzero(opens)
        assert prefix_trie.Parentheses(np.array(opens)).close(at).tolist() == [match[i] for i in at.tolist()]


def test_range_least():
    values = np.random.RandomState(1).randint(0, 99, 300)
    start = np.arange(300)
    size = np.minimum(np.random.RandomState(2).randint(1, 300, 300), 300 - start)
    assert prefix_trie.range_least(values, start, size).tolist() == [values[a : a + n].min() for a, n in zip(start, size)]


@pytest.mark.parametrize("shards", [1, 2, 7, 60])
def test_against_counting(spark, shards):
    """Few words, so that conversations share, end within and repeat each other; more shards than paths as well."""
    dice = random.Random(shards)
    rows = []
    for c in [*range(40), *range(95, 140), 200, -5, -100, -101, 10**12 + 3]:
        rows += [(c, t, dice.choice("ua"), dice.choice(["x", "yy", "é😀"])) for t in range(dice.randint(1, 6))]
    number = prefix_trie.F.col("conv_id")
    head = prefix_trie.F.crc32(prefix_trie.F.encode(number.cast("string"), "UTF-8")) % 6
    paths = prefix_trie.rebuilt(table(spark, rows), number - number % 100, head, 5)
    assert found(prefix_trie.trie(paths, shards)) == brute(rows)


def test_copies_and_depth(spark):
    """Hundreds of equal conversations over several ranges of ids, and two long ones that part late."""
    spread = 1 << prefix_trie.ID_BITS
    rows = [(c * spread // 40, t, "user", f"t{t}") for c in range(300) for t in range(8)]
    rows += [(7, t, "assistant", "abc") for t in range(900)] + [(9, t, "assistant", "abc" if t < 880 else f"{t}") for t in range(900)]
    got = found(prefix_trie.shared_prefixes(table(spark, rows)))
    assert got == brute(rows)
    assert max(r[3] for r in got if r[1]) > 40


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (1, 0, "a", "b"), (2, None, "user", "x"), (2, None, "user", "w"), (2, 5, None, "long " * 50_000), (None, 1, "user", "x"),
            (100, 1, "ab", "c"), (101, 1, "a", "bc"), (102, 1, "ab", "c"), (103, 1, "ab", "c"), (104, -3, "ab", "c"), (105, 1, "user", "q"), (306, 1, "user", "q"), (307, 1, "user", "q"), (308, 1, "user", "q")]
    assert found(prefix_trie.shared_prefixes(table(spark, rows))) == brute(rows)
    assert found(prefix_trie.shared_prefixes(table(spark, rows[:0]))) == []
    assert found(prefix_trie.shared_prefixes(table(spark, [(None, 1, "user", "x")]))) == []
    turnless = [(c, 0, "user", "x") for c in (301, 302, 303, 304, 305, 306)]  # one turn, and no conversation 300 to start with
    got = found(prefix_trie.shared_prefixes(table(spark, turnless)))
    assert got == brute(turnless) and got[0][1] == 0 and got[0][3] == 6


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(R.queries["op11_prefix_trie"](spark, folder)) == brute(rows)
