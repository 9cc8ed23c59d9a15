"""Matching-block similarity (2M / T) as expressions, with bounds that settle almost all word pairs.

M counts the letters of matching blocks: the longest common block (the first in the left, then in the right
text), then the same to its left and to its right.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.text import bind


def _longest_block(part: Column) -> Column:
    """Longest common block of part.a and part.b: its length k and places i, j; NULL when no letter is common."""
    a, b = part["a"], part["b"]
    least = F.least(F.length(a), F.length(b))
    places = lambda k: F.sequence(F.lit(1), F.length(a) - k + 1)
    common = lambda k: lambda i: F.contains(b, F.substr(a, i, k))
    # all lengths up to that of the longest block occur
    k = F.size(F.filter(F.sequence(F.lit(1), least), lambda n: F.exists(places(n), common(n))))

    def placed(k):
        first = F.get(F.filter(places(k), common(k)), F.lit(0))
        return F.when(k > 0, bind(first, lambda i: F.struct(
            k.alias("k"), i.alias("i"), F.position(F.substr(a, i, k), b).alias("j"), a.alias("a"), b.alias("b"))))

    return bind(k, placed)


def _rest(block: Column) -> Column:
    """What lies left and right of a block in both texts."""
    a, b, i, j, k = (block[c] for c in "abijk")
    return F.array(
        F.struct(F.substr(a, F.lit(1), i - 1).alias("a"), F.substr(b, F.lit(1), j - 1).alias("b")),
        F.struct(F.substr(a, i + k).alias("a"), F.substr(b, j + k).alias("b")))


def matched_letters(left: Column, right: Column) -> Column:
    """Letters of all matching blocks of two texts; every round takes one block of each part that is left."""
    least = F.least(F.length(left), F.length(right))
    start = F.struct(F.array(F.struct(left.alias("a"), right.alias("b"))).alias("parts"), F.lit(0).alias("m"))

    def round_of(state, _):
        found = F.filter(F.transform(state["parts"], _longest_block), lambda f: f.isNotNull())

        def after(blocks):
            parts = F.filter(F.flatten(F.transform(blocks, _rest)), lambda p: (p["a"] != "") & (p["b"] != ""))
            gained = F.aggregate(blocks, F.lit(0), lambda m, f: m + f["k"])
            return F.struct(parts.alias("parts"), (state["m"] + gained).alias("m"))

        return F.when(F.size(state["parts"]) == 0, state).otherwise(bind(found, after))

    whole = F.aggregate(F.sequence(F.lit(1), least), start, round_of, lambda state: state["m"])
    return F.when(least > 0, whole).otherwise(F.when(least.isNotNull(), F.lit(0)))


def block_ratio(left: Column, right: Column) -> Column:
    """2M / T; 1 for two empty texts, NULL where one is NULL."""
    total = F.length(left) + F.length(right)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * matched_letters(left, right) / total)


# --- Fixed values: a name word of at most SHORT_WORD letters needs the higher similarity --------------

SHORT_WORD, SHORT_LIMIT, LONG_LIMIT = 5, 0.90, 0.88


def document_words(normal_text: Column) -> Column:
    """Distinct letter-only words of a normalised text."""
    words = F.array_distinct(F.regexp_extract_all(normal_text, F.lit(r"\b[A-Z']{2,}\b"), F.lit(0)))
    return F.filter(F.transform(words, lambda w: F.replace(w, F.lit("'"), F.lit(""))), lambda w: w != "")


def _containment(token: Column, word: Column) -> Column:
    inside = F.contains(word, token) | F.contains(token, word)
    a, b = F.length(token), F.length(word)
    return F.when(inside, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)


def containment_score(token: Column, words: Column) -> Column:
    """Best length ratio over the words that contain the token or lie in it."""
    return F.coalesce(F.array_max(F.transform(words, lambda w: _containment(token, w))), F.lit(0.0))


def _lost(text: Column, other: Column) -> Column:
    """Letters of a text that the other one lacks."""
    return F.length(F.call_function("translate", text, other, F.lit("")))


def reaches(token: Column, word: Column) -> Column:
    """Does a document word contain the name word, lie in it, or resemble it closely enough?

    Blocks are only looked for where three bounds leave it open: matched letters are no more than the shorter
    word's, no more than the letters both have, and no more than half of what the edit distance leaves of both.
    """
    a, b = F.length(token), F.length(word)
    limit = F.when(a <= SHORT_WORD, F.lit(SHORT_LIMIT)).otherwise(F.lit(LONG_LIMIT))
    enough = lambda letters: 2.0 * letters / (a + b) >= limit
    contained = (F.contains(word, token) | F.contains(token, word)) & (F.least(a, b) / F.greatest(a, b) >= limit)
    may = enough(F.least(a - _lost(token, word), b - _lost(word, token))) & enough((a + b - F.levenshtein(token, word)) / 2.0)
    return enough(F.least(a, b)) & (contained | (may & enough(matched_letters(token, word))))


def with_token_hits(rows: DataFrame, tokens: str, words: str, out: str) -> DataFrame:
    """How many name tokens reach their limit with some document word."""
    sizes = F.transform(tokens, lambda t: F.length(t))
    slack = LONG_LIMIT / (2 - LONG_LIMIT)
    low, high = F.floor(F.array_min(sizes) * slack), F.ceil(F.array_max(sizes) / slack)
    near = lambda bounds: F.filter(F.col(words), lambda w: F.length(w).between(bounds["low"], bounds["high"]))
    hits = lambda pool: F.size(F.filter(F.col(tokens), lambda t: F.exists(pool, lambda w: reaches(t, w))))
    found = bind(F.struct(low.alias("low"), high.alias("high")), lambda bounds: bind(near(bounds), hits))
    return rows.withColumn(out, F.when(F.size(tokens) > 0, found).otherwise(0))
