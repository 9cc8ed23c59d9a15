"""Text columns: casing, words, keyword hits, list columns.

Patterns carry ``(?U)`` where word boundaries, digits or spaces must follow Unicode, as the rules
were defined on Unicode text.  Keyword tests look for the literal first, which is a plain byte scan,
and evaluate a pattern only on texts that contain it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Inside a lambda a repeated expression is evaluated at every place and for every element; binding
    it to a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def uni(pattern: str) -> str:
    return "(?U)" + pattern


def none_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a pattern, NULL when there is none."""
    return none_if_empty(F.regexp_extract(c, uni(pattern), group))


def all_groups(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(uni(pattern)), F.lit(group))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(uni(r"\S+")))


def text_lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def contains_any(c: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | c.contains(word)
    return found


def whole_word(c: Column, phrase: str) -> Column:
    """The phrase between word boundaries, any white space between its words."""
    return c.contains(phrase.split(" ")[0]) & c.rlike(uni(_phrase_pattern(phrase)))


def _phrase_pattern(phrase: str) -> str:
    return r"\b" + re.escape(phrase).replace(r"\ ", r"\s+") + r"\b"


def sql_text(s: str) -> str:
    """A string literal for SQL expression text."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_list(words) -> Column:
    """Array literal, built in one call."""
    return F.expr("array(" + ", ".join(sql_text(w) for w in words) + ")")


def _is_word(s: str) -> bool:
    return re.fullmatch(r"\w+", s) is not None


def known_words(upper: Column, *lists) -> Column:
    """The words of the lists that the text contains, found in one pass over the text.

    Phrases are represented by their first word.
    """
    vocabulary = dict.fromkeys(p.split(" ")[0] for words in lists for p in words)
    words = F.regexp_extract_all(upper, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.array_intersect(words, literal_list([w for w in vocabulary if _is_word(w)]))


def word_hits(known: str, upper: str, phrases) -> Column:
    """Whole phrases found, in listed order.  ``known`` is a column made by :func:`known_words`.

    Single words are settled by it; a pattern is tried only for a phrase whose first word occurs.
    """
    def test(p: str) -> str:
        head = p.split(" ")[0]
        met = f"array_contains({known}, {sql_text(head)})" if _is_word(head) else f"contains({upper}, {sql_text(head)})"
        return met if _is_word(p) else f"{met} AND rlike({upper}, {sql_text(uni(_phrase_pattern(p)))})"

    cases = ", ".join(f"IF({test(p)}, {sql_text(p)}, NULL)" for p in phrases)
    return F.array_compact(F.expr(f"array({cases})"))


def text_hits(upper: str, phrases) -> Column:
    """Phrases contained anywhere in the text, in listed order."""
    cases = ", ".join(f"IF(contains({upper}, {sql_text(p)}), {sql_text(p)}, NULL)" for p in phrases)
    return F.array_compact(F.expr(f"array({cases})"))


def phrase_hits(c: Column, phrases) -> Column:
    """Phrases contained anywhere in a text expression, in listed order."""
    return F.array_compact(F.array(*[F.when(c.contains(p), F.lit(p)) for p in phrases]))


def first_listed(c: Column, pairs) -> Column:
    """Value of the first listed key contained in the text."""
    chain = None
    for key, value in pairs:
        test, result = c.contains(key), F.lit(value)
        chain = F.when(test, result) if chain is None else chain.when(test, result)
    return chain


def texts(*items) -> Column:
    """Array of the non-null items; an item is a column or plain text."""
    columns = [i if isinstance(i, Column) else F.lit(i) for i in items]
    if not columns:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*columns)).cast("array<string>")


def no_texts() -> Column:
    return F.array().cast("array<string>")


def join_lists(*lists: Column) -> Column:
    """Lists one after the other; a NULL list counts as empty."""
    return F.concat(*[F.coalesce(item, no_texts()) for item in lists])


def distinct_in_order(c: Column) -> Column:
    return F.array_distinct(c)


def priority_first(found: Column, priority) -> Column:
    """Listed priority items first, the rest in found order."""
    distinct = F.array_distinct(found)
    listed = literal_list(priority)
    return F.concat(F.array_intersect(listed, distinct), F.array_except(distinct, listed))


def split_issues(c: Column) -> Column:
    """Stored issue text back to a list."""
    return F.filter(F.transform(F.split(c, ";"), lambda x: F.trim(x)), lambda x: x != "")


def join_issues(c: Column) -> Column:
    return F.array_join(c, "; ")


def labelize(c: Column) -> Column:
    """Underscores to spaces, first letter up."""
    spaced = F.translate(c, "_", " ")
    return F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2)))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def safe_text(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def safe_bool(c: Column) -> Column:
    """Text to a three-valued boolean."""
    value = F.lower(F.trim(c))
    return F.when(value.isin("true", "1"), True).when(value.isin("false", "0"), False)


def pseudonym(name: Column) -> Column:
    return F.concat(F.lit("candidate-"), F.left(F.md5(name), F.lit(8)))


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def percent(fraction: Column, digits: int = 1) -> Column:
    return F.round(fraction * 100, digits)


def accept_scale(conf: Column) -> Column:
    """Threshold given as fraction (at most 1) or percent, as whole percent."""
    return F.when(conf <= 1, F.floor(conf * 100)).otherwise(F.floor(conf)).cast("int")


def detect_scale(conf: Column) -> Column:
    """Threshold given as percent (above 1) or fraction, as fraction."""
    return F.when(conf > 1, conf / 100).otherwise(conf)


def show_date(ts: Column) -> Column:
    return F.date_format(ts, "MMM dd, yyyy")


def show_date_or_dash(ts: Column) -> Column:
    return F.coalesce(show_date(ts), F.lit("-"))


def number_text(c: Column, digits: int = 1) -> Column:
    """A number printed with a fixed count of decimals and no grouping."""
    return F.format_string(f"%.{digits}f", c.cast("double"))
