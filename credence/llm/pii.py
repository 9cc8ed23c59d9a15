"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of the result. The first four are base kinds: what passes its check stays whatever its score.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
#: A pattern run starts only where its first run of characters starts, or where the last match ended; possessive
#: repeats match what greedy ones would here, without backtracking over long runs.  Runs of digits are matched whole,
#: so those of another length than a card's, which fail their check, need not be listed.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Cheap tests that every text with a match passes.
GUARDS: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][0-9 -]{15}"),
    "phone": lambda t: t.contains("+"),
    "iban": lambda t: t.rlike("[A-Z]{2}[0-9]{2}"),
    "ssn": lambda t: t.rlike("-[0-9]{2}-"),
}
#: Score of a checked span by kind, and what a word of its list within CONTEXT code points adds.
SCORES = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}
WORDS_NEAR = {
    "email": "mail|contact|address", "ip": "ip|host|server|address", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile",
    "iban": "iban|bank|account", "ssn": "ssn|social|security",
}
CONTEXT, CONTEXT_ADDS, THRESHOLD = 40, 0.2, 0.5
#: Code points of a piece of a text; what is cut out of a text is cut out of its pieces, not counted from its start.
PIECE = 1024
_SPAN = "struct<kind:string,start:bigint,end:bigint,score:double,text:string>"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda acc, i: acc + value(i))
    return (total % 10) == 0


def mod97(code: Column) -> Column:
    """Whether an account code without spaces has remainder 1 by 97, its first four signs moved to the end, letters as 10 to 35."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(acc: Column, i: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(moved, i, F.lit(1))) - 1
        return (acc * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), step) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(F.when(F.length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return bind(_digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    return F.lit(True)


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running combination of an array, in rounds that each look twice as far back: n log n steps and no growing array."""

    def reach(acc: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda v, i: F.when(i >= step, combine(v, F.get(acc, i - step))).otherwise(v))

    return F.aggregate(F.sequence(F.lit(0), F.length(F.bin(F.size(values))) - 1), values, reach)


def pieces(text: Column) -> Column:
    """A text in pieces of PIECE code points, the last one shorter."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}+"), F.lit(0)))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to before ``end`` of a text in pieces."""

    def of(k: Column) -> Column:
        first = F.greatest(start - k * PIECE, F.lit(0))
        return F.substring(F.get(parts, k.cast("int")), (first + 1).cast("int"), (F.least(end - k * PIECE, F.lit(PIECE)) - first).cast("int"))

    whole = F.array_join(F.transform(F.sequence(F.floor(start / PIECE), F.floor((end - 1) / PIECE)), of), "")
    return F.when(end > start, whole).otherwise("")


def spans(text: Column) -> Column:
    """All spans of a text, by kind as in KINDS and then by start: array of (kind, start, end, score, text), code points, end exclusive.

    A kind's matches are leftmost and do not overlap; a match that fails its check is dropped and not
    tried again.  Kinds may overlap one another.  Null and empty texts have none.  Time grows with the length of a
    text (times the logarithm of its matches), whatever it holds.
    """
    return bind(pieces(text), lambda parts: F.concat(*[_of_kind(text, parts, kind) for kind in KINDS]))


def _of_kind(text: Column, pieces_of_text: Column, kind: str) -> Column:
    def place(match: Column, end: Column) -> Column:
        start = end - F.length(match)
        return F.struct(F.lit(kind).alias("kind"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), F.lit(SCORES[kind]).alias("score"), match.alias("text"))

    none = F.array().cast(f"array<{_SPAN}>")
    gaps, matches = F.split(text, PATTERNS[kind], -1).alias("gap"), F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)).alias("match")
    parts = F.filter(F.arrays_zip(gaps, matches), lambda p: p["match"].isNotNull())
    lengths = lambda found: F.transform(found, lambda p: F.length(p["gap"]) + F.length(p["match"]))
    placed = bind(parts, lambda found: bind(running(lengths(found), lambda a, b: a + b), lambda ends: F.transform(found, lambda p, i: place(p["match"], F.get(ends, i)))))
    checked = F.filter(placed, lambda s: _valid(kind, s["text"]))
    scored = F.transform(checked, lambda s: s.withField("score", s["score"] + _context(pieces_of_text, s, kind)))
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= THRESHOLD)
    return F.when(GUARDS[kind](text), scored).otherwise(none)


def _context(parts: Column, span: Column, kind: str) -> Column:
    # a place beyond the text is in no piece, or beyond the end of the last one
    behind = F.least(span["end"] + CONTEXT, F.lit(PIECE) * F.size(parts))
    around = F.concat_ws(" ", cut(parts, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"]), cut(parts, span["end"], behind))
    return F.when(F.lower(around).rlike(rf"\b(?:{WORDS_NEAR[kind]})\b"), CONTEXT_ADDS).otherwise(0.0)


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every whole text, a null text as empty.  Repeated rows and null ids are kept, other columns not read."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", spans(F.col("text")).alias("spans"))


def listed(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _is(kind: str):
    return lambda s: s["kind"] == kind


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and the list of all spans, per document."""
    found = F.col("spans")
    counts = [F.size(F.filter(found, _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter(found, lambda s: s["kind"].isin(*BASE))
    return personal_data(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"))


def redacted(text: Column, found: Column) -> Column:
    """The text with every stretch that spans cover replaced by its first kind in angle brackets; overlapping spans are one stretch."""
    ordered = F.array_sort(found, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))

    def whole(parts: Column, sorted_spans: Column, reach: Column) -> Column:
        def step(s: Column, i: Column) -> Column:
            at = F.coalesce(F.get(reach, i - 1), F.lit(0))  # how far earlier spans reach
            return F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

        rest = cut(parts, F.element_at(reach, -1), F.length(text))
        return F.concat(F.array_join(F.transform(sorted_spans, step), ""), rest)

    placed = lambda parts, o: bind(running(F.transform(o, lambda s: s["end"]), F.greatest), lambda reach: whole(parts, o, reach))
    return F.when(F.size(found) > 0, bind(pieces(text), lambda parts: bind(ordered, lambda o: placed(parts, o)))).otherwise(text)
