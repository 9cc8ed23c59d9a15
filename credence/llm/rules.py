"""Quality rules: decision lists of threshold conjunctions, grown and pruned by sequential covering. Spark expressions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import written
from credence.llm.pii import bind

#: Statistics that conditions may use.
FEATURES = ("n_words", "word_length", "symbols_per_word", "bars_per_word", "exclaims_per_word", "upper_share", "dup_line_share", "repeat_share")
#: Cut points tried per statistic; conditions per rule; rules; least share of junk and least number of rows on the rows held for pruning.
CUTS, MOST_CONDITIONS, MOST_RULES, LEAST_PURITY, LEAST_ROWS = 32, 3, 8, 0.9, 3

_BLANK = r"[\x20\x09-\x0D]"
_BLANKS = " \t\n\x0b\x0c\r"


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))

    def covered(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))

        def starts(o: Column) -> Column:
            last = F.size(o) - 1
            again = F.filter(F.transform(o, lambda x, n: F.when(((n > 0) & (o[F.greatest(n - 1, F.lit(0))]["k"] == x["k"])) | ((n < last) & (o[F.least(n + 1, last)]["k"] == x["k"])), x["i"])), lambda x: x.isNotNull())
            return F.array_sort(again)

        def cover(s: Column) -> Column:
            count = F.aggregate(s, F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n")), lambda acc, x: F.struct(x.alias("at"), (acc["n"] + F.least(F.lit(3), x - acc["at"])).alias("n")), lambda acc: acc["n"])
            return count

        return bind(bind(ordered, starts), cover)

    some = bind(windows, lambda keys: F.when(F.size(F.array_distinct(keys)) < F.size(keys), covered(keys)).otherwise(F.lit(0)))
    return F.when(F.size(words) >= 3, some).otherwise(F.lit(0)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and FEATURES) of every whole text, a null text as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")

    def without(signs: str) -> Column:
        return F.length(text) - F.length(F.translate(text, signs, ""))

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.filter(F.split(text, f"{_BLANK}+", -1), lambda w: w != "")
    found = rows.select(
        "doc_id", (F.length(text) - without(_BLANKS)).cast("long").alias("word_chars"), without("#*$%&|<>").cast("long").alias("n_symbols"),
        without("|").alias("bars"), without("!").alias("exclaims"), F.length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("uppers"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("lines"),
        bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("again"))).alias("words"),
    )
    flat = found.select("doc_id", F.col("words.n").alias("n_words"), "word_chars", "n_symbols", F.col("lines.again").alias("n_dup_lines"), F.col("words.again").alias("n_repeat_words"), "bars", "exclaims", "uppers", F.col("lines.n").alias("n_lines"))
    per = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return flat.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", per("word_chars").alias("word_length"), per("n_symbols").alias("symbols_per_word"),
        per("bars").alias("bars_per_word"), per("exclaims").alias("exclaims_per_word"), (F.col("uppers") / F.greatest("word_chars", F.lit(1))).alias("upper_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"), per("n_repeat_words").alias("repeat_share"),
    )


class Rule:
    """A conjunction of (statistic, above or not, threshold)."""

    def __init__(self, conditions: list[tuple[str, bool, float]]) -> None:
        self.conditions = conditions

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f) > F.lit(t) if above else F.col(f) <= F.lit(t) for f, above, t in self.conditions])

    def __str__(self) -> str:
        return " AND ".join(f"{f} {'>' if above else '<='} {t!r}" for f, above, t in self.conditions)


def learn(labelled: DataFrame) -> list[Rule]:
    """Rules for junk, in order, from rows of FEATURES and a boolean ``junk``; no rules without both kinds of rows.

    Two thirds of the rows (by a hash of the row) grow a rule by the condition of the highest information gain, the
    rest prune it from its end to the highest (junk - good) / (junk + good).  A rule that is not pure
    enough there is dropped; what a rule covers is taken out before the next.  Every step is one
    aggregate of (statistic, cut) counts over all labelled rows.
    """
    cuts = {f: sorted(set(c)) for f, c in zip(FEATURES, labelled.agg(F.array(*[F.percentile_approx(F.col(f).cast("double"), [i / CUTS for i in range(1, CUTS)], 10000) for f in FEATURES]).alias("c")).first()["c"]) if c}
    # the quantiles of junk alone find thresholds that are rare among all rows
    more = labelled.where("junk").agg(F.array(*[F.percentile_approx(F.col(f).cast("double"), [i / CUTS for i in range(0, CUTS)], 10000) for f in FEATURES]).alias("c")).first()["c"]
    for f, c in zip(FEATURES, more):
        cuts[f] = sorted({*cuts.get(f, ()), *(c or ())})
    if not any(cuts.values()):
        return []
    bins = [reduce(lambda a, b: a + b, [(F.col(f) > F.lit(float(t))).cast("int") for t in cuts[f]], F.lit(0)).alias(f"bin_{f}") for f in FEATURES]
    part = F.pmod(F.xxhash64(*FEATURES, "doc_id"), F.lit(3)) == 2
    rows = written(labelled.select(*FEATURES, "junk", part.alias("pruning"), *bins), "labelled")
    rules: list[Rule] = []
    left = rows
    for _ in range(MOST_RULES):
        grown: list[tuple[str, bool, float]] = []
        inside = left.where("not pruning")
        p, n = _both(inside)
        while p and n and len(grown) < MOST_CONDITIONS:
            best = _best(inside, cuts, p, n)
            if best is None:
                break
            grown.append(best[0])
            inside = inside.where(Rule([best[0]]).column())
            p, n = best[1], best[2]
        if not grown:
            break
        held = left.where("pruning")
        sizes = held.agg(*[F.sum(F.when(Rule(grown[: i + 1]).column() & (F.col("junk") == kind), 1).otherwise(0)).alias(f"c{i}{kind}") for i in range(len(grown)) for kind in (True, False)]).first()
        scores = [((sizes[f"c{i}True"] or 0), (sizes[f"c{i}False"] or 0)) for i in range(len(grown))]
        worth = [(a - b) / (a + b) if a + b else -1.0 for a, b in scores]
        keep = max(range(len(grown)), key=lambda i: (worth[i], -i))
        a, b = scores[keep]
        rule = Rule(grown[: keep + 1])
        if a >= LEAST_ROWS and a >= LEAST_PURITY * (a + b):
            rules.append(rule)
        left = left.where(~rule.column())
    return rules


def _both(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.count_if("junk").alias("p"), F.count_if(~F.col("junk")).alias("n")).first()
    return int(r["p"]), int(r["n"])


def _best(rows: DataFrame, cuts: dict[str, list[float]], p: int, n: int):
    """The condition of highest gain p' * (log2 p'/(p'+n') - log2 p/(p+n)), with its counts; None if none gains."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in FEATURES])).alias("x")
    counts = rows.select("junk", pairs).groupBy("x.f", "x.b").agg(F.count_if("junk").alias("p"), F.count_if(~F.col("junk")).alias("n")).collect()
    best, most = None, 1e-9
    for f in FEATURES:
        by = {r["b"]: (r["p"], r["n"]) for r in counts if r["f"] == f}
        for i, t in enumerate(cuts[f]):
            low = [sum(v[k] for b, v in by.items() if b <= i) for k in (0, 1)]
            for above, (x, y) in ((False, low), (True, (p - low[0], n - low[1]))):
                if x and x + y < p + n:
                    gain = x * (math.log2(x / (x + y)) - math.log2(p / (p + n)))
                    if gain > most:
                        best, most = ((f, above, float(t)), x, y), gain
    return best


def verdict(rules: list[Rule]) -> Column:
    """The first rule that a row meets, as text; null if none: one ordered conditional expression."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.column(), F.lit(str(rule))).otherwise(out)
    return out


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with its statistics, base_failed, the rule that it meets, and kept.

    Rules are learned from all labelled documents that pass the base test (quality 0 is junk; of several labels the lowest counts).
    base_failed: under 50 words, or over half of the words in repeated windows.  Null texts count as empty, a null
    doc_id is judged without a label, repeated rows are judged each, other columns are not read; without
    labels there are no rules.
    """
    facts = written(statistics(docs), "statistics")
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min(F.col("quality").cast("int")) == 0).alias("junk"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = learn(facts.where(~failed).join(marks, "doc_id").select("doc_id", *FEATURES, "junk"))
    out = facts.withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
