"""Consistency across the documents of one person, and repeated parts inside one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.text import all_groups, bind, text_lines, texts, uni


def name_tokens(text: Column) -> Column:
    """Distinct words of more than two letters, upper case."""
    words = F.split(F.upper(text), uni(r"\s+"))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(uni(r"^\p{L}{3,}$"))))


def date_tokens(text: Column) -> Column:
    return F.array_distinct(F.concat(*[all_groups(text, p) for p in fv.DATE_SHAPES]))


def cross_consistency(docs: DataFrame, group: str, text: str) -> DataFrame:
    """Per group: score 100, less 30 without a common name word, less 25 without a common date.

    Each document contributes its distinct tokens, plus one marker row per kind.  A token is common
    when it was counted as often as the marker; everything is counted with partial aggregates, so
    no group is gathered and nothing is joined.
    """
    text_col, marker = F.col(text), F.lit("")
    dates = date_tokens(text_col)
    tagged = lambda kind, arr: F.transform(arr, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("token")))
    items = F.concat(
        tagged("name", F.concat(F.array(marker), name_tokens(text_col))),
        tagged("date", F.when(F.size(dates) > 0, F.concat(F.array(marker), dates)).otherwise(F.array().cast("array<string>"))),
    )
    exploded = docs.where(text_col.isNotNull()).select(F.col(group), F.explode(items).alias("_i")).select(group, "_i.kind", "_i.token")
    counted = exploded.groupBy(group, "kind", "token").agg(F.count(F.lit(1)).alias("n"))
    # number of tokens seen n times, per kind: at most one row per document count
    by_count = counted.groupBy(group, "kind", (F.col("token") == "").alias("is_marker"), "n").agg(F.count(F.lit(1)).alias("tokens"))
    docs_of = lambda kind: F.coalesce(F.max(F.when((F.col("kind") == kind) & F.col("is_marker"), F.col("n"))), F.lit(0))
    top_of = lambda kind: F.max(F.when((F.col("kind") == kind) & ~F.col("is_marker"), F.struct("n", "tokens")))
    per = by_count.groupBy(group).agg(
        docs_of("name").alias("n_docs"), docs_of("date").alias("n_dated"), top_of("name").alias("_name"), top_of("date").alias("_date")
    )
    common = lambda top, n: F.when(F.col(top)["n"] == F.col(n), F.col(top)["tokens"]).otherwise(F.lit(0))
    per = per.withColumns({"common_names": F.coalesce(common("_name", "n_docs"), F.lit(0)),
                           "common_dates": F.coalesce(common("_date", "n_dated"), F.lit(0))})
    several = F.col("n_docs") >= 2
    no_name = several & (F.col("common_names") == 0)
    no_date = several & (F.col("n_dated") >= 2) & (F.col("common_dates") == 0)
    return per.select(
        group, "n_docs", "n_dated", "common_names", "common_dates",
        (F.lit(100) - F.when(no_name, 30).otherwise(0) - F.when(no_date, 25).otherwise(0)).alias("score"),
        (~no_name & ~no_date).alias("consistent"),
        texts(F.when(no_name, "No matching names found across documents"),
              F.when(no_date, "Date of birth does not match across documents")).alias("issues"),
    )


def common_tokens(docs: DataFrame, group: str, text: str) -> DataFrame:
    """The name words found in every document of a group, one row per word."""
    tokens = F.concat(F.array(F.lit("")), name_tokens(F.col(text)))
    counted = docs.where(F.col(text).isNotNull()).select(F.col(group), F.explode(tokens).alias("token"))
    counted = counted.groupBy(group, "token").agg(F.count(F.lit(1)).alias("n"))
    size = counted.where("token = ''").select(group, "n")
    return counted.where("token <> ''").join(size, [group, "n"]).select(group, "token", F.col("n").alias("n_docs"))


def repeated_lines(text: Column) -> Column:
    """Repeats among the non-blank lines of one text: struct of lines, repeats, groups of more than two.

    Works inside the row on sorted lines: line i starts a group of more than two when it equals line
    i + 2 and differs from line i - 1.
    """
    sorted_lines = F.array_sort(F.filter(F.transform(text_lines(text), lambda s: F.trim(s)), lambda s: s != ""))

    def count(lines: Column) -> Column:
        n = F.size(lines)
        positions = F.when(n > 2, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
        groups = F.size(F.filter(
            positions,
            lambda i: (F.get(lines, i) == F.get(lines, i + 2)) & ((i == 0) | (F.get(lines, F.greatest(i - 1, F.lit(0))) != F.get(lines, i))),
        ))
        return F.struct(n.alias("lines"), (n - F.size(F.array_distinct(lines))).alias("repeats"), groups.alias("groups_over_two"))

    return bind(sorted_lines, count)


def clone_blocks(blocks: DataFrame, image: str = "image_id", block: str = "block", images: DataFrame | None = None) -> DataFrame:
    """Per image: blocks, repeats, groups of more than two, clone score, cloned flag.

    ``images`` lists the image keys, so that an image without any textured block is kept with zeros.  With a
    column total_blocks there, that number (flat blocks and all) must be over 20 for an image to be cloned.
    """
    counted = blocks.groupBy(image, block).agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy(image).agg(
        F.sum("n").alias("blocks"), F.sum(F.col("n") - 1).alias("repeats"), F.count_if(F.col("n") > 2).alias("groups_over_two")
    )
    if images is not None:
        known = [image, *(c for c in images.columns if c == "total_blocks")]
        per = images.select(*known).join(per, image, "left").na.fill(0, ["blocks", "repeats", "groups_over_two"])
    total = F.col("total_blocks" if "total_blocks" in per.columns else "blocks")
    return per.withColumns({
        "clone_score": F.least(F.lit(100), F.col("repeats") * 10).cast("int"),
        "cloned": (total > 20) & (F.col("groups_over_two") >= 2),
    })
