"""The same file submitted more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.functions.hotkeys import SALTS, salt_of
from credence.functions.text import no_texts, texts
from credence.operators.outcome import fmt


def file_hash(content: Column) -> Column:
    return F.md5(content)


def content_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def duplicate_pairs(
    submissions: DataFrame,
    owners: DataFrame | None = None,
    id_col: str = "id",
    owner: str = "candidate_id",
    hash_col: str = "file_hash",
    salts: int = SALTS,
) -> DataFrame:
    """Each submission with the first (lowest id) other submission of the same file.

    Returns id, owner and hash columns plus n_copies, first_id, other_id, other_candidate, other_name,
    any_other_candidate.  ``owners`` (id, full_name) supplies the name.

    Only id, owner and hash travel, through one exchange on (hash, salt) that all steps read.  The
    lowest other id is the lowest id of the file, or the lowest of the rest for that row itself;
    both are plain minima, summed up per (hash, salt) first, so a file with any number of copies is
    never gathered in one task.

    If the hash is computed on the fly from large contents, checkpoint id, owner and hash before.
    """
    # a submission without a hash is a file of its own; neither key can be NULL, so that no step
    # filters the rows before the exchange and all steps can share it
    alone = F.concat(F.lit("none:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = submissions.select(
        F.col(id_col).alias("_id"), F.col(owner).alias("_owner"), F.coalesce(F.col(hash_col), alone).alias("_hash")
    )
    rows = rows.withColumn("_salt", salt_of("_id", salts=salts)).repartition("_hash", "_salt")
    pair = F.struct(F.col("_id").alias("id"), F.col("_owner").alias("owner"))
    owner_text = F.coalesce(F.col("_owner").cast("string"), F.lit("none"))
    parts = rows.groupBy("_hash", "_salt").agg(
        F.count(F.lit(1)).alias("n"), F.min(pair).alias("low"), F.min(owner_text).alias("omin"), F.max(owner_text).alias("omax")
    )
    per_file = Window.partitionBy("_hash")
    repeated = parts.select(
        "_hash", "_salt",
        F.sum("n").over(per_file).alias("_n"), F.min("low").over(per_file).alias("_low"),
        F.min("omin").over(per_file).alias("_omin"), F.max("omax").over(per_file).alias("_omax"),
    ).where("_n > 1")
    members = rows.join(repeated.select("_hash", "_salt", "_low"), ["_hash", "_salt"])
    later = F.when(F.col("_id") > F.col("_low.id"), pair)
    rest = (
        members.groupBy("_hash", "_salt").agg(F.min(later).alias("_next"))
        .groupBy("_hash").agg(F.min("_next").alias("_next"))
    )
    files = repeated.join(rest, "_hash")
    if owners is not None:
        names = owners.select(F.col("id").alias("_oid"), F.col("full_name").alias("_oname"))
        for part, name in (("_low", "_low_name"), ("_next", "_next_name")):
            looked = names.withColumnRenamed("_oname", name)
            files = files.join(looked, F.col(f"{part}.owner") == F.col("_oid"), "left").drop("_oid")
    else:
        files = files.withColumns({"_low_name": F.lit(None).cast("string"), "_next_name": F.lit(None).cast("string")})
    joined = rows.join(files, ["_hash", "_salt"], "left")
    is_first = F.col("_id") == F.col("_low.id")
    other = F.when(is_first, F.col("_next")).otherwise(F.col("_low"))
    copied = F.col("_n").isNotNull()
    return joined.select(
        F.col("_id").alias(id_col), F.col("_owner").alias(owner), F.when(~F.col("_hash").startswith("none:"), F.col("_hash")).alias(hash_col),
        F.coalesce(F.col("_n"), F.lit(1)).cast("bigint").alias("n_copies"),
        F.col("_low.id").alias("first_id"),
        other["id"].alias("other_id"),
        other["owner"].alias("other_candidate"),
        F.when(is_first, F.col("_next_name")).otherwise(F.col("_low_name")).alias("other_name"),
        # a submission without a candidate counts as someone else's
        (copied & ((F.col("_omin") != F.col("_omax")) | F.col("_owner").isNull())).alias("any_other_candidate"),
    )


def duplicate_outcome(pairs: DataFrame, owner: str = "candidate_id", out: str = "duplicate") -> DataFrame:
    """Unique, re-upload by the same candidate (no penalty) or another candidate's file (-60)."""
    found = F.col("other_id").isNotNull()
    same = found & F.coalesce(F.col("other_candidate") == F.col(owner), F.lit(False))
    who = F.coalesce(F.col("other_name"), F.lit("Unknown"))
    borrowed = found & ~same
    struct = F.struct(
        found.alias("found"), same.alias("same_candidate"), F.col("other_id").alias("other_id"),
        F.when(found, who).alias("other_name"),
        F.when(borrowed, -60).otherwise(0).alias("score_adjustment"),
        F.when(borrowed, texts(fmt(
            "⚠ CRITICAL: DUPLICATE DOCUMENT DETECTED — This exact file was previously submitted by '%s' (doc ID: %s). "
            "This is a strong indicator of a borrowed or shared certificate!", who, F.col("other_id"))))
        .otherwise(no_texts()).alias("issues"),
        F.when(same, texts(fmt("Note: This candidate previously submitted an identical file (doc ID: %s) — possible re-upload",
                               F.col("other_id"))))
        .when(~found, texts("No duplicate submissions found — this document is unique in the system"))
        .otherwise(no_texts()).alias("positives"),
    )
    return pairs.withColumn(out, struct)


def duplicate_groups(submissions: DataFrame, hash_col: str = "file_hash", owner: str = "candidate_id") -> DataFrame:
    """Files submitted more than once and the number of candidates behind them.

    Counting per (file, candidate) first keeps the distinct count a plain two-step sum.
    """
    per_owner = submissions.groupBy(hash_col, owner).agg(F.count(F.lit(1)).alias("_n"))
    per_file = per_owner.groupBy(hash_col).agg(
        F.sum("_n").alias("n_docs"), F.count(owner).alias("n_candidates")
    )
    return per_file.where("n_docs > 1")
