"""Duplicate persons and the set-based changes to the three application tables.

Every change is a function from the old tables to new ones; writing a new version and switching to
it is the job of ``credence.sources.tableset``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.functions.hotkeys import with_key_summary
from credence.session import cut_lineage
from credence.sources.tableset import TableSet


def with_person_key(candidates: DataFrame) -> DataFrame:
    """Keys of the same person, regardless of case and accents; a row without a name has no name key and is nobody's copy."""
    norm = lambda c: F.collate(F.trim(c), "UNICODE_CI_AI")
    return candidates.withColumns({"_name_key": norm(F.col("full_name")), "_mail_key": norm(F.coalesce(F.col("email"), F.lit("")))})


def keeper_map(candidates: DataFrame) -> DataFrame:
    """(duplicate_id, keeper_id): the lowest id with the same normalised name and e-mail is kept."""
    keyed = with_person_key(candidates).select("id", "_name_key", "_mail_key").where("_name_key is not null")
    summed = with_key_summary(
        keyed, ["_name_key", "_mail_key"], ["id"],
        partial={"_low": F.min("id"), "_n": F.count(F.lit(1))},
        total={"_keeper": F.min("_low"), "_all": F.sum("_n")},
        keep=F.col("_all") > 1,
    )
    # coalesce keeps the comparison from being pushed below the shared exchange as a NULL filter
    is_copy = F.coalesce(F.col("id") > F.col("_keeper"), F.lit(False))
    return summed.where(is_copy).select(F.col("id").alias("duplicate_id"), F.col("_keeper").alias("keeper_id"))


def _repoint(child: DataFrame, mapping: DataFrame) -> DataFrame:
    """candidate_id replaced by its keeper.  Rows without a candidate skip the join."""
    owned, free = child.where("candidate_id is not null"), child.where("candidate_id is null")
    moved = owned.join(mapping, F.col("candidate_id") == F.col("duplicate_id"), "left")
    moved = moved.withColumn("candidate_id", F.coalesce("keeper_id", "candidate_id")).drop("duplicate_id", "keeper_id")
    return moved.unionByName(free)


def merge_persons(candidates: DataFrame, documents: DataFrame, verifications: DataFrame):
    """New versions of the three tables with duplicates merged into their keeper."""
    mapping = keeper_map(candidates)
    kept = candidates.join(mapping.select(F.col("duplicate_id").alias("id")), "id", "left_anti")
    return kept, _repoint(documents, mapping), _repoint(verifications, mapping)


#: Tables that change together when persons are merged; each has the key id.
TABLES = ["candidates", "documents", "verifications"]


def apply_merge(tables: TableSet) -> int:
    """Merges duplicates into their keeper in the stored tables: all three change in one commit, or none; returns the new version.

    Only the buckets of removed persons and of the rows that move to a keeper get new files.
    """
    change = tables.begin()
    mapping = cut_lineage(keeper_map(change.table("candidates")))
    for child in ("documents", "verifications"):
        rows = change.table(child)
        moved = rows.join(mapping, F.col("candidate_id") == F.col("duplicate_id")).withColumn("candidate_id", F.col("keeper_id"))
        change.upsert(child, moved.select(rows.columns))
    change.delete("candidates", mapping.select(F.col("duplicate_id").alias("id")))
    return change.commit()


def delete_candidates(ids: DataFrame, candidates: DataFrame, documents: DataFrame, verifications: DataFrame):
    """Candidates with all their documents and verifications removed; ``ids`` has one column, id."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()

    def without(df, column):
        # rows without a candidate skip the join
        linked = df.where(F.col(column).isNotNull()).join(gone, F.col(column) == F.col("_gone"), "left_anti")
        return linked.unionByName(df.where(F.col(column).isNull()))

    kept = candidates.join(gone, F.col("id") == F.col("_gone"), "left_anti")
    return kept, without(documents, "candidate_id"), without(verifications, "candidate_id")


def set_null_on_delete(ids: DataFrame, child: DataFrame, column: str = "candidate_id") -> DataFrame:
    """References to deleted parents become NULL."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    linked, free = child.where(F.col(column).isNotNull()), child.where(F.col(column).isNull())
    cleared = linked.join(gone, F.col(column) == F.col("_gone"), "left").withColumn(
        column, F.when(F.col("_gone").isNull(), F.col(column))
    )
    return cleared.drop("_gone").unionByName(free)


def cascade_on_delete(ids: DataFrame, child: DataFrame, column: str = "document_id") -> DataFrame:
    """Rows that reference deleted parents disappear."""
    gone = ids.select(F.col("id").alias("_gone")).distinct()
    return child.join(gone, F.col(column) == F.col("_gone"), "left_anti")


def insert_unique(candidates: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming persons that are neither present nor repeated in the batch (lowest id wins)."""
    present = with_person_key(candidates).select("_name_key", "_mail_key").distinct()
    fresh = with_person_key(incoming).where("_name_key <> ''")
    new_keys = fresh.join(present, ["_name_key", "_mail_key"], "left_anti")
    columns = [c for c in incoming.columns if c != "id"]
    first = new_keys.groupBy("_name_key", "_mail_key").agg(F.min(F.struct("id", *columns)).alias("_row"))
    return first.select(*[F.col(f"_row.{c}").alias(c) for c in incoming.columns])


def update_persons(candidates: DataFrame, changes: DataFrame) -> DataFrame:
    """Name, e-mail and position replaced by id, unless another row already has that name and e-mail.

    ``changes`` has id, full_name, email, position_applied.  The collision test joins on the
    normalised key; only ids of accepted changes are joined back.
    """
    wanted = with_person_key(changes)
    held = with_person_key(candidates).select(F.col("id").alias("_holder"), "_name_key", "_mail_key")
    holders = held.groupBy("_name_key", "_mail_key").agg(F.min("_holder").alias("_lo"), F.max("_holder").alias("_hi"))
    checked = wanted.where("_name_key <> ''").join(holders, ["_name_key", "_mail_key"], "left")
    taken = F.coalesce((F.col("_lo") != F.col("id")) | (F.col("_hi") != F.col("id")), F.lit(False))
    accepted = checked.where(~taken).select(
        "id", F.col("full_name").alias("_n"), F.col("email").alias("_e"), F.col("position_applied").alias("_p"), F.lit(True).alias("_set")
    )
    joined = candidates.join(accepted, "id", "left")
    pick = lambda new, old: F.when(F.col("_set"), F.col(new)).otherwise(F.col(old))
    return joined.withColumns({"full_name": pick("_n", "full_name"), "email": pick("_e", "email"),
                               "position_applied": pick("_p", "position_applied")}).select(*candidates.columns)


def upsert(old: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key; ``new`` has one row per key."""
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)
