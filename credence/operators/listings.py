"""Listings, lookups, joins and dashboard aggregates over candidates, documents and verifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.hotkeys import left_join_spread
from credence.functions.text import labelize, show_date_or_dash


def candidate_status(candidates: DataFrame, verifications: DataFrame) -> DataFrame:
    """Every candidate once per verification, once with NULL when there is none."""
    ver = verifications.select(F.col("candidate_id").alias("_cid"), "status")
    return left_join_spread(candidates, ver, "id", "_cid").drop("_cid", "_owner")


def verification_list(verifications: DataFrame, candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Verifications of known candidates, with the document where it still exists."""
    cand = candidates.select(F.col("id").alias("candidate_id"), "full_name", "position_applied")
    docs = documents.select(F.col("id").alias("document_id"), "doc_type", "file_path")
    joined = verifications.join(cand, "candidate_id", "inner").join(docs, "document_id", "left")
    return joined.withColumns({
        "shown_type": labelize(F.coalesce(F.col("doc_type"), F.lit("-"))),
        "shown_date": show_date_or_dash(F.col("verified_at")),
    })


def candidate_documents(verifications: DataFrame, documents: DataFrame) -> DataFrame:
    """Report rows: all verifications of a candidate with their document, NULL where missing."""
    docs = documents.select(F.col("id").alias("document_id"), "doc_type", "file_path", "uploaded_at")
    return verifications.join(docs, "document_id", "left")


def verification_of_document(verifications: DataFrame, documents: DataFrame) -> DataFrame:
    docs = documents.select(F.col("id").alias("document_id"), "doc_type", "file_path")
    return verifications.join(docs, "document_id", "inner")


def document_history(documents: DataFrame, verifications: DataFrame) -> DataFrame:
    """Documents with status and score, Pending when not yet verified."""
    ver = verifications.select(F.col("document_id").alias("_did"), "status", "authenticity_score")
    joined = left_join_spread(documents, ver, "id", "_did").drop("_did", "_owner")
    return joined.withColumn("shown_status", F.coalesce(F.col("status"), F.lit("Pending")))


def pending_documents(documents: DataFrame, verifications: DataFrame) -> DataFrame:
    """Documents without a verification."""
    done = verifications.select(F.col("document_id").alias("id")).distinct()
    return documents.join(done, "id", "left_anti")


def verified_flag(documents: DataFrame, verifications: DataFrame) -> DataFrame:
    """Per document: is there a verification yet?"""
    done = verifications.select(F.col("document_id").alias("id")).distinct().withColumn("_done", F.lit(True))
    return documents.join(done, "id", "left").withColumn("done", F.coalesce(F.col("_done"), F.lit(False))).drop("_done")


def worst_status(status: Column) -> Column:
    """Fake beats Suspicious, anything else counts as Verified."""
    fake, doubtful = F.count_if(status == "Fake"), F.count_if(status == "Suspicious")
    return F.when(fake > 0, "Fake").when(doubtful > 0, "Suspicious").otherwise("Verified")


def recommendation(status: Column) -> Column:
    return F.when(status == "Verified", fv.RECOMMENDATIONS["Verified"]).when(
        status == "Suspicious", fv.RECOMMENDATIONS["Suspicious"]
    ).otherwise(fv.RECOMMENDATIONS["Fake"])


def candidate_report(candidates: DataFrame, verifications: DataFrame) -> DataFrame:
    """Per candidate: number of documents, rounded average score, worst status, recommendation.

    Verifications are aggregated before the join, so the join carries one row per candidate.
    """
    per = verifications.where("candidate_id is not null").groupBy(F.col("candidate_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.avg("authenticity_score")).cast("int").alias("avg_score"),
        worst_status(F.col("status")).alias("overall_status"),
    )
    full = candidates.join(per, "id", "left").withColumns({
        "n_docs": F.coalesce("n_docs", F.lit(0)),
        "avg_score": F.coalesce("avg_score", F.lit(0)),
        "overall_status": F.coalesce("overall_status", F.lit("Verified")),
    })
    return full.withColumn("recommendation", recommendation(F.col("overall_status")))


def dashboard_counts(candidates: DataFrame, documents: DataFrame, verifications: DataFrame) -> DataFrame:
    """Five counts in one row; each table is read once, three one-row results are put side by side."""
    cand = candidates.agg(F.count(F.lit(1)).alias("candidates"))
    docs = documents.agg(F.count(F.lit(1)).alias("documents"))
    ver = verifications.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("Verified", "Fake", "Suspicious")])
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(cand).join(one(docs), "_one").join(one(ver), "_one").drop("_one")


def status_counts(verifications: DataFrame) -> DataFrame:
    return verifications.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def same_person(name_a: Column, email_a: Column, name_b: Column, email_b: Column) -> Column:
    """Name and e-mail equal without regard to case and outer spaces; no e-mail equals an empty one."""
    norm = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (norm(name_a) == norm(name_b)) & (norm(email_a) == norm(email_b))


def foreign_key_violations(candidates: DataFrame, documents: DataFrame, verifications: DataFrame, users: DataFrame) -> DataFrame:
    """Rows of each table whose non-null reference has no target."""
    def orphans(child, column, parent, label):
        keys = parent.select(F.col("id").alias("_ref"))
        bad = child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_ref"), "left_anti")
        return bad.select(F.lit(label).alias("constraint_name"), F.col("id").cast("bigint").alias("row_id"),
                          F.col(column).cast("bigint").alias("missing_id"))

    return (
        orphans(candidates, "created_by", users, "candidates.created_by")
        .unionByName(orphans(documents, "candidate_id", candidates, "documents.candidate_id"))
        .unionByName(orphans(verifications, "candidate_id", candidates, "verifications.candidate_id"))
        .unionByName(orphans(verifications, "document_id", documents, "verifications.document_id"))
    )


def label_summary(files: DataFrame, label: str = "label") -> DataFrame:
    """Per label: files, unreadable files, sizes, share of all files, readiness.

    ``files`` has width and height, -1 when unreadable.
    """
    readable = F.col("width") >= 0
    per = files.groupBy(label).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(~readable).alias("unreadable"),
        *[F.floor(F.avg(F.when(readable, F.col(c)))).cast("bigint").alias(f"avg_{c}") for c in ("width", "height")],
        *[F.min(F.when(readable, F.col(c))).alias(f"min_{c}") for c in ("width", "height")],
        *[F.max(F.when(readable, F.col(c))).alias(f"max_{c}") for c in ("width", "height")],
    )
    # one row per label, so the total is a window over a handful of rows
    total = F.sum("files").over(Window.partitionBy(F.lit(1)))
    ready = F.when(F.col("files") < 10, "too few").when(F.col("files") < 20, "small").otherwise("good")
    return per.withColumns({"share": F.round(F.col("files") / total * 100, 1), "readiness": ready})

