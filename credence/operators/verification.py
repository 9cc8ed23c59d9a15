"""All checks in a row: from submissions to verdicts and verification rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.text import join_issues
from credence.operators.capture import with_detect_check, with_metadata_check
from credence.operators.content import with_name_match
from credence.operators.duplicates import duplicate_outcome, duplicate_pairs, file_hash
from credence.operators.fusion import fuse, name_check_applies
from credence.operators.links import printed_link, with_linked_pages
from credence.session import cut_lineage


def with_printed_name(docs: DataFrame, text: str = "text", candidate: str = "candidate_name", out: str = "printed") -> DataFrame:
    """Name on the document, for the classes it is checked for.

    Rows outside the gate never reach the text functions: their text is replaced by an empty one
    before, and an empty name is settled without Python.
    """
    gate = F.coalesce(name_check_applies(F.col("detect.class"), F.col(candidate)), F.lit(False))
    step = docs.withColumns({"_gate": gate, "_gtext": F.when(gate, F.col(text)).otherwise(""), "_gname": F.when(gate, F.col(candidate))})
    step = with_name_match(step, "_gtext", "_gname", "_pn")
    points = F.when(F.col("_gate"), F.col("_pn.adjustment")).otherwise(0)
    struct = F.struct((points <= -50).alias("mismatch"), (points >= 10).alias("match"), F.col("_pn.found_names").alias("found_names"))
    return step.withColumn(out, struct).drop("_gate", "_gtext", "_gname", "_pn")


def no_link() -> Column:
    empty = F.array().cast("array<string>")
    nothing = F.lit(None).cast("string")
    return F.struct(
        F.lit(False).alias("found"), F.lit(False).alias("trusted"), F.lit(False).alias("verified_online"), F.lit(None).cast("boolean").alias("name_match"),
        nothing.alias("holder"), nothing.alias("institution"), nothing.alias("url"), empty.alias("issues"), empty.alias("positives"))


def no_duplicate() -> Column:
    empty = F.array().cast("array<string>")
    return F.struct(F.lit(False).alias("found"), F.lit(False).alias("same_candidate"), F.lit(None).cast("string").alias("other_name"),
                    F.lit(0).alias("score_adjustment"), empty.alias("issues"), empty.alias("positives"))


def no_printed_name() -> Column:
    return F.struct(F.lit(False).alias("mismatch"), F.lit(False).alias("match"), F.array().cast("array<string>").alias("found_names"))


def evidence(submissions: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All checks of a document that need no other row, and what the others need; the text itself stays behind.

    ``submissions``: id, candidate_id, candidate_name, doc_type, text, payload, detections, exif,
    file_size_kb, created, modified, pdf_failed, pdf_converted and, if stored at ingest, file_hash.
    """
    if "file_hash" not in submissions.columns:
        submissions = submissions.withColumn("file_hash", file_hash(F.col("text")))
    step = with_detect_check(submissions)
    step = with_metadata_check(step, as_of=as_of)
    step = with_printed_name(step).withColumn("printed_link", printed_link(F.col("text"), F.col("payload")))
    return step.select("id", "candidate_id", "candidate_name", "doc_type", "pdf_failed", "pdf_converted", "payload", "file_hash", "detect", "metadata", "printed", "printed_link")


def verify(submissions: DataFrame, pages: DataFrame, owners: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Verdict for every submission (columns of :func:`evidence`).

    ``pages`` are fetched pages: url, http_status, html and, if known, fetched_at.  The text is read once: all row-local checks run in
    that pass, and what is kept per document is small.  That narrow result is checkpointed; the duplicate
    search and the joins read it.  Only pages that some document links to are judged.
    """
    narrow = cut_lineage(evidence(submissions, as_of))
    dup = duplicate_outcome(duplicate_pairs(narrow.select("id", "candidate_id", "file_hash"), owners)).select("id", "duplicate")
    linked = with_linked_pages(narrow, pages, printed="printed_link")
    return fuse(linked.join(dup, "id"))


def verification_rows(verified: DataFrame, verified_at: Column | None = None) -> DataFrame:
    """Rows of the verifications table, lists joined to text."""
    v, k = F.col("verdict"), F.col("link")
    return verified.select(
        "candidate_id", F.col("id").alias("document_id"), v["score"].alias("authenticity_score"), v["status"].alias("status"),
        join_issues(v["issues"]).alias("issues"), v["recommendation"].alias("recommendation"),
        (verified_at if verified_at is not None else F.current_timestamp()).alias("verified_at"),
        F.coalesce(k["url"], F.lit("")).alias("qr_url"), F.coalesce(k["institution"], F.lit("")).alias("qr_institution"),
        F.coalesce(k["verified_online"], F.lit(False)).alias("qr_verified"), k["name_match"].alias("name_match"),
        F.coalesce(k["holder"], F.lit("")).alias("cert_holder"),
    )
