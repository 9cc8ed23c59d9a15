"""Downgrade on read, written back to the stored verifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.text import join_issues, split_issues
from credence.operators.fusion import recheck
from credence.session import cut_lineage
from credence.sources.tableset import Change, Conflict, TableSet


def downgrades(verifications: DataFrame, detected: DataFrame, class_thresholds: bool = False, default_confidence: float = fv.DEFAULT_ACCEPT_CONFIDENCE) -> DataFrame:
    """Rows of the verifications table whose new detector result no longer supports what is stored, as they should read.

    ``detected``: document_id, doc_type, detect, is_pdf, detect_ok.
    """
    joined = verifications.join(detected, "document_id")
    verdict = recheck(
        F.col("authenticity_score"), F.col("status"), split_issues(F.coalesce("issues", F.lit(""))), F.col("recommendation"), F.col("doc_type"), F.col("detect"), F.col("is_pdf"), F.col("detect_ok"),
        class_thresholds, default_confidence)
    lowered = joined.withColumn("_r", verdict).where("_r.downgraded")
    new = {"authenticity_score": F.col("_r.score").cast("int"), "status": F.col("_r.status"), "issues": join_issues(F.col("_r.issues")), "recommendation": F.col("_r.recommendation")}
    return lowered.withColumns(new).select(verifications.columns)


def write_back(tables: TableSet, detected: DataFrame, read: Change | None = None, **limits) -> int | None:
    """Stores the downgrades of the given documents on the version they were judged on; returns the new version, None where none was needed.

    ``read`` is a change begun when the rows were shown.  A verdict that was stored since makes the downgrade stale: then
    Conflict is raised and nothing is written; the caller reads again.
    """
    change = read or tables.begin()
    if tables.manifest()["version"] != change.base["version"]:
        raise Conflict(f"version {change.base['version']} was read, another one is stored")
    stored = change.lookup("verifications", detected.select("document_id"))
    rows = cut_lineage(downgrades(stored, detected, **limits))
    if not rows.limit(1).count():
        return None
    change.upsert("verifications", rows)
    return change.commit()
