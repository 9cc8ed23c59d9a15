"""All checks of a document to one score, status, recommendation and list of issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.text import clamp, join_lists, labelize, number_text, safe_text, texts
from credence.operators.capture import accepted_types, class_value, types_match
from credence.operators.outcome import fmt


def _is(c: Column, value: bool) -> Column:
    return F.coalesce(c == F.lit(value), F.lit(False))


def link_bonus(found: Column, trusted: Column, verified: Column) -> Column:
    return F.when(found & trusted & verified, 10).when(found & trusted, 5).when(found, -10).otherwise(0)


def name_check_applies(detected_class: Column, candidate: Column) -> Column:
    """Printed names are compared only for classes without a portal, and only with a candidate name."""
    return detected_class.isin(fv.NAME_CHECKED_CLASSES) & (F.coalesce(candidate, F.lit("")) != "")


def regroup_issues(issues: Column) -> Column:
    """Name issues, then software issues, then duplicates; an issue may appear in two groups."""
    def having(*low, exact=()):
        def test(i):
            found = F.lit(False)
            for word in low:
                found = found | F.contains(F.lower(i), F.lit(word))
            for word in exact:
                found = found | F.contains(i, F.lit(word))
            return found
        return test

    return F.concat(
        F.filter(issues, having("borrowed", "name", exact=("CRITICAL",))),
        F.filter(issues, having("editing", "photoshop", "software")),
        F.filter(issues, having("duplicate")),
    )


def fuse(docs: DataFrame, out: str = "verdict") -> DataFrame:
    """Adds the verdict struct.

    Input columns: doc_type, pdf_failed, pdf_converted, candidate_name, and the structs
    detect (verified, class, type, description, confidence, hint), link (found, trusted,
    verified_online, name_match, institution, issues, positives), metadata (software,
    software_suspicious), duplicate (found, same_candidate, other_name, score_adjustment, issues,
    positives), printed (mismatch, match, found_names).  Column expressions only: one stage, no shuffle.
    """
    det, link, meta, dup, ocr = (F.col(c) for c in ("detect", "link", "metadata", "duplicate", "printed"))
    found, trusted = F.coalesce(link["found"], F.lit(False)), F.coalesce(link["trusted"], F.lit(False))
    online = F.coalesce(link["verified_online"], F.lit(False))
    edited = F.coalesce(meta["software_suspicious"], F.lit(False))
    borrowed = F.coalesce(dup["found"] & ~dup["same_candidate"], F.lit(False))
    ocr_bad, ocr_ok = F.coalesce(ocr["mismatch"], F.lit(False)), F.coalesce(ocr["match"], F.lit(False))
    name_bad = _is(link["name_match"], False)

    kind, cls = F.coalesce(det["type"], F.lit("unknown")), F.when(det["class"] != "", det["class"])
    step = docs.withColumns({
        "_class": F.coalesce(cls, F.lit("trained document class")),
        "_label": F.coalesce(F.when(det["description"] != "", det["description"]), cls, F.lit("trained document class")),
        "_min": class_value(F.coalesce(cls, F.lit("")), 3, F.lit(fv.DEFAULT_ACCEPT_CONFIDENCE)),
        "_fit": types_match(F.col("doc_type"), kind),
        "_bonus": link_bonus(found, trusted, online),
        "_stop": F.coalesce(F.col("pdf_failed"), F.lit(False)),
        "_seen": F.coalesce(det["verified"], F.lit(False)),
    })
    cls, label, least, fit, bonus, stop, seen = (F.col(c) for c in ("_class", "_label", "_min", "_fit", "_bonus", "_stop", "_seen"))
    accepted = seen & (det["confidence"] >= least) & fit
    base = clamp(F.lit(100) + bonus + F.when(edited, -30).otherwise(0) + F.coalesce(dup["score_adjustment"], F.lit(0)))
    step = step.withColumns({"_ok": ~stop & F.coalesce(accepted, F.lit(False)), "_base": base})
    ok, base = F.col("_ok"), F.col("_base")

    ocr_over = ocr_bad & ~_is(link["name_match"], True)
    score = F.when(name_bad, F.lit(50)).otherwise(base)
    score = F.when(ocr_over, F.least(score, F.lit(50))).otherwise(score)
    score = F.when(edited | borrowed, F.least(score, F.lit(30))).otherwise(score)
    status = (
        F.when(~ok | edited | borrowed, "Fake").when(name_bad | ocr_over, "Suspicious")
        .when(base >= fv.VERIFIED_FROM, "Verified").otherwise("Suspicious")
    )

    conf, need = number_text(det["confidence"]), number_text(least, 0)
    inst = F.coalesce(link["institution"], F.lit(""))
    shown = F.coalesce(F.get(F.filter(ocr["found_names"], lambda n: (F.length(n) > 5) & ~n.rlike("[0-9]")), F.lit(0)), F.lit("another person"))
    converted = F.coalesce(F.col("pdf_converted"), F.lit(False))
    gathered = join_lists(
        dup["issues"],
        texts(F.when(ocr_bad, fmt("⚠ NAME MISMATCH: Certificate shows '%s' but candidate is '%s' — possible borrowed certificate!",
                                  shown, F.col("candidate_name")))),
        link["issues"],
        texts(
            F.when(found & ~trusted, "QR links to unrecognized domain (-10 penalty)"),
            F.when(found & name_bad, "⚠ CRITICAL: Name on certificate does not match candidate — possible borrowed certificate!"),
            F.when(edited, fmt("⚠ CRITICAL: Document edited with %s — strong indicator of tampering!", F.coalesce(meta["software"], F.lit("None")))),
        ),
    )
    misfit = ~fit & accepted_types(F.col("doc_type")).isNotNull()
    refusal = F.when(~seen, "No trained model document class detected.").when(
        misfit,
        F.concat(F.lit("Type mismatch: expected "), accepted_types(F.col("doc_type")), F.lit(", got "), label, F.lit(" ("), kind,
                 F.lit(") at "), conf, F.lit("%.")),
    ).otherwise(F.concat(F.lit("Low-confidence detection: "), label, F.lit(" ("), conf, F.lit("%, required "), need, F.lit("%).")))
    issues = (
        F.when(stop, texts("PDF conversion failed — document cannot be verified automatically."))
        .when(~ok, F.concat(gathered, texts(refusal)))
        .when((base >= fv.VERIFIED_FROM) & ~edited, regroup_issues(gathered))
        .otherwise(gathered)
    )
    positives = F.when(stop, texts()).otherwise(join_lists(
        texts(F.when(converted, "PDF automatically converted to image for AI model verification")),
        dup["positives"],
        texts(F.when(ocr_ok & ~ocr_bad, "✔ OCR NAME CONFIRMED: Candidate name found on document")),
        link["positives"],
        texts(
            F.when(found & trusted & online, fmt("QR verified online at %s (+10 bonus)", F.coalesce(link["institution"], F.lit("None"))))
            .when(found & trusted, fmt("QR links to trusted institution: %s (+5 bonus)", F.coalesce(link["institution"], F.lit("None")))),
            F.when(ok, F.concat(F.lit("Trained model recognized "), label, F.lit(" ("), conf, F.lit("% confidence, required "), need, F.lit("%)."))),
        ),
    ))
    advice = (
        F.when(stop, "PDF could not be converted for verification. Please ask the candidate to upload a JPG or PNG scan instead.")
        .when(~seen, "Document not recognized by trained model. Treat as fake or unsupported.")
        .when(~ok & misfit, fmt("Document type mismatch. Selected '%s' but model detected %s (%s).", F.col("doc_type"), cls, kind))
        .when(~ok, F.coalesce(F.when(det["hint"] != "", det["hint"]), F.concat(
            F.lit("Detected '"), cls, F.lit("' at "), conf, F.lit("% (required "), need,
            F.lit("%). Please upload a clear, flat, well-lit scan of the front of the document."))))
        .when(borrowed, fmt("DUPLICATE DOCUMENT: This file was previously submitted by '%s'. This is a borrowed certificate. "
                            "Reject this application.", F.coalesce(dup["other_name"], F.lit("another candidate"))))
        .when(edited, fmt("Document was edited with %s. This is a strong indicator of tampering. Reject this document.",
                          F.coalesce(meta["software"], F.lit("None"))))
        .when(ocr_over, "Document type confirmed by AI but name mismatch via OCR. Manual review required.")
        .when(name_bad, "Document type confirmed by AI but name mismatch via QR. Manual review required.")
        .otherwise(F.concat(
            F.lit("Document matches trained model class: "), cls, F.lit(". Description: "), label, F.lit(". Confidence: "), conf,
            F.lit("% (required "), need, F.lit("%). "),
            F.when(online, fmt("QR verified online at %s. ", inst)).otherwise(""),
            F.when(converted, "PDF auto-converted for verification. ").otherwise(""),
            F.when(base == 100, "Marked valid at 100%. Candidate may proceed.")
            .otherwise("Some issues detected — manual review recommended."),
        ))
    )
    struct = F.struct(
        F.when(ok, score).otherwise(0).cast("int").alias("score"), status.alias("status"), advice.alias("recommendation"),
        issues.alias("issues"), positives.alias("positives"),
    )
    return step.withColumn(out, struct).drop("_class", "_label", "_min", "_fit", "_bonus", "_stop", "_seen", "_ok", "_base")


def screen(
    verified: Column, confidence: Column, threshold: Column, name_match: Column, holder: Column, candidate: Column,
    link_issues: Column, detected_class: Column, link_online: Column, institution: Column,
) -> Column:
    """The short screening rule: 100 / 70 / 30 from the detector, 50 on a name mismatch."""
    borrowed = _is(name_match, False)
    base = F.when(verified, 100).when(confidence >= threshold, 70).otherwise(30)
    score = F.when(borrowed, 50).otherwise(base)
    unseen = ~verified & (confidence < threshold)
    own = texts(
        F.when(unseen, "✗ Document type could not be confirmed by AI model."),
        F.when(borrowed, fmt("✗ BORROWED CERTIFICATE — QR confirms this certificate belongs to '%s', not candidate '%s'.",
                             F.when(F.coalesce(holder, F.lit("")) != "", holder).otherwise("unknown"), candidate)),
    )
    covered = ["name mismatch", "borrowed", "does not match candidate"]
    def fresh(i):
        keep = i != ""
        for word in covered:
            keep = keep & ~F.contains(F.lower(i), F.lit(word))
        return keep
    others = F.filter(F.transform(F.coalesce(link_issues, texts()), safe_text), fresh)
    status = F.when(borrowed, "Suspicious").when(score >= 80, "Verified").when(score >= 50, "Suspicious").otherwise("Unverified")
    note = F.when((F.coalesce(holder, F.lit("")) != "") & _is(name_match, True), fmt(" Name verified: %s.", holder)).otherwise("")
    verdict = (
        F.when(borrowed, "Document type confirmed by AI but name mismatch via QR. Manual review required.")
        .when(score >= 80, F.concat(
            F.lit("Document matches trained model class: "), detected_class, F.lit(". Confidence: "), number_text(confidence),
            F.lit("% (required "), F.floor(threshold).cast("string"), F.lit("%). "),
            F.when(link_online, fmt("QR verified online at %s.", F.when(F.coalesce(institution, F.lit("")) != "", institution).otherwise("institution")))
            .otherwise(""), note, F.lit(" Candidate may proceed.")))
        .when(score >= 50, "Document partially verified. Manual review recommended.")
        .otherwise("Document could not be verified. AI confidence too low or critical checks failed.")
    )
    return F.struct(score.alias("score"), status.alias("status"), verdict.alias("verdict"),
                    F.array_distinct(F.concat(own, others)).alias("issues"))


def recheck(
    stored_score: Column, stored_status: Column, stored_issues: Column, stored_advice: Column, doc_type: Column, detect: Column,
    is_pdf: Column, detect_ok: Column, class_thresholds: bool = False, default_confidence: float = fv.DEFAULT_ACCEPT_CONFIDENCE,
) -> Column:
    """Downgrade on read: a stored result becomes Fake, 0 when the detector no longer supports it.

    ``stored_issues`` is an array.  ``class_thresholds=False`` uses one threshold for every class.
    """
    name, kind = detect["class"], F.coalesce(detect["type"], F.lit("unknown"))
    need = class_value(name, 3, F.lit(default_confidence)) if class_thresholds else F.lit(default_confidence)
    fit, verified, any_found = types_match(doc_type, kind), detect["verified"], detect["total_found"] > 0
    accepted = verified & (detect["confidence"] >= need) & fit
    drop = ~is_pdf & detect_ok & ~accepted
    expected = accepted_types(doc_type)
    conf = number_text(detect["confidence"])
    label = F.coalesce(detect["description"], name, F.lit("unknown"))
    issue = (
        F.when(verified & any_found & expected.isNull(),
               fmt("Selected document type '%s' cannot be automatically verified against model class %s.", doc_type, name))
        .when(verified & any_found & ~fit,
              F.concat(F.lit("Document type mismatch: selected "), labelize(doc_type), F.lit(" expects "), expected,
                       F.lit(", but model detected "), label, F.lit(" ("), kind, F.lit(") at "), conf, F.lit("% confidence.")))
        .when(verified & any_found,
              F.concat(F.lit("Low-confidence trained model guess: "), label, F.lit(" ("), conf, F.lit("%, required "), number_text(need, 0), F.lit("%).")))
        .otherwise("No trained model document class detected.")
    )
    advice = (
        F.when(verified & any_found & ~fit, "The trained model result does not match the selected document type. Document was not marked valid.")
        .when(verified & any_found,
              F.concat(F.lit("The model made a low-confidence guess ("), conf, F.lit("%, required "), number_text(need, 0),
                       F.lit("%). Document was not marked valid.")))
        .otherwise("Document was not recognized by the trained model. Treat as fake or unsupported.")
    )
    return F.struct(
        F.when(drop, 0).otherwise(stored_score).alias("score"),
        F.when(drop, "Fake").otherwise(stored_status).alias("status"),
        F.when(drop, F.array_distinct(F.concat(stored_issues, F.array(issue)))).otherwise(stored_issues).alias("issues"),
        F.when(drop, advice).otherwise(stored_advice).alias("recommendation"),
        drop.alias("downgraded"),
    )


def issue_flags(issues_text: Column, advice: Column) -> Column:
    """name_mismatch and name_confirmed as read from the stored texts, any case."""
    low, tip = F.lower(F.coalesce(issues_text, F.lit(""))), F.lower(F.coalesce(advice, F.lit("")))
    bad = F.lit(False)
    for word in ("identity mismatch", "not found in document", "possible borrowed", "borrowed document"):
        bad = bad | F.contains(low, F.lit(word))
    good = (
        F.contains(low, F.lit("identity confirmed"))
        | F.contains(tip, F.lit("candidate name confirmed via ocr"))
        | F.contains(tip, F.lit("certificate holder from qr"))
    )
    return F.struct(bad.alias("name_mismatch"), (~bad & good).alias("name_confirmed"))
