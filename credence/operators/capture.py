"""How a file was captured: metadata, detector output, pixel statistics, error levels, faces, security features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.text import clamp, contains_any, number_text, percent, sql_text, texts
from credence.operators.outcome import deduct, fmt


def doc_classes(spark) -> DataFrame:
    """The detector class dictionary as a 13-row dimension."""
    return spark.createDataFrame(fv.DOC_CLASSES, "class string, type string, description string, min_conf double")


def class_value(name: Column, field: int, default: Column) -> Column:
    """Class dictionary lookup as an expression, for names inside arrays."""
    number = field == 3
    pairs = ", ".join(f"{sql_text(c[0])}, " + (f"{c[field]}d" if number else sql_text(c[field])) for c in fv.DOC_CLASSES)
    return F.coalesce(F.element_at(F.expr(f"map({pairs})"), name), default)


def types_match(doc_type: Column, detected: Column) -> Column:
    """Selected document type accepts the detector type; an unlisted type accepts nothing."""
    match = F.lit(False)
    for selected, accepted in fv.ACCEPTED_TYPES.items():
        match = match | ((doc_type == selected) & detected.isin(accepted))
    return F.coalesce(match, F.lit(False))


def accepted_types(doc_type: Column) -> Column:
    """Sorted, comma-separated accepted types; NULL for an unlisted type."""
    chain = None
    for selected, accepted in fv.ACCEPTED_TYPES.items():
        value = F.lit(", ".join(sorted(accepted)))
        chain = F.when(doc_type == selected, value) if chain is None else chain.when(doc_type == selected, value)
    return chain


# --- upload and metadata ---------------------------------------------------------------------------


def upload_rejection(ext: Column, size: Column) -> Column:
    """Reason an upload is refused, NULL when accepted."""
    return F.when(~F.coalesce(F.lower(ext).isin(fv.UPLOAD_EXTENSIONS), F.lit(False)), "Only JPG, PNG, and PDF files are allowed.").when(
        size > fv.UPLOAD_MAX_BYTES, "File size must be under 5MB."
    )


def image_rejection(mime: Column, size: Column) -> Column:
    return F.when(~F.coalesce(mime.isin(fv.IMAGE_MIME_TYPES), F.lit(False)), "Only JPG and PNG images are supported.").when(
        size > fv.IMAGE_MAX_BYTES, "File too large. Maximum size is 10MB."
    )


def software_type(name: Column) -> Column:
    """editing, scanner, legitimate or unknown; lists are tried in that order."""
    low = F.lower(F.trim(name))
    return (
        F.when(contains_any(low, fv.EDITING_SOFTWARE), "editing")
        .when(contains_any(low, fv.LEGITIMATE_SOFTWARE),
              F.when(contains_any(low, fv.SCANNER_SOFTWARE), "scanner").otherwise("legitimate"))
        .otherwise("unknown")
    )


def map_first(exif: Column, tags) -> Column:
    """First non-empty value among the tags."""
    return F.coalesce(*[F.when(exif[t] != "", exif[t]) for t in tags])


def key_exif(exif: Column) -> Column:
    return F.map_filter(exif, lambda k, v: k.isin(fv.KEY_EXIF_TAGS))


def exif_date_issue(label: str, value: Column, as_of: Column) -> Column:
    stamp = F.try_to_timestamp(F.left(value, F.lit(19)), F.lit("yyyy:MM:dd HH:mm:ss"))
    return F.when(stamp > as_of, fmt(f"EXIF {label} date is in the future: %s — possible manipulation", value)).when(
        F.year(stamp) < 1990, fmt(f"EXIF {label} date is suspiciously old: %s", value)
    )


def file_age_days(created: Column, modified: Column) -> Column:
    """Whole days between creation and change, rounded down."""
    seconds = F.unix_seconds(modified.cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))
    return F.floor(seconds / 86400).cast("int")


def with_metadata_check(
    docs: DataFrame,
    exif: str = "exif",
    size_kb: str = "file_size_kb",
    created: str = "created",
    modified: str = "modified",
    ext: str | None = None,
    as_of: Column | None = None,
    out: str = "metadata",
) -> DataFrame:
    """Struct of score, software, software_type, software_suspicious, key_exif, issues, positives."""
    as_of = as_of if as_of is not None else F.current_timestamp()
    step = docs.withColumns({
        "_exif": F.coalesce(F.col(exif), F.expr("map()").cast("map<string,string>")),
        "_kb": F.coalesce(F.round(F.col(size_kb), 1), F.lit(0.0)),
        "_age": file_age_days(F.col(created), F.col(modified)),
    })
    step = step.withColumn("_sw", map_first(F.col("_exif"), fv.SOFTWARE_TAGS))
    step = step.withColumn("_type", software_type(F.col("_sw")))
    e, sw, kind, kb, age = (F.col(c) for c in ("_exif", "_sw", "_type", "_kb", "_age"))
    unknown = (kind == "unknown") & sw.isNotNull()
    empty, gps = F.size(e) == 0, F.coalesce(e["GPSInfo"] != "", F.lit(False))
    odd_colour = F.coalesce(e["ColorSpace"] == "65535", F.lit(False))
    device = F.trim(F.concat_ws(" ", F.coalesce(e["Make"], F.lit("")), F.coalesce(e["Model"], F.lit(""))))
    kb_text = number_text(kb)
    lost = deduct(
        F.when(kind == "editing", 40).when(unknown, 5), F.when(gps, 5), F.when(empty, 10), F.when(kb < 10, 10), F.when(odd_colour, 5)
    )
    issues = texts(
        F.when(kind == "editing", fmt('⚠ EDITING SOFTWARE DETECTED: "%s" — document was processed with image editing software. '
                                      "This is a strong indicator of tampering.", sw))
        .when(unknown, fmt('Unknown software detected: "%s" — manual check recommended', sw)),
        F.when(gps, "GPS coordinates embedded in document image — scanned certificates should not have GPS data"),
        exif_date_issue("Original", e["DateTimeOriginal"], as_of),
        exif_date_issue("Digitized", e["DateTimeDigitized"], as_of),
        exif_date_issue("Modified", e["DateTime"], as_of),
        F.when(age > 30, fmt("File was modified %s days after creation — possible post-scan editing", age)),
        F.when(empty, "No EXIF metadata found — metadata may have been stripped. Online editing tools often remove EXIF data."),
        F.when(kb < 10, fmt("File size very small (%sKB) — may be a low-quality copy", kb_text)),
        F.when(odd_colour, "Unusual color space detected — may indicate processing"),
    )
    positives = texts(
        F.when(kind == "scanner", fmt("Document scanned with legitimate scanner software: %s", sw))
        .when(kind == "legitimate", fmt("Software consistent with legitimate document capture: %s", sw)),
        F.when(device != "", fmt("Captured with device: %s", device)),
        F.when(age.between(0, 30), "File creation and modification dates are consistent"),
        F.when(~empty, fmt("EXIF metadata present (%s fields)", F.size(e))),
        F.when(kb > 100, fmt("File size consistent with a real scan (%sKB)", kb_text)),
    )
    skipped = ~F.lower(F.col(ext)).isin(fv.EXIF_EXTENSIONS) if ext else F.lit(False)
    struct = F.struct(
        F.when(skipped, 70).otherwise(clamp(F.lit(100) - lost)).alias("score"),
        F.when(~skipped, -lost).alias("score_adjustment"),
        F.when(~skipped, sw).alias("software"),
        F.when(~skipped, kind).alias("software_type"),
        (~skipped & (kind == "editing")).alias("software_suspicious"),
        F.size(e).alias("exif_fields"),
        key_exif(e).alias("key_exif"),
        F.when(skipped, texts()).otherwise(issues).alias("issues"),
        F.when(skipped, texts("File format does not support EXIF metadata")).otherwise(positives).alias("positives"),
    )
    return step.withColumn(out, struct).drop("_exif", "_kb", "_age", "_sw", "_type")


# --- detector output -----------------------------------------------------------------------------------


def detection(name: Column, fraction: Column, bbox: Column | None = None) -> Column:
    """One detection record out of a class name and a confidence fraction."""
    return F.struct(
        name.alias("class"),
        class_value(name, 1, F.lit("unknown")).alias("type"),
        class_value(name, 2, name).alias("description"),
        percent(fraction).alias("confidence"),
        (bbox if bbox is not None else F.lit(None).cast("array<int>")).alias("bbox"),
    )


def with_detect_check(docs: DataFrame, detections: str = "detections", out: str = "detect") -> DataFrame:
    """Class of the first detection, highest confidence over all, per-class threshold."""
    d = F.col(detections)
    first = F.get(d, F.lit(0))
    step = docs.withColumns({
        "_first": first,
        "_conf": F.coalesce(F.array_max(F.transform(d, lambda x: x["confidence"])), F.lit(0.0)),
        "_count": F.coalesce(F.size(d), F.lit(0)),
    })
    name, conf = F.coalesce(F.col("_first.class"), F.lit("")), F.col("_conf")
    step = step.withColumn("_min", class_value(name, 3, F.lit(fv.DEFAULT_DETECT_CONFIDENCE)))
    some = F.col("_count") > 0
    verified = some & (conf >= F.col("_min"))
    c, m = number_text(conf), number_text(F.col("_min"))
    hint = F.when(
        some & ~verified,
        F.when(name.isin(fv.HINT_NAMED_CLASSES),
               fmt("Document detected as %s at %s% confidence (minimum required: %s%). "
                   "Please upload a clear, flat, well-lit scan of the front of the document.", name, c, m))
        .otherwise(fmt("Document detected at %s% confidence (minimum required: %s%). "
                       "Please upload a higher quality image.", c, m)),
    )
    struct = F.struct(
        verified.alias("verified"),
        F.when(verified, 100).otherwise(0).alias("score"),
        conf.alias("confidence"),
        name.alias("class"),
        F.coalesce(F.col("_first.type"), F.lit("unknown")).alias("type"),
        F.col("_first.description").alias("description"),
        F.col("_count").alias("total_found"),
        F.col("_min").alias("min_conf"),
        hint.alias("hint"),
    )
    return step.withColumn(out, struct).drop("_first", "_conf", "_count", "_min")


# --- pixel statistics ---------------------------------------------------------------------------------------


def image_check(width, height, sharpness, edge_share, white_share, saturation, noise, cloned, jpeg, gray_var) -> Column:
    """Score and texts out of the image statistics columns."""
    good_res, fair_res = (width >= 600) & (height >= 350), (width >= 300) & (height >= 200)
    flat_jpeg = jpeg & (gray_var < 100)
    lost = deduct(
        F.when(~good_res & ~fair_res, 30),
        F.when(sharpness < 5, 25).when(sharpness < 20, 10),
        F.when(edge_share <= 0.01, 15),
        F.when(white_share > 0.92, 20),
        F.when(saturation < 10, 8),
        F.when(noise >= 25, 12).when(noise >= 15, 5),
        F.when(cloned, 25),
        F.when(flat_jpeg, 10),
    )
    issues = texts(
        F.when(~good_res & ~fair_res, "Very low resolution - possibly a photo of a photo"),
        F.when(sharpness < 5, "Document is very blurry - possible tampered or re-photographed")
        .when(sharpness < 20, "Document appears slightly blurry - could be a photocopy"),
        F.when(edge_share <= 0.01, "Very few edges detected - document may lack printed content"),
        F.when(white_share > 0.92, "Extremely high white area - possible blank or heavily altered document"),
        F.when(saturation < 10, "No color detected - document is black and white only"),
        F.when(noise >= 25, "High noise pattern detected - scan quality is low")
        .when(noise >= 15, "Moderate noise pattern detected - scan quality could be better"),
        F.when(cloned, "Repeated image blocks detected - possible copy-paste manipulation"),
        F.when(flat_jpeg, "Unusual JPEG compression pattern detected"),
    )
    positives = texts(
        F.when(good_res, "Good resolution - consistent with a scanned document").when(fair_res, "Acceptable resolution"),
        F.when(sharpness >= 80, "Document is sharp and clear")
        .when(sharpness >= 20, "Acceptable sharpness - may be laminated document"),
        F.when(edge_share > 0.03, "Clear edge structure detected - consistent with printed document"),
        F.when((white_share > 0.80) & (white_share <= 0.92), "Normal white background ratio for document"),
        F.when(saturation >= 25, "Color elements detected - consistent with official colored document"),
        F.when(noise < 5, "Low noise level - consistent with authentic scan")
        .when(noise < 15, "Acceptable noise level for scanned document"),
        F.when(~cloned, "No cloned regions detected"),
    )
    return F.struct(clamp(F.lit(100) - lost).alias("score"), issues.alias("issues"), positives.alias("positives"))


def error_level_check(mean: Column, std: Column, ratio: Column) -> Column:
    """Forgery, suspicious, warning or clean, in that order."""
    m, s, r = number_text(mean), number_text(std), number_text(ratio * 100)
    level = (
        F.when((ratio > fv.HIGH_ERROR_RATIO) & (mean > fv.HIGH_ERROR_MEAN), "forgery")
        .when((std > fv.HIGH_ERROR_STD) & (mean > 8.0), "suspicious")
        .when(mean > fv.HIGH_ERROR_MEAN, "warning")
        .otherwise("clean")
    )
    issue = (
        F.when(level == "forgery", F.concat(F.lit("⚠ ELA FORGERY DETECTED: "), r, F.lit("% of pixels show high error levels (mean ELA: "), m,
                                            F.lit(") — image regions were edited after original creation")))
        .when(level == "suspicious", F.concat(F.lit("⚠ ELA SUSPICIOUS: Inconsistent compression patterns detected (std: "), s,
                                              F.lit(", mean: "), m, F.lit(") — possible copy-paste or text overlay on document")))
        .when(level == "warning", F.concat(F.lit("⚠ ELA WARNING: Elevated error levels detected (mean: "), m,
                                           F.lit(") — document may have been processed or lightly edited")))
    )
    clean = F.when(level == "clean", F.concat(F.lit("ELA integrity check passed — uniform compression levels (mean: "), m,
                                              F.lit(", ratio: "), r, F.lit("%) — no pixel-level editing detected")))
    return F.struct(
        level.alias("level"),
        F.when(level == "forgery", 20).when(level == "suspicious", 50).when(level == "warning", 70).otherwise(100).alias("score"),
        F.when(level == "forgery", -40).when(level == "suspicious", -20).when(level == "warning", -10).otherwise(0).alias("score_adjustment"),
        (level != "clean").alias("suspicious"),
        (level == "forgery").alias("forgery_detected"),
        texts(issue).alias("issues"),
        texts(clean).alias("positives"),
    )


def face_check(frontal, profile, box_x, box_w, box_h, width, height, contrast) -> Column:
    """Face rule out of frontal and profile counts and the first frontal box."""
    count = F.when(frontal > 0, frontal).otherwise(profile)
    boxed = frontal > 0
    centre = box_x + F.floor(box_w / 2)
    area = (box_w * box_h) / (width * height)
    issues = texts(
        F.when((count == 1) & boxed & (area <= 0.02), "Detected face is very small — may not be a proper ID photo")
        .when(count == 0, "No face detected — ID document should have a photo")
        .when(count > 1, fmt("%s faces detected — ID should have only one photo", count)),
        F.when(boxed & (contrast < 15), "Face photo area has very low contrast — may be tampered"),
    )
    positives = texts(
        F.when((frontal == 0) & (profile > 0), "Face detected (profile view) — consistent with ID photo"),
        F.when(count == 1, "Exactly one face detected — consistent with ID document"),
        F.when((count == 1) & boxed, F.when(centre < width * 0.5, "Face positioned in expected ID photo area")
               .otherwise("Face detected on document")),
        F.when((count == 1) & boxed & (area > 0.02), "Face photo size is appropriate for ID document"),
        F.when(boxed & (contrast > 20), "Face photo has good contrast and clarity"),
    )
    return F.struct(
        (count > 0).alias("face_found"), count.alias("face_count"),
        F.when(count == 1, 100).when(count > 1, 70).otherwise(40).alias("score"),
        issues.alias("issues"), positives.alias("positives"),
    )


def security_check(doc_type, blue_red, header_bright, sat_std, sharpness, ink_std, hue_std, sat_mean, seal, border_detail) -> Column:
    """Four security-feature scores and their weighted sum (halves round to even)."""
    is_id, is_cert = doc_type == "national_id", doc_type == "certificate"
    inked = ink_std.isNotNull()
    holo = F.when((hue_std > 40) & (sat_mean > 60), "yes").when(hue_std > 20, "maybe").otherwise("no")
    uv = clamp(F.lit(100) - deduct(
        F.when(blue_red > 1.1, -5).when(blue_red < 0.6, 15), F.when(header_bright < 0.05, 10), F.when(~(sat_std > 30), 10)))
    laser = clamp(F.lit(100) - F.when(is_id, deduct(
        F.when(sharpness > 300, -5).when(sharpness <= 100, 20), F.when(inked & (ink_std >= 25), 15)
    )).otherwise(deduct(F.when(sharpness <= 50, 10))))
    holo_score = clamp(F.lit(100) - F.when(is_cert, deduct(
        F.when((holo == "yes") | ((holo == "no") & seal), -5).when(holo == "no", 15)
    )).when(is_id, deduct(F.when(holo == "yes", -5).when(holo == "no", 10))).otherwise(F.lit(0)))
    micro = clamp(F.lit(100) - deduct(F.when(border_detail > 200, -5).when(border_detail <= 50, 10)))
    total = F.rint(uv * 0.20 + laser * 0.35 + holo_score * 0.25 + micro * 0.20).cast("int")
    place = F.when(is_cert, "bottom center").otherwise("top right")
    issues = texts(
        F.when(blue_red < 0.6, "Unusual color channel ratio — may indicate non-official printing"),
        F.when(header_bright < 0.05, "Missing expected bright region in document header — logo may be absent"),
        F.when(~(sat_std > 30), "Low color variation — may indicate plain paper printing"),
        F.when(is_id & (sharpness <= 100), "Blurry text edges — laser-engraved IDs should have very sharp text")
        .when(~is_id & (sharpness <= 50), "Poor print quality detected"),
        F.when(is_id & inked & (ink_std >= 25), "Uneven text intensity — may indicate inkjet or toner printing"),
        F.when(is_cert & (holo == "no") & ~seal, "No official seal or hologram detected in expected location")
        .when(is_id & (holo == "no"), "No hologram detected in expected ID position"),
        F.when(border_detail <= 50, "No fine detail in border areas — microtext/guilloche pattern may be missing"),
    )
    positives = texts(
        F.when(blue_red > 1.1, "Blue channel pattern consistent with official color printing"),
        F.when(header_bright > 0.15, "Expected bright emblem/logo region detected in header area"),
        F.when(sat_std > 30, "Good color depth variation — consistent with security printing"),
        F.when(is_id & (sharpness > 300), "Very sharp text edges detected — consistent with laser engraving")
        .when(is_id & (sharpness > 100), "Good sharpness — acceptable for official document")
        .when(~is_id & (sharpness > 50), "Print quality consistent with official document production"),
        F.when(is_id & inked & (ink_std < 25), "Uniform text intensity — consistent with laser engraving"),
        F.when((is_cert | is_id) & (holo == "yes"), fmt("Hologram-like iridescent pattern detected in %s", place))
        .when((is_cert | is_id) & (holo == "maybe"), fmt("Possible hologram in %s — hue variation present", place))
        .when(is_cert & seal, "Official circular seal/stamp detected in expected location"),
        F.when(border_detail > 200, "Fine detail pattern detected in borders — consistent with microtext/guilloche")
        .when(border_detail > 50, "Border pattern detected"),
    )
    return F.struct(
        total.alias("score"), uv.alias("uv"), laser.alias("laser"), holo_score.alias("hologram"), micro.alias("microtext"),
        issues.alias("issues"), positives.alias("positives"),
    )
