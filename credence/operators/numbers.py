"""Reference-number checks: national ID, examination and university numbers, and their router."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.text import contains_any, first_group, first_listed, no_texts, texts, whole_word
from credence.operators.outcome import fmt


def _result(found, value, valid, detail, points, issues, positives) -> Column:
    return F.struct(
        F.lit(found).alias("number_found") if isinstance(found, bool) else found.alias("number_found"),
        value.cast("string").alias("number_value"),
        F.lit(valid).alias("format_valid") if isinstance(valid, bool) else valid.alias("format_valid"),
        detail.alias("format_detail"),
        F.lit(points).cast("int").alias("score_adjustment") if isinstance(points, int) else points.alias("score_adjustment"),
        issues.alias("issues"),
        positives.alias("positives"),
    )


def _none() -> Column:
    return F.lit(None).cast("string")


def national_id_value(text: Column) -> Column:
    return F.coalesce(first_group(text, fv.NATIONAL_ID_NUMBER), first_group(text, fv.ANY_16_DIGITS))


def national_id_check(number: Column, as_of_year: int = fv.AS_OF_YEAR) -> Column:
    """Outcome for an extracted 16-digit number (NULL: none found)."""
    first, year = F.left(number, F.lit(1)), F.substring(number, 2, 4).try_cast("int")
    age = as_of_year - year
    problem = (
        F.when(~first.isin("1", "2"), fmt("NID first digit '%s' invalid — must be 1 (Rwandan) or 2 (foreign)", first))
        .when(~year.between(1900, as_of_year), fmt(f"NID birth year '%s' out of valid range (1900–{as_of_year})", year))
        .when(age < 16, fmt("NID birth year implies age %s — too young for a national ID", age))
    )
    kind = F.when(first == "1", "Rwandan citizen").otherwise("Foreign national")
    missing = _result(
        False, _none(), False, F.lit("NID number not readable — OCR quality too low (laminated card)"), 0, no_texts(),
        texts("Document confirmed as National ID by AI model — NID number not OCR-readable (normal for laminated cards)"),
    )
    valid = _result(True, number, True, fmt("NID number %s passed format validation", number), 10, no_texts(),
                    texts(fmt("NID structure valid: %s, born %s", kind, year)))
    invalid = _result(True, number, False, fmt("NID number %s failed format check", number), -20, texts(problem), no_texts())
    return F.when(number.isNull(), missing).when(problem.isNull(), valid).otherwise(invalid)


def exam_number_check(upper: Column, as_of_year: int = fv.AS_OF_YEAR) -> Column:
    values = [first_group(upper, p, 0) for p in fv.EXAM_NUMBER_PATTERNS]
    years = [first_group(upper, p, 1) for p in fv.EXAM_NUMBER_PATTERNS]
    number, year = F.coalesce(*values), F.coalesce(*years).try_cast("int")
    plain = first_group(upper, fv.EXAM_NUMBER_PLAIN)
    good = _result(True, number, True, fmt("NESA certificate number found: %s (year %s)", number, year), 10, no_texts(),
                   texts(fmt("NESA certificate serial number validated: %s", number)))
    bad = _result(True, number, False, fmt("NESA number year %s is out of valid range", year), -10,
                  texts(fmt("Certificate year %s is invalid", year)), no_texts())
    numeric = _result(True, plain, True, fmt("Certificate number detected (numeric): %s", plain), 5, no_texts(),
                      texts(fmt("Certificate number detected: %s", plain)))
    missing = _result(False, _none(), False, F.lit("No NESA certificate number found — OCR may not have read it"), 0,
                      no_texts(), texts("NESA certificate type confirmed by AI model"))
    return (
        F.when(number.isNotNull() & year.between(2000, as_of_year), good)
        .when(number.isNotNull(), bad)
        .when(plain.isNotNull(), numeric)
        .otherwise(missing)
    )


def university_code(upper: Column) -> Column:
    return first_listed(upper, fv.UNIVERSITY_CODE_WORDS)


def _university_match(upper: Column, code: Column) -> tuple[Column, Column]:
    """Number and year of the first matching pattern of the text's university."""
    number = year = None
    for name, patterns in fv.UNIVERSITY_NUMBER_PATTERNS.items():
        values = [first_group(upper, p, 0) for p, _ in patterns]
        chain = None
        for value, (pattern, group) in zip(values, patterns):
            y = first_group(upper, pattern, group).try_cast("int") if group else F.lit(None).cast("int")
            chain = F.when(value.isNotNull(), y) if chain is None else chain.when(value.isNotNull(), y)
        here = code == name
        number = F.when(here, F.coalesce(*values)) if number is None else number.when(here, F.coalesce(*values))
        year = F.when(here, chain) if year is None else year.when(here, chain)
    return number, year


def university_number_check(upper: Column, code: Column, as_of_year: int = fv.AS_OF_YEAR) -> Column:
    number, year = _university_match(upper, code)
    labelled, plain = first_group(upper, fv.LABELLED_NUMBER), first_group(upper, fv.PLAIN_NUMBER)
    label = F.coalesce(code, F.lit("University"))
    bad_year = _result(True, number, False, fmt("%s certificate year %s is out of range", code, year), -10,
                       texts(fmt("Degree year %s is invalid for %s", year, code)), no_texts())
    good = _result(True, number, True, fmt("%s certificate number found: %s", code, number), 10, no_texts(),
                   texts(fmt("%s degree certificate number validated: %s", code, number)))
    by_label = _result(True, labelled, True, fmt("Certificate/degree reference number detected: %s", labelled), 5, no_texts(),
                       texts(fmt("%s degree reference number detected: %s", label, labelled)))
    numeric = _result(True, plain, True, fmt("Numeric reference number found: %s", plain), 3, no_texts(),
                      texts(fmt("Numeric reference detected: %s", plain)))
    missing = _result(False, _none(), False, fmt("No %s certificate number found", label), -10,
                      texts(fmt("No degree/certificate number detected for %s", label)), no_texts())
    return (
        # a missing year counts as valid
        F.when(number.isNotNull() & ((year < 1990) | (year > as_of_year)), bad_year)
        .when(number.isNotNull(), good)
        .when(labelled.isNotNull(), by_label)
        .when(plain.isNotNull(), numeric)
        .otherwise(missing)
    )


def institution_route(upper: Column, hint: Column | None = None) -> Column:
    """Which number check a text belongs to; substring tests, in this order."""
    hint = F.upper(F.coalesce(hint, F.lit(""))) if hint is not None else F.lit("")
    return (
        F.when(contains_any(upper, fv.ROUTE_ID_WORDS) | contains_any(hint, ["NATIONAL_ID", "NID"]), "nida")
        .when(contains_any(upper, fv.ROUTE_EXAM_WORDS) | contains_any(hint, ["NESA", "REB"]), "nesa")
        .when(whole_word(upper, "UR") | contains_any(upper, fv.ROUTE_UNIVERSITY_WORDS), "university")
    )


def with_number_check(
    docs: DataFrame,
    text: str = "text",
    doc_type_hint: str | None = None,
    institution_hint: str | None = None,
    out: str = "number",
    as_of_year: int = fv.AS_OF_YEAR,
) -> DataFrame:
    """Adds the routed number check as one struct column.  One pass over the row, no shuffle."""
    type_hint = F.coalesce(F.col(doc_type_hint), F.lit("")) if doc_type_hint else F.lit("")
    inst_hint = F.coalesce(F.col(institution_hint), F.lit("")) if institution_hint else F.lit("")
    chosen = F.lower(F.trim(F.when(type_hint != "", type_hint).otherwise(inst_hint)))
    body = F.coalesce(F.col(text), F.lit(""))
    prepared = docs.withColumns({"_text": body, "_up": F.upper(body), "_hint": chosen, "_type": type_hint})
    routed = institution_route(F.col("_up"), inst_hint)
    hint = F.col("_hint")
    too_short = F.length(F.trim(F.col("_text"))) < 10
    by_hint = hint.isin("national_id", "nesa", "secondary", "reb", "certificate", "transcript", "degree")
    route = (
        F.when(hint == "national_id", "nida")
        .when(hint.isin("nesa", "secondary", "reb"), "nesa")
        .when(hint.isin("certificate", "transcript", "degree"), F.when(routed.isin("nesa", "university"), routed))
        .when(~too_short, routed)
    )
    prepared = prepared.withColumn("_route", route)
    prepared = prepared.withColumns({
        "_nid": F.when(F.col("_route") == "nida", national_id_value(F.col("_text"))),
        "_code": F.when(F.col("_route") == "university", university_code(F.col("_up"))),
    })
    r = F.col("_route")
    unchecked = F.when(by_hint | ~too_short, "Institution not in hash-check scope (RP uses QR instead)").otherwise(
        "No OCR text and no doc_type hint provided"
    )
    result = (
        F.when(r == "nida", national_id_check(F.col("_nid"), as_of_year))
        .when(r == "nesa", exam_number_check(F.col("_up"), as_of_year))
        .when(r == "university", university_number_check(F.col("_up"), F.col("_code"), as_of_year))
        .otherwise(_result(False, _none(), False, unchecked, 0, no_texts(), no_texts()))
    )
    institution = (
        F.when(r == "nida", "Rwanda National ID (NIDA)")
        .when(r == "nesa", "NESA / Rwanda Education Board")
        .when(r == "university", F.coalesce(F.col("_code"), F.lit("University (Rwanda)")))
    )
    kind = (
        F.when(r == "nida", "national_id")
        .when(r.isin("nesa", "university"), "certificate")
        .otherwise(F.when((by_hint | ~too_short) & (F.col("_type") != ""), F.col("_type")))
    )
    done = prepared.withColumn("_res", result)
    fields = ["number_found", "number_value", "format_valid", "format_detail", "score_adjustment", "issues", "positives"]
    struct = F.struct(
        r.isNotNull().alias("checked"), institution.alias("institution"), kind.alias("doc_type"),
        *[F.col(f"_res.{f}").alias(f) for f in fields],
    )
    return done.withColumn(out, struct).drop("_text", "_up", "_hint", "_type", "_route", "_nid", "_code", "_res")
