"""Document text rules: institution, document type, authority, content validation, name matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.names import holder_names, letters_only, name_parts, normal_name, phrase_in_text
from credence.functions.similarity import document_words, with_token_hits
from credence.functions.text import (
    all_groups, bind, clamp, contains_any, first_listed, join_lists, known_words, no_texts, phrase_hits, priority_first, text_hits, texts, uni, word_count, word_hits,
)
from credence.operators.outcome import deduct, fmt

POLYTECHNIC_URL = "RWANDA POLYTECHNIC (via URL)"
UNIVERSITY_URL = "UNIVERSITY OF RWANDA (via URL)"


ALL_WORDS = [*fv.INSTITUTION_WORDS.values(), [c for c, _ in fv.SHORT_CODES], fv.ID_WORDS, fv.CERTIFICATE_WORDS, fv.TRANSCRIPT_WORDS]


def with_known_words(docs: DataFrame, upper: str, out: str = "_known") -> DataFrame:
    """The dictionary words of a text, found once for all lists."""
    return docs.withColumn(out, known_words(F.col(upper), *ALL_WORDS))


def with_institution(docs: DataFrame, upper: str, out: str = "institution", known: str | None = None) -> DataFrame:
    """Struct of found institutions (priority order) and category."""
    up = F.col(upper)
    step = docs if known else with_known_words(docs, upper, "_iknown")
    words = known or "_iknown"
    by_category = {f"_{c}": word_hits(words, upper, listed) for c, listed in fv.INSTITUTION_WORDS.items()}
    step = step.withColumns({**by_category, "_codes": word_hits(words, upper, [c for c, _ in fv.SHORT_CODES])})
    listed = [F.col(f"_{c}") for c in fv.INSTITUTION_WORDS]
    named = F.array_distinct(F.concat(*listed, F.col("_codes")))
    step = step.withColumn("_named", named)
    fragments = F.when(F.size("_named") == 0, text_hits(upper, [f for f, _ in fv.INSTITUTION_FRAGMENTS]))
    step = step.withColumn("_frags", F.coalesce(fragments, no_texts()))

    # the last category with a listed word wins; codes only fill a gap, first code with a category
    last_listed = F.coalesce(*[F.when(F.size(f"_{c}") > 0, F.lit(c)) for c in reversed(list(fv.INSTITUTION_WORDS))])
    by_code = F.coalesce(*[F.when(F.array_contains("_codes", c), F.lit(cat)) for c, cat in fv.SHORT_CODES if cat])
    # among fragments the last one with a category wins
    by_fragment = F.coalesce(
        *[F.when(F.array_contains("_frags", f), F.lit(cat)) for f, cat in reversed(fv.INSTITUTION_FRAGMENTS) if cat]
    )
    poly, uni_url = contains_any(up, ["RP.AC.RW", "GRADUATE.RP"]), up.contains("UR.AC.RW")
    category = F.when(uni_url, "universities").when(poly, "polytechnics").otherwise(F.coalesce(last_listed, by_code, by_fragment))
    found = F.concat(
        F.col("_named"), F.col("_frags"),
        texts(F.when(poly, F.lit(POLYTECHNIC_URL)), F.when(uni_url, F.lit(UNIVERSITY_URL))),
    )
    struct = F.struct(priority_first(found, fv.INSTITUTION_PRIORITY).alias("found"), category.alias("category"))
    return step.withColumn(out, struct).drop(*by_category, "_codes", "_named", "_frags", "_iknown")


def authority_role(upper: Column) -> Column:
    """First listed authority role in the text, capitalised as a title."""
    titled = [(role, "-".join(w.title() for w in role.split("-"))) for role in fv.AUTHORITY_ROLES]
    return first_listed(upper, titled)


def with_doc_type(docs: DataFrame, upper: str, out: str = "doc_kind", known: str | None = None) -> DataFrame:
    """Struct of document kind and keyword score."""
    step = docs if known else with_known_words(docs, upper, "_tknown")
    words = known or "_tknown"
    step = step.withColumns({
        "_id": word_hits(words, upper, fv.ID_WORDS),
        "_cert": F.size(word_hits(words, upper, fv.CERTIFICATE_WORDS)) + F.size(text_hits(upper, fv.CERTIFICATE_PHRASES)),
        "_trans": F.size(word_hits(words, upper, fv.TRANSCRIPT_WORDS)),
    })
    strong = F.size(F.filter("_id", lambda k: ~k.isin(fv.WEAK_ID_WORDS)))
    step = step.withColumn("_strong", strong)
    cert = (F.col("_cert") >= 2) & (F.col("_cert") >= F.col("_strong"))
    trans = (F.col("_trans") >= 2) & (F.col("_trans") >= F.col("_cert"))
    ident = F.col("_strong") >= 2
    kind = F.when(cert, "certificate").when(trans, "transcript").when(ident, "national_id").otherwise("unknown")
    score = F.when(cert, F.col("_cert")).when(trans, F.col("_trans")).when(ident, F.size("_id")).otherwise(0)
    return step.withColumn(out, F.struct(kind.alias("kind"), score.cast("int").alias("score"))).drop(
        "_id", "_cert", "_trans", "_strong", "_tknown"
    )


def _validation(score: Column, issues: Column, positives: Column) -> Column:
    return F.struct(score.cast("int").alias("score"), issues.alias("issues"), positives.alias("positives"))


def id_validation(text: Column, upper: str, found: Column) -> Column:
    """National-ID content: number, official words, a date."""
    long_no, old_no = text.rlike(uni(r"\b\d{16}\b")), text.rlike(uni(r"\b\d{10}\b"))
    words = text_hits(upper, fv.ID_WORDS)
    n, dated = F.size(words), text.rlike(uni(fv.ANY_DATE))
    score = F.lit(100) - deduct(
        F.when(~long_no & ~old_no, 20), F.when(n < 1, 30).when(n < 3, 10), F.when(~dated, 10)
    )
    issues = texts(
        F.when(~long_no & ~old_no, "No valid Rwandan NID number format found"),
        F.when(n < 1, "No official Rwandan ID keywords found"),
        F.when(~dated, "No date of birth detected"),
    )
    positives = texts(
        F.when(long_no, "Valid 16-digit Rwandan NID number detected").when(old_no, "ID number detected (older format)"),
        F.when(n >= 3, F.concat(F.lit("Official ID keywords: "), F.array_join(F.slice(words, 1, 3), ", "))).when(
            n >= 1, "Some ID keywords detected"
        ),
        F.when(dated, "Date of birth field detected"),
        F.when(F.size(found) > 0, F.concat(F.lit("Issuing authority recognized: "), F.array_join(F.slice(found, 1, 2), ", "))),
    )
    return _validation(F.greatest(F.lit(0), score), issues, positives)


def certificate_validation(text: Column, upper: str, found: Column) -> Column:
    """Certificate content: institution, words, authority role, year, official address."""
    known, n = F.size(found) > 0, F.size(text_hits(upper, fv.CERTIFICATE_WORDS))
    upper = F.col(upper)
    role = authority_role(upper)
    century = F.try_element_at(all_groups(text, fv.ISSUE_YEAR, 1), F.lit(-1))
    in_words = contains_any(upper, fv.YEAR_WORDS)
    official = contains_any(upper, fv.OFFICIAL_HOSTS)
    score = F.lit(100) - deduct(
        F.when(known, -5).otherwise(10),
        F.when(n < 2, 15).when(n < 4, 5),
        F.when(role.isNull(), 8),
        F.when(century.isNull() & ~in_words, 8),
        F.when(official, -5),
    )
    issues = texts(
        F.when(~known, "Issuing institution not clearly detected — manual review recommended"),
        F.when(n < 2, "Too few certificate keywords found"),
        F.when(role.isNull(), "No issuing authority signature role detected"),
        F.when(century.isNull() & ~in_words, "No issue year found on certificate"),
        F.when((score < 60) & ~known, "Certificate lacks key verification markers — manual review recommended"),
    )
    positives = texts(
        F.when(known, F.concat(F.lit("Recognized Rwandan institution: "), F.array_join(F.slice(found, 1, 2), ", "))),
        F.when(n >= 4, "Strong certificate content verified").when(n >= 2, "Certificate keywords found"),
        fmt("Issuing authority detected: %s", role),
        F.when(century.isNotNull(), fmt("Issue year detected: %s", century)).when(
            in_words, "Issue year detected (written in words)"
        ),
        F.when(upper.rlike(uni(r"[A-Z]{2,}\s+[A-Z]{2,}")), "Candidate name format detected on certificate"),
        F.when(official, "Official institution URL detected on certificate"),
    )
    return _validation(clamp(score), issues, positives)


def transcript_validation(text: Column, upper: str, found: Column) -> Column:
    """Transcript content: institution, words, grade values."""
    known, n = F.size(found) > 0, F.size(text_hits(upper, fv.TRANSCRIPT_WORDS))
    graded = text.rlike(uni(fv.GRADE_VALUE))
    score = F.lit(100) - deduct(F.when(~known, 15), F.when(n < 1, 20).when(n < 3, 10), F.when(~graded, 10))
    issues = texts(
        F.when(~known, "Institution not recognized in Rwanda database"),
        F.when(n < 1, "No transcript keywords detected"),
        F.when(~graded, "No grade values found in transcript"),
    )
    positives = texts(
        F.when(known, F.concat(F.lit("Recognized institution: "), F.array_join(F.slice(found, 1, 2), ", "))),
        F.when(n >= 3, "Transcript content verified").when(n >= 1, "Some transcript keywords found"),
        F.when(graded, "Grade values detected"),
    )
    return _validation(F.greatest(F.lit(0), score), issues, positives)


def unknown_validation(words: Column) -> Column:
    """No known type: judged by the amount of text."""
    issues = texts(
        F.when(words < 10, "Very little text extracted — image quality may be too low").when(
            words < 30, "Limited text extracted — document type unconfirmed"
        )
    )
    return _validation(
        F.when(words < 10, 40).when(words < 30, 60).otherwise(75), issues, texts(F.when(words >= 30, "Text extracted successfully"))
    )


def with_name_match(docs: DataFrame, text: str, candidate: str, out: str = "name_check") -> DataFrame:
    """Compares the candidate name with the document text.

    Struct of adjustment, found_names, issues, positives.  Exact matches are settled by
    literal tests; words that may resemble an unmatched name are compared block by block.
    A null text counts as empty.
    """
    name, whole = F.col(candidate), F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumns({
        "_ntext": normal_name(whole),
        "_nname": normal_name(name),
        "_names": holder_names(whole),
    })
    # a candidate made of one word keeps its stop words out as well
    step = step.withColumn("_parts", name_parts(F.col("_nname")))
    judged = (F.length(F.trim(name)) >= 3) & (F.size("_parts") > 0)
    same_found = F.exists("_names", lambda n: normal_name(n) == F.col("_nname"))
    step = step.withColumns({
        "_judged": F.coalesce(judged, F.lit(False)),
        "_exact": F.coalesce(phrase_in_text(F.col("_nname"), F.col("_ntext")) | same_found, F.lit(False)),
        "_short": (F.size("_parts") == 1) & (F.length(F.get("_parts", F.lit(0))) <= 5),
    })
    open_case = F.col("_judged") & ~F.col("_exact") & ~F.col("_short")
    empty = F.array().cast("array<string>")
    step = step.withColumns({
        "_tokens": F.when(open_case, F.transform("_parts", letters_only)).otherwise(empty),
        "_words": F.when(open_case, document_words(F.col("_ntext"))).otherwise(empty),
    })
    step = with_token_hits(step, "_tokens", "_words", "_hits")
    short_hit = phrase_in_text(F.get("_parts", F.lit(0)), F.col("_ntext"))
    total = F.size("_parts")
    hits = F.when(F.col("_short"), F.when(short_hit, 1).otherwise(0)).otherwise(F.col("_hits"))
    step = step.withColumns({"_n": hits, "_ratio": F.when(total > 0, hits / total).otherwise(0.0)})
    n, ratio, short = F.col("_n"), F.col("_ratio"), F.col("_short")
    listed = F.size("_names") > 0
    case = (
        F.when(~F.col("_judged"), "none")
        .when(F.col("_exact"), "exact")
        .when(short & (n > 0), "short")
        .when(short & listed, "other")
        .when(short, "absent")
        .when(ratio >= 0.9, "fuzzy")
        .when(ratio >= 0.6, "partial")
        .when(listed, "other")
        .when(ratio > 0, "few")
        .otherwise("absent")
    )
    step = step.withColumn("_case", case)
    c = F.col("_case")
    points = (
        F.when(c == "exact", 15).when(c == "short", 12).when(c == "fuzzy", 10).when(c == "partial", -5)
        .when(c == "few", -40).when(c.isin("other", "absent"), -70).otherwise(0)
    )
    issues = texts(
        F.when(c == "other", F.concat(fmt("IDENTITY MISMATCH: Candidate '%s' not found. Document name(s) detected: ", name),
                                      F.array_join("_names", ", "))),
        F.when(c == "few", fmt("Only %s/%s name parts found — document may belong to someone else", n, total)),
        F.when(c == "absent", fmt("IDENTITY MISMATCH: Name '%s' not found in document — "
                                  "this document likely belongs to a different person", name)),
    )
    positives = texts(
        F.when(c == "exact", fmt("Candidate name '%s' matches document — identity confirmed", name))
        .when(c == "short", fmt("Candidate name '%s' found in document — identity confirmed", name))
        .when(c == "fuzzy", fmt("Candidate name '%s' fuzzy-matches OCR text — identity likely confirmed", name))
        .when(c == "partial", fmt("Partial name match (%s/%s parts matched)", n, total))
    )
    struct = F.struct(
        points.cast("int").alias("adjustment"),
        F.when(F.col("_judged"), F.col("_names")).otherwise(empty).alias("found_names"),
        issues.alias("issues"), positives.alias("positives"),
    )
    return step.withColumn(out, struct).drop(
        "_ntext", "_nname", "_names", "_parts", "_judged", "_exact", "_short", "_tokens", "_words", "_hits", "_n", "_ratio", "_case"
    )


def with_content_check(docs: DataFrame, text: str = "text", candidate: str | None = None, out: str = "content") -> DataFrame:
    """Type, institution, content score and name match of a document text as one struct."""
    step = docs.withColumn("_body", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), uni(r"^\s+|\s+$"), ""))
    step = step.withColumns({"_up": F.upper("_body"), "_wc": word_count(F.col("_body"))})
    step = with_known_words(step, "_up", "_known")
    step = with_institution(step, "_up", "_inst", known="_known")
    step = with_doc_type(step, "_up", "_kind", known="_known").withColumn("_found", F.col("_inst.found"))
    body, found, kind = F.col("_body"), F.col("_found"), F.col("_kind.kind")
    step = step.withColumn(
        "_val",
        F.when(kind == "national_id", id_validation(body, "_up", found))
        .when(kind == "certificate", certificate_validation(body, "_up", found))
        .when(kind == "transcript", transcript_validation(body, "_up", found))
        .otherwise(unknown_validation(F.col("_wc"))),
    )
    if candidate is None:
        none = F.array().cast("array<string>")
        name = F.struct(F.lit(0).alias("adjustment"), none.alias("found_names"), none.alias("issues"), none.alias("positives"))
        step = step.withColumn("_name", name)
    else:
        step = with_name_match(step, "_body", candidate, "_name")
    points = F.col("_name.adjustment")
    score = clamp(F.col("_val.score") + points)
    score = F.when(points <= -50, F.least(score, F.lit(35))).otherwise(score)
    struct = F.struct(
        F.col("_wc").cast("int").alias("word_count"),
        kind.alias("detected_type"),
        F.col("_kind.score").alias("keyword_score"),
        score.cast("int").alias("content_score"),
        found.alias("institutions_found"),
        F.col("_inst.category").alias("institution_category"),
        F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("institution_name"),
        points.alias("name_adjustment"),
        F.col("_name.found_names").alias("found_names"),
        (points >= 10).alias("name_match"),
        (points <= -50).alias("name_mismatch"),
        join_lists(F.col("_val.issues"), F.col("_name.issues")).alias("issues"),
        join_lists(F.col("_val.positives"), F.col("_name.positives")).alias("positives"),
    )
    return step.withColumn(out, struct).drop("_body", "_up", "_wc", "_known", "_inst", "_kind", "_found", "_val", "_name")


def text_features(text: Column) -> dict[str, Column]:
    """The five text features of the classifier; the text is put in capitals once per feature that needs it."""
    upper = F.upper(text)
    return {
        "word_count": F.least(F.lit(100), word_count(text)).cast("double"),
        "rwanda_keywords": bind(upper, lambda u: F.size(phrase_hits(u, fv.FEATURE_WORDS)).cast("double")),
        "authority_found": bind(upper, lambda u: contains_any(u, fv.FEATURE_ROLES).cast("double")),
        "date_found": text.rlike(uni(fv.ANY_DATE)).cast("double"),
        "id_number_found": text.rlike(uni(r"\b\d{16}\b|\b\d{10}\b")).cast("double"),
    }


