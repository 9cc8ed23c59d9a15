"""Rule operators over whole tables: numbers, content, links, metadata, detector, fusion."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions import text as X
from credence.operators import capture, content, numbers
from credence.operators.fusion import fuse, name_check_applies, recheck, screen
from credence.operators.links import embedded_certificate, newest_pages, with_link_check, with_portal_verdict
from credence.operators.provider import with_provider_check
from credence.plans.registry import Registry
from credence.plans.tables import derived, with_detections, with_exif, with_tables
from credence.plans.text_queries import (
    any_of, ascii_words, count_of, exam_holder_sql, first_of, holders_sql, html_text, match_sql, matched_sql, name_in_url_sql, norm, page_holder_sql, page_match_sql, parts_of, sq, up, url_serial_sql, url_sql,
)
from credence.sources.tables import parquet_table

R = Registry()
Y = fv.AS_OF_YEAR


def _subm(spark, sf):
    return derived(spark, sf, "submissions")


def _ascii(c: str) -> str:
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '_', 'g')"


def _rx(c: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({c}, {sq(pattern)}, {group}), '')"


# base columns of a submission: t raw, u upper, w upper with other letters as underscore
_BASE = f"b AS (SELECT id, doc_type, text, {up('text')} AS u, {ascii_words('text')} AS w, {_ascii('text')} AS t FROM subm)"

# --- numbers: each check as SQL columns -----------------------------------------------------------------------

_NID = f"coalesce({_rx('t', fv.NATIONAL_ID_NUMBER, 1)}, {_rx('t', fv.ANY_16_DIGITS, 1)})"
_NID_BAD = (
    f"CASE WHEN left(n, 1) NOT IN ('1', '2') THEN concat('NID first digit ''', left(n, 1), ''' invalid — must be 1 (Rwandan) or 2 (foreign)') "
    f"WHEN y NOT BETWEEN 1900 AND {Y} THEN concat('NID birth year ''', y, ''' out of valid range (1900–{Y})') "
    f"WHEN {Y} - y < 16 THEN concat('NID birth year implies age ', {Y} - y, ' — too young for a national ID') END"
)
_NID_CTE = f"nid AS (SELECT *, {_NID_BAD} AS bad FROM (SELECT id, {_NID} AS n, CAST(substr({_NID}, 2, 4) AS INTEGER) AS y FROM b))"
_NID_ROWS = (
    "SELECT id, n AS number_value, n IS NOT NULL AND bad IS NULL AS format_valid, CASE WHEN n IS NULL THEN 0 WHEN bad IS NULL THEN 10 ELSE -20 END AS score_adjustment, "
    "coalesce(bad, '') AS issues, CASE WHEN n IS NULL THEN 'Document confirmed as National ID by AI model — NID number not OCR-readable (normal for laminated cards)' "
    "WHEN bad IS NULL THEN concat('NID structure valid: ', CASE WHEN left(n, 1) = '1' THEN 'Rwandan citizen' ELSE 'Foreign national' END, ', born ', y) ELSE '' END AS positives FROM nid"
)
_E1, _E2 = fv.EXAM_NUMBER_PATTERNS
_EXAM_CTE = (
    f"exam AS (SELECT id, coalesce({_rx('w', _E1)}, {_rx('w', _E2)}) AS n, CAST(coalesce({_rx('w', _E1, 1)}, {_rx('w', _E2, 1)}) AS INTEGER) AS y, "
    f"{_rx('w', fv.EXAM_NUMBER_PLAIN, 1)} AS p FROM b)"
)
_EXAM_ROWS = (
    f"SELECT id, coalesce(n, p) AS number_value, CASE WHEN n IS NOT NULL THEN y BETWEEN 2000 AND {Y} ELSE p IS NOT NULL END AS format_valid, "
    f"CASE WHEN n IS NOT NULL THEN CASE WHEN y BETWEEN 2000 AND {Y} THEN 10 ELSE -10 END WHEN p IS NOT NULL THEN 5 ELSE 0 END AS score_adjustment, "
    f"CASE WHEN n IS NOT NULL AND y NOT BETWEEN 2000 AND {Y} THEN concat('Certificate year ', y, ' is invalid') ELSE '' END AS issues, "
    f"CASE WHEN n IS NOT NULL THEN CASE WHEN y BETWEEN 2000 AND {Y} THEN concat('NESA certificate serial number validated: ', n) ELSE '' END "
    "WHEN p IS NOT NULL THEN concat('Certificate number detected: ', p) ELSE 'NESA certificate type confirmed by AI model' END AS positives FROM exam"
)


def _uni_sql() -> tuple[str, str]:
    code = first_of("u", fv.UNIVERSITY_CODE_WORDS)
    number, year = "CASE code ", "CASE code "
    for name, patterns in fv.UNIVERSITY_NUMBER_PATTERNS.items():
        values = [_rx("w", p) for p, _ in patterns]
        number += f"WHEN '{name}' THEN coalesce({', '.join(values)}) "
        cases = " ".join(f"WHEN {v} IS NOT NULL THEN {_rx('w', p, g) if g else 'NULL'}" for v, (p, g) in zip(values, patterns))
        year += f"WHEN '{name}' THEN CASE {cases} END "
    cte = (
        f"uni AS (SELECT id, code, {number} END AS n, CAST({year} END AS INTEGER) AS y, {_rx('w', fv.LABELLED_NUMBER, 1)} AS l, {_rx('w', fv.PLAIN_NUMBER, 1)} AS p "
        f"FROM (SELECT *, {code} AS code FROM b))"
    )
    bad = f"n IS NOT NULL AND (y < 1990 OR y > {Y})"
    rows = (
        f"SELECT id, code, coalesce(n, l, p) AS number_value, CASE WHEN {bad} THEN false ELSE coalesce(n, l, p) IS NOT NULL END AS format_valid, "
        f"CASE WHEN {bad} THEN -10 WHEN n IS NOT NULL THEN 10 WHEN l IS NOT NULL THEN 5 WHEN p IS NOT NULL THEN 3 ELSE -10 END AS score_adjustment, "
        f"CASE WHEN {bad} THEN concat('Degree year ', y, ' is invalid for ', code) WHEN coalesce(n, l, p) IS NULL THEN concat('No degree/certificate number detected for ', coalesce(code, 'University')) ELSE '' END AS issues, "
        f"CASE WHEN {bad} THEN '' WHEN n IS NOT NULL THEN concat(code, ' degree certificate number validated: ', n) "
        "WHEN l IS NOT NULL THEN concat(coalesce(code, 'University'), ' degree reference number detected: ', l) WHEN p IS NOT NULL THEN concat('Numeric reference detected: ', p) ELSE '' END AS positives FROM uni"
    )
    return cte, rows


_UNI_CTE, _UNI_ROWS = _uni_sql()
_ROUTE = (
    f"CASE WHEN {any_of('u', fv.ROUTE_ID_WORDS)} THEN 'nida' WHEN {any_of('u', fv.ROUTE_EXAM_WORDS)} THEN 'nesa' "
    f"WHEN regexp_matches(w, '\\bUR\\b') OR {any_of('u', fv.ROUTE_UNIVERSITY_WORDS)} THEN 'university' END"
)


def _number_columns(rows, struct):
    s = F.col(struct)
    return rows.select("id", s["number_value"].alias("number_value"), s["format_valid"].alias("format_valid"), s["score_adjustment"].alias("score_adjustment"),
                       X.join_issues(s["issues"]).alias("issues"), X.join_issues(s["positives"]).alias("positives"))


@R.add("r_nid", with_tables(_NID_ROWS, "submissions", extra=(_BASE, _NID_CTE)))
def r_nid(spark, sf):
    rows = _subm(spark, sf).select("id", numbers.national_id_value(F.col("text")).alias("n"))
    return _number_columns(rows.select("id", numbers.national_id_check(F.col("n")).alias("r")), "r")


@R.add("r_nesa_no", with_tables(_EXAM_ROWS, "submissions", extra=(_BASE, _EXAM_CTE)))
def r_nesa_no(spark, sf):
    rows = _subm(spark, sf).select("id", F.upper("text").alias("u"))
    return _number_columns(rows.select("id", numbers.exam_number_check(F.col("u")).alias("r")), "r")


@R.add("r_uni_no", with_tables(f"SELECT * EXCLUDE (code) FROM ({_UNI_ROWS})", "submissions", extra=(_BASE, _UNI_CTE)))
def r_uni_no(spark, sf):
    rows = _subm(spark, sf).select("id", F.upper("text").alias("u")).withColumn("code", numbers.university_code(F.col("u")))
    return _number_columns(rows.select("id", numbers.university_number_check(F.col("u"), F.col("code")).alias("r")), "r")


@R.add("r_uni_code", with_tables(f"SELECT id, {first_of('u', fv.UNIVERSITY_CODE_WORDS)} AS code FROM b", "submissions", extra=(_BASE,)))
def r_uni_code(spark, sf):
    rows = _subm(spark, sf).select("id", F.upper("text").alias("u"))
    return rows.select("id", numbers.university_code(F.col("u")).alias("code"))


@R.add("r_inst_route", with_tables(f"SELECT id, {_ROUTE} AS route FROM b", "submissions", extra=(_BASE,)))
def r_inst_route(spark, sf):
    rows = _subm(spark, sf).select("id", F.upper("text").alias("u"))
    return rows.select("id", numbers.institution_route(F.col("u")).alias("route"))


@R.add("r_number_check", with_tables(
    f"SELECT r.id, route IS NOT NULL AS checked, CASE route WHEN 'nida' THEN 'Rwanda National ID (NIDA)' WHEN 'nesa' THEN 'NESA / Rwanda Education Board' "
    "WHEN 'university' THEN coalesce(u.code, 'University (Rwanda)') END AS institution, CASE route WHEN 'nida' THEN 'national_id' WHEN 'nesa' THEN 'certificate' "
    "WHEN 'university' THEN 'certificate' ELSE r.doc_type END AS doc_type, CASE route WHEN 'nida' THEN n.number_value WHEN 'nesa' THEN e.number_value WHEN 'university' THEN u.number_value END AS number_value, "
    "coalesce(CASE route WHEN 'nida' THEN n.format_valid WHEN 'nesa' THEN e.format_valid WHEN 'university' THEN u.format_valid END, false) AS format_valid, "
    "coalesce(CASE route WHEN 'nida' THEN n.score_adjustment WHEN 'nesa' THEN e.score_adjustment WHEN 'university' THEN u.score_adjustment END, 0) AS score_adjustment, "
    "coalesce(CASE route WHEN 'nida' THEN n.issues WHEN 'nesa' THEN e.issues WHEN 'university' THEN u.issues END, '') AS issues, "
    "coalesce(CASE route WHEN 'nida' THEN n.positives WHEN 'nesa' THEN e.positives WHEN 'university' THEN u.positives END, '') AS positives "
    f"FROM (SELECT id, doc_type, CASE WHEN doc_type = 'national_id' THEN 'nida' WHEN doc_type IN ('certificate', 'transcript') THEN CASE WHEN rt <> 'nida' THEN rt END "
    f"WHEN length(trim(text)) >= 10 THEN rt END AS route FROM (SELECT *, {_ROUTE} AS rt FROM b)) r JOIN ({_NID_ROWS}) n USING (id) JOIN ({_EXAM_ROWS}) e USING (id) JOIN ({_UNI_ROWS}) u USING (id)",
    "submissions", extra=(_BASE, _NID_CTE, _EXAM_CTE, _UNI_CTE)))
def r_number_check(spark, sf):
    rows = numbers.with_number_check(_subm(spark, sf), doc_type_hint="doc_type")
    s = F.col("number")
    return rows.select("id", s["checked"].alias("checked"), s["institution"].alias("institution"), s["doc_type"].alias("doc_type"),
                       s["number_value"].alias("number_value"), s["format_valid"].alias("format_valid"), s["score_adjustment"].alias("score_adjustment"),
                       X.join_issues(s["issues"]).alias("issues"), X.join_issues(s["positives"]).alias("positives"))


# --- content ------------------------------------------------------------------------------------------------------


def _word_rx(phrase: str) -> str:
    return r"\b" + re.escape(phrase).replace(r"\ ", r"\s+") + r"\b"


def _whole(c: str, phrase: str) -> str:
    return f"regexp_matches({c}, {sq(_word_rx(phrase))})"


def _hit_list(c: str, phrases, whole: bool) -> str:
    test = (lambda p: _whole(c, p)) if whole else (lambda p: f"contains(u, {sq(p)})")
    return "list_filter([" + ", ".join(f"CASE WHEN {test(p)} THEN {sq(p)} END" for p in phrases) + "], lambda x: x IS NOT NULL)"


def _inst_ctes() -> tuple[str, ...]:
    lists = {c: _hit_list("w", words, True) for c, words in fv.INSTITUTION_WORDS.items()}
    codes = _hit_list("w", [c for c, _ in fv.SHORT_CODES], True)
    first = "i1 AS (SELECT id, u, w, doc_type, text, t, " + ", ".join(f"{v} AS l_{k}" for k, v in lists.items()) + f", {codes} AS codes FROM b)"
    frags = _hit_list("u", [f for f, _ in fv.INSTITUTION_FRAGMENTS], False)
    second = (
        "i2 AS (SELECT *, list_concat(l_universities, l_polytechnics, l_secondary, l_government, codes) AS named, "
        f"{frags} AS frags_all, {any_of('u', ['RP.AC.RW', 'GRADUATE.RP'])} AS poly, contains(u, 'UR.AC.RW') AS uni FROM i1)"
    )
    listed = "CASE WHEN len(l_government) > 0 THEN 'government' WHEN len(l_secondary) > 0 THEN 'secondary' WHEN len(l_polytechnics) > 0 THEN 'polytechnics' WHEN len(l_universities) > 0 THEN 'universities' END"
    by_code = "CASE " + " ".join(f"WHEN list_contains(codes, {sq(c)}) THEN {sq(cat)}" for c, cat in fv.SHORT_CODES if cat) + " END"
    by_frag = "CASE " + " ".join(f"WHEN list_contains(frags, {sq(f)}) THEN {sq(cat)}" for f, cat in reversed(fv.INSTITUTION_FRAGMENTS) if cat) + " END"
    third = "i3 AS (SELECT *, CASE WHEN len(named) = 0 THEN frags_all ELSE [] END AS frags FROM i2)"
    prio = "[" + ", ".join(sq(p) for p in fv.INSTITUTION_PRIORITY) + "]"
    found = "list_concat(named, frags, CASE WHEN poly THEN ['RWANDA POLYTECHNIC (via URL)'] ELSE [] END, CASE WHEN uni THEN ['UNIVERSITY OF RWANDA (via URL)'] ELSE [] END)"
    # keep the first occurrence only, then priority items first
    fourth = f"i4 AS (SELECT *, {found} AS raw FROM i3)"
    fifth = (
        "i5 AS (SELECT *, list_filter(raw, lambda x, i: list_position(raw, x) = i) AS dist, "
        f"CASE WHEN uni THEN 'universities' WHEN poly THEN 'polytechnics' ELSE coalesce({listed}, {by_code}, {by_frag}) END AS category FROM i4)"
    )
    sixth = f"inst AS (SELECT id, u, w, doc_type, text, t, category, list_concat(list_filter({prio}, lambda x: list_contains(dist, x)), list_filter(dist, lambda x: NOT list_contains({prio}, x))) AS found FROM i5)"
    return first, second, third, fourth, fifth, sixth


_INST = _inst_ctes()


@R.add("r_institution", with_tables("SELECT id, array_to_string(found, '|') AS found, category FROM inst", "submissions", extra=(_BASE, *_INST)))
def r_institution(spark, sf):
    rows = content.with_institution(_subm(spark, sf).select("id", F.upper("text").alias("u")), "u")
    return rows.select("id", F.array_join("institution.found", "|").alias("found"), F.col("institution.category").alias("category"))


def _hits(phrases, whole=True, col="w") -> str:
    test = (lambda p: _whole(col, p)) if whole else (lambda p: f"contains(u, {sq(p)})")
    return "(" + " + ".join(f"CAST({test(p)} AS INTEGER)" for p in phrases) + ")"


_STRONG = [p for p in fv.ID_WORDS if p not in fv.WEAK_ID_WORDS]
_KIND = (
    f"kind AS (SELECT *, CASE WHEN c >= 2 AND c >= s THEN 'certificate' WHEN tr >= 2 AND tr >= c THEN 'transcript' WHEN s >= 2 THEN 'national_id' ELSE 'unknown' END AS kind, "
    "CASE WHEN c >= 2 AND c >= s THEN c WHEN tr >= 2 AND tr >= c THEN tr WHEN s >= 2 THEN i ELSE 0 END AS score FROM "
    f"(SELECT *, {_hits(fv.ID_WORDS)} AS i, {_hits(_STRONG)} AS s, {_hits(fv.CERTIFICATE_WORDS)} + {_hits(fv.CERTIFICATE_PHRASES, False)} AS c, {_hits(fv.TRANSCRIPT_WORDS)} AS tr FROM inst))"
)


@R.add("r_doc_type", with_tables("SELECT id, kind, score FROM kind", "submissions", extra=(_BASE, *_INST, _KIND)))
def r_doc_type(spark, sf):
    rows = content.with_doc_type(_subm(spark, sf).select("id", F.upper("text").alias("u")), "u")
    return rows.select("id", "doc_kind.kind", "doc_kind.score")


_ROLES = first_of("u", [(r, "-".join(w.title() for w in r.split("-"))) for r in fv.AUTHORITY_ROLES])


@R.add("r_auth_role", with_tables(f"SELECT id, {_ROLES} AS role FROM b", "submissions", extra=(_BASE,)))
def r_auth_role(spark, sf):
    rows = _subm(spark, sf).select("id", F.upper("text").alias("u"))
    return rows.select("id", content.authority_role(F.col("u")).alias("role"))


def _lines(*cases: str) -> str:
    return f"concat_ws('; ', {', '.join(cases)})"


_TWO = "array_to_string(found[1:2], ', ')"
_ID_N = count_of("u", fv.ID_WORDS)
_ID_ISSUES = _lines("CASE WHEN NOT l16 AND NOT l10 THEN 'No valid Rwandan NID number format found' END", "CASE WHEN n < 1 THEN 'No official Rwandan ID keywords found' END",
                    "CASE WHEN NOT dated THEN 'No date of birth detected' END")
_VALID_ID = (
    f"vid AS (SELECT id, greatest(0, 100 - CASE WHEN l16 OR l10 THEN 0 ELSE 20 END - CASE WHEN n < 1 THEN 30 WHEN n < 3 THEN 10 ELSE 0 END - CASE WHEN dated THEN 0 ELSE 10 END) AS score, {_ID_ISSUES} AS issues, "
    + _lines("CASE WHEN l16 THEN 'Valid 16-digit Rwandan NID number detected' WHEN l10 THEN 'ID number detected (older format)' END",
             f"CASE WHEN n >= 3 THEN concat('Official ID keywords: ', array_to_string(({_hit_list('u', fv.ID_WORDS, False)})[1:3], ', ')) WHEN n >= 1 THEN 'Some ID keywords detected' END",
             "CASE WHEN dated THEN 'Date of birth field detected' END", f"CASE WHEN len(found) > 0 THEN concat('Issuing authority recognized: ', {_TWO}) END")
    + f" AS positives FROM (SELECT *, regexp_matches(t, '\\b\\d{{16}}\\b') AS l16, regexp_matches(t, '\\b\\d{{10}}\\b') AS l10, {_ID_N} AS n, regexp_matches(t, {sq(fv.ANY_DATE)}) AS dated FROM inst))"
)
_CERT_SCORE = (
    "100 + CASE WHEN known THEN 5 ELSE -10 END - CASE WHEN n < 2 THEN 15 WHEN n < 4 THEN 5 ELSE 0 END - CASE WHEN role IS NULL THEN 8 ELSE 0 END "
    "- CASE WHEN yr IS NULL AND NOT yw THEN 8 ELSE 0 END + CASE WHEN host THEN 5 ELSE 0 END"
)
_VALID_CERT = (
    f"vcert AS (SELECT id, least(100, greatest(0, raw)) AS score, "
    + _lines("CASE WHEN NOT known THEN 'Issuing institution not clearly detected — manual review recommended' END", "CASE WHEN n < 2 THEN 'Too few certificate keywords found' END",
             "CASE WHEN role IS NULL THEN 'No issuing authority signature role detected' END", "CASE WHEN yr IS NULL AND NOT yw THEN 'No issue year found on certificate' END",
             "CASE WHEN raw < 60 AND NOT known THEN 'Certificate lacks key verification markers — manual review recommended' END")
    + " AS issues, "
    + _lines(f"CASE WHEN known THEN concat('Recognized Rwandan institution: ', {_TWO}) END", "CASE WHEN n >= 4 THEN 'Strong certificate content verified' WHEN n >= 2 THEN 'Certificate keywords found' END",
             "CASE WHEN role IS NOT NULL THEN concat('Issuing authority detected: ', role) END",
             "CASE WHEN yr IS NOT NULL THEN concat('Issue year detected: ', yr) WHEN yw THEN 'Issue year detected (written in words)' END",
             "CASE WHEN regexp_matches(w, '[A-Z]{2,}\\s+[A-Z]{2,}') THEN 'Candidate name format detected on certificate' END", "CASE WHEN host THEN 'Official institution URL detected on certificate' END")
    + f" AS positives FROM (SELECT *, {_CERT_SCORE} AS raw FROM (SELECT *, len(found) > 0 AS known, {count_of('u', fv.CERTIFICATE_WORDS)} AS n, {_ROLES} AS role, "
    f"regexp_extract_all(t, {sq(fv.ISSUE_YEAR)}, 1)[-1] AS yr, {any_of('u', fv.YEAR_WORDS)} AS yw, {any_of('u', fv.OFFICIAL_HOSTS)} AS host FROM inst)))"
)
_VALID_TRANS = (
    "vtrans AS (SELECT id, greatest(0, 100 - CASE WHEN len(found) > 0 THEN 0 ELSE 15 END - CASE WHEN n < 1 THEN 20 WHEN n < 3 THEN 10 ELSE 0 END - CASE WHEN graded THEN 0 ELSE 10 END) AS score, "
    + _lines("CASE WHEN len(found) = 0 THEN 'Institution not recognized in Rwanda database' END", "CASE WHEN n < 1 THEN 'No transcript keywords detected' END", "CASE WHEN NOT graded THEN 'No grade values found in transcript' END")
    + " AS issues, "
    + _lines(f"CASE WHEN len(found) > 0 THEN concat('Recognized institution: ', {_TWO}) END", "CASE WHEN n >= 3 THEN 'Transcript content verified' WHEN n >= 1 THEN 'Some transcript keywords found' END",
             "CASE WHEN graded THEN 'Grade values detected' END")
    + f" AS positives FROM (SELECT *, {count_of('u', fv.TRANSCRIPT_WORDS)} AS n, regexp_matches(t, {sq(fv.GRADE_VALUE)}) AS graded FROM inst))"
)
_BODY = f"b AS (SELECT id, doc_type, text, {up('text')} AS u, {ascii_words('text')} AS w, {_ascii('text')} AS t FROM (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text) FROM subm))"


def _validated(fn):
    def run(spark, sf):
        rows = content.with_institution(_subm(spark, sf).select("id", "text", F.upper("text").alias("u")), "u")
        v = fn(F.col("text"), "u", F.col("institution.found"))
        done = rows.select("id", v.alias("v"))
        return done.select("id", "v.score", X.join_issues(F.col("v.issues")).alias("issues"), X.join_issues(F.col("v.positives")).alias("positives"))

    return run


R.add("r_valid_id", with_tables("SELECT * FROM vid", "submissions", extra=(_BASE, *_INST, _VALID_ID)))(_validated(content.id_validation))
R.add("r_valid_cert", with_tables("SELECT * FROM vcert", "submissions", extra=(_BASE, *_INST, _VALID_CERT)))(_validated(content.certificate_validation))
R.add("r_valid_trans", with_tables("SELECT * FROM vtrans", "submissions", extra=(_BASE, *_INST, _VALID_TRANS)))(_validated(content.transcript_validation))


@R.add("r_content", with_tables(
    "SELECT k.id, CAST(wc AS INTEGER) AS word_count, k.kind AS detected_type, k.score AS keyword_score, coalesce(found[1], '') AS institution_name, category AS institution_category, "
    "CAST(CASE kind WHEN 'national_id' THEN i.score WHEN 'certificate' THEN c.score WHEN 'transcript' THEN r.score ELSE CASE WHEN wc < 10 THEN 40 WHEN wc < 30 THEN 60 ELSE 75 END END AS INTEGER) AS content_score, "
    "CASE kind WHEN 'national_id' THEN i.issues WHEN 'certificate' THEN c.issues WHEN 'transcript' THEN r.issues ELSE CASE WHEN wc < 10 THEN 'Very little text extracted — image quality may be too low' "
    "WHEN wc < 30 THEN 'Limited text extracted — document type unconfirmed' ELSE '' END END AS issues, "
    "CASE kind WHEN 'national_id' THEN i.positives WHEN 'certificate' THEN c.positives WHEN 'transcript' THEN r.positives ELSE CASE WHEN wc >= 30 THEN 'Text extracted successfully' ELSE '' END END AS positives "
    "FROM (SELECT *, len(regexp_extract_all(text, '\\S+')) AS wc FROM kind) k JOIN vid i USING (id) JOIN vcert c USING (id) JOIN vtrans r USING (id)",
    "submissions", extra=(_BODY, *_INST, _KIND, _VALID_ID, _VALID_CERT, _VALID_TRANS)))
def r_content(spark, sf):
    rows = content.with_content_check(_subm(spark, sf).select("id", "text"))
    c = F.col("content")
    names = ["word_count", "detected_type", "keyword_score", "institution_name", "institution_category", "content_score"]
    return rows.select("id", *[c[n].alias(n) for n in names], X.join_issues(c["issues"]).alias("issues"), X.join_issues(c["positives"]).alias("positives"))


_IN_TEXT = "contains(concat(' ', translate(nt, concat(chr(10), ''''), '  '), ' '), concat(' ', {p}, ' '))"
#: Candidate name against the whole text; blocks are compared only where the shorter word and the edit distance leave it open.
NAME_CHECK = (
    f"nm0 AS (SELECT s.id, s.candidate_name AS cn, {norm('s.text')} AS nt, {norm('s.candidate_name')} AS nn, h.names, {parts_of(norm('s.candidate_name'))} AS parts FROM subm s JOIN ({holders_sql()}) h USING (id))",
    f"nm1 AS (SELECT *, coalesce(length(trim(cn)) >= 3 AND len(parts) > 0, false) AS judged, coalesce({_IN_TEXT.format(p='nn')} OR len(list_filter(names, lambda n: {norm('n')} = nn)) > 0, false) AS exact, "
    f"coalesce(len(parts) = 1 AND length(parts[1]) <= 5, false) AS short, CASE WHEN len(parts) = 1 THEN {_IN_TEXT.format(p='parts[1]')} END AS short_hit FROM nm0)",
    "nt0 AS (SELECT id, i, replace(parts[i], '''', '') AS t, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(nt, '\\b[A-Z'']{2,}\\b'), lambda w: replace(w, '''', '')), lambda w: w <> ''))) AS w "
    "FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM nm1 WHERE judged AND NOT exact AND NOT short))",
    "nt1 AS (SELECT *, CASE WHEN length(t) <= 5 THEN 0.90::DOUBLE ELSE 0.88::DOUBLE END AS lim, (length(t) + length(w))::DOUBLE AS total FROM nt0)",
    "nt2 AS (SELECT *, (contains(w, t) OR contains(t, w)) AND least(length(t), length(w))::DOUBLE / greatest(length(t), length(w)) >= lim AS inside FROM nt1 WHERE 2 * least(length(t), length(w)) / total >= lim)",
    f"nt3 AS (SELECT id, i FROM nt2 WHERE inside UNION ALL SELECT id, i FROM (SELECT * FROM nt2 WHERE NOT inside AND 1 - levenshtein(t, w) / total >= lim) WHERE 2 * {matched_sql('t', 'w')} / total >= lim)",
    "nm2 AS (SELECT nm1.*, CASE WHEN short THEN CASE WHEN short_hit THEN 1 ELSE 0 END ELSE coalesce(k.hits, 0) END AS n, len(parts) AS total FROM nm1 LEFT JOIN (SELECT id, count(DISTINCT i) AS hits FROM nt3 GROUP BY id) k USING (id))",
    "nm AS (SELECT *, CASE WHEN NOT judged THEN 'none' WHEN exact THEN 'exact' WHEN short AND n > 0 THEN 'short' WHEN short AND len(names) > 0 THEN 'other' WHEN short THEN 'absent' "
    "WHEN n::DOUBLE / total >= 0.9::DOUBLE THEN 'fuzzy' WHEN n::DOUBLE / total >= 0.6::DOUBLE THEN 'partial' WHEN len(names) > 0 THEN 'other' WHEN n > 0 THEN 'few' ELSE 'absent' END AS c FROM nm2)",
)


@R.add("r_name_match", with_tables(
    "SELECT id, cn AS candidate_name, CAST(CASE c WHEN 'exact' THEN 15 WHEN 'short' THEN 12 WHEN 'fuzzy' THEN 10 WHEN 'partial' THEN -5 WHEN 'few' THEN -40 WHEN 'other' THEN -70 WHEN 'absent' THEN -70 ELSE 0 END AS INTEGER) AS adjustment, "
    "CASE WHEN judged THEN array_to_string(names, ', ') ELSE '' END AS found_names, "
    "CASE c WHEN 'other' THEN concat('IDENTITY MISMATCH: Candidate ''', cn, ''' not found. Document name(s) detected: ', array_to_string(names, ', ')) "
    "WHEN 'few' THEN concat('Only ', n, '/', total, ' name parts found — document may belong to someone else') "
    "WHEN 'absent' THEN concat('IDENTITY MISMATCH: Name ''', cn, ''' not found in document — this document likely belongs to a different person') ELSE '' END AS issues, "
    "CASE c WHEN 'exact' THEN concat('Candidate name ''', cn, ''' matches document — identity confirmed') WHEN 'short' THEN concat('Candidate name ''', cn, ''' found in document — identity confirmed') "
    "WHEN 'fuzzy' THEN concat('Candidate name ''', cn, ''' fuzzy-matches OCR text — identity likely confirmed') WHEN 'partial' THEN concat('Partial name match (', n, '/', total, ' parts matched)') ELSE '' END AS positives FROM nm",
    "submissions", extra=NAME_CHECK))
def r_name_match(spark, sf):
    """Candidate name against the whole text."""
    rows = content.with_name_match(_subm(spark, sf).select("id", "text", "candidate_name"), "text", "candidate_name")
    n = F.col("name_check")
    return rows.select("id", "candidate_name", n["adjustment"].alias("adjustment"), F.array_join(n["found_names"], ", ").alias("found_names"),
                       X.join_issues(n["issues"]).alias("issues"), X.join_issues(n["positives"]).alias("positives"))


# --- links -------------------------------------------------------------------------------------------------------------

_M1, _M2 = fv.EMBEDDED_CERT_PATTERNS
_EMB_CTE = (
    f"e1 AS (SELECT *, {any_of('upper(payload)', fv.EMBEDDED_CERT_WORDS)} AS emb, coalesce({_rx('payload', _M1)}, {_rx('payload', _M2)}) AS n, "
    f"CAST(coalesce({_rx('payload', _M1, 2)}, {_rx('payload', _M2, 2)}) AS INTEGER) AS y FROM links_src), "
    "e2 AS (SELECT *, trim(substr(payload, position(n IN payload) + length(n))) AS tail FROM e1), "
    f"e3 AS (SELECT *, coalesce(trim({_rx('upper(tail)', fv.EMBEDDED_NAME, 1)}), CASE WHEN len(ws) >= 2 THEN array_to_string(ws[1:3], ' ') END) AS holder_n FROM "
    "(SELECT *, list_filter(regexp_split_to_array(tail, '\\s+'), lambda w: regexp_full_match(w, '\\p{L}{2,}')) AS ws FROM e2)), "
    f"emb AS (SELECT id, payload, candidate_name/*more*/, coalesce(emb, false) AS emb, n, y, CASE WHEN n IS NOT NULL THEN holder_n END AS holder, n IS NOT NULL AND (y = 0 OR y BETWEEN 1990 AND {Y}) AS ok FROM e3)"
)


@R.add("r_mku_qr", with_tables(
    f"SELECT id, n AS cert_number, y AS cert_year, holder, ok AS format_valid, CASE WHEN n IS NULL THEN 'MKU QR detected but certificate number not found' "
    "WHEN ok THEN concat('MKU certificate number validated from QR: ', n) ELSE concat('MKU certificate year ', y, ' is out of valid range') END AS message FROM emb WHERE emb", "links", extra=(_EMB_CTE,)))
def r_mku_qr(spark, sf):
    rows = derived(spark, sf, "links").select("id", embedded_certificate(F.col("payload")).alias("e")).where("e is not null")
    return rows.select("id", "e.cert_number", "e.cert_year", "e.holder", "e.format_valid", "e.message")


def _portal(spark, sf):
    return with_portal_verdict(newest_pages(derived(spark, sf, "portal_pages")))


@R.add("r_portal", with_tables(
    "SELECT page_id, CASE WHEN kind = 'exam' THEN contains(u, 'VALID') AND contains(u, 'GRADUATE NAME') AND NOT {bad_e} WHEN http_status <> 200 THEN false "
    "WHEN kind = 'poly' THEN {good_p} AND NOT {bad_p} WHEN {good} THEN true WHEN {bad} THEN false END AS record_found, kind FROM "
    "(SELECT page_id, http_status, CASE WHEN contains(url, 'nesa.gov.rw') THEN 'exam' WHEN contains(url, 'graduate.rp.ac.rw') THEN 'poly' ELSE 'any' END AS kind, "
    "CASE WHEN contains(url, 'nesa.gov.rw') OR contains(url, 'graduate.rp.ac.rw') THEN {spaced} ELSE {joined} END AS u FROM portal_src)".format(
        bad_e=any_of("u", fv.EXAM_PAGE_ERRORS), good_p=any_of("u", fv.POLYTECHNIC_PAGE_WORDS), bad_p=any_of("u", fv.POLYTECHNIC_PAGE_ERRORS),
        good=any_of("u", fv.PAGE_WORDS), bad=any_of("u", fv.PAGE_ERRORS), spaced=up(html_text("html")), joined=up(html_text("html", ""))), "portal_pages"))
def r_portal(spark, sf):
    rows = with_portal_verdict(derived(spark, sf, "portal_pages").select("page_id", "url", "http_status", "html"))
    return rows.select("page_id", "portal.record_found", "portal.kind")


def _lines_sql(u: str) -> str:
    return f"list_filter(list_transform(string_split({u}, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')"


PORTAL_CTE = (
    "pg0 AS (SELECT url, http_status, CASE WHEN contains(url, 'nesa.gov.rw') THEN 'exam' WHEN contains(url, 'graduate.rp.ac.rw') THEN 'poly' ELSE 'any' END AS kind, "
    f"CASE WHEN contains(url, 'nesa.gov.rw') OR contains(url, 'graduate.rp.ac.rw') THEN {up(html_text('html'))} ELSE {up(html_text('html', ''))} END AS u FROM portal_src QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, http_status DESC, html DESC) = 1), "
    f"pg1 AS (SELECT *, {_lines_sql('u')} AS l, CASE WHEN kind = 'exam' THEN contains(u, 'VALID') AND contains(u, 'GRADUATE NAME') AND NOT {any_of('u', fv.EXAM_PAGE_ERRORS)} WHEN http_status <> 200 THEN false "
    f"WHEN kind = 'poly' THEN {any_of('u', fv.POLYTECHNIC_PAGE_WORDS)} AND NOT {any_of('u', fv.POLYTECHNIC_PAGE_ERRORS)} WHEN {any_of('u', fv.PAGE_WORDS)} THEN true WHEN {any_of('u', fv.PAGE_ERRORS)} THEN false END AS record FROM pg0), "
    f"pj AS (SELECT url, kind, record, CASE WHEN kind = 'exam' THEN {exam_holder_sql()} WHEN http_status = 200 AND (kind = 'poly' OR record) THEN {page_holder_sql()} END AS holder, "
    "CASE WHEN kind = 'exam' THEN CASE WHEN contains(u, 'VALID') AND contains(u, 'GRADUATE NAME') THEN 'NESA certificate verified online' ELSE 'NESA record not confirmed' END WHEN http_status <> 200 THEN concat('HTTP ', http_status) "
    "WHEN kind = 'poly' THEN CASE WHEN record THEN 'Certificate verified by Rwanda Polytechnic portal' ELSE 'Record not confirmed' END WHEN record THEN 'Certificate record found online' "
    "WHEN NOT record THEN 'Record not found — possible fake' ELSE 'URL reachable but could not confirm record' END AS message FROM pg1)"
)
_LINK_CTE = (
    f"k1 AS (SELECT id/*more*/, coalesce(candidate_name, '') AS cand, emb, n, y, ok, holder AS eh, nullif(payload, '') AS data, CASE WHEN NOT emb THEN {url_sql('payload')} END AS url FROM emb), "
    f"k2 AS (SELECT *, {name_in_url_sql('url')} AS link_name, coalesce({url_serial_sql('url')}, NULL/*printed*/) AS serial, coalesce({any_of('lower(url)', fv.TRUSTED_DOMAINS)}, false) AS trusted_url, "
    f"{first_of('lower(url)', fv.INSTITUTION_BY_DOMAIN)} AS inst, {first_of('lower(url)', [(d, d) for d, _ in fv.INSTITUTION_BY_DOMAIN])} AS domain, coalesce(contains(url, 'nesa.gov.rw'), false) AS exam FROM k1), "
    "k3 AS (SELECT k2.*, pj.url IS NOT NULL OR (exam AND serial IS NULL) AS reached, pj.record, pj.holder AS ph, pj.kind, pj.message FROM k2 LEFT JOIN pj ON pj.url = CASE WHEN exam THEN concat('https://graduate.nesa.gov.rw/?serial=', serial) ELSE k2.url END), "
    "k4 AS (SELECT *, coalesce(ph, CASE WHEN NOT exam AND trusted_url THEN link_name END) AS page_holder FROM k3), "
    "k5 AS (SELECT *, CASE WHEN record THEN coalesce(page_holder, link_name) ELSE link_name END AS who FROM k4), "
    f"k6 AS (SELECT *, CASE WHEN record AND cand <> '' THEN coalesce(CASE WHEN ph IS NOT NULL AND kind <> 'exam' THEN {page_match_sql('ph', 'cand')} ELSE {match_sql('page_holder', 'cand')} END, {match_sql('who', 'cand')}) END AS online FROM k5), "
    f"k7 AS (SELECT *, CASE WHEN online IS NOT NULL THEN online WHEN who IS NOT NULL AND cand <> '' THEN {match_sql('who', 'cand')} END AS m, CASE WHEN coalesce(eh, '') <> '' AND cand <> '' THEN {match_sql('eh', 'cand')} END AS em FROM k6)"
)


def link_ctes(more: str = "", printed: str = "NULL") -> tuple[str, str]:
    """The CTEs from links_src to the judged links k7; ``more`` names further columns to carry, ``printed`` a serial that counts where the address has none."""
    fill = lambda sql: sql.replace("/*more*/", f", {more}" if more else "").replace("NULL/*printed*/", printed)
    return fill(_EMB_CTE), fill(_LINK_CTE)


_DETAIL = "concat('Name on certificate: ''', who, ''' ', CASE WHEN ph IS NOT NULL AND kind <> 'exam' THEN '—' ELSE '-' END, ' ', CASE WHEN online THEN 'MATCHES' ELSE 'DOES NOT MATCH' END, ' candidate ''', cand, '''')"
_LATE = "(online IS NULL AND who IS NOT NULL AND cand <> '')"
_VERIFIED = "(reached AND coalesce(record, false))"


def _present(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


#: Issues and positives of a judged link; ``{seen}`` tells where the address came from.
LINK_ISSUES = (
    "CASE WHEN emb THEN " + _present(
        "CASE WHEN NOT em THEN concat('⚠ NAME MISMATCH via MKU QR: QR shows ''', eh, ''' but candidate is ''', cand, ''' — possible borrowed certificate!') END",
        "CASE WHEN n IS NULL THEN 'MKU QR detected but certificate number not found' WHEN NOT ok THEN concat('MKU certificate year ', y, ' is out of valid range') END")
    + " WHEN url IS NOT NULL THEN " + _present(
        "CASE WHEN NOT trusted_url THEN concat('QR URL domain is NOT recognized: ', url) END",
        f"CASE WHEN {_VERIFIED} AND NOT online THEN concat('⚠ NAME MISMATCH ONLINE: ', {_DETAIL}, ' — This may be a borrowed certificate!') END",
        "CASE WHEN reached AND NOT record THEN 'Online check: Certificate not found in institution records — possible fake or altered document' END",
        f"CASE WHEN {_LATE} AND NOT coalesce(m, false) THEN concat('Name mismatch from QR link: QR shows ''', who, ''' but candidate is ''', cand, '''') END")
    + " WHEN data IS NOT NULL THEN ['QR code found but contains no recognizable URL'] ELSE []::VARCHAR[] END"
)
LINK_POSITIVES = (
    "CASE WHEN emb THEN " + _present(
        "{seen}", "CASE WHEN em THEN concat('✓ NAME VERIFIED via MKU QR: ''', eh, ''' matches candidate') END", "CASE WHEN ok THEN concat('✓ MKU certificate number validated from QR: ', n) END",
        "CASE WHEN ok THEN 'Mount Kenya University certificate data verified from embedded QR' END")
    + " WHEN url IS NOT NULL THEN " + _present(
        "{seen}", "concat('QR code links to: ', left(url, 70))", "CASE WHEN link_name IS NOT NULL THEN concat('Certificate holder from QR link: ', link_name) END",
        "CASE WHEN trusted_url AND inst IS NOT NULL THEN concat('QR URL belongs to trusted institution: ', inst) WHEN trusted_url THEN 'QR URL belongs to a trusted Rwandan government domain' END",
        f"CASE WHEN {_VERIFIED} THEN concat('✓ ONLINE VERIFIED: Certificate record confirmed at ', coalesce(domain, url)) END",
        f"CASE WHEN {_VERIFIED} AND online THEN concat('✓ NAME VERIFIED ONLINE: ', {_DETAIL}) WHEN {_VERIFIED} AND who IS NOT NULL AND online IS NULL THEN concat('Certificate holder: ', who) "
        f"WHEN {_VERIFIED} AND who IS NULL AND cand <> '' THEN 'Certificate verified online — name extraction not available (manual name check recommended)' END",
        "CASE WHEN reached AND record IS NULL THEN concat('QR URL reachable — verify manually at: ', url) WHEN NOT reached THEN concat('QR URL could not be reached (network issue) — verify manually at: ', url) END",
        f"CASE WHEN {_LATE} AND m THEN concat('Name from QR link matches candidate: ', who) END")
    + " WHEN data IS NOT NULL THEN [{seen}] ELSE []::VARCHAR[] END"
)


@R.add("r_qr", with_tables(
    "SELECT id, data IS NOT NULL AS found, CASE WHEN emb THEN ok AND coalesce(em, true) ELSE trusted_url AND coalesce(record, true) AND coalesce(m, true) END AS trusted, "
    "CASE WHEN emb OR url IS NULL THEN false ELSE reached AND coalesce(record, false) END AS verified_online, CASE WHEN emb THEN em WHEN url IS NOT NULL THEN m END AS name_match, "
    "CASE WHEN emb THEN eh WHEN url IS NOT NULL THEN who END AS holder, CASE WHEN emb THEN 'Mount Kenya University' ELSE inst END AS institution, CASE WHEN emb THEN 'mku.ac.ke' ELSE domain END AS matched_domain, url, "
    "CASE WHEN url IS NOT NULL THEN serial END AS serial, CASE WHEN emb THEN CASE WHEN n IS NULL THEN 'MKU QR detected but certificate number not found' WHEN ok THEN concat('MKU certificate number validated from QR: ', n) "
    "ELSE concat('MKU certificate year ', y, ' is out of valid range') END WHEN url IS NOT NULL THEN coalesce(message, CASE WHEN exam AND serial IS NULL THEN 'NESA verification page requires certificate number' END, 'not fetched') ELSE '' END AS online_status FROM k7",
    "links", "portal_pages", extra=(_EMB_CTE, PORTAL_CTE, _LINK_CTE)))
def r_qr(spark, sf):
    """Full link verdict per submission, with the fetched pages joined by address."""
    rows = with_link_check(derived(spark, sf, "links"), _portal(spark, sf))
    k = F.col("link")
    names = ["found", "trusted", "verified_online", "name_match", "holder", "institution", "matched_domain", "url", "serial", "online_status"]
    return rows.select("id", *[k[n].alias(n) for n in names])


@R.add("r_qr_texts", with_tables(
    f"SELECT id, array_to_string({LINK_ISSUES}, '; ') AS issues, array_to_string({LINK_POSITIVES.format(seen="'QR code detected on document'")}, '; ') AS positives FROM k7",
    "links", "portal_pages", extra=(_EMB_CTE, PORTAL_CTE, _LINK_CTE)))
def r_qr_texts(spark, sf):
    """Issues and positives of the link verdict."""
    rows = with_link_check(derived(spark, sf, "links"), _portal(spark, sf))
    k = F.col("link")
    return rows.select("id", X.join_issues(k["issues"]).alias("issues"), X.join_issues(k["positives"]).alias("positives"))


_LINK_FACTS = (
    f"lf AS (SELECT id, emb, ok, holder AS emb_holder, payload IS NOT NULL AND payload <> '' AS found, CASE WHEN NOT emb THEN {url_sql('payload')} END AS url FROM emb)"
)


@R.add("r_qr_trust", with_tables(
    f"SELECT id, found, url, CASE WHEN emb THEN 'Mount Kenya University' ELSE {first_of('lower(url)', fv.INSTITUTION_BY_DOMAIN)} END AS institution, "
    f"CASE WHEN url IS NOT NULL THEN {url_serial_sql('url')} END AS serial, {name_in_url_sql('url')} AS link_name FROM lf", "links", extra=(_EMB_CTE, _LINK_FACTS)))
def r_qr_trust(spark, sf):
    """The parts of the link verdict that need no page."""
    from credence.functions.links import name_in_url

    rows = with_link_check(derived(spark, sf, "links"), _portal(spark, sf))
    k = F.col("link")
    return rows.select("id", k["found"].alias("found"), k["url"].alias("url"), k["institution"].alias("institution"), k["serial"].alias("serial"),
                       name_in_url(k["url"]).alias("link_name"))


# --- capture facts --------------------------------------------------------------------------------------------------------

_KEY = ["document_id", "line_no", "part", "supp"]
_K = ", ".join(_KEY)
_SW = "CASE WHEN no_exif THEN NULL WHEN software <> '' THEN software WHEN part % 16 = 2 THEN 'canon host' END"
SW_TYPE = (
    f"CASE WHEN {any_of('lower(trim(sw))', fv.EDITING_SOFTWARE)} THEN 'editing' WHEN {any_of('lower(trim(sw))', fv.LEGITIMATE_SOFTWARE)} THEN "
    f"CASE WHEN {any_of('lower(trim(sw))', fv.SCANNER_SOFTWARE)} THEN 'scanner' ELSE 'legitimate' END ELSE 'unknown' END"
)
_META = (
    f"m1 AS (SELECT *, {_SW} AS sw, CAST(floor((epoch(modified) - epoch(created)) / 86400) AS INTEGER) AS age, CASE WHEN NOT no_exif THEN try_strptime(left(stamp, 19), '%Y:%m:%d %H:%M:%S') END AS ts, "
    "(CASE WHEN no_exif THEN 0 ELSE 1 + CAST(gps AS INTEGER) + CAST(supp % 4 = 0 AS INTEGER) + CAST(stamp <> '' AS INTEGER) + CAST(software <> '' OR part % 16 = 2 AS INTEGER) END) AS fields FROM capt), "
    f"m AS (SELECT *, {SW_TYPE} AS kind, NOT no_exif AND gps AS g, NOT no_exif AND odd_colour AS oc FROM m1)"
)
_LOST = ("CASE WHEN kind = 'editing' THEN 40 WHEN kind = 'unknown' AND sw IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN g THEN 5 ELSE 0 END + CASE WHEN no_exif THEN 10 ELSE 0 END "
         "+ CASE WHEN file_size_kb < 10 THEN 10 ELSE 0 END + CASE WHEN oc THEN 5 ELSE 0 END")


def _metadata(spark, sf):
    rows = with_exif(derived(spark, sf, "captures"))
    return capture.with_metadata_check(rows, as_of=F.lit("2026-06-01 00:00:00").cast("timestamp"))


@R.add("r_software", with_tables(f"SELECT {_K}, kind AS software_type, sw AS software FROM m", "captures", extra=(_META,)))
def r_software(spark, sf):
    return _metadata(spark, sf).select(*_KEY, "metadata.software_type", "metadata.software")


@R.add("r_metadata", with_tables(
    f"SELECT {_K}, greatest(0, 100 - ({_LOST})) AS score, kind = 'editing' AS software_suspicious, CAST(fields AS INTEGER) AS exif_fields, "
    + _lines("CASE WHEN kind = 'editing' THEN concat('⚠ EDITING SOFTWARE DETECTED: \"', sw, '\" — document was processed with image editing software. This is a strong indicator of tampering.') "
             "WHEN kind = 'unknown' AND sw IS NOT NULL THEN concat('Unknown software detected: \"', sw, '\" — manual check recommended') END",
             "CASE WHEN g THEN 'GPS coordinates embedded in document image — scanned certificates should not have GPS data' END",
             "CASE WHEN ts > TIMESTAMP '2026-06-01 00:00:00' THEN concat('EXIF Original date is in the future: ', stamp, ' — possible manipulation') WHEN year(ts) < 1990 THEN concat('EXIF Original date is suspiciously old: ', stamp) END",
             "CASE WHEN age > 30 THEN concat('File was modified ', age, ' days after creation — possible post-scan editing') END",
             "CASE WHEN no_exif THEN 'No EXIF metadata found — metadata may have been stripped. Online editing tools often remove EXIF data.' END",
             "CASE WHEN file_size_kb < 10 THEN concat('File size very small (', format('{:.1f}', file_size_kb), 'KB) — may be a low-quality copy') END",
             "CASE WHEN oc THEN 'Unusual color space detected — may indicate processing' END")
    + " AS issues, "
    + _lines("CASE WHEN kind = 'scanner' THEN concat('Document scanned with legitimate scanner software: ', sw) WHEN kind = 'legitimate' THEN concat('Software consistent with legitimate document capture: ', sw) END",
             "CASE WHEN NOT no_exif AND supp % 4 = 0 THEN 'Captured with device: Acme' END", "CASE WHEN age BETWEEN 0 AND 30 THEN 'File creation and modification dates are consistent' END",
             "CASE WHEN NOT no_exif THEN concat('EXIF metadata present (', fields, ' fields)') END",
             "CASE WHEN file_size_kb > 100 THEN concat('File size consistent with a real scan (', format('{:.1f}', file_size_kb), 'KB)') END")
    + " AS positives FROM m", "captures", extra=(_META,)))
def r_metadata(spark, sf):
    m = F.col("metadata")
    return _metadata(spark, sf).select(*_KEY, m["score"].alias("score"), m["software_suspicious"].alias("software_suspicious"), m["exif_fields"].alias("exif_fields"),
                                       X.join_issues(m["issues"]).alias("issues"), X.join_issues(m["positives"]).alias("positives"))


@R.add("a_sum_deduct", with_tables(f"SELECT {_K}, greatest(0, least(100, 100 - ({_LOST}))) AS score, -({_LOST}) AS score_adjustment FROM m", "captures", extra=(_META,)))
def a_sum_deduct(spark, sf):
    return _metadata(spark, sf).select(*_KEY, "metadata.score", "metadata.score_adjustment")


_MIN = "CASE " + " ".join(f"WHEN {{c}} = {sq(c[0])} THEN {c[3]}::DOUBLE" for c in fv.DOC_CLASSES) + " ELSE {d}::DOUBLE END"
_TYPE = "CASE " + " ".join(f"WHEN {{c}} = {sq(c[0])} THEN {sq(c[1])}" for c in fv.DOC_CLASSES) + " ELSE 'unknown' END"
_DESC = "CASE " + " ".join(f"WHEN {{c}} = {sq(c[0])} THEN {sq(c[2])}" for c in fv.DOC_CLASSES) + " ELSE {c} END"
DET = (
    "d1 AS (SELECT *, n_detections > 0 AS has, CASE WHEN n_detections > 0 THEN class_1 ELSE '' END AS cls, CASE n_detections WHEN 0 THEN 0::DOUBLE WHEN 1 THEN round(conf_1 * 100, 1) "
    "ELSE greatest(round(conf_1 * 100, 1), round(conf_2 * 100, 1)) END AS conf FROM capt), "
    f"d2 AS (SELECT *, {_MIN.format(c='cls', d=25)} AS mn, {_MIN.format(c='cls', d=60)} AS need, CASE WHEN has THEN {_TYPE.format(c='cls')} ELSE 'unknown' END AS typ, "
    f"CASE WHEN has THEN {_DESC.format(c='cls')} END AS descr FROM d1), "
    "det AS (SELECT *, has AND conf >= mn AS verified, CASE doc_type WHEN 'national_id' THEN typ = 'id' WHEN 'driving_license' THEN typ = 'license' WHEN 'certificate' THEN typ IN ('certificate', 'degree') "
    "WHEN 'transcript' THEN typ = 'transcript' ELSE false END AS fit, CASE doc_type WHEN 'national_id' THEN 'id' WHEN 'driving_license' THEN 'license' WHEN 'certificate' THEN 'certificate, degree' "
    "WHEN 'transcript' THEN 'transcript' END AS expected FROM d2)"
)


def _n1(c: str) -> str:
    return f"format('{{:.1f}}', {c})"


_HINT = (
    f"CASE WHEN has AND NOT verified THEN CASE WHEN cls IN ('Rwanda Driving License', 'Rwanda National ID') THEN concat('Document detected as ', cls, ' at ', {_n1('conf')}, '% confidence (minimum required: ', {_n1('mn')}, "
    f"'%). Please upload a clear, flat, well-lit scan of the front of the document.') ELSE concat('Document detected at ', {_n1('conf')}, '% confidence (minimum required: ', {_n1('mn')}, '%). Please upload a higher quality image.') END END"
)


def _detect(spark, sf):
    return capture.with_detect_check(with_detections(derived(spark, sf, "captures")))


@R.add("r_detect", with_tables(
    f"SELECT {_K}, verified, CASE WHEN verified THEN 100 ELSE 0 END AS score, conf AS confidence, cls AS class, typ AS type, n_detections AS total_found, mn AS min_conf, {_HINT} AS hint FROM det", "captures", extra=(DET,)))
def r_detect(spark, sf):
    names = ["verified", "score", "confidence", "class", "type", "total_found", "min_conf", "hint"]
    return _detect(spark, sf).select(*_KEY, *[F.col(f"detect.{n}").alias(n) for n in names])


@R.add("r_ocr_gate", with_tables(
    f"SELECT {_K}, cls IN ('UR Degree', 'UR Transcript', 'ULK Degree', 'ULK Transcript') AND part % 5 <> 0 AS applies FROM det", "captures", extra=(DET,)))
def r_ocr_gate(spark, sf):
    name = F.when(F.col("part") % 5 != 0, "ALPHA BRAVO")
    return _detect(spark, sf).select(*_KEY, name_check_applies(F.col("detect.class"), name).alias("applies"))


# --- fusion: every input combination occurs among the capture facts -----------------------------------------------------------

_FUSE_IN = (
    "f0 AS (SELECT det.*, part % 4 AS q, part % 3 AS nm, supp % 9 = 0 AS edited, supp % 8 AS du, part % 6 = 1 AS ocr_bad, part % 6 = 2 AS ocr_ok, part % 50 = 49 AS stop, part % 10 = 3 AS pdf FROM det), "
    "f1 AS (SELECT *, q > 0 AS found, q IN (2, 3) AS trusted, q = 3 AS online, CASE WHEN q = 0 THEN NULL WHEN nm = 0 THEN true WHEN nm = 1 THEN false END AS nmatch, du IN (1, 2) AS dup, du = 1 AS same FROM f0), "
    "/*facts*/f2 AS (SELECT *, CASE WHEN found AND trusted AND online THEN 10 WHEN found AND trusted THEN 5 WHEN found THEN -10 ELSE 0 END AS bonus, dup AND NOT same AS borrowed, coalesce(NOT nmatch, false) AS name_bad FROM f1), "
    "f3 AS (SELECT *, least(100, greatest(0, 100 + bonus - CASE WHEN edited THEN 30 ELSE 0 END - CASE WHEN borrowed THEN 60 ELSE 0 END)) AS base, verified AND conf >= need AND fit AND NOT stop AS ok, "
    "ocr_bad AND NOT coalesce(nmatch, false) AS ocr_over FROM f2), "
    "f4 AS (SELECT *, CASE WHEN name_bad THEN 50 ELSE base END AS s1 FROM f3), f5 AS (SELECT *, CASE WHEN ocr_over THEN least(s1, 50) ELSE s1 END AS s2 FROM f4), "
    "f6 AS (SELECT *, CASE WHEN edited OR borrowed THEN least(s2, 30) ELSE s2 END AS s3 FROM f5), "
    "fused AS (SELECT *, CASE WHEN ok THEN s3 ELSE 0 END AS score, CASE WHEN NOT ok OR edited OR borrowed THEN 'Fake' WHEN name_bad OR ocr_over THEN 'Suspicious' WHEN base >= 75 THEN 'Verified' ELSE 'Suspicious' END AS status FROM f6)"
)
#: From a row's check results (table f1) to its fused score and status.
FUSE_CTE = _FUSE_IN.split("/*facts*/")[1]
_I = {
    "dup": "CASE WHEN borrowed THEN '⚠ CRITICAL: DUPLICATE found' END",
    "ocr": "CASE WHEN ocr_bad THEN '⚠ NAME MISMATCH: Certificate shows ''ALPHA KILO'' but candidate is ''DELTA'' — possible borrowed certificate!' END",
    "link": "CASE WHEN found AND name_bad THEN 'link name issue' END",
    "pen": "CASE WHEN found AND NOT trusted THEN 'QR links to unrecognized domain (-10 penalty)' END",
    "crit": "CASE WHEN found AND name_bad THEN '⚠ CRITICAL: Name on certificate does not match candidate — possible borrowed certificate!' END",
    "edit": "CASE WHEN edited THEN '⚠ CRITICAL: Document edited with GIMP 2.10 — strong indicator of tampering!' END",
}
_ALL_ISSUES = "[" + ", ".join(_I.values()) + "]"
_REFUSAL = (
    f"CASE WHEN NOT verified THEN 'No trained model document class detected.' WHEN NOT fit AND expected IS NOT NULL THEN concat('Type mismatch: expected ', expected, ', got ', coalesce(descr, cls), ' (', typ, ') at ', {_n1('conf')}, '%.') "
    f"ELSE concat('Low-confidence detection: ', coalesce(descr, cls), ' (', {_n1('conf')}, '%, required ', CAST(CAST(need AS INTEGER) AS VARCHAR), '%).') END"
)
_REGROUP = (
    "list_concat(list_concat(list_filter(gi, lambda x: contains(lower(x), 'borrowed') OR contains(lower(x), 'name') OR contains(x, 'CRITICAL')), "
    "list_filter(gi, lambda x: contains(lower(x), 'editing') OR contains(lower(x), 'photoshop') OR contains(lower(x), 'software'))), list_filter(gi, lambda x: contains(lower(x), 'duplicate')))"
)
FUSED_ISSUES = (
    f"array_to_string(CASE WHEN stop THEN ['PDF conversion failed — document cannot be verified automatically.'] WHEN NOT ok THEN list_concat(gi, [{_REFUSAL}]) WHEN base >= 75 AND NOT edited THEN {_REGROUP} ELSE gi END, '; ')"
)
def advice_sql(owner: str, software: str, institution: str) -> str:
    """Recommendation of a fused row; the arguments are SQL expressions."""
    return (
        "CASE WHEN stop THEN 'PDF could not be converted for verification. Please ask the candidate to upload a JPG or PNG scan instead.' WHEN NOT verified THEN 'Document not recognized by trained model. Treat as fake or unsupported.' "
        "WHEN NOT ok AND NOT fit AND expected IS NOT NULL THEN concat('Document type mismatch. Selected ''', doc_type, ''' but model detected ', cls, ' (', typ, ').') "
        f"WHEN NOT ok THEN concat('Detected ''', cls, ''' at ', {_n1('conf')}, '% (required ', CAST(CAST(need AS INTEGER) AS VARCHAR), '%). Please upload a clear, flat, well-lit scan of the front of the document.') "
        f"WHEN borrowed THEN concat('DUPLICATE DOCUMENT: This file was previously submitted by ''', {owner}, '''. This is a borrowed certificate. Reject this application.') "
        f"WHEN edited THEN concat('Document was edited with ', {software}, '. This is a strong indicator of tampering. Reject this document.') WHEN ocr_over THEN 'Document type confirmed by AI but name mismatch via OCR. Manual review required.' "
        "WHEN name_bad THEN 'Document type confirmed by AI but name mismatch via QR. Manual review required.' "
        f"ELSE concat('Document matches trained model class: ', cls, '. Description: ', coalesce(descr, cls), '. Confidence: ', {_n1('conf')}, '% (required ', CAST(CAST(need AS INTEGER) AS VARCHAR), '%). ', "
        f"CASE WHEN online THEN concat('QR verified online at ', {institution}, '. ') ELSE '' END, CASE WHEN pdf THEN 'PDF auto-converted for verification. ' ELSE '' END, "
        "CASE WHEN base = 100 THEN 'Marked valid at 100%. Candidate may proceed.' ELSE 'Some issues detected — manual review recommended.' END) END"
    )


def fusion_inputs(spark, sf):
    """Check results in every combination, from the key columns of the capture facts."""
    rows = _detect(spark, sf)
    part, supp = F.col("part"), F.col("supp")
    q, du = part % 4, supp % 8
    name = F.when(q == 0, None).when(part % 3 == 0, True).when(part % 3 == 1, False)
    empty, bad = F.array().cast("array<string>"), q.isNotNull() & (q > 0) & F.coalesce(name == F.lit(False), F.lit(False))
    borrowed = du == 2
    return rows.withColumns({
        "pdf_failed": part % 50 == 49, "pdf_converted": part % 10 == 3, "candidate_name": F.lit("DELTA"),
        "link": F.struct((q > 0).alias("found"), q.isin(2, 3).alias("trusted"), (q == 3).alias("verified_online"), name.alias("name_match"), F.lit("Inst").alias("institution"),
                         F.when(bad, F.array(F.lit("link name issue"))).otherwise(empty).alias("issues"), empty.alias("positives")),
        "metadata": F.struct(F.lit("GIMP 2.10").alias("software"), (supp % 9 == 0).alias("software_suspicious")),
        "duplicate": F.struct(du.isin(1, 2).alias("found"), (du == 1).alias("same_candidate"), F.lit("ECHO MIKE").alias("other_name"),
                              F.when(borrowed, -60).otherwise(0).alias("score_adjustment"),
                              F.when(borrowed, F.array(F.lit("⚠ CRITICAL: DUPLICATE found"))).otherwise(empty).alias("issues"), empty.alias("positives")),
        "printed": F.struct((part % 6 == 1).alias("mismatch"), (part % 6 == 2).alias("match"), F.array(F.lit("AB"), F.lit("ALPHA KILO")).alias("found_names")),
    })


@R.add("r_fuse", with_tables(
    f"SELECT {_K}, score, status, {FUSED_ISSUES} AS issues, {advice_sql("'ECHO MIKE'", "'GIMP 2.10'", "'Inst'")} AS recommendation FROM (SELECT *, list_filter({_ALL_ISSUES}, lambda x: x IS NOT NULL) AS gi FROM fused)", "captures", extra=(DET, _FUSE_IN)))
def r_fuse(spark, sf):
    rows = fuse(fusion_inputs(spark, sf))
    v = F.col("verdict")
    return rows.select(*_KEY, v["score"].alias("score"), v["status"].alias("status"), X.join_issues(v["issues"]).alias("issues"), v["recommendation"].alias("recommendation"))


@R.add("p_result_struct", with_tables(
    f"SELECT {_K}, concat('{{\"document_id\":', document_id, ',\"final_score\":', score, ',\"status\":\"', status, '\",\"qr_found\":', found, ',\"qr_trusted\":', trusted, CASE WHEN nmatch IS NULL THEN '' ELSE concat(',\"name_match\":', nmatch) END, "
    "',\"metadata_suspicious\":', edited, '}') AS result FROM fused", "captures", extra=(DET, _FUSE_IN)))
def p_result_struct(spark, sf):
    rows = fuse(fusion_inputs(spark, sf))
    record = F.struct(F.col("document_id"), F.col("verdict.score").alias("final_score"), F.col("verdict.status").alias("status"), F.col("link.found").alias("qr_found"),
                      F.col("link.trusted").alias("qr_trusted"), F.col("link.name_match").alias("name_match"), F.col("metadata.software_suspicious").alias("metadata_suspicious"))
    return rows.select(*_KEY, F.to_json(record).alias("result"))


_SCREEN = (
    "sc AS (SELECT *, CASE WHEN verified THEN 100 WHEN conf >= 40 THEN 70 ELSE 30 END AS base_s, part % 3 = 1 AS bad, CASE WHEN part % 3 = 0 THEN 'ALPHA KILO' ELSE '' END AS holder FROM det), "
    "sc2 AS (SELECT *, CASE WHEN bad THEN 50 ELSE base_s END AS s FROM sc)"
)


@R.add("r_fuse_v3", with_tables(
    f"SELECT {_K}, s AS score, CASE WHEN bad THEN 'Suspicious' WHEN s >= 80 THEN 'Verified' WHEN s >= 50 THEN 'Suspicious' ELSE 'Unverified' END AS status, "
    + _lines("CASE WHEN NOT verified AND conf < 40 THEN '✗ Document type could not be confirmed by AI model.' END",
             "CASE WHEN bad THEN concat('✗ BORROWED CERTIFICATE — QR confirms this certificate belongs to ''', CASE WHEN holder = '' THEN 'unknown' ELSE holder END, ''', not candidate ''DELTA ECHO''.') END", "'plain note'")
    + " AS issues, CASE WHEN bad THEN 'Document type confirmed by AI but name mismatch via QR. Manual review required.' WHEN s >= 80 THEN concat('Document matches trained model class: ', cls, '. Confidence: ', "
    f"{_n1('conf')}, '% (required 40%). ', CASE WHEN supp % 2 = 0 THEN 'QR verified online at institution.' ELSE '' END, CASE WHEN part % 3 = 0 THEN ' Name verified: ALPHA KILO.' ELSE '' END, ' Candidate may proceed.') "
    "WHEN s >= 50 THEN 'Document partially verified. Manual review recommended.' ELSE 'Document could not be verified. AI confidence too low or critical checks failed.' END AS verdict FROM sc2",
    "captures", extra=(DET, _SCREEN)))
def r_fuse_v3(spark, sf):
    part = F.col("part")
    name = F.when(part % 3 == 0, True).when(part % 3 == 1, False)
    notes = F.array(*[F.lit(t) for t in ("plain note", "Possible BORROWED file", "", " plain note ", "x Name mismatch y")])
    d = F.col("detect")
    s = screen(d["verified"], d["confidence"], F.lit(40.0), name, F.when(part % 3 == 0, "ALPHA KILO").otherwise(""), F.lit("DELTA ECHO"), notes,
               d["class"], F.col("supp") % 2 == 0, F.lit(""))
    rows = _detect(spark, sf).withColumn("s", s)
    return rows.select(*_KEY, "s.score", "s.status", X.join_issues(F.col("s.issues")).alias("issues"), "s.verdict")


_RE = (
    "re AS (SELECT *, CASE WHEN part % 2 = 0 THEN need ELSE 60::DOUBLE END AS want, CAST(part % 101 AS INTEGER) AS old_score FROM det), "
    "re2 AS (SELECT *, NOT (verified AND conf >= want AND fit) AND supp % 10 <> 9 AS dropped FROM re)"
)
_RE_ISSUE = (
    "CASE WHEN verified AND has AND expected IS NULL THEN concat('Selected document type ''', doc_type, ''' cannot be automatically verified against model class ', cls, '.') "
    f"WHEN verified AND has AND NOT fit THEN concat('Document type mismatch: selected ', concat(upper(left(doc_type, 1)), substr(replace(doc_type, '_', ' '), 2)), ' expects ', expected, ', but model detected ', coalesce(descr, cls), ' (', typ, ') at ', {_n1('conf')}, '% confidence.') "
    f"WHEN verified AND has THEN concat('Low-confidence trained model guess: ', coalesce(descr, cls), ' (', {_n1('conf')}, '%, required ', CAST(CAST(want AS INTEGER) AS VARCHAR), '%).') ELSE 'No trained model document class detected.' END"
)


@R.add("r_recheck", with_tables(
    f"SELECT {_K}, CASE WHEN dropped THEN 0 ELSE old_score END AS score, CASE WHEN dropped THEN 'Fake' ELSE 'Verified' END AS status, dropped AS downgraded, concat_ws('; ', 'old', CASE WHEN dropped THEN {_RE_ISSUE} END) AS issues FROM re2",
    "captures", extra=(DET, _RE)))
def r_recheck(spark, sf):
    d, part = F.col("detect"), F.col("part")
    common = dict(stored_score=(part % 101).cast("int"), stored_status=F.lit("Verified"), stored_issues=F.array(F.lit("old")), stored_advice=F.lit("keep"),
                  doc_type=F.col("doc_type"), detect=d, is_pdf=F.col("supp") % 10 == 9, detect_ok=F.lit(True))
    r = F.when(part % 2 == 0, recheck(**common, class_thresholds=True)).otherwise(recheck(**common))
    rows = _detect(spark, sf).withColumn("r", r)
    return rows.select(*_KEY, "r.score", "r.status", "r.downgraded", X.join_issues(F.col("r.issues")).alias("issues"))


@R.add("r_recheck_stored", with_tables(
    f"SELECT document_id, CASE WHEN dropped THEN 0 ELSE old_score END AS authenticity_score, CASE WHEN dropped THEN 'Fake' ELSE 'Verified' END AS status, concat_ws('; ', 'old', CASE WHEN dropped THEN {_RE_ISSUE} END) AS issues "
    "FROM (SELECT *, NOT (verified AND conf >= want AND fit) AND supp % 10 <> 9 AS dropped FROM (SELECT *, 60::DOUBLE AS want, CAST(part % 101 AS INTEGER) AS old_score FROM (SELECT * FROM det QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY line_no, part, supp) = 1)))",
    "captures", extra=(DET,)))
def r_recheck_stored(spark, sf):
    """The verifications table after one read of every document has written its downgrades back."""
    from credence.operators.recheck import write_back
    from credence.sources.tableset import TableSet

    captured = _detect(spark, sf)
    first = captured.groupBy("document_id").agg(F.min(F.struct("line_no", "part", "supp")).alias("_f")).select("document_id", "_f.*")
    rows = captured.join(first, ["document_id", "line_no", "part", "supp"]).dropDuplicates(["document_id"])
    tables = TableSet.new(spark, "rechecked")
    change = tables.begin()
    change.create("verifications", rows.select("document_id", (F.col("part") % 101).cast("int").alias("authenticity_score"), F.lit("Verified").alias("status"),
                                               F.lit("old").alias("issues"), F.lit("keep").alias("recommendation")), "document_id")
    change.commit()
    write_back(tables, rows.select("document_id", "doc_type", "detect", (F.col("supp") % 10 == 9).alias("is_pdf"), F.lit(True).alias("detect_ok")))
    return tables.read("verifications").select("document_id", "authenticity_score", "status", "issues")


# --- provider answers, pixel statistics ------------------------------------------------------------------------------------------

_SMILE = (
    "sm AS (SELECT id, candidate_name, id % 4 AS dv, id % 5 <> 0 AS ret, CASE WHEN id % 6 = 0 THEN '' WHEN id % 6 < 3 THEN upper(candidate_name) WHEN id % 6 < 5 THEN 'DELTA ECHO KILO' ELSE 'NOBODY ELSE' END AS full_name, "
    "id % 7 < 5 AS dob, id % 8 < 6 AS num, id % 3 AS sc, id % 11 % 3 AS lv, id % 19 <> 7 AS http_ok FROM links_src), "
    "sm2 AS (SELECT *, ret AND full_name <> '' AS named, list_filter(regexp_split_to_array(upper(candidate_name), '\\s+'), lambda p: p <> '') AS ps FROM sm), "
    "sm3 AS (SELECT *, CASE WHEN len(ps) > 0 THEN len(list_filter(ps, lambda p: contains(full_name, p)))::DOUBLE / len(ps) ELSE 0 END AS ratio, named AND candidate_name <> '' AS cmp FROM sm2)"
)


@R.add("r_smile", with_tables(
    "SELECT id, http_ok AS success, CAST(CASE WHEN http_ok THEN least(100, greatest(0, 50 + CASE dv WHEN 0 THEN 30 WHEN 1 THEN -30 WHEN 2 THEN -10 ELSE 0 END + CASE WHEN named THEN 10 ELSE 0 END "
    "+ CASE WHEN cmp AND ratio >= 0.8::DOUBLE THEN 15 WHEN cmp AND ratio < 0.5::DOUBLE THEN -30 ELSE 0 END + CASE WHEN ret AND dob THEN 5 ELSE 0 END + CASE WHEN ret AND num THEN 5 ELSE 0 END "
    "+ CASE sc WHEN 0 THEN 10 WHEN 1 THEN -20 ELSE 0 END + CASE lv WHEN 0 THEN 5 WHEN 1 THEN -15 ELSE 0 END)) ELSE 50 END AS INTEGER) AS score, "
    "CASE WHEN http_ok THEN " + _lines(
        "CASE dv WHEN 1 THEN 'Smile ID: Document verification FAILED' WHEN 2 THEN 'Smile ID: Document requires manual review' END",
        "CASE WHEN cmp AND ratio >= 0.5::DOUBLE AND ratio < 0.8::DOUBLE THEN 'Smile ID: Partial name match with ID record' WHEN cmp AND ratio < 0.5::DOUBLE THEN concat('Smile ID: Name mismatch — ID shows ''', full_name, ''' but candidate is ''', candidate_name, '''') END",
        "CASE WHEN sc = 1 THEN 'Smile ID: Face did NOT match ID photo' END", "CASE WHEN lv = 1 THEN 'Smile ID: Liveness check failed' END")
    + " ELSE 'Smile ID API returned an error' END AS issues FROM sm3", "links", extra=(_SMILE,)))
def r_smile(spark, sf):
    i, cand = F.col("id"), F.col("candidate_name")
    pick = lambda m, names: F.element_at(F.array(*[F.lit(n) for n in names]), (m + 1).cast("int"))
    name = F.when(i % 6 == 0, "").when(i % 6 < 3, F.upper(cand)).when(i % 6 < 5, "DELTA ECHO KILO").otherwise("NOBODY ELSE")
    body = F.to_json(F.struct(F.struct(
        F.struct(pick(i % 4, ["Passed", "Failed", "Caution", ""]).alias("Verify_Document"), F.when(i % 5 != 0, "Returned").otherwise("No").alias("Return_Personal_Info"),
                 pick(i % 3, ["Completed", "Failed", ""]).alias("Selfie_To_ID_Card_Compare"), pick(i % 11 % 3, ["Passed", "Failed", ""]).alias("Liveness_Check")).alias("Actions"),
        name.alias("FullName"), F.when(i % 7 < 5, "1990-01-01").otherwise("").alias("DOB"), F.when(i % 8 < 6, "77").otherwise("").alias("IDNumber")).alias("result")))
    rows = derived(spark, sf, "links").select("id", "candidate_name", body.alias("body"), F.when(i % 19 != 7, 200).otherwise(500).alias("http_status"))
    rows = with_provider_check(rows)
    return rows.select("id", "provider.success", "provider.score", X.join_issues(F.col("provider.issues")).alias("issues"))


_PIX = (
    "px AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 900 AS width, l_partkey % 500 AS height, l_quantity * 2 AS sharp, l_discount / 2 AS edge, (l_partkey % 100)::DOUBLE / 100 AS white, "
    "(l_suppkey % 40)::DOUBLE AS sat, (l_partkey % 30)::DOUBLE AS noise, l_suppkey % 7 = 0 AS cloned, l_linenumber % 2 = 0 AS jpeg, (l_partkey % 300)::DOUBLE AS gv FROM lineitem)"
)


def _pixels(spark, sf):
    d = lambda e: F.expr(e).cast("double")
    return parquet_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr("l_partkey % 900").alias("width"), F.expr("l_partkey % 500").alias("height"),
        (F.col("l_quantity") * 2).alias("sharp"), (F.col("l_discount") / 2).alias("edge"), (d("l_partkey % 100") / 100).alias("white"), d("l_suppkey % 40").alias("sat"),
        d("l_partkey % 30").alias("noise"), F.expr("l_suppkey % 7 = 0").alias("cloned"), F.expr("l_linenumber % 2 = 0").alias("jpeg"), d("l_partkey % 300").alias("gv"))


_PK = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@R.add("r_image_rules", (
    f"WITH {_PIX} SELECT {', '.join(_PK)}, greatest(0, 100 - (CASE WHEN width >= 600 AND height >= 350 OR width >= 300 AND height >= 200 THEN 0 ELSE 30 END + CASE WHEN sharp < 5 THEN 25 WHEN sharp < 20 THEN 10 ELSE 0 END "
    "+ CASE WHEN edge <= 0.01::DOUBLE THEN 15 ELSE 0 END + CASE WHEN white > 0.92::DOUBLE THEN 20 ELSE 0 END + CASE WHEN sat < 10 THEN 8 ELSE 0 END + CASE WHEN noise >= 25 THEN 12 WHEN noise >= 15 THEN 5 ELSE 0 END "
    "+ CASE WHEN cloned THEN 25 ELSE 0 END + CASE WHEN jpeg AND gv < 100 THEN 10 ELSE 0 END)) AS score, "
    + _lines("CASE WHEN width >= 600 AND height >= 350 OR width >= 300 AND height >= 200 THEN NULL ELSE 'Very low resolution - possibly a photo of a photo' END",
             "CASE WHEN sharp < 5 THEN 'Document is very blurry - possible tampered or re-photographed' WHEN sharp < 20 THEN 'Document appears slightly blurry - could be a photocopy' END",
             "CASE WHEN edge <= 0.01::DOUBLE THEN 'Very few edges detected - document may lack printed content' END", "CASE WHEN white > 0.92::DOUBLE THEN 'Extremely high white area - possible blank or heavily altered document' END",
             "CASE WHEN sat < 10 THEN 'No color detected - document is black and white only' END",
             "CASE WHEN noise >= 25 THEN 'High noise pattern detected - scan quality is low' WHEN noise >= 15 THEN 'Moderate noise pattern detected - scan quality could be better' END",
             "CASE WHEN cloned THEN 'Repeated image blocks detected - possible copy-paste manipulation' END", "CASE WHEN jpeg AND gv < 100 THEN 'Unusual JPEG compression pattern detected' END")
    + " AS issues FROM px"))
def r_image_rules(spark, sf):
    rows = _pixels(spark, sf)
    c = capture.image_check(*[F.col(n) for n in ("width", "height", "sharp", "edge", "white", "sat", "noise", "cloned", "jpeg", "gv")])
    return rows.select(*_PK, c.alias("c")).select(*_PK, "c.score", X.join_issues(F.col("c.issues")).alias("issues"))


@R.add("r_ela_rule", (
    f"WITH {_PIX}, lv AS (SELECT *, CASE WHEN white > 0.15::DOUBLE AND noise > 12 THEN 'forgery' WHEN sat > 18 AND noise > 8 THEN 'suspicious' WHEN noise > 12 THEN 'warning' ELSE 'clean' END AS level FROM px) "
    f"SELECT {', '.join(_PK)}, level, CASE level WHEN 'forgery' THEN 20 WHEN 'suspicious' THEN 50 WHEN 'warning' THEN 70 ELSE 100 END AS score, CASE level WHEN 'forgery' THEN -40 WHEN 'suspicious' THEN -20 WHEN 'warning' THEN -10 ELSE 0 END AS score_adjustment FROM lv"))
def r_ela_rule(spark, sf):
    rows = _pixels(spark, sf).withColumn("e", capture.error_level_check(F.col("noise"), F.col("sat"), F.col("white")))
    return rows.select(*_PK, "e.level", "e.score", "e.score_adjustment")


_FACE = "fc AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 3 AS INTEGER) AS fr, CAST(l_suppkey % 3 AS INTEGER) AS pr, l_partkey % 700 AS bx, l_linenumber * 30 AS bw, l_linenumber * 25 AS bh, l_quantity AS ct FROM lineitem)"


@R.add("r_face_rule", (
    f"WITH {_FACE}, f2 AS (SELECT *, CASE WHEN fr > 0 THEN fr ELSE pr END AS n, (bw * bh)::DOUBLE / (800 * 600) AS area FROM fc) SELECT {', '.join(_PK)}, n AS face_count, CASE WHEN n = 1 THEN 100 WHEN n > 1 THEN 70 ELSE 40 END AS score, "
    + _lines("CASE WHEN n = 1 AND fr > 0 AND area <= 0.02::DOUBLE THEN 'Detected face is very small — may not be a proper ID photo' WHEN n = 0 THEN 'No face detected — ID document should have a photo' "
             "WHEN n > 1 THEN concat(n, ' faces detected — ID should have only one photo') END", "CASE WHEN fr > 0 AND ct < 15 THEN 'Face photo area has very low contrast — may be tampered' END")
    + " AS issues FROM f2"))
def r_face_rule(spark, sf):
    c = F.col
    face = capture.face_check((c("l_partkey") % 3).cast("int"), (c("l_suppkey") % 3).cast("int"), c("l_partkey") % 700, c("l_linenumber") * 30, c("l_linenumber") * 25,
                              F.lit(800), F.lit(600), c("l_quantity"))
    rows = parquet_table(spark, sf, "lineitem").select(*_PK, face.alias("f"))
    return rows.select(*_PK, "f.face_count", "f.score", X.join_issues(F.col("f.issues")).alias("issues"))


_ADV = (
    "ad AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 3 WHEN 0 THEN 'certificate' WHEN 1 THEN 'national_id' ELSE 'transcript' END AS kind, (l_partkey % 15)::DOUBLE / 10 AS br, l_discount * 2 AS hb, (l_suppkey % 60)::DOUBLE AS ss, "
    "l_quantity * 8 AS sh, CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE (l_suppkey % 40)::DOUBLE END AS ink, (l_partkey % 50)::DOUBLE AS hs, (l_partkey % 90)::DOUBLE AS sm, l_linenumber % 2 = 0 AS seal, l_quantity * 5 AS bd FROM lineitem), "
    "ad2 AS (SELECT *, CASE WHEN hs > 40 AND sm > 60 THEN 'yes' WHEN hs > 20 THEN 'maybe' ELSE 'no' END AS holo FROM ad), "
    "ad3 AS (SELECT *, least(100, 100 + CASE WHEN br > 1.1::DOUBLE THEN 5 WHEN br < 0.6::DOUBLE THEN -15 ELSE 0 END - CASE WHEN hb < 0.05::DOUBLE THEN 10 ELSE 0 END - CASE WHEN ss > 30 THEN 0 ELSE 10 END) AS uv, "
    "least(100, 100 + CASE WHEN kind = 'national_id' THEN CASE WHEN sh > 300 THEN 5 WHEN sh <= 100 THEN -20 ELSE 0 END - CASE WHEN ink >= 25 THEN 15 ELSE 0 END ELSE CASE WHEN sh <= 50 THEN -10 ELSE 0 END END) AS laser, "
    "least(100, 100 + CASE kind WHEN 'certificate' THEN CASE WHEN holo = 'yes' OR (holo = 'no' AND seal) THEN 5 WHEN holo = 'no' THEN -15 ELSE 0 END WHEN 'national_id' THEN CASE holo WHEN 'yes' THEN 5 WHEN 'no' THEN -10 ELSE 0 END ELSE 0 END) AS hologram, "
    "least(100, 100 + CASE WHEN bd > 200 THEN 5 WHEN bd <= 50 THEN -10 ELSE 0 END) AS microtext FROM ad2)"
)


def _security(spark, sf):
    c, d = F.col, lambda e: F.expr(e).cast("double")
    kind = F.when(c("l_partkey") % 3 == 0, "certificate").when(c("l_partkey") % 3 == 1, "national_id").otherwise("transcript")
    ink = F.when(c("l_suppkey") % 5 != 0, d("l_suppkey % 40"))
    s = capture.security_check(kind, d("l_partkey % 15") / 10, c("l_discount") * 2, d("l_suppkey % 60"), c("l_quantity") * 8, ink, d("l_partkey % 50"), d("l_partkey % 90"),
                               c("l_linenumber") % 2 == 0, c("l_quantity") * 5)
    return parquet_table(spark, sf, "lineitem").select(*_PK, s.alias("s"))


@R.add("r_adv_rules", (
    f"WITH {_ADV} SELECT {', '.join(_PK)}, uv, laser, hologram, microtext, "
    + _lines("CASE WHEN br < 0.6::DOUBLE THEN 'Unusual color channel ratio — may indicate non-official printing' END", "CASE WHEN hb < 0.05::DOUBLE THEN 'Missing expected bright region in document header — logo may be absent' END",
             "CASE WHEN ss > 30 THEN NULL ELSE 'Low color variation — may indicate plain paper printing' END",
             "CASE WHEN kind = 'national_id' AND sh <= 100 THEN 'Blurry text edges — laser-engraved IDs should have very sharp text' WHEN kind <> 'national_id' AND sh <= 50 THEN 'Poor print quality detected' END",
             "CASE WHEN kind = 'national_id' AND ink >= 25 THEN 'Uneven text intensity — may indicate inkjet or toner printing' END",
             "CASE WHEN kind = 'certificate' AND holo = 'no' AND NOT seal THEN 'No official seal or hologram detected in expected location' WHEN kind = 'national_id' AND holo = 'no' THEN 'No hologram detected in expected ID position' END",
             "CASE WHEN bd <= 50 THEN 'No fine detail in border areas — microtext/guilloche pattern may be missing' END")
    + " AS issues FROM ad3"))
def r_adv_rules(spark, sf):
    return _security(spark, sf).select(*_PK, "s.uv", "s.laser", "s.hologram", "s.microtext", X.join_issues(F.col("s.issues")).alias("issues"))


@R.add("a_adv_weighted", (
    f"WITH {_ADV} SELECT {', '.join(_PK)}, CAST(round_even(uv * 0.20::DOUBLE + laser * 0.35::DOUBLE + hologram * 0.25::DOUBLE + microtext * 0.20::DOUBLE, 0) AS INTEGER) AS score FROM ad3"))
def a_adv_weighted(spark, sf):
    return _security(spark, sf).select(*_PK, "s.score")


