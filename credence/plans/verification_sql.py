"""Oracle SQL of the whole verification, put together from the parts of the rule queries."""

from __future__ import annotations

from credence import fixed_values as fv
from credence.plans.rule_queries import DET, FUSE_CTE, FUSED_ISSUES, LINK_ISSUES, NAME_CHECK, PORTAL_CTE, SW_TYPE, advice_sql, link_ctes
from credence.plans.tables import CLASSES, DOC_TYPES, SOFTWARE, cte, link_text, pick
from credence.plans.text_queries import serial_sql, sq, url_sql

_CHECKED = ", ".join(sq(c) for c in fv.NAME_CHECKED_CLASSES)
_COMPACT = "regexp_replace(text, '\\s+', '', 'g')"
_ADDRESS = f"CASE WHEN regexp_matches({_COMPACT}, '(?i)graduate\\.?nesa\\.?gov\\.?rw') THEN 'https://graduate.nesa.gov.rw' ELSE {url_sql(_COMPACT)} END"

_EMBEDDED, _LINKS = link_ctes("printed_serial", "printed_serial")

#: Submissions with all they arrive with; then the checks of their own, links, names, duplicates, and the fused verdict.
VERIFY_CTES = ", ".join((
    cte("candidates"), cte("documents"), cte("portal_pages"),
    cte("submissions").replace("subm AS", "arrived AS", 1),
    f"s0 AS (SELECT a.id, d.candidate_id, a.candidate_name, {pick(DOC_TYPES, 'a.id // 3', 'duck')} AS doc_type, a.text AS own, CASE WHEN a.id % 11 <> 5 THEN {link_text('a.id', 'duck')} END AS payload, "
    f"CASE WHEN a.id % 11 = 5 THEN {link_text('a.id', 'duck')} END AS printed, {pick(SOFTWARE, 'a.id', 'duck')} AS software, a.id % 50 = 49 AS stop, a.id % 10 = 3 AS pdf FROM arrived a JOIN docs d USING (id))",
    "s1 AS (SELECT * EXCLUDE (printed), concat_ws(chr(10), own, printed) AS text, md5(substr(own, position(chr(10) IN own) + 1)) AS file_hash FROM s0)",
    f"capt AS (SELECT *, 1 AS n_detections, {pick(CLASSES, 'id', 'duck')} AS class_1, '' AS class_2, (id % 97 + 3) / 100::DOUBLE AS conf_1, 0::DOUBLE AS conf_2 FROM s1)",
    DET,
    # a text gives its address where there is no payload, its serial where the examination portal may be meant
    f"links_src AS (SELECT id, candidate_name, CASE WHEN coalesce(payload, '') <> '' THEN payload ELSE {_ADDRESS} END AS payload, "
    f"CASE WHEN coalesce(payload, '') = '' OR contains(payload, 'nesa.gov.rw') THEN {serial_sql('text')} END AS printed_serial FROM s1)",
    _EMBEDDED, PORTAL_CTE, _LINKS,
    f"subm AS (SELECT id, CASE WHEN gate THEN text ELSE '' END AS text, CASE WHEN gate THEN candidate_name END AS candidate_name FROM (SELECT *, cls IN ({_CHECKED}) AND coalesce(candidate_name, '') <> '' AS gate FROM det))",
    *NAME_CHECK,
    "low AS (SELECT id, candidate_id, file_hash, min(id) OVER (PARTITION BY file_hash) AS first FROM s1)",
    "fellow AS (SELECT id, CASE WHEN id = first THEN min(CASE WHEN id > first THEN id END) OVER (PARTITION BY file_hash) ELSE first END AS other_id FROM low)",
    "dups AS (SELECT f.id, f.other_id, o.candidate_id AS other_candidate, coalesce(c.full_name, 'Unknown') AS other_name FROM fellow f LEFT JOIN s1 o ON o.id = f.other_id LEFT JOIN cand c ON c.id = o.candidate_id)",
    f"lk AS (SELECT id, {LINK_ISSUES} AS link_issues, data IS NOT NULL AS found, coalesce(CASE WHEN emb THEN ok AND coalesce(em, true) ELSE trusted_url AND coalesce(record, true) AND coalesce(m, true) END, false) AS trusted, "
    "CASE WHEN emb OR url IS NULL THEN false ELSE reached AND coalesce(record, false) END AS online, CASE WHEN emb THEN em WHEN url IS NOT NULL THEN m END AS nmatch, "
    "CASE WHEN emb THEN 'Mount Kenya University' ELSE inst END AS inst, url, CASE WHEN emb THEN eh WHEN url IS NOT NULL THEN who END AS holder FROM k7)",
    "printed AS (SELECT id, c IN ('other', 'absent') AS ocr_bad, c IN ('exact', 'short', 'fuzzy') AS ocr_ok, CASE WHEN judged THEN names ELSE []::VARCHAR[] END AS found_names FROM nm)",
    f"edits AS (SELECT id, sw, coalesce({SW_TYPE} = 'editing', false) AS edited FROM (SELECT id, nullif(software, '') AS sw FROM s1))",
    "same_file AS (SELECT d.id, other_id IS NOT NULL AS dup, coalesce(other_candidate = s1.candidate_id, false) AS same, other_id, other_name FROM dups d JOIN s1 USING (id))",
    "f1 AS (SELECT * FROM det JOIN lk USING (id) JOIN printed USING (id) JOIN edits USING (id) JOIN same_file USING (id))",
    FUSE_CTE,
    "gathered AS (SELECT *, list_concat(list_concat(list_filter(["
    "CASE WHEN borrowed THEN concat('⚠ CRITICAL: DUPLICATE DOCUMENT DETECTED — This exact file was previously submitted by ''', other_name, ''' (doc ID: ', other_id, '). This is a strong indicator of a borrowed or shared certificate!') END, "
    "CASE WHEN ocr_bad THEN concat('⚠ NAME MISMATCH: Certificate shows ''', coalesce(list_filter(found_names, lambda n: length(n) > 5 AND NOT regexp_matches(n, '[0-9]'))[1], 'another person'), ''' but candidate is ''', candidate_name, ''' — possible borrowed certificate!') END"
    "], lambda x: x IS NOT NULL), link_issues), list_filter(["
    "CASE WHEN found AND NOT trusted THEN 'QR links to unrecognized domain (-10 penalty)' END, "
    "CASE WHEN found AND name_bad THEN '⚠ CRITICAL: Name on certificate does not match candidate — possible borrowed certificate!' END, "
    "CASE WHEN edited THEN concat('⚠ CRITICAL: Document edited with ', sw, ' — strong indicator of tampering!') END], lambda x: x IS NOT NULL)) AS gi FROM fused)",
    f"verified AS (SELECT candidate_id, id AS document_id, CAST(score AS INTEGER) AS authenticity_score, status, {FUSED_ISSUES} AS issues, {advice_sql('other_name', 'sw', "coalesce(inst, '')")} AS recommendation, "
    "coalesce(url, '') AS qr_url, coalesce(inst, '') AS qr_institution, online AS qr_verified, nmatch AS name_match, coalesce(holder, '') AS cert_holder FROM gathered)",
))

VERIFY = f"WITH {VERIFY_CTES} SELECT * FROM verified"

_ADVICE = " ".join(f"WHEN {sq(s)} THEN {sq(fv.RECOMMENDATIONS[s])}" for s in ("Verified", "Suspicious", "Fake"))
TRUST = (
    f"WITH {VERIFY_CTES}, rep AS (SELECT candidate_id AS id, count(*) AS n_docs, CAST(round(avg(authenticity_score)) AS INTEGER) AS avg_score, "
    "CASE WHEN bool_or(status = 'Fake') THEN 'Fake' WHEN bool_or(status = 'Suspicious') THEN 'Suspicious' ELSE 'Verified' END AS overall_status FROM verified WHERE candidate_id IS NOT NULL GROUP BY 1), "
    "whole AS (SELECT c.id, c.full_name, coalesce(n_docs, 0) AS n_docs, coalesce(avg_score, 0) AS avg_score, coalesce(overall_status, 'Verified') AS overall_status FROM cand c LEFT JOIN rep USING (id)) "
    f"SELECT *, CASE overall_status {_ADVICE} END AS recommendation FROM whole"
)
