"""Filters, projections, joins, dashboard aggregates, ordering, mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions import text as X
from credence.functions.hotkeys import latest_per_key, numbered, with_key_summary
from credence.operators import capture, listings, persons
from credence.operators.duplicates import duplicate_groups, duplicate_outcome, duplicate_pairs, file_hash
from credence.plans.registry import Registry
from credence.plans.tables import derived, with_tables
from credence.session import cut_lineage
from credence.sources.tables import parquet_table

R = Registry()
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"


def hashed_documents(spark, folder, owners: int = 7):
    """Uploaded files with the hash of their content; few owners, so all duplicate cases occur."""
    docs = parquet_table(spark, folder, "documents")
    narrow = docs.select(F.col("doc_id").alias("id"), F.pmod("doc_id", F.lit(owners)).alias("candidate_id"), file_hash(F.col("text")).alias("file_hash"))
    # the contents are read and hashed once, whatever the steps after this do
    return cut_lineage(narrow)


HASHED = "hd AS (SELECT doc_id AS id, doc_id % 7 AS candidate_id, md5(text) AS file_hash FROM documents)"
PAIRS = (
    HASHED,
    "dp AS (SELECT a.id, a.candidate_id, a.file_hash, min(b.id) AS other_id, count(b.id) + 1 AS n_copies, "
    "coalesce(bool_or(b.candidate_id <> a.candidate_id), false) AS any_other_candidate "
    "FROM hd a LEFT JOIN hd b ON a.file_hash = b.file_hash AND a.id <> b.id GROUP BY ALL)",
)


# --- filters and projections --------------------------------------------------------------------------


@R.add("src_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_table(spark, sf):
    return parquet_table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@R.add("f_status_eq", with_tables("SELECT id, document_id, authenticity_score FROM ver WHERE status = 'Fake'", "verifications"))
def f_status_eq(spark, sf):
    return derived(spark, sf, "verifications").where("status = 'Fake'").select("id", "document_id", "authenticity_score")


@R.add("f_by_key", with_tables(
    "SELECT id, full_name, email FROM cand WHERE id IN (SELECT candidate_id FROM docs WHERE candidate_id IS NOT NULL)", "candidates", "documents"))
def f_by_key(spark, sf):
    wanted = derived(spark, sf, "documents").select(F.col("candidate_id").alias("id"))
    return derived(spark, sf, "candidates").select("id", "full_name", "email").join(wanted, "id", "left_semi")


@R.add("f_by_id", with_tables("SELECT c.id, c.full_name, v.document_id, v.status FROM cand c LEFT JOIN ver v ON v.candidate_id = c.id WHERE c.id = 7", "candidates", "verifications"))
def f_by_id(spark, sf):
    """One candidate and the verdicts on their documents: the key is pushed to the scan of candidates; the derived owner of a verdict is compared after its scan."""
    one = derived(spark, sf, "candidates").where("id = 7").select("id", "full_name")
    verdicts = derived(spark, sf, "verifications").where("candidate_id = 7").select(F.col("candidate_id").alias("id"), "document_id", "status")
    return one.join(verdicts, "id", "left")


@R.add("f_exists", with_tables("SELECT id, id IN (SELECT document_id FROM ver WHERE status <> 'Pending') AS done FROM docs", "documents", "verifications"))
def f_exists(spark, sf):
    done = derived(spark, sf, "verifications").where("status <> 'Pending'")
    return listings.verified_flag(derived(spark, sf, "documents").select("id"), done)


@R.add("f_ci_match", with_tables(
    "SELECT id, count(*) OVER (PARTITION BY strip_accents(lower(trim(full_name))), lower(trim(coalesce(email, '')))) > 1 AS taken FROM cand", "candidates"))
def f_ci_match(spark, sf):
    keyed = persons.with_person_key(derived(spark, sf, "candidates")).select("id", "_name_key", "_mail_key")
    counted = with_key_summary(keyed, ["_name_key", "_mail_key"], ["id"], {"_n": F.count(F.lit(1))}, {"_all": F.sum("_n")}, F.col("_all") > 1)
    return counted.select("id", F.col("_all").isNotNull().alias("taken"))


@R.add("f_upload", with_tables(
    "SELECT id, CASE WHEN lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) NOT IN ('jpg','jpeg','png','pdf') "
    "THEN 'Only JPG, PNG, and PDF files are allowed.' WHEN size_bytes > 5242880 THEN 'File size must be under 5MB.' END AS reason, "
    "CASE WHEN lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) NOT IN ('jpg','jpeg','png') THEN 'Only JPG and PNG images are supported.' "
    "WHEN size_bytes > 10485760 THEN 'File too large. Maximum size is 10MB.' END AS image_reason FROM docs", "documents"))
def f_upload(spark, sf):
    docs = derived(spark, sf, "documents")
    ext = X.extension(F.col("file_path"))
    return docs.select(
        "id", capture.upload_rejection(ext, F.col("size_bytes")).alias("reason"),
        capture.image_rejection(F.concat(F.lit("image/"), ext), F.col("size_bytes")).alias("image_reason"),
    )


@R.add("f_email_valid", with_tables(
    f"SELECT id, full_name <> '' AND regexp_matches(coalesce(email, ''), '{EMAIL}') AS valid FROM cand", "candidates"))
def f_email_valid(spark, sf):
    ok = (F.col("full_name") != "") & F.coalesce(F.col("email"), F.lit("")).rlike(EMAIL)
    return derived(spark, sf, "candidates").select("id", ok.alias("valid"))


@R.add("f_anti_unverified", with_tables(
    "SELECT d.id, coalesce(v.status, 'Pending') AS shown_status FROM docs d LEFT JOIN ver v ON v.document_id = d.id AND v.status <> 'Pending'",
    "documents", "verifications"))
def f_anti_unverified(spark, sf):
    ver = derived(spark, sf, "verifications").where("status <> 'Pending'")
    return listings.document_history(derived(spark, sf, "documents"), ver).select("id", "shown_status")


@R.add("f_date_nullif", with_tables("SELECT id, coalesce(strftime(verified_at, '%b %d, %Y'), '-') AS shown FROM ver", "verifications"))
def f_date_nullif(spark, sf):
    return derived(spark, sf, "verifications").select("id", X.show_date_or_dash(F.col("verified_at")).alias("shown"))


@R.add("p_fields", with_tables("SELECT id, name, role FROM usr", "users"))
def p_fields(spark, sf):
    return derived(spark, sf, "users").select("id", "name", "role")


# --- joins ----------------------------------------------------------------------------------------------


@R.add("j_cand_status", with_tables(
    "SELECT c.id, c.full_name, v.status FROM cand c LEFT JOIN ver v ON v.candidate_id = c.id", "candidates", "verifications"))
def j_cand_status(spark, sf):
    joined = listings.candidate_status(derived(spark, sf, "candidates").select("id", "full_name"), derived(spark, sf, "verifications"))
    return joined.select("id", "full_name", "status")


@R.add("j_verif_list", with_tables(
    "SELECT v.id, c.full_name, c.position_applied, d.file_path, coalesce(strftime(v.verified_at, '%b %d, %Y'), '-') AS shown_date, "
    "CASE WHEN d.doc_type IS NULL THEN '-' ELSE concat(upper(left(d.doc_type, 1)), substr(replace(d.doc_type, '_', ' '), 2)) END AS shown_type "
    "FROM ver v JOIN cand c ON v.candidate_id = c.id LEFT JOIN docs d ON v.document_id = d.id", "verifications", "candidates", "documents"))
def j_verif_list(spark, sf):
    rows = listings.verification_list(*[derived(spark, sf, t) for t in ("verifications", "candidates", "documents")])
    return rows.select("id", "full_name", "position_applied", "file_path", "shown_date", "shown_type")


@R.add("j_report", with_tables(
    "SELECT v.id, v.candidate_id, v.status, d.doc_type, d.file_path, d.uploaded_at FROM ver v LEFT JOIN docs d ON v.document_id = d.id "
    "WHERE v.candidate_id IS NOT NULL", "verifications", "documents"))
def j_report(spark, sf):
    ver = derived(spark, sf, "verifications").where("candidate_id is not null")
    return listings.candidate_documents(ver, derived(spark, sf, "documents")).select(
        "id", "candidate_id", "status", "doc_type", "file_path", "uploaded_at")


@R.add("j_result", with_tables(
    "SELECT v.id, v.document_id, v.status, d.doc_type, d.file_path FROM ver v JOIN docs d ON v.document_id = d.id", "verifications", "documents"))
def j_result(spark, sf):
    rows = listings.verification_of_document(derived(spark, sf, "verifications"), derived(spark, sf, "documents"))
    return rows.select("id", "document_id", "status", "doc_type", "file_path")


@R.add("j_doc_history", with_tables(
    "SELECT d.id, d.candidate_id, v.status, v.authenticity_score, coalesce(v.status, 'Pending') AS shown_status "
    "FROM docs d LEFT JOIN ver v ON v.document_id = d.id", "documents", "verifications"))
def j_doc_history(spark, sf):
    rows = listings.document_history(derived(spark, sf, "documents"), derived(spark, sf, "verifications"))
    return rows.select("id", "candidate_id", "status", "authenticity_score", "shown_status")


def _pairs(spark, sf):
    owners = derived(spark, sf, "candidates").select("id", "full_name")
    return duplicate_pairs(hashed_documents(spark, sf), owners)


@R.add("j_dup_self", with_tables(
    "SELECT dp.id, dp.n_copies, dp.other_id, o.candidate_id AS other_candidate, c.full_name AS other_name, dp.any_other_candidate "
    "FROM dp LEFT JOIN hd o ON o.id = dp.other_id LEFT JOIN cand c ON c.id = o.candidate_id", "candidates", extra=PAIRS))
def j_dup_self(spark, sf):
    return _pairs(spark, sf).select("id", "n_copies", "other_id", "other_candidate", "other_name", "any_other_candidate")


@R.add("w_first_dup", with_tables("SELECT id, file_hash, other_id FROM dp WHERE other_id IS NOT NULL", extra=PAIRS))
def w_first_dup(spark, sf):
    return duplicate_pairs(hashed_documents(spark, sf)).where("other_id is not null").select("id", "file_hash", "other_id")


@R.add("r_duplicate", with_tables(
    "SELECT dp.id, dp.other_id IS NOT NULL AS found, coalesce(o.candidate_id = dp.candidate_id, false) AS same_candidate, "
    "CASE WHEN dp.other_id IS NOT NULL AND o.candidate_id <> dp.candidate_id THEN -60 ELSE 0 END AS score_adjustment, "
    "CASE WHEN o.candidate_id <> dp.candidate_id THEN concat('⚠ CRITICAL: DUPLICATE DOCUMENT DETECTED — This exact file was previously submitted by ''', "
    "c.full_name, ''' (doc ID: ', dp.other_id, '). This is a strong indicator of a borrowed or shared certificate!') ELSE '' END AS issues, "
    "CASE WHEN dp.other_id IS NULL THEN 'No duplicate submissions found — this document is unique in the system' "
    "WHEN o.candidate_id = dp.candidate_id THEN concat('Note: This candidate previously submitted an identical file (doc ID: ', dp.other_id, ') — possible re-upload') "
    "ELSE '' END AS positives FROM dp LEFT JOIN hd o ON o.id = dp.other_id LEFT JOIN cand c ON c.id = o.candidate_id", "candidates", extra=PAIRS))
def r_duplicate(spark, sf):
    rows = duplicate_outcome(_pairs(spark, sf))
    d = F.col("duplicate")
    return rows.select("id", d["found"].alias("found"), d["same_candidate"].alias("same_candidate"), d["score_adjustment"].alias("score_adjustment"),
                       X.join_issues(d["issues"]).alias("issues"), X.join_issues(d["positives"]).alias("positives"))


@R.add("a_dup_groups", with_tables(
    "SELECT file_hash, count(*) AS n_docs, count(DISTINCT candidate_id) AS n_candidates FROM hd GROUP BY file_hash HAVING count(*) > 1", extra=(HASHED,)))
def a_dup_groups(spark, sf):
    docs = parquet_table(spark, sf, "documents")
    return duplicate_groups(docs.select(F.pmod("doc_id", F.lit(7)).alias("candidate_id"), file_hash(F.col("text")).alias("file_hash")))


DEDUPE = (
    "dm AS (SELECT c1.id AS duplicate_id, min(c2.id) AS keeper_id FROM cand c1 JOIN cand c2 ON strip_accents(lower(trim(c1.full_name))) = strip_accents(lower(trim(c2.full_name))) "
    "AND coalesce(lower(trim(c1.email)), '') = coalesce(lower(trim(c2.email)), '') AND c1.id > c2.id GROUP BY c1.id)",
)


@R.add("j_dedupe_self", with_tables("SELECT duplicate_id, keeper_id FROM dm", "candidates", extra=DEDUPE))
def j_dedupe_self(spark, sf):
    return persons.keeper_map(derived(spark, sf, "candidates"))


@R.add("a_dedupe_keeper", with_tables("SELECT keeper_id, count(*) AS n_duplicates FROM dm GROUP BY keeper_id", "candidates", extra=DEDUPE))
def a_dedupe_keeper(spark, sf):
    return persons.keeper_map(derived(spark, sf, "candidates")).groupBy("keeper_id").agg(F.count(F.lit(1)).alias("n_duplicates"))


@R.add("w_keeper", with_tables(
    "SELECT id, min(id) OVER (PARTITION BY strip_accents(lower(trim(full_name))), lower(trim(coalesce(email, '')))) AS keeper_id FROM cand", "candidates"))
def w_keeper(spark, sf):
    keyed = persons.with_person_key(derived(spark, sf, "candidates")).select("id", "_name_key", "_mail_key")
    kept = with_key_summary(keyed, ["_name_key", "_mail_key"], ["id"], {"_low": F.min("id")}, {"keeper_id": F.min("_low")})
    return kept.select("id", "keeper_id")


@R.add("j_creator", with_tables(
    "SELECT c.id, c.created_by, u.name AS creator, u.role FROM cand c LEFT JOIN usr u ON u.id = c.created_by", "candidates", "users"))
def j_creator(spark, sf):
    users = derived(spark, sf, "users").select(F.col("id").alias("created_by"), F.col("name").alias("creator"), "role")
    return derived(spark, sf, "candidates").select("id", "created_by").join(users, "created_by", "left").select("id", "created_by", "creator", "role")


@R.add("j_fk_audit", with_tables(
    "SELECT 'candidates.created_by' AS constraint_name, id AS row_id, CAST(created_by AS BIGINT) AS missing_id FROM cand WHERE created_by NOT IN (SELECT id FROM usr) "
    "UNION ALL SELECT 'documents.candidate_id', id, candidate_id FROM docs WHERE candidate_id NOT IN (SELECT id FROM cand) "
    "UNION ALL SELECT 'verifications.candidate_id', id, candidate_id FROM ver WHERE candidate_id NOT IN (SELECT id FROM cand) "
    "UNION ALL SELECT 'verifications.document_id', id, document_id FROM ver WHERE document_id NOT IN (SELECT id FROM docs)",
    "candidates", "documents", "verifications", "users"))
def j_fk_audit(spark, sf):
    return listings.foreign_key_violations(*[derived(spark, sf, t) for t in ("candidates", "documents", "verifications", "users")])


# --- aggregates ----------------------------------------------------------------------------------------------


@R.add("a_dash_counts", with_tables(
    "SELECT (SELECT count(*) FROM cand) AS candidates, (SELECT count(*) FROM docs) AS documents, count(*) FILTER (status = 'Verified') AS verified, "
    "count(*) FILTER (status = 'Fake') AS fake, count(*) FILTER (status = 'Suspicious') AS suspicious FROM ver", "candidates", "documents", "verifications"))
def a_dash_counts(spark, sf):
    return listings.dashboard_counts(*[derived(spark, sf, t) for t in ("candidates", "documents", "verifications")])


_REPORT = (
    "rep AS (SELECT candidate_id AS id, count(*) AS n_docs, CAST(round(avg(authenticity_score)) AS INTEGER) AS avg_score, "
    "CASE WHEN bool_or(status = 'Fake') THEN 'Fake' WHEN bool_or(status = 'Suspicious') THEN 'Suspicious' ELSE 'Verified' END AS overall_status "
    "FROM ver WHERE candidate_id IS NOT NULL GROUP BY candidate_id)",
)


@R.add("a_report", with_tables(
    "SELECT c.id, coalesce(r.n_docs, 0) AS n_docs, coalesce(r.avg_score, 0) AS avg_score, coalesce(r.overall_status, 'Verified') AS overall_status "
    "FROM cand c LEFT JOIN rep r USING (id)", "candidates", "verifications", extra=_REPORT))
def a_report(spark, sf):
    rows = listings.candidate_report(derived(spark, sf, "candidates").select("id"), derived(spark, sf, "verifications"))
    return rows.select("id", "n_docs", "avg_score", "overall_status")


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@R.add("r_recommend", with_tables(
    "SELECT c.id, CASE coalesce(r.overall_status, 'Verified') WHEN 'Verified' THEN {} WHEN 'Suspicious' THEN {} ELSE {} END AS recommendation "
    "FROM cand c LEFT JOIN rep r USING (id)".format(*[_sq(fv.RECOMMENDATIONS[s]) for s in ("Verified", "Suspicious", "Fake")]),
    "candidates", "verifications", extra=_REPORT))
def r_recommend(spark, sf):
    rows = listings.candidate_report(derived(spark, sf, "candidates").select("id"), derived(spark, sf, "verifications"))
    return rows.select("id", "recommendation")


@R.add("a_dataset_summary", (
    "WITH f AS (SELECT lang AS label, CASE WHEN n_chars % 10 = 3 THEN -1 ELSE n_chars END AS width, "
    "CASE WHEN n_chars % 10 = 3 THEN -1 ELSE n_chars // 2 END AS height FROM documents) "
    "SELECT label, count(*) AS files, count(*) FILTER (width < 0) AS unreadable, CAST(floor(avg(width) FILTER (width >= 0)) AS BIGINT) AS avg_width, "
    "CAST(floor(avg(height) FILTER (width >= 0)) AS BIGINT) AS avg_height, min(width) FILTER (width >= 0) AS min_width, min(height) FILTER (width >= 0) AS min_height, "
    "max(width) FILTER (width >= 0) AS max_width, max(height) FILTER (width >= 0) AS max_height, "
    "round(count(*)::DOUBLE / sum(count(*)) OVER () * 100, 1) AS share, "
    "CASE WHEN count(*) < 10 THEN 'too few' WHEN count(*) < 20 THEN 'small' ELSE 'good' END AS readiness FROM f GROUP BY label"))
def a_dataset_summary(spark, sf):
    bad = F.col("n_chars") % 10 == 3
    files = parquet_table(spark, sf, "documents").select(
        F.col("lang").alias("label"), F.when(bad, F.lit(-1)).otherwise(F.col("n_chars")).cast("bigint").alias("width"),
        F.when(bad, F.lit(-1)).otherwise(F.expr("n_chars div 2")).cast("bigint").alias("height"))
    return listings.label_summary(files)


# --- windows, order, sets ----------------------------------------------------------------------------------------


@R.add("w_rownum", with_tables(
    "SELECT id, row_number() OVER (ORDER BY verified_at DESC NULLS LAST, id DESC) AS row_no FROM ver", "verifications"))
def w_rownum(spark, sf):
    ver = derived(spark, sf, "verifications").select("id", "verified_at")
    return numbered(ver, [F.col("verified_at").desc_nulls_last(), F.col("id").desc()]).select("id", "row_no")


@R.add("w_seq_name", with_tables(
    "SELECT id, concat(CASE doc_type WHEN 'certificate' THEN 'cert' WHEN 'transcript' THEN 'trans' ELSE 'id' END, '_', "
    "lpad(CAST(n AS VARCHAR), CAST(greatest(4, length(CAST(n AS VARCHAR))) AS INTEGER), '0')) AS new_name FROM ("
    "SELECT id, doc_type, row_number() OVER (ORDER BY CASE doc_type WHEN 'certificate' THEN 1 WHEN 'transcript' THEN 2 ELSE 3 END, id) AS n FROM docs)", "documents"))
def w_seq_name(spark, sf):
    kind = F.col("doc_type")
    docs = derived(spark, sf, "documents").select(
        "id", F.when(kind == "certificate", "cert").when(kind == "transcript", "trans").otherwise("id").alias("prefix"),
        F.when(kind == "certificate", 1).when(kind == "transcript", 2).otherwise(3).alias("folder"))
    rows = numbered(docs, [F.col("folder"), F.col("id")], "n")
    n = F.col("n").cast("string")
    return rows.select("id", F.concat("prefix", F.lit("_"), F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit("0"))).alias("new_name"))


@R.add("w_latest", with_tables(
    "SELECT candidate_id, id, status, verified_at FROM ver WHERE candidate_id IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY verified_at DESC NULLS LAST, id DESC) = 1", "verifications"))
def w_latest(spark, sf):
    ver = derived(spark, sf, "verifications").where("candidate_id is not null").select("candidate_id", "verified_at", "id", "status")
    return latest_per_key(ver, "candidate_id", "verified_at", "id").select("candidate_id", "id", "status", "verified_at")


@R.add("s_recent5", with_tables(
    "SELECT c.id, c.full_name, v.id AS verification_id, v.status FROM cand c LEFT JOIN ver v ON v.candidate_id = c.id "
    "ORDER BY c.created_at DESC, c.id DESC, v.id DESC LIMIT 5", "candidates", "verifications"))
def s_recent5(spark, sf):
    ver = derived(spark, sf, "verifications").select("candidate_id", F.col("id").alias("verification_id"), "status")
    # every candidate gives a row, so the five newest of them hold the five newest rows
    recent = derived(spark, sf, "candidates").select("id", "full_name", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(5)
    order = [F.desc("created_at"), F.desc("id"), F.desc("verification_id")]
    matched = ver.join(F.broadcast(recent), F.col("candidate_id") == F.col("id")).orderBy(*order).limit(5)
    # one whose rows all fall behind these five is behind them as well without them
    single = recent.join(matched.select("id").distinct(), "id", "left_anti")
    newest = matched.unionByName(single, allowMissingColumns=True).orderBy(*order).limit(5)
    return newest.select("id", "full_name", "verification_id", "status")


@R.add("s_desc_list", with_tables("SELECT id, uploaded_at, file_path FROM docs ORDER BY uploaded_at DESC, id DESC", "documents"))
def s_desc_list(spark, sf):
    docs = derived(spark, sf, "documents").select("id", "uploaded_at", "file_path")
    return docs.orderBy(F.desc("uploaded_at"), F.desc("id"))


@R.add("s_by_name", with_tables("SELECT id, full_name FROM cand ORDER BY lower(full_name), id", "candidates"))
def s_by_name(spark, sf):
    return derived(spark, sf, "candidates").select("id", "full_name").orderBy(F.collate("full_name", "UNICODE_CI_AI"), "id")


@R.add("s_best_text", (
    "SELECT conv_id, text AS best_text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(trim(text)) DESC, turn) = 1"))
def s_best_text(spark, sf):
    conv = parquet_table(spark, sf, "conversations")
    rank = F.struct(F.length(F.trim("text")).alias("n"), (-F.col("turn")).alias("t"))
    return conv.groupBy("conv_id").agg(F.max_by("text", rank).alias("best_text"))


@R.add("s_limit1", with_tables("SELECT id FROM cand WHERE id IN (SELECT candidate_id FROM ver WHERE status = 'Verified')", "candidates", "verifications"))
def s_limit1(spark, sf):
    seen = derived(spark, sf, "verifications").where("status = 'Verified'").select(F.col("candidate_id").alias("id"))
    return derived(spark, sf, "candidates").select("id").join(seen, "id", "left_semi")


@R.add("u_stack", (
    "SELECT doc_id, 1 AS label FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 0 FROM labels WHERE quality = 1"))
def u_stack(spark, sf):
    labels = parquet_table(spark, sf, "labels")
    real = labels.where("quality = 0").select("doc_id", F.lit(1).alias("label"))
    return real.unionByName(labels.where("quality = 1").select("doc_id", F.lit(0).alias("label")))


# --- changes ---------------------------------------------------------------------------------------------------------


def _three(spark, sf):
    return [derived(spark, sf, t) for t in ("candidates", "documents", "verifications")]


@R.add("d_dedupe_apply", with_tables(
    "SELECT 'candidate' AS kind, c.id, c.id AS candidate_id FROM cand c WHERE c.id NOT IN (SELECT duplicate_id FROM dm) "
    "UNION ALL SELECT 'document', d.id, coalesce(m.keeper_id, d.candidate_id) FROM docs d LEFT JOIN dm m ON m.duplicate_id = d.candidate_id "
    "UNION ALL SELECT 'verification', v.id, coalesce(m.keeper_id, v.candidate_id) FROM ver v LEFT JOIN dm m ON m.duplicate_id = v.candidate_id",
    "candidates", "documents", "verifications", extra=DEDUPE))
def d_dedupe_apply(spark, sf):
    """The three tables after the merge, changed under one manifest and read back."""
    from credence.sources.tableset import TableSet

    tables = TableSet.new(spark, "application")
    change = tables.begin()
    for name, rows, columns in zip(persons.TABLES, _three(spark, sf), (["id", "full_name", "email"], ["id", "candidate_id"], ["id", "candidate_id"])):
        change.create(name, rows.select(columns), "id")
    change.commit()
    persons.apply_merge(tables)
    cand, docs, ver = (tables.read(name) for name in persons.TABLES)
    part = lambda df, kind, owner: df.select(F.lit(kind).alias("kind"), "id", F.col(owner).alias("candidate_id"))
    return part(cand, "candidate", "id").unionByName(part(docs, "document", "candidate_id")).unionByName(part(ver, "verification", "candidate_id"))


_GONE = "gone AS (SELECT id FROM cand WHERE position_applied IS NULL)"


def _leaving(cand):
    return cand.where("position_applied is null").select("id")


@R.add("d_delete_cand", with_tables(
    "SELECT 'candidate' AS kind, id FROM cand WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'document', id FROM docs "
    "WHERE candidate_id IS NULL OR candidate_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'verification', id FROM ver "
    "WHERE candidate_id IS NULL OR candidate_id NOT IN (SELECT id FROM gone)", "candidates", "documents", "verifications", extra=(_GONE,)))
def d_delete_cand(spark, sf):
    tables = _three(spark, sf)
    kept = persons.delete_candidates(_leaving(tables[0]), *tables)
    parts = [df.select(F.lit(kind).alias("kind"), "id") for df, kind in zip(kept, ("candidate", "document", "verification"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@R.add("d_fk_setnull", with_tables(
    "SELECT 'document' AS kind, id, CASE WHEN candidate_id IN (SELECT id FROM gone) THEN NULL ELSE candidate_id END AS candidate_id FROM docs "
    "UNION ALL SELECT 'verification', id, candidate_id FROM ver WHERE document_id NOT IN (SELECT id FROM docs WHERE doc_type = 'other')",
    "candidates", "documents", "verifications", extra=(_GONE,)))
def d_fk_setnull(spark, sf):
    cand, docs, ver = _three(spark, sf)
    cleared = persons.set_null_on_delete(_leaving(cand), docs)
    left = persons.cascade_on_delete(docs.where("doc_type = 'other'").select("id"), ver)
    part = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "candidate_id")
    return part(cleared, "document").unionByName(part(left, "verification"))


_INCOMING = (
    "inc AS (SELECT o_orderkey AS id, concat(' ', translate(upper(c.full_name), 'OE', 'ÓÉ')) AS full_name, CASE WHEN o_orderkey % 2 = 0 THEN c.email "
    "ELSE concat('n', CAST(o_custkey AS VARCHAR), '@example.net') END AS email FROM orders JOIN cand c ON c.id = o_custkey)"
)


def _incoming(spark, sf, cand):
    orders = parquet_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    joined = orders.join(cand.select(F.col("id").alias("o_custkey"), "full_name", F.col("email").alias("_m")), "o_custkey")
    mail = F.when(F.col("o_orderkey") % 2 == 0, F.col("_m")).otherwise(F.concat(F.lit("n"), F.col("o_custkey").cast("string"), F.lit("@example.net")))
    return joined.select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" "), F.translate(F.upper("full_name"), "OE", "ÓÉ")).alias("full_name"), mail.alias("email"))


@R.add("d_insert_unique", with_tables(
    "SELECT min(id) AS id FROM inc WHERE NOT EXISTS (SELECT 1 FROM cand c WHERE strip_accents(lower(trim(c.full_name))) = strip_accents(lower(trim(inc.full_name))) "
    "AND lower(trim(coalesce(c.email, ''))) = lower(trim(coalesce(inc.email, '')))) GROUP BY strip_accents(lower(trim(full_name))), lower(trim(coalesce(email, '')))",
    "candidates", extra=(_INCOMING,)))
def d_insert_unique(spark, sf):
    cand = derived(spark, sf, "candidates")
    return persons.insert_unique(cand, _incoming(spark, sf, cand)).select("id")


_CHANGES = (
    "chg AS (SELECT id, CASE WHEN id % 2 = 0 THEN concat(trim(full_name), ' X') ELSE translate(upper(trim(full_name)), 'OE', 'ÓÉ') END AS full_name, '' AS email, 'clerk' AS position_applied "
    "FROM cand WHERE position_applied IS NOT NULL)"
)


@R.add("d_update", with_tables(
    "SELECT c.id, CASE WHEN ok.id IS NULL THEN c.full_name ELSE ok.full_name END AS full_name, CASE WHEN ok.id IS NULL THEN c.email ELSE ok.email END AS email, "
    "CASE WHEN ok.id IS NULL THEN c.position_applied ELSE ok.position_applied END AS position_applied FROM cand c LEFT JOIN ("
    "SELECT * FROM chg WHERE NOT EXISTS (SELECT 1 FROM cand o WHERE o.id <> chg.id AND strip_accents(lower(trim(o.full_name))) = strip_accents(lower(trim(chg.full_name))) "
    "AND lower(trim(coalesce(o.email, ''))) = lower(trim(chg.email)))) ok ON ok.id = c.id", "candidates", extra=(_CHANGES,)))
def d_update(spark, sf):
    cand = derived(spark, sf, "candidates")
    name = F.trim("full_name")
    changes = cand.where("position_applied is not null").select(
        "id", F.when(F.col("id") % 2 == 0, F.concat(name, F.lit(" X"))).otherwise(F.translate(F.upper(name), "OE", "ÓÉ")).alias("full_name"),
        F.lit("").alias("email"), F.lit("clerk").alias("position_applied"))
    return persons.update_persons(cand, changes).select("id", "full_name", "email", "position_applied")


@R.add("sink_upsert", with_tables(
    "SELECT document_id, status, authenticity_score FROM ver WHERE document_id NOT IN (SELECT id FROM docs) "
    "UNION ALL SELECT id, 'Verified', 100 FROM docs", "verifications", "documents"))
def sink_upsert(spark, sf):
    from credence.sources.tableset import TableSet

    tables = TableSet.new(spark, "verifications")
    change = tables.begin()
    change.create("verifications", derived(spark, sf, "verifications").select("document_id", "status", "authenticity_score"), "document_id")
    change.commit()
    fresh = derived(spark, sf, "documents").select(F.col("id").alias("document_id"), F.lit("Verified").alias("status"), F.lit(100).alias("authenticity_score"))
    change = tables.begin()
    change.upsert("verifications", fresh)
    change.commit()
    return tables.read("verifications")


@R.add("x_hash", "SELECT doc_id AS id, md5(text) AS file_hash, sha256(text) AS content_digest FROM documents")
def x_hash(spark, sf):
    from credence.operators.duplicates import content_digest

    docs = parquet_table(spark, sf, "documents")
    return docs.select(F.col("doc_id").alias("id"), file_hash(F.col("text")).alias("file_hash"), content_digest(F.col("text")).alias("content_digest"))


@R.add("sink_hash", R.oracles["x_hash"])
def sink_hash(spark, sf):
    """Hashes stored beside the documents, as at upload, and read back."""
    from credence.sources.tableset import TableSet

    tables = TableSet.new(spark, "file-hashes")
    change = tables.begin()
    change.create("hashes", x_hash(spark, sf), "id")
    change.commit()
    return tables.read("hashes")
