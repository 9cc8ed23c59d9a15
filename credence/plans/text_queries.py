"""Text, name, link, page, date and list functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions import links as L
from credence.functions import names as N
from credence.functions import similarity as S
from credence.functions import text as X
from credence.operators import capture, consistency
from credence.operators.content import text_features
from credence.operators.fusion import issue_flags, regroup_issues
from credence.plans.registry import Registry
from credence.plans.tables import derived, person, with_exif, with_tables
from credence.sources.records import pack_texts, parse_records, text_batches
from credence.sources.tables import parquet_table

R = Registry()

# --- pieces of oracle SQL -------------------------------------------------------------------------------


def up(c: str) -> str:
    """Upper case with the sharp s spelled out, as Spark does."""
    return f"upper(replace({c}, 'ß', 'SS'))"


def ascii_words(c: str) -> str:
    """Upper case with other letters as an underscore, so that word boundaries stay where they are."""
    return f"regexp_replace({up(c)}, '[^\\x00-\\x7F]', '_', 'g')"


def norm(c: str) -> str:
    return f"regexp_replace(regexp_replace({up(c)}, '[^A-Z\\s'']+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, words) -> str:
    return "(" + " OR ".join(f"contains({c}, {sq(w)})" for w in words) + ")"


def count_of(c: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, {sq(w)}) AS INTEGER)" for w in words) + ")"


def in_list(words) -> str:
    return "(" + ", ".join(sq(w) for w in words) + ")"


def first_of(c: str, pairs) -> str:
    return "CASE " + " ".join(f"WHEN contains({c}, {sq(k)}) THEN {sq(v)}" for k, v in pairs) + " END"


def parts_of(c: str) -> str:
    return f"list_filter(regexp_extract_all({ascii_words(c)}, '\\b[A-Z'']{{2,}}\\b'), lambda w: w NOT IN {in_list(fv.NAME_STOP_WORDS)})"


def null_if_empty(e: str) -> str:
    return f"nullif({e}, '')"


def clean_person(c: str) -> str:
    """Expression over a text expression without side conditions on case."""
    stop = fv.PERSON_NAME_END.replace("'", "''")
    single = f"trim(regexp_replace(regexp_replace(translate(url_decode({c}), '+_-', '   '), '[^A-Za-z\\s'']', ' ', 'g'), '\\s+', ' ', 'g'))"
    head = f"trim(regexp_replace({single}, '(?i){stop}.*$', ''))"
    words = f"list_filter(string_split(upper({head}), ' '), lambda w: length(w) > 1)"
    return (
        f"CASE WHEN length({head}) >= 4 AND len({words}) BETWEEN 2 AND 5 AND NOT list_has_any({words}, [{', '.join(sq(w) for w in fv.PERSON_NAME_BLOCKED)}]) "
        f"THEN array_to_string({words}, ' ') END"
    )


def html_text(c: str, separator: str = "\\n") -> str:
    sep = "chr(10)" if separator == "\\n" else sq(separator)
    out = f"regexp_replace({c}, '(?is)<(script|style|template)\\b.*?</(script|style|template)\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->|<![^>]*>', '', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', {sep}, 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = f"replace({out}, {sq(entity)}, {sq(char)})"
    return out


# --- names ---------------------------------------------------------------------------------------------------


def _subm(spark, sf):
    return derived(spark, sf, "submissions")


@R.add("x_norm_name", with_tables(f"SELECT id, md5({norm('text')}) AS digest, {norm('candidate_name')} AS name FROM subm", "submissions"))
def x_norm_name(spark, sf):
    return _subm(spark, sf).select("id", F.md5(N.normal_name(F.col("text"))).alias("digest"), N.normal_name(F.col("candidate_name")).alias("name"))


@R.add("x_name_parts", with_tables(
    f"SELECT id, CAST(len({parts_of('text')}) AS INTEGER) AS n, md5(array_to_string({parts_of('text')}, ' ')) AS digest FROM subm", "submissions"))
def x_name_parts(spark, sf):
    rows = _subm(spark, sf).select("id", N.name_parts(F.col("text")).alias("p"))
    return rows.select("id", F.size("p").alias("n"), F.md5(F.array_join("p", " ")).alias("digest"))


@R.add("x_compact", with_tables(f"SELECT id, md5(regexp_replace({up('text')}, '[^A-Z]+', '', 'g')) AS digest FROM subm", "submissions"))
def x_compact(spark, sf):
    return _subm(spark, sf).select("id", F.md5(N.letters_only(F.col("text"))).alias("digest"))


@R.add("x_word_in_text", with_tables(
    f"SELECT id, contains(concat(' ', translate(n, concat(chr(10), ''''), '  '), ' '), concat(' ', c, ' ')) AS found FROM "
    f"(SELECT id, {norm('text')} AS n, {norm('candidate_name')} AS c FROM subm)", "submissions"))
def x_word_in_text(spark, sf):
    rows = _subm(spark, sf).select("id", N.normal_name(F.col("text")).alias("n"), N.normal_name(F.col("candidate_name")).alias("c"))
    return rows.select("id", F.when(F.col("c").isNotNull(), N.phrase_in_text(F.col("c"), F.col("n"))).otherwise(False).alias("found"))


R.oracles["x_word_in_text"] = R.oracles["x_word_in_text"].replace("concat(' ', c, ' ')) AS found", "concat(' ', c, ' ')) AND c IS NOT NULL AS found")


@R.add("x_token_match", with_tables(
    "SELECT id, round(coalesce(list_max(list_transform(words, lambda w: CASE WHEN contains(w, token) OR contains(token, w) THEN "
    "least(length(w), length(token))::DOUBLE / greatest(length(w), length(token)) ELSE 0 END)), 0), 6) AS score FROM ("
    f"SELECT id, {parts_of('candidate_name')}[1] AS token, list_filter(list_transform(regexp_extract_all({norm('text')}, '\\b[A-Z'']{{2,}}\\b'), "
    "lambda w: replace(w, '''', '')), lambda w: w <> '') AS words FROM subm) WHERE token IS NOT NULL", "submissions"))
def x_token_match(spark, sf):
    rows = _subm(spark, sf).select(
        "id", N.letters_only(F.get(N.name_parts(F.col("candidate_name")), F.lit(0))).alias("token"),
        S.document_words(N.normal_name(F.col("text"))).alias("words")).where("token is not null")
    return rows.select("id", F.round(S.containment_score(F.col("token"), F.col("words")), 6).alias("score"))


@R.add("x_clean_person", with_tables(f"SELECT id, {clean_person('payload')} AS name FROM links_src", "links"))
def x_clean_person(spark, sf):
    return derived(spark, sf, "links").select("id", N.clean_person_name(F.col("payload")).alias("name"))


def _holder_words_sql(raw: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace({raw}, '[^A-Z\\s'']+', ' ', 'g'), '\\s+'), "
            f"lambda w: length(w) > 1 AND w NOT IN {in_list(fv.NAME_STOP_WORDS)})")


def holders_sql() -> str:
    anchors = []
    for _, pattern in fv.HOLDER_ANCHORS:
        words = _holder_words_sql(f"regexp_extract(u, {sq(pattern)}, 1)")
        anchors.append(f"CASE WHEN len({words}) BETWEEN 2 AND 4 THEN array_to_string({words}, ' ') END")
    labels = [f"list_transform(regexp_extract_all(u, {sq(p)}, 1), lambda r: array_to_string({_holder_words_sql('r')}, ' '))" for p in fv.HOLDER_LABELS]
    parts = f"list_filter(regexp_extract_all(s, '\\b[A-Z'']{{2,}}\\b'), lambda w: w NOT IN {in_list(fv.NAME_STOP_WORDS)})"
    lines = (
        f"list_transform(list_filter(list_transform(list_filter(string_split(u, chr(10)), lambda s: NOT regexp_matches(s, '\\d')), lambda s: {parts}), "
        f"lambda ws: len(ws) BETWEEN 2 AND 4 AND NOT list_has_any(ws, [{', '.join(sq(w) for w in fv.FIELD_OF_STUDY_WORDS)}]) "
        "AND len(list_filter(ws, lambda w: length(w) > 12 AND NOT regexp_matches(w, '[AEIOU]'))) = 0), lambda ws: array_to_string(ws, ' '))"
    )
    return (
        f"SELECT id, CASE WHEN anchored IS NOT NULL THEN [anchored] ELSE list_filter(list_sort(list_distinct(list_concat(labelled, lined))), "
        "lambda n: NOT regexp_matches(n, '(^|\\s)\\S{1,2}(\\s|$)'))[1:4] END AS names FROM ("
        f"SELECT id, coalesce({', '.join(anchors)}) AS anchored, list_filter(list_concat({', '.join(labels)}), lambda n: length(n) > 1) AS labelled, {lines} AS lined "
        f"FROM (SELECT id, {ascii_words('text')} AS u FROM subm))"
    )


@R.add("x_extract_names", with_tables(f"SELECT id, array_to_string(names, ', ') AS names FROM ({holders_sql()})", "submissions"))
def x_extract_names(spark, sf):
    return _subm(spark, sf).select("id", F.array_join(N.holder_names(F.col("text")), ", ").alias("names"))


def matched_sql(a: str, b: str) -> str:
    """Letters of the matching blocks of two texts, both of them not empty."""
    common = "contains(s.b, substr(s.a, CAST(i AS BIGINT), CAST(k AS BIGINT)))"
    places = f"list_filter(range(1, length(s.a) - k + 2), lambda i: {common})"
    longest = f"len(list_filter(range(1, least(length(s.a), length(s.b)) + 1), lambda k: len({places}) > 0))"
    block = (f"list_transform(list_transform([{longest}], lambda k: {{'k': k, 'i': {places}[1]}}), "
             "lambda f: {'k': f.k, 'i': f.i, 'j': position(substr(s.a, f.i, f.k) IN s.b), 'a': s.a, 'b': s.b})[1]")
    left = "{'a': substr(f.a, 1, f.i - 1), 'b': substr(f.b, 1, f.j - 1)}"
    right = "{'a': substr(f.a, f.i + f.k), 'b': substr(f.b, f.j + f.k)}"
    rest = f"list_filter(flatten(list_transform(fs, lambda f: [{left}, {right}])), lambda p: p.a <> '' AND p.b <> '')"
    after = f"{{'parts': {rest}, 'm': st.m + coalesce(list_sum(list_transform(fs, lambda f: f.k)), 0)::BIGINT}}"
    step = f"list_transform([list_filter(list_transform(st.parts, lambda s: {block}), lambda f: f.k > 0)], lambda fs: {after})[1]"
    none = "{'parts': []::STRUCT(a VARCHAR, b VARCHAR)[], 'm': 0::BIGINT}"
    return (f"list_reduce(list_prepend({{'parts': [{{'a': {a}, 'b': {b}}}], 'm': 0::BIGINT}}, list_transform(range(least(length({a}), length({b}))), lambda _: {none})), "
            f"lambda st, x: CASE WHEN len(st.parts) = 0 THEN st ELSE {step} END).m")


@R.add("x_seq_ratio", with_tables(
    f"SELECT id, candidate_name, holder, round(2 * {matched_sql('candidate_name', 'holder')}::DOUBLE / (length(candidate_name) + length(holder)), 4) AS ratio FROM "
    f"(SELECT s.id, s.candidate_name, h.names[1] AS holder FROM subm s JOIN ({holders_sql()}) h USING (id))", "submissions"))
def x_seq_ratio(spark, sf):
    """Similarity of each candidate with the first holder name printed on the document."""
    rows = _subm(spark, sf).select("id", "candidate_name", F.get(N.holder_names(F.col("text")), F.lit(0)).alias("holder"))
    return rows.select("id", "candidate_name", "holder", F.round(S.block_ratio(F.col("candidate_name"), F.col("holder")), 4).alias("ratio"))


R.add("s_cap_names", R.oracles["x_extract_names"])(x_extract_names)


def match_sql(a: str, b: str) -> str:
    long_a, long_b = (f"list_filter(regexp_split_to_array(trim(upper({c})), '\\s+'), lambda p: length(p) > 2)" for c in (a, b))
    return (
        f"CASE WHEN coalesce({a}, '') = '' OR coalesce({b}, '') = '' THEN NULL WHEN trim(upper({a})) = trim(upper({b})) THEN true "
        f"WHEN len({long_a}) = 0 OR len({long_b}) = 0 THEN NULL "
        f"ELSE len(list_filter({long_a}, lambda p: contains(upper({b}), p)))::DOUBLE / len({long_a}) >= 0.6::DOUBLE END"
    )


@R.add("x_match_names", with_tables(
    f"SELECT id, {match_sql('holder', 'candidate_name')} AS match FROM (SELECT id, candidate_name, {person('(id // 2)', 'duck')} AS holder FROM links_src)", "links"))
def x_match_names(spark, sf):
    rows = derived(spark, sf, "links").withColumn("holder", F.expr(person("(id div 2)", "spark")))
    return rows.select("id", N.names_match(F.col("holder"), F.col("candidate_name")).alias("match"))


# --- numbers, dates, plain text ---------------------------------------------------------------------------------


def serial_sql(c: str) -> str:
    def repaired(compact):
        heads = f"list_filter(list_transform(regexp_extract_all({compact}, 'A[A-Z0-9]{{6,12}}'), lambda r: left(r, 9)), lambda h: length(regexp_replace(h, '[^0-9]', '', 'g')) >= 4)"
        return (f"list_filter(list_transform({heads}, lambda h: translate(h, '{fv.SERIAL_LETTERS}', '{fv.SERIAL_DIGITS}')), "
                "lambda s: regexp_full_match(s, 'A[0-9]{8}'))[1]")

    whole = repaired(f"upper(regexp_replace({c}, '[^A-Za-z0-9]', '', 'g'))")
    spaced = f"regexp_replace(regexp_extract(upper({c}), 'A\\s*([0-9OQILNZSBE]\\s*){{8}}'), '[^A-Z0-9]', '', 'g')"
    return f"coalesce({whole}, {repaired(spaced)})"


@R.add("x_nesa_serial", with_tables(
    f"SELECT id, {serial_sql('payload')} AS serial, coalesce(regexp_full_match(upper(trim(payload)), 'A[0-9]{{8}}'), false) AS plain FROM links_src", "links"))
def x_nesa_serial(spark, sf):
    rows = derived(spark, sf, "links")
    return rows.select("id", L.exam_serial(F.col("payload")).alias("serial"), F.coalesce(L.is_exam_serial(F.col("payload")), F.lit(False)).alias("plain"))


_DATES_SQL = "list_concat(" + ", ".join(f"regexp_extract_all(text, {sq(p)})" for p in fv.DATE_SHAPES) + ")"


@R.add("x_dates", with_tables(
    f"SELECT id, array_to_string(list_sort(list_distinct({_DATES_SQL})), ' ') AS dates, regexp_matches(text, {sq(fv.ANY_DATE)}) AS has_date FROM subm", "submissions"))
def x_dates(spark, sf):
    text = F.col("text")
    return _subm(spark, sf).select(
        "id", F.array_join(F.array_sort(consistency.date_tokens(text)), " ").alias("dates"), text.rlike(X.uni(fv.ANY_DATE)).alias("has_date"))


@R.add("x_year", with_tables(
    f"SELECT id, regexp_matches({ascii_words('text')}, {sq(fv.ISSUE_YEAR)}) OR {any_of(up('text'), fv.YEAR_WORDS)} AS has_year FROM subm", "submissions"))
def x_year(spark, sf):
    text = F.col("text")
    return _subm(spark, sf).select("id", (text.rlike(X.uni(fv.ISSUE_YEAR)) | X.contains_any(F.upper(text), fv.YEAR_WORDS)).alias("has_year"))


@R.add("x_grade", with_tables(f"SELECT id, regexp_matches({ascii_words('text')}, {sq(fv.GRADE_VALUE)}) AS graded FROM subm", "submissions"))
def x_grade(spark, sf):
    return _subm(spark, sf).select("id", F.col("text").rlike(X.uni(fv.GRADE_VALUE)).alias("graded"))


@R.add("x_labelize", with_tables("SELECT id, concat(upper(left(doc_type, 1)), substr(replace(doc_type, '_', ' '), 2)) AS label FROM docs", "documents"))
def x_labelize(spark, sf):
    return derived(spark, sf, "documents").select("id", X.labelize(F.col("doc_type")).alias("label"))


@R.add("x_basename", with_tables(
    "SELECT id, string_split(file_path, '/')[-1] AS name, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS ext FROM docs", "documents"))
def x_basename(spark, sf):
    path = F.col("file_path")
    return derived(spark, sf, "documents").select("id", X.base_name(path).alias("name"), X.extension(path).alias("ext"))


@R.add("x_wordcount", "SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS words FROM documents")
def x_wordcount(spark, sf):
    return parquet_table(spark, sf, "documents").select("doc_id", X.word_count(F.col("text")).cast("int").alias("words"))


@R.add("x_trunc", "SELECT doc_id, left(text, 200) AS t200, left(text, 300) AS t300, left(text, 70) AS t70 FROM documents")
def x_trunc(spark, sf):
    cut = lambda n: F.left(F.col("text"), F.lit(n)).alias(f"t{n}")
    return parquet_table(spark, sf, "documents").select("doc_id", cut(200), cut(300), cut(70))


@R.add("x_mask_id", "SELECT c_custkey, concat('candidate-', left(md5(c_name), 8)) AS pseudonym FROM customer")
def x_mask_id(spark, sf):
    return parquet_table(spark, sf, "customer").select("c_custkey", X.pseudonym(F.col("c_name")).alias("pseudonym"))


_FLAGS = [" True", "1", "FALSE ", "0", "yes", ""]


@R.add("x_safe_bool", (
    "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lower(trim(f)) IN ('true', '1') THEN true WHEN lower(trim(f)) IN ('false', '0') THEN false END AS flag "
    f"FROM (SELECT *, list_extract([{', '.join(sq(f) for f in _FLAGS)}], CAST(l_partkey % 6 AS INTEGER) + 1) AS f FROM lineitem)"))
def x_safe_bool(spark, sf):
    flag = F.element_at(F.array(*[F.lit(f) for f in _FLAGS]), (F.col("l_partkey") % 6 + 1).cast("int"))
    return parquet_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", X.safe_bool(flag).alias("flag"))


@R.add("x_safe_str", with_tables("SELECT id, coalesce(trim(full_name), '') AS name, coalesce(trim(email), '') AS email FROM cand", "candidates"))
def x_safe_str(spark, sf):
    return derived(spark, sf, "candidates").select("id", X.safe_text(F.col("full_name")).alias("name"), X.safe_text(F.col("email")).alias("email"))


@R.add("x_date_fmt", with_tables("SELECT id, strftime(uploaded_at, '%b %d, %Y') AS short, strftime(uploaded_at, '%B %d, %Y at %H:%M') AS long FROM docs", "documents"))
def x_date_fmt(spark, sf):
    ts = F.col("uploaded_at")
    return derived(spark, sf, "documents").select("id", X.show_date(ts).alias("short"), F.date_format(ts, "MMMM dd, yyyy 'at' HH:mm").alias("long"))


@R.add("x_clamp", "SELECT c_custkey, least(100, greatest(0, CAST(floor(c_acctbal / 50) AS BIGINT))) AS score FROM customer")
def x_clamp(spark, sf):
    return parquet_table(spark, sf, "customer").select("c_custkey", X.clamp(F.floor(F.col("c_acctbal") / 50)).alias("score"))


@R.add("x_pct", with_tables("SELECT document_id, line_no, part, supp, round(conf_1 * 100, 1) AS pct FROM capt", "captures"))
def x_pct(spark, sf):
    return derived(spark, sf, "captures").select("document_id", "line_no", "part", "supp", X.percent(F.col("conf_1")).alias("pct"))


@R.add("x_conf_scale", (
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(CASE WHEN c <= 1 THEN c * 100 ELSE c END) AS INTEGER) AS accept_pct, "
    "CASE WHEN c > 1 THEN c / 100 ELSE c END AS detect_fraction FROM "
    "(SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_quantity / 64 END AS c FROM lineitem)"))
def x_conf_scale(spark, sf):
    c = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(F.col("l_quantity") / 64)
    return parquet_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", X.accept_scale(c).alias("accept_pct"), X.detect_scale(c).alias("detect_fraction"))


@R.add("x_year_range", (
    "SELECT o_orderkey, year(o_orderdate) BETWEEN 1996 AND 2000 AS in_range, 2010 - year(o_orderdate) >= 16 AS of_age FROM orders"))
def x_year_range(spark, sf):
    year = F.year("o_orderdate")
    return parquet_table(spark, sf, "orders").select("o_orderkey", year.between(1996, 2000).alias("in_range"), (F.lit(2010) - year >= 16).alias("of_age"))


@R.add("x_exif_dates", with_tables(
    "SELECT document_id, line_no, part, supp, CASE WHEN s > TIMESTAMP '2026-06-01 00:00:00' THEN concat('EXIF Original date is in the future: ', stamp, ' — possible manipulation') "
    "WHEN year(s) < 1990 THEN concat('EXIF Original date is suspiciously old: ', stamp) END AS issue "
    "FROM (SELECT *, try_strptime(left(stamp, 19), '%Y:%m:%d %H:%M:%S') AS s FROM capt)", "captures"))
def x_exif_dates(spark, sf):
    as_of = F.lit("2026-06-01 00:00:00").cast("timestamp")
    return derived(spark, sf, "captures").select(
        "document_id", "line_no", "part", "supp", capture.exif_date_issue("Original", F.col("stamp"), as_of).alias("issue"))


@R.add("x_file_age", with_tables(
    "SELECT document_id, line_no, part, supp, CAST(floor((epoch(modified) - epoch(created)) / 86400) AS INTEGER) AS days FROM capt", "captures"))
def x_file_age(spark, sf):
    return derived(spark, sf, "captures").select("document_id", "line_no", "part", "supp", capture.file_age_days(F.col("created"), F.col("modified")).alias("days"))


# --- lists and stored issues ---------------------------------------------------------------------------------------


_SPLIT = "list_filter(list_transform(string_split(issues, ';'), lambda s: trim(s)), lambda s: s <> '')"


@R.add("x_issues_split", with_tables(f"SELECT id, CAST(len({_SPLIT}) AS INTEGER) AS n, array_to_string({_SPLIT}, '|') AS items FROM ver", "verifications"))
def x_issues_split(spark, sf):
    items = X.split_issues(F.col("issues"))
    return derived(spark, sf, "verifications").select("id", F.size(items).alias("n"), F.array_join(items, "|").alias("items"))


@R.add("x_issues_join", with_tables(f"SELECT id, array_to_string({_SPLIT}, '; ') AS issues FROM ver", "verifications"))
def x_issues_join(spark, sf):
    return derived(spark, sf, "verifications").select("id", X.join_issues(X.split_issues(F.col("issues"))).alias("issues"))


_BAD = any_of("lower(issues)", ["identity mismatch", "not found in document", "possible borrowed", "borrowed document"])


@R.add("x_issue_flags", with_tables(
    f"SELECT id, {_BAD} AS name_mismatch, NOT {_BAD} AND (contains(lower(issues), 'identity confirmed') OR contains(lower(recommendation), 'certificate holder from qr') "
    "OR contains(lower(recommendation), 'candidate name confirmed via ocr')) AS name_confirmed FROM ver", "verifications"))
def x_issue_flags(spark, sf):
    flags = issue_flags(F.col("issues"), F.col("recommendation"))
    return derived(spark, sf, "verifications").select("id", flags["name_mismatch"].alias("name_mismatch"), flags["name_confirmed"].alias("name_confirmed"))


def _groups_sql() -> str:
    group = lambda words, exact=(): "list_filter(i, lambda x: " + " OR ".join(
        [f"contains(lower(x), {sq(w)})" for w in words] + [f"contains(x, {sq(w)})" for w in exact]) + ")"
    return (f"array_to_string(list_concat(list_concat({group(['borrowed', 'name'], ['CRITICAL'])}, {group(['editing', 'photoshop', 'software'])}), "
            f"{group(['duplicate'])}), '; ')")


_NOTES = ["Duplicate editing name", "CRITICAL: software", "plain", "borrowed"]


@R.add("x_issue_group", with_tables(
    f"SELECT id, {_groups_sql()} AS issues FROM (SELECT id, list_concat({_SPLIT}, [list_extract([{', '.join(sq(n) for n in _NOTES)}], CAST(id % 4 AS INTEGER) + 1)]) AS i FROM ver)",
    "verifications"))
def x_issue_group(spark, sf):
    note = F.element_at(F.array(*[F.lit(n) for n in _NOTES]), (F.col("id") % 4 + 1).cast("int"))
    items = F.concat(X.split_issues(F.col("issues")), F.array(note))
    return derived(spark, sf, "verifications").select("id", X.join_issues(regroup_issues(items)).alias("issues"))


_WORDS_SQL = f"list_filter(string_split(lower(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda w: w <> '')"


def _words(c: str = "text"):
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"\s+", " ")), " "), lambda w: w != "")


@R.add("u_distinct", f"SELECT doc_id, CAST(len({_WORDS_SQL}) AS INTEGER) AS words, CAST(len(list_distinct({_WORDS_SQL})) AS INTEGER) AS distinct_words FROM documents")
def u_distinct(spark, sf):
    rows = parquet_table(spark, sf, "documents").select("doc_id", _words().alias("w"))
    return rows.select("doc_id", F.size("w").alias("words"), F.size(X.distinct_in_order(F.col("w"))).alias("distinct_words"))


@R.add("u_intersect", (
    "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), "
    f"t AS (SELECT conv_id, turn, unnest(list_distinct(list_filter(regexp_split_to_array({up('text')}, '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}')))) AS token FROM conversations) "
    "SELECT t.conv_id, token, count(*) AS n_docs FROM t JOIN n USING (conv_id) GROUP BY t.conv_id, token, n.n HAVING count(*) = n.n"))
def u_intersect(spark, sf):
    return consistency.common_tokens(parquet_table(spark, sf, "conversations"), "conv_id", "text")


@R.add("u_except", with_tables(
    f"SELECT id, array_to_string(list_filter({_SPLIT}, lambda x: NOT (contains(lower(x), 'name mismatch') OR contains(lower(x), 'borrowed') OR contains(lower(x), 'identity'))), '; ') AS issues FROM ver",
    "verifications"))
def u_except(spark, sf):
    items = F.filter(X.split_issues(F.col("issues")), lambda i: ~X.contains_any(F.lower(i), ["name mismatch", "borrowed", "identity"]))
    return derived(spark, sf, "verifications").select("id", X.join_issues(items).alias("issues"))


@R.add("u_concat", with_tables(f"SELECT id, array_to_string(list_concat({_SPLIT}, CASE WHEN verified_at IS NULL THEN [] ELSE [status] END), '; ') AS issues FROM ver", "verifications"))
def u_concat(spark, sf):
    extra = F.when(F.col("verified_at").isNotNull(), F.array("status"))
    return derived(spark, sf, "verifications").select("id", X.join_issues(X.join_lists(X.split_issues(F.col("issues")), extra)).alias("issues"))


@R.add("s_priority_sort", (
    "SELECT doc_id, concat_ws('|', " + ", ".join(f"CASE WHEN contains(upper(text), {sq(w)}) THEN {sq(w)} END" for w in ("THE", "DER", "QUE", "ENT", "AND", "LES"))
    + ") AS found FROM documents"))
def s_priority_sort(spark, sf):
    found = X.phrase_hits(F.upper("text"), ["AND", "THE", "ENT", "LES", "QUE", "DER"])
    ordered = X.priority_first(found, ["THE", "DER", "QUE", "ENT"])
    return parquet_table(spark, sf, "documents").select("doc_id", F.array_join(ordered, "|").alias("found"))


# --- dictionaries ---------------------------------------------------------------------------------------------------


@R.add("j_keyword_hits", with_tables(
    "SELECT id, " + ", ".join(f"{count_of('u', words)} AS {name}" for name, words in (
        ("id_words", fv.ID_WORDS), ("certificate_words", fv.CERTIFICATE_WORDS), ("transcript_words", fv.TRANSCRIPT_WORDS), ("feature_words", fv.FEATURE_WORDS)))
    + f" FROM (SELECT id, {up('text')} AS u FROM subm)", "submissions"))
def j_keyword_hits(spark, sf):
    rows = _subm(spark, sf).select("id", F.upper("text").alias("u"))
    n = lambda words: F.size(X.phrase_hits(F.col("u"), words))
    return rows.select("id", n(fv.ID_WORDS).alias("id_words"), n(fv.CERTIFICATE_WORDS).alias("certificate_words"),
                       n(fv.TRANSCRIPT_WORDS).alias("transcript_words"), n(fv.FEATURE_WORDS).alias("feature_words"))


SITE_DOMAINS = [("spam-farm.example.org", "Farm"), ("example.com", "Example Institute"), ("example.org", "Example Board"), ("example", "Any Example")]


@R.add("j_domain_dim", f"SELECT page_id, {first_of('lower(url)', SITE_DOMAINS)} AS institution, {first_of('lower(url)', [(d, d) for d, _ in SITE_DOMAINS])} AS domain FROM pages")
def j_domain_dim(spark, sf):
    url = F.col("url")
    return parquet_table(spark, sf, "pages").select(
        "page_id", L.institution_of(url, SITE_DOMAINS).alias("institution"), L.matched_domain(url, SITE_DOMAINS).alias("domain"))


@R.add("j_class_dim", with_tables(
    "SELECT document_id, line_no, part, supp, class_1, coalesce(d.type, 'unknown') AS type, coalesce(d.description, class_1) AS description, "
    "coalesce(d.min_conf, 25.0::DOUBLE) AS detect_min, coalesce(d.min_conf, 60.0::DOUBLE) AS accept_min FROM capt LEFT JOIN (VALUES "
    + ", ".join(f"({sq(a)}, {sq(b)}, {sq(c)}, {d}::DOUBLE)" for a, b, c, d in fv.DOC_CLASSES) + ") d(class, type, description, min_conf) ON d.class = class_1", "captures"))
def j_class_dim(spark, sf):
    dim = F.broadcast(capture.doc_classes(spark))  # 13 fixed rows
    rows = derived(spark, sf, "captures").join(dim, F.col("class_1") == F.col("class"), "left")
    return rows.select("document_id", "line_no", "part", "supp", "class_1", F.coalesce("type", F.lit("unknown")).alias("type"),
                       F.coalesce("description", "class_1").alias("description"), F.coalesce("min_conf", F.lit(25.0)).alias("detect_min"),
                       F.coalesce("min_conf", F.lit(60.0)).alias("accept_min"))


_TYPE_SQL = "CASE " + " ".join(f"WHEN class_1 = {sq(c[0])} THEN {sq(c[1])}" for c in fv.DOC_CLASSES) + " ELSE 'unknown' END"


@R.add("j_type_compat", with_tables(
    f"SELECT document_id, line_no, part, supp, CASE doc_type WHEN 'national_id' THEN t = 'id' WHEN 'driving_license' THEN t = 'license' "
    f"WHEN 'certificate' THEN t IN ('certificate', 'degree') WHEN 'transcript' THEN t = 'transcript' ELSE false END AS fits FROM (SELECT *, {_TYPE_SQL} AS t FROM capt)", "captures"))
def j_type_compat(spark, sf):
    kind = capture.class_value(F.col("class_1"), 1, F.lit("unknown"))
    return derived(spark, sf, "captures").select("document_id", "line_no", "part", "supp", capture.types_match(F.col("doc_type"), kind).alias("fits"))


@R.add("s_top_detection", with_tables(
    "SELECT document_id, line_no, part, supp, CASE WHEN n_detections > 0 THEN class_1 ELSE '' END AS class, CASE n_detections WHEN 0 THEN 0 WHEN 1 THEN round(conf_1 * 100, 1) "
    "ELSE greatest(round(conf_1 * 100, 1), round(conf_2 * 100, 1)) END AS confidence FROM capt", "captures"))
def s_top_detection(spark, sf):
    from credence.plans.tables import with_detections

    rows = capture.with_detect_check(with_detections(derived(spark, sf, "captures")))
    return rows.select("document_id", "line_no", "part", "supp", F.col("detect.class").alias("class"), F.col("detect.confidence").alias("confidence"))


@R.add("x_map_first", with_tables(
    "SELECT document_id, line_no, part, supp, CASE WHEN no_exif THEN NULL WHEN software <> '' THEN software WHEN part % 16 = 2 THEN 'canon host' END AS software FROM capt", "captures"))
def x_map_first(spark, sf):
    rows = with_exif(derived(spark, sf, "captures"))
    return rows.select("document_id", "line_no", "part", "supp", capture.map_first(F.col("exif"), fv.SOFTWARE_TAGS).alias("software"))


@R.add("p_key_exif", with_tables(
    "SELECT document_id, line_no, part, supp, CASE WHEN no_exif THEN '' ELSE concat_ws('|', CASE WHEN stamp <> '' THEN concat('DateTimeOriginal=', stamp) END, "
    "CASE WHEN supp % 4 = 0 THEN 'Make=Acme' END, CASE WHEN software <> '' THEN concat('Software=', software) END) END AS kept FROM capt", "captures"))
def p_key_exif(spark, sf):
    rows = with_exif(derived(spark, sf, "captures")).withColumn("k", capture.key_exif(F.col("exif")))
    pairs = F.transform(F.array_sort(F.map_keys("k")), lambda t: F.concat(t, F.lit("="), F.element_at("k", t)))
    return rows.select("document_id", "line_no", "part", "supp", F.array_join(pairs, "|").alias("kept"))


# --- records -----------------------------------------------------------------------------------------------------------


@R.add("src_json", (
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k, "
    "CASE WHEN event_id % 5 = 0 THEN 'No JSON in output' END AS error FROM events"))
def src_json(spark, sf):
    events = parquet_table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("warning: no record")).otherwise(F.concat(F.lit("warning: slow\n"), F.col("props")))
    rows = parse_records(events.select("event_id", raw.alias("raw")), "raw", "k int")
    return rows.select("event_id", F.col("record.k").alias("k"), "error")


@R.add("src_text_batch", "SELECT conv_id, turn AS pos, text FROM conversations WHERE text IS NOT NULL")
def src_text_batch(spark, sf):
    """Conversations packed as JSON arrays of four turns and unpacked again with their positions."""
    packed = pack_texts(parquet_table(spark, sf, "conversations"), "conv_id", "turn", "text", 4)
    rows = text_batches(packed, "batch").where("text is not null")
    return rows.select("conv_id", (F.col("chunk") * 4 + F.col("pos")).alias("pos"), "text")


@R.add("src_text_arrays", "SELECT conv_id, turn // 4 AS chunk, max(turn % 4) + 1 AS places, count(text) AS n_texts FROM conversations GROUP BY ALL")
def src_text_arrays(spark, sf):
    """How many places and texts the packed arrays have."""
    packed = pack_texts(parquet_table(spark, sf, "conversations"), "conv_id", "turn", "text", 4)
    texts = F.from_json("batch", "array<string>")
    return packed.select("conv_id", "chunk", F.size(texts).cast("long").alias("places"), F.size(F.array_compact(texts)).cast("long").alias("n_texts"))


@R.add("x_json_path", "SELECT event_id, CAST(coalesce(json_extract_string(props, '$.k'), '0') AS INTEGER) AS k, coalesce(json_extract_string(props, '$.a.b'), '-') AS missing FROM events")
def x_json_path(spark, sf):
    props = F.col("props")
    return parquet_table(spark, sf, "events").select(
        "event_id", F.coalesce(F.get_json_object(props, "$.k"), F.lit("0")).cast("int").alias("k"), F.coalesce(F.get_json_object(props, "$.a.b"), F.lit("-")).alias("missing"))


@R.add("x_to_json", with_tables("SELECT id, concat('{\"id\":', id, ',\"status\":\"', status, '\",\"score\":', authenticity_score, '}') AS result FROM ver", "verifications"))
def x_to_json(spark, sf):
    from credence.sources.sinks import as_json

    rows = derived(spark, sf, "verifications").select("id", "status", F.col("authenticity_score").alias("score"))
    return as_json(rows, "id", "status", "score").select("id", "result")


# --- links and pages ------------------------------------------------------------------------------------------------------


def url_sql(c: str) -> str:
    full = null_if_empty(f"regexp_extract({c}, 'https?://[^\\s\"''<>]+')")
    bare = null_if_empty(f"regexp_extract({c}, '(?:www\\.)?[\\w\\-]+\\.(?:ac\\.rw|gov\\.rw|rw|ke)[^\\s]*')")
    return f"CASE WHEN {full} IS NOT NULL THEN {full} WHEN {bare} IS NOT NULL THEN concat('https://', {bare}) END"


@R.add("x_url_extract", with_tables(f"SELECT id, {url_sql('payload')} AS url FROM links_src", "links"))
def x_url_extract(spark, sf):
    return derived(spark, sf, "links").select("id", L.first_url(F.col("payload")).alias("url"))


@R.add("x_url_text_fallback", with_tables(
    f"SELECT id, CASE WHEN regexp_matches(c, '(?i)graduate\\.?nesa\\.?gov\\.?rw') THEN 'https://graduate.nesa.gov.rw' ELSE {url_sql('c')} END AS url FROM "
    "(SELECT id, regexp_replace(concat(CASE WHEN id % 6 = 2 THEN 'Graduate . nesa gov.rw ' ELSE '' END, text), '\\s+', '', 'g') AS c FROM subm)", "submissions"))
def x_url_text_fallback(spark, sf):
    text = F.concat(F.when(F.col("id") % 6 == 2, "Graduate . nesa gov.rw ").otherwise(""), F.col("text"))
    return _subm(spark, sf).select("id", L.url_in_text(text).alias("url"))


def pairs_sql(u: str) -> str:
    """List of {k, v} of the query part, decoded; pairs without a value are left out."""
    query = f"CASE WHEN contains({u}, '?') THEN regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1) ELSE '' END"
    pair = "{'k': url_decode(replace(split_part(p, '=', 1), '+', ' ')), 'v': url_decode(replace(substr(p, position('=' IN p) + 1), '+', ' '))}"
    return f"list_transform(list_filter(string_split({query}, '&'), lambda p: regexp_matches(p, '=.')), lambda p: {pair})"


def _path_sql(u: str) -> str:
    return f"list_filter(string_split(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda p: p <> '')"


def _keyed_sql(u: str, keys) -> str:
    """Values of the listed keys in any case, key by key."""
    return f"flatten(list_transform([{', '.join(map(sq, keys))}], lambda key: list_transform(list_filter({pairs_sql(u)}, lambda x: lower(x.k) = key), lambda x: x.v)))"


def name_in_url_sql(u: str) -> str:
    """Name of a link: the first of name keys, first and last name, and path parts from the end that reads like one."""
    both = f"concat({_keyed_sql(u, ['first_name', 'firstname'])}[1], ' ', {_keyed_sql(u, ['last_name', 'lastname'])}[1])"
    two = f"CASE WHEN len({_keyed_sql(u, ['first_name', 'firstname'])}) > 0 AND len({_keyed_sql(u, ['last_name', 'lastname'])}) > 0 THEN [{both}] ELSE []::VARCHAR[] END"
    tried = f"list_concat(list_concat({_keyed_sql(u, fv.NAME_KEYS)}, {two}), list_reverse({_path_sql(u)}))"
    return f"list_filter(list_transform({tried}, lambda p: {clean_person('p')}), lambda n: n IS NOT NULL)[1]"


def url_serial_sql(u: str) -> str:
    """Serial of a link: the first of serial keys and path parts that gives one."""
    tried = f"list_concat({_keyed_sql(u, fv.SERIAL_KEYS)}, {_path_sql(u)})"
    return f"list_filter(list_transform({tried}, lambda p: {serial_sql('p')}), lambda n: n IS NOT NULL)[1]"


@R.add("x_url_param", with_tables(
    f"SELECT id, url, nullif(regexp_extract(url, 'certificate_no=(\\w+)', 1), '') AS certificate_no, {url_serial_sql('url')} AS serial, "
    f"{name_in_url_sql('url')} AS name FROM (SELECT id, {url_sql('payload')} AS url FROM links_src) WHERE url IS NOT NULL", "links"))
def x_url_param(spark, sf):
    rows = derived(spark, sf, "links").select("id", L.first_url(F.col("payload")).alias("url")).where("url is not null")
    url = F.col("url")
    return rows.select("id", "url", L.certificate_no(url).alias("certificate_no"), L.link_facts(url).alias("_facts")).select(
        "id", "url", "certificate_no", "_facts.serial", "_facts.name")


def _host_sql(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@R.add("x_trusted", with_tables(
    f"SELECT id, {any_of('lower(url)', fv.TRUSTED_DOMAINS)} AS trusted, (" + " OR ".join(
        f"h = {sq(d)} OR ends_with(h, {sq('.' + d)})" for d in fv.TRUSTED_DOMAINS)
    + f") AS trusted_host FROM (SELECT id, url, {_host_sql('url')} AS h FROM (SELECT id, {url_sql('payload')} AS url FROM links_src)) WHERE url IS NOT NULL", "links"))
def x_trusted(spark, sf):
    rows = derived(spark, sf, "links").select("id", L.first_url(F.col("payload")).alias("url")).where("url is not null")
    return rows.select("id", L.is_trusted(F.col("url")).alias("trusted"), L.is_trusted_host(F.col("url")).alias("trusted_host"))


@R.add("x_html_text", f"SELECT page_id, md5({html_text('html')}) AS digest, CAST(length({html_text('html', '')}) AS INTEGER) AS joined_length FROM pages")
def x_html_text(spark, sf):
    html = F.col("html")
    return parquet_table(spark, sf, "pages").select("page_id", F.md5(L.html_text(html)).alias("digest"), F.length(L.html_text(html, "")).alias("joined_length"))


_EXAM_OK = f"contains(u, 'VALID') AND contains(u, 'GRADUATE NAME') AND NOT {any_of('u', fv.EXAM_PAGE_ERRORS)}"


@R.add("x_page_verdict", with_tables(
    f"SELECT page_id, CASE WHEN {any_of('u', fv.PAGE_WORDS)} THEN true WHEN {any_of('u', fv.PAGE_ERRORS)} THEN false END AS general, "
    f"{any_of('u', fv.POLYTECHNIC_PAGE_WORDS)} AND NOT {any_of('u', fv.POLYTECHNIC_PAGE_ERRORS)} AS polytechnic, {_EXAM_OK} AS exam "
    f"FROM (SELECT page_id, {up(html_text('html'))} AS u FROM portal_src)", "portal_pages"))
def x_page_verdict(spark, sf):
    rows = derived(spark, sf, "portal_pages").select("page_id", F.upper(L.html_text(F.col("html"))).alias("u"))
    u = F.col("u")
    return rows.select("page_id", L.page_verdict(u).alias("general"), L.polytechnic_verdict(u).alias("polytechnic"), L.exam_verdict(u).alias("exam"))


def _page_lines_sql() -> str:
    return (f"list_filter(list_transform(string_split({up(html_text('html'))}, chr(10)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '')")


# page lines hold stray percent signs, which are not escapes: both sides keep such a line as it is
def _line_person(c: str) -> str:
    return clean_person(c).replace(f"url_decode({c})", c)


_LABEL_NAME = (
    f"list_filter(list_transform(range(1, len(l)), lambda i: CASE WHEN regexp_replace(l[i], ':+$', '') IN {in_list(fv.PAGE_NAME_LABELS)} "
    f"THEN {_line_person('l[i + 1]')} END), lambda n: n IS NOT NULL)[1]"
)
_REGISTRATION_NAME = (
    f"list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(l[i], {sq(fv.REGISTRATION_LINE)}) THEN "
    f"list_filter(list_transform(list_reverse(l[greatest(i - 5, 1):i - 1]), lambda p: {_line_person('p')}), lambda n: n IS NOT NULL)[1] END), lambda n: n IS NOT NULL)[1]"
)


@R.add("w_next_line", with_tables(f"SELECT page_id, {_LABEL_NAME} AS name FROM (SELECT page_id, {_page_lines_sql()} AS l FROM portal_src)", "portal_pages"))
def w_next_line(spark, sf):
    rows = derived(spark, sf, "portal_pages").select("page_id", L.page_lines(F.upper(L.html_text(F.col("html")))).alias("l"))
    return rows.select("page_id", L.name_after_label(F.col("l")).alias("name"))


@R.add("w_prev_line", with_tables(f"SELECT page_id, {_REGISTRATION_NAME} AS name FROM (SELECT page_id, {_page_lines_sql()} AS l FROM portal_src)", "portal_pages"))
def w_prev_line(spark, sf):
    rows = derived(spark, sf, "portal_pages").select("page_id", L.page_lines(F.upper(L.html_text(F.col("html")))).alias("l"))
    return rows.select("page_id", L.name_before_registration(F.col("l")).alias("name"))


def page_holder_sql(u: str = "u", lines: str = "l") -> str:
    """Holder on a page: after a label, in a phrase, before a registration line.  Columns u and l."""
    phrases = ", ".join(f"CASE WHEN {any_of(u, needed)} THEN nullif(regexp_extract({u}, {sq('(?m)' + p)}, 1), '') END" for needed, p in fv.PAGE_NAME_PATTERNS)
    by_phrase = f"list_filter(list_transform([{phrases}], lambda p: {_line_person('p')}), lambda n: n IS NOT NULL)[1]"
    return f"coalesce(CASE WHEN {any_of(u, ['NAME', 'GRADUATE'])} THEN {_LABEL_NAME} END, {by_phrase}, CASE WHEN contains({u}, 'REG') THEN {_REGISTRATION_NAME} END)"


def exam_holder_sql(u: str = "u") -> str:
    phrase = f"list_transform([nullif(regexp_extract({u}, {sq('(?m)' + fv.EXAM_PAGE_NAME)}, 1), '')], lambda p: {_line_person('p')})[1]"
    at = "list_filter(range(1, len(l)), lambda i: regexp_matches(l[i], 'GRADUATE\\s+NAME'))[1]"
    by_line = f"list_filter(list_transform([nullif(trim(regexp_extract(l[{at}], '[:\\-](.*)$', 1)), ''), l[{at} + 1]], lambda p: {_line_person('p')}), lambda n: n IS NOT NULL)[1]"
    return f"CASE WHEN contains({u}, 'GRADUATE') THEN coalesce({phrase}, {by_line}) END"


def page_match_sql(holder: str, own: str) -> str:
    parts = f"list_filter(regexp_split_to_array(trim(upper({own})), '\\s+'), lambda p: length(p) > 2)"
    return (f"CASE WHEN coalesce({holder}, '') <> '' AND coalesce({own}, '') <> '' THEN CASE WHEN len({parts}) > 0 THEN "
            f"len(list_filter({parts}, lambda p: contains({holder}, p)))::DOUBLE / len({parts}) >= 0.6::DOUBLE ELSE false END END")


@R.add("x_name_from_page", with_tables(
    f"SELECT page_id, holder, exam_holder, {page_match_sql('holder', 'own')} AS match FROM (SELECT page_id, {page_holder_sql()} AS holder, {exam_holder_sql()} AS exam_holder, {person('page_id', 'duck')} AS own "
    f"FROM (SELECT page_id, {up(html_text('html'))} AS u, {_page_lines_sql()} AS l FROM portal_src))", "portal_pages"))
def x_name_from_page(spark, sf):
    """Holder on every page by all routes, and its match with the page's own person."""
    rows = derived(spark, sf, "portal_pages").select("page_id", F.upper(L.html_text(F.col("html"))).alias("u"))
    rows = rows.select("page_id", L.name_on_page(F.col("u")).alias("holder"), L.name_on_exam_page(F.col("u")).alias("exam_holder"), F.expr(person("page_id", "spark")).alias("own"))
    return rows.select("page_id", "holder", "exam_holder", N.page_name_match(F.col("holder"), F.col("own")).alias("match"))


# --- whole documents ---------------------------------------------------------------------------------------------------


@R.add("a_cross_consist", (
    f"WITH d AS (SELECT conv_id, turn, concat(text, CASE WHEN turn % 2 = 0 THEN ' 01/02/1990' WHEN conv_id % 3 = 0 THEN ' 03.02.1990' WHEN conv_id % 3 = 1 THEN ' 01/02/1990' ELSE '' END) AS text FROM conversations), "
    "n AS (SELECT conv_id, count(*) AS n_docs FROM d GROUP BY conv_id), "
    f"t AS (SELECT conv_id, unnest(list_distinct(list_filter(regexp_split_to_array({up('text')}, '\\s+'), lambda w: regexp_full_match(w, '\\p{{L}}{{3,}}')))) AS token FROM d), "
    f"ds AS (SELECT conv_id, list_distinct({_DATES_SQL}) AS l FROM d), "
    "dn AS (SELECT conv_id, count(*) FILTER (len(l) > 0) AS n_dated FROM ds GROUP BY conv_id), "
    "tc AS (SELECT conv_id, count(*) AS common_names FROM (SELECT conv_id, token, count(*) AS c FROM t GROUP BY ALL) JOIN n USING (conv_id) WHERE c = n_docs GROUP BY conv_id), "
    "dc AS (SELECT conv_id, count(*) AS common_dates FROM (SELECT conv_id, token, count(*) AS c FROM (SELECT conv_id, unnest(l) AS token FROM ds) GROUP BY ALL) JOIN dn USING (conv_id) WHERE c = n_dated GROUP BY conv_id) "
    "SELECT conv_id, n_docs, n_dated, coalesce(common_names, 0) AS common_names, coalesce(common_dates, 0) AS common_dates, "
    "100 - CASE WHEN n_docs >= 2 AND coalesce(common_names, 0) = 0 THEN 30 ELSE 0 END - CASE WHEN n_docs >= 2 AND n_dated >= 2 AND coalesce(common_dates, 0) = 0 THEN 25 ELSE 0 END AS score "
    "FROM n JOIN dn USING (conv_id) LEFT JOIN tc USING (conv_id) LEFT JOIN dc USING (conv_id)"))
def a_cross_consist(spark, sf):
    conv = parquet_table(spark, sf, "conversations").select("conv_id", "turn", "text")
    dated = F.when(F.col("turn") % 2 == 0, " 01/02/1990").when(F.col("conv_id") % 3 == 0, " 03.02.1990").when(F.col("conv_id") % 3 == 1, " 01/02/1990").otherwise("")
    docs = conv.select("conv_id", F.concat("text", dated).alias("text"))
    return consistency.cross_consistency(docs, "conv_id", "text").select("conv_id", "n_docs", "n_dated", "common_names", "common_dates", "score")


@R.add("a_clone_blocks", (
    "WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents), g AS (SELECT doc_id, line, count(*) AS c FROM l WHERE line <> '' GROUP BY ALL) "
    "SELECT doc_id, CAST(sum(c) AS INTEGER) AS lines, CAST(sum(c - 1) AS INTEGER) AS repeats, CAST(count(*) FILTER (c > 2) AS INTEGER) AS groups_over_two FROM g GROUP BY doc_id"))
def a_clone_blocks(spark, sf):
    rows = parquet_table(spark, sf, "documents").select("doc_id", "text").select("doc_id", consistency.repeated_lines(F.col("text")).alias("r"))
    return rows.where("r.lines > 0").select("doc_id", "r.lines", "r.repeats", "r.groups_over_two")


@R.add("i_text_feats", with_tables(
    f"SELECT id, least(100, len(regexp_extract_all(text, '\\S+')))::DOUBLE AS word_count, {count_of('u', fv.FEATURE_WORDS)}::DOUBLE AS rwanda_keywords, "
    f"CAST({any_of('u', fv.FEATURE_ROLES)} AS INTEGER)::DOUBLE AS authority_found, CAST(regexp_matches(text, {sq(fv.ANY_DATE)}) AS INTEGER)::DOUBLE AS date_found, "
    f"CAST(regexp_matches({ascii_words('text')}, '\\b\\d{{16}}\\b|\\b\\d{{10}}\\b') AS INTEGER)::DOUBLE AS id_number_found FROM (SELECT id, text, {up('text')} AS u FROM subm)", "submissions"))
def i_text_feats(spark, sf):
    return _subm(spark, sf).select("id", *[c.alias(n) for n, c in text_features(F.col("text")).items()])


