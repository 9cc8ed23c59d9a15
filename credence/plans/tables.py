"""The application tables derived from the given tables, for Spark and, alike, as SQL for the oracle.

customer plays candidates, nation users, documents the uploaded files and their text, orders the
verifications, lineitem the capture facts (metadata, detector output), pages the portal pages.
Every derived table has one row per source row, so work grows with the given tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.sources.tables import parquet_table

# --- Fixed values: invented words of the derived rows ------------------------------------------------

GIVEN = ["ALPHA", "BRAVO", "ALEXANDERSON", "DELTA", "ECHO", "FOXTROT", "GOLF", "HOTEL"]
FAMILY = ["KILO", "LIMA", "MIKE", "OSCAR", "QUEBEC", "ROMEO"]
DOC_TYPES = ["national_id", "driving_license", "certificate", "transcript", "other"]
EXTENSIONS = ["jpg", "JPG", "png", "pdf", "exe", "jpeg"]
SOFTWARE = ["GIMP 2.10", "EPSON Scan", "", "FooTool", "Adobe Photoshop CS6", "Adobe Acrobat 9", "Samsung Camera", "HP Scanjet"]
STAMPS = ["2031:01:01 00:00:00", "1980:05:05 10:00:00", "garbage", "2020:01:02 03:04:05", ""]
CLASSES = [c[0] for c in fv.DOC_CLASSES] + ["Unlisted Form", "Other Form"]
HEADERS = [
    "",
    "REPUBLIC OF RWANDA NATIONAL ID INDANGAMUNTU\nAMAZINA: {name}\nNID 1199880012{n} SEX M DISTRICT DATE OF BIRTH 01/02/1990",
    "National ID 2201570012{n}\nvalid",
    "NESA/2019/{n} SENIOR SIX Certificate",
    "REB-2031-{n} this is to certify that {name} has passed",
    "University of Rwanda\nUR/2018/SCI/{n}\nCollege of Science\n{name}\nis awarded the degree of Bachelor with Second Class honours, Registrar, two thousand",
    "KIGALI INDEPENDENT UNIVERSITY ULK/2031/{n} DEGREE Vice Chancellor 2019",
    "Mount Kenya University MKU {n} transcript grade 75.5 semester marks course",
    "UTAB-{n} University of Technology and Arts of Byumba",
    "ACADEMIC RECORD\nSTUDENT {name}\nCREDIT 20 GRADE 88% MODULE SCORE",
    "Rwanda Polytechnic https://graduate.rp.ac.rw/?certificate_no={n}\nADVANCED DIPLOMA congregation",
    "IPRC Kigali\nName of Holder: {name}\nDirector",
    "confers upon you\n{name}\nthe degree",
    "ref: AB{n}X degree certificate hereby",
    "certificate NO{n} UR 2020-01-05",
    "lycee secondary school S6/2020/{n} faculty award",
]
LINKS = [
    None,
    "https://graduate.rp.ac.rw/?certificate_no=RP{n}",
    "scan https://graduate.nesa.gov.rw/?{serial_key}=A1{n}O now",
    "https://www.ulk.ac.rw/verify/{path}",
    "https://evil.example/?u=ur.ac.rw&name={path}",
    "www.rra.gov.rw/check",
    "MKU BACHELOR BIT/2018/{n} {name} BACHELOR OF SCIENCE",
    "no address here",
    "https://utab.ac.rw/certificates?{name_key}={path}&page=2",
    "CONGREGATION BIT/2031/{n} x",
]
#: Keys of the query part; the last ones carry a name in two parts, and a second name under another key.
LINK_NAME_KEYS = [*fv.NAME_KEYS, "HOLDER", "Full_Name", "first_name=DELTA&last_name", "firstname=ECHO&x=1&lastname", "owner=DELTA+ECHO%20GOLF&name", "page"]
LINK_SERIAL_KEYS = [*fv.SERIAL_KEYS, "SERIAL", "ID", "ref=none&cert", "x"]
PAGE_TAILS = [
    "<p>plain page</p>",
    "<div>Certificate verified</div><p>Student Name</p><p>{name}</p>",
    "<div>Record NOT FOUND</div>",
    "<div>GRADUATE NAME: {name} INDEX NUMBER 12</div><p>VALID</p>",
    "<div>Diploma</div><p>DELTA ECHO</p><p>Registration Number: 77</p>",
]


def _sq(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def spark_list(items) -> str:
    def quoted(s):
        return "NULL" if s is None else "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"

    return "array(" + ", ".join(quoted(i) for i in items) + ")"


def duck_list(items) -> str:
    def quoted(s):
        if s is None:
            return "NULL"
        return " || chr(10) || ".join(_sq(part) for part in s.split("\n")) if "\n" in s else _sq(s)

    return "[" + ", ".join(quoted(i) for i in items) + "]"


def pick(items, key: str, dialect: str) -> str:
    """Expression choosing an item by key modulo the list length."""
    if dialect == "spark":
        return f"element_at({spark_list(items)}, cast(pmod({key}, {len(items)}) as int) + 1)"
    return f"list_extract({duck_list(items)}, CAST(({key}) % {len(items)} AS INTEGER) + 1)"


def person(key: str, dialect: str) -> str:
    """An invented three-word name, unique per key."""
    if dialect == "duck":
        letters = f"translate(lpad(CAST({key} AS VARCHAR), CAST(greatest(7, length(CAST({key} AS VARCHAR))) AS INTEGER), '0'), '0123456789', 'BCDFGHKLMN')"
    else:
        letters = f"translate(lpad(cast({key} as string), greatest(7, length(cast({key} as string))), '0'), '0123456789', 'BCDFGHKLMN')"
    return f"concat({pick(GIVEN, key, dialect)}, ' ', {pick(FAMILY, key, dialect)}, ' ', {letters})"


def _number(key: str, dialect: str) -> str:
    kind = "string" if dialect == "spark" else "VARCHAR"
    return f"lpad(cast({key} % 1000000 as {kind}), 6, '0')"


# Expression lists: (name, spark expression, duck expression or None when the same text works in both).


def _both(expr: str) -> tuple[str, str]:
    return expr, expr


def _candidate_exprs() -> dict[str, tuple[str, str]]:
    half = {d: f"c_custkey {'div' if d == 'spark' else '//'} 3" for d in ("spark", "duck")}
    base = {d: person(f"({half[d]})", d) for d in half}
    name = {d: f"case when c_custkey % 3 = 1 then concat(' ', lower({base[d]}), ' ') else {base[d]} end" for d in base}
    return {
        "id": _both("c_custkey"),
        "full_name": (name["spark"], name["duck"]),
        "email": (
            "case when c_custkey % 3 = 1 then '' when c_custkey % 15 = 5 then concat('p', cast(c_custkey as string), '@example.org') end",
            "case when c_custkey % 3 = 1 then '' when c_custkey % 15 = 5 then concat('p', CAST(c_custkey AS VARCHAR), '@example.org') end",
        ),
        "position_applied": _both("case when c_custkey % 4 <> 0 then c_mktsegment end"),
        "created_by": _both("case when c_custkey % 97 = 1 then c_nationkey + 100 when c_custkey % 31 <> 0 then c_nationkey end"),
        "created_at": (
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast((c_custkey % 10000000) * 7 as int), 0)",
            "TIMESTAMP '2024-01-01 00:00:00' + to_minutes((c_custkey % 10000000) * 7)",
        ),
    }


def _document_exprs() -> dict[str, tuple[str, str]]:
    kinds = {d: pick(DOC_TYPES, "doc_id", d) for d in ("spark", "duck")}
    ext = {d: pick(EXTENSIONS, "doc_id", d) for d in ("spark", "duck")}
    return {
        "id": _both("doc_id"),
        "candidate_id": (
            "case when doc_id % 41 = 7 then doc_id + 1000000000000 when doc_id % 17 <> 0 then doc_id div 3 end",
            "case when doc_id % 41 = 7 then doc_id + 1000000000000 when doc_id % 17 <> 0 then doc_id // 3 end",
        ),
        "doc_type": (kinds["spark"], kinds["duck"]),
        "file_path": (
            f"concat('uploads/', source, '/doc_', cast(doc_id as string), '.', {ext['spark']})",
            f"concat('uploads/', source, '/doc_', CAST(doc_id AS VARCHAR), '.', {ext['duck']})",
        ),
        "size_bytes": _both("n_chars * 1500"),
        "uploaded_at": (
            "timestamp_ntz'2024-02-01 00:00:00' + make_dt_interval(0, 0, cast((doc_id % 10000000) * 11 as int), 0)",
            "TIMESTAMP '2024-02-01 00:00:00' + to_minutes((doc_id % 10000000) * 11)",
        ),
    }


def _verification_exprs() -> dict[str, tuple[str, str]]:
    issues = ["", "Low confidence; IDENTITY MISMATCH: another holder", " first ;; second; ", "possible borrowed certificate",
              "identity confirmed on page 1"]
    text = {d: pick(issues, "o_orderkey", d) for d in ("spark", "duck")}
    status = "case when o_orderkey % 19 = 0 then 'Pending' when o_orderstatus = 'F' then 'Fake' when o_orderstatus = 'O' then 'Suspicious' else 'Verified' end"
    return {
        "id": _both("o_orderkey"),
        "candidate_id": _both("case when o_orderkey % 13 <> 0 then o_custkey end"),
        "document_id": _both("o_orderkey"),
        "authenticity_score": _both("cast(cast(floor(o_totalprice) as bigint) % 101 as int)"),
        "status": _both(status),
        "issues": (text["spark"], text["duck"]),
        "recommendation": _both("case when o_orderkey % 7 = 0 then 'Certificate holder from QR code' else o_orderpriority end"),
        "verified_at": _both("case when o_orderkey % 23 <> 0 then o_orderdate end"),
    }


def _submission_exprs() -> dict[str, tuple[str, str]]:
    """Whole texts with a heading that carries numbers, names and key words."""
    out = {}
    sides = {}
    for d in ("spark", "duck"):
        own = person("doc_id", d)
        written = (
            f"case when doc_id % 3 = 0 then {own} when doc_id % 3 = 1 then replace({own}, 'XANDER', 'XENDER') else 'DELTA ECHO ZULU' end"
        )
        head = f"replace(replace({pick(HEADERS, 'doc_id', d)}, '{{n}}', {_number('doc_id', d)}), '{{name}}', {written})"
        newline = "'\\n'" if d == "spark" else "chr(10)"
        sides[d] = {
            "text": f"concat({head}, {newline}, text)",
            "candidate_name": f"case when doc_id % 31 = 5 then null when doc_id % 29 = 3 then 'RENE' else {own} end",
            "doc_type": pick(DOC_TYPES, "doc_id", d),
        }
    out["id"] = _both("doc_id")
    for name in ("doc_type", "candidate_name", "text"):
        out[name] = (sides["spark"][name], sides["duck"][name])
    return out


def _capture_exprs() -> dict[str, tuple[str, str]]:
    """Scalar capture facts; maps and arrays are built from them on the Spark side."""
    out: dict[str, tuple[str, str]] = {
        "document_id": _both("l_orderkey"), "line_no": _both("l_linenumber"), "part": _both("l_partkey"), "supp": _both("l_suppkey"),
    }
    picks = {
        "software": (SOFTWARE, "l_partkey"), "stamp": (STAMPS, "l_suppkey"), "class_1": (CLASSES, "l_suppkey"),
        "class_2": (CLASSES, "l_partkey"), "doc_type": (DOC_TYPES, "l_linenumber"),
    }
    for name, (items, key) in picks.items():
        out[name] = (pick(items, key, "spark"), pick(items, key, "duck"))
    out.update({
        "no_exif": _both("l_partkey % 11 = 0"),
        "gps": _both("l_suppkey % 7 = 0"),
        "odd_colour": _both("l_suppkey % 6 = 0"),
        "file_size_kb": _both("round(l_quantity * 8.25, 1)"),
        "created": _both("l_shipdate"),
        "modified": (
            "l_shipdate + make_dt_interval(l_linenumber * 10 - 15, 5, 0, 0)",
            "l_shipdate + to_days(l_linenumber * 10 - 15) + to_hours(5)",
        ),
        "conf_1": _both("cast(l_partkey % 1000 as double) / 1000.0"),
        "conf_2": _both("cast(l_suppkey % 100 as double) / 100.0"),
        "n_detections": _both("case when l_partkey % 9 = 0 then 0 when l_linenumber % 2 = 0 then 1 else 2 end"),
    })
    # a division by a decimal literal differs between the engines
    for name in ("conf_1", "conf_2"):
        spark_side, duck = out[name]
        out[name] = (spark_side.replace("1000.0", "1000d").replace("/ 100.0", "/ 100d"),
                     duck.replace("1000.0", "1000::DOUBLE").replace("/ 100.0", "/ 100::DOUBLE"))
    out["file_size_kb"] = ("round(l_quantity * 8.25d, 1)", "round(l_quantity * 8.25::DOUBLE, 1)")
    return out


def _portal_exprs() -> dict[str, tuple[str, str]]:
    out = {
        "page_id": _both("page_id"), "http_status": _both("case when page_id % 11 = 3 then 404 else 200 end"),
        # of two fetches of one address either may be the later one
        "fetched_at": ("timestamp_ntz'2024-03-01 00:00:00' + make_dt_interval(0, 0, cast((page_id * 37) % 1000 as int), 0)", "TIMESTAMP '2024-03-01 00:00:00' + to_minutes(CAST((page_id * 37) % 1000 AS INTEGER))"),
    }
    sides = {}
    for d in ("spark", "duck"):
        kind = "string" if d == "spark" else "VARCHAR"
        size = "greatest(6, length(cast(page_id as string)))" if d == "spark" else "CAST(greatest(6, length(CAST(page_id AS VARCHAR))) AS INTEGER)"
        number = f"lpad(cast(page_id as {kind}), {size}, '0')"
        fetched_twice = f"lpad(cast(page_id - case when page_id % 10 = 6 then 5 else 0 end as {kind}), {size}, '0')"
        url = (
            f"case when page_id % 5 = 3 then concat('https://graduate.nesa.gov.rw/?serial=A1', {number}, '0') "
            f"when page_id % 5 = 1 then concat('https://graduate.rp.ac.rw/?certificate_no=RP', {fetched_twice}) else url end"
        )
        tail = f"replace({pick(PAGE_TAILS, 'page_id', d)}, '{{name}}', {person('page_id', d)})"
        sides[d] = {"url": url, "html": f"concat(html, {tail})", "source_url": f"cast(url as {kind})"}
    for name in ("url", "html", "source_url"):
        out[name] = (sides["spark"][name], sides["duck"][name])
    return out


def link_text(key: str, dialect: str) -> str:
    """Link payload of a row."""
    own, div = person(key, dialect), "div" if dialect == "spark" else "//"
    path = f"lower(replace({own}, ' ', '_'))"
    filled = f"replace(replace(replace({pick(LINKS, key, dialect)}, '{{n}}', {_number(key, dialect)}), '{{path}}', {path}), '{{name}}', {own})"
    keys = [pick(items, f"{key} {div} 10", dialect) for items in (LINK_NAME_KEYS, LINK_SERIAL_KEYS)]
    return f"replace(replace({filled}, '{{name_key}}', {keys[0]}), '{{serial_key}}', {keys[1]})"


def _link_exprs() -> dict[str, tuple[str, str]]:
    """Link payloads of verifications; part of them point to fetched pages."""
    sides = {}
    for d in ("spark", "duck"):
        own = person("o_orderkey", d)
        sides[d] = {
            "payload": link_text("o_orderkey", d),
            "candidate_name": f"case when o_orderkey % 7 = 2 then 'DELTA ECHO' when o_orderkey % 11 = 4 then '' else {own} end",
        }
    return {"id": _both("o_orderkey"), **{n: (sides["spark"][n], sides["duck"][n]) for n in ("payload", "candidate_name")}}


_DERIVED = {
    "candidates": ("customer", _candidate_exprs),
    "documents": ("documents", _document_exprs),
    "verifications": ("orders", _verification_exprs),
    "submissions": ("documents", _submission_exprs),
    "captures": ("lineitem", _capture_exprs),
    "portal_pages": ("pages", _portal_exprs),
    "links": ("orders", _link_exprs),
    "users": ("nation", lambda: {
        "id": _both("n_nationkey"), "name": _both("n_name"),
        "role": _both("case when n_regionkey = 0 then 'admin' else 'hr' end"),
    }),
}


SQL_NAMES = {
    "candidates": "cand", "documents": "docs", "verifications": "ver", "submissions": "subm", "captures": "capt",
    "portal_pages": "portal_src", "links": "links_src", "users": "usr",
}


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, exprs = _DERIVED[name]
    rows = parquet_table(spark, folder, source)
    return rows.selectExpr(*[f"{e[0]} as {n}" for n, e in exprs().items()])


def table_expressions(name: str) -> dict[str, str]:
    """Spark expressions of a derived table's columns over rows of its source."""
    return {n: e[0] for n, e in _DERIVED[name][1]().items()}


def cte(name: str) -> str:
    source, exprs = _DERIVED[name]
    columns = ", ".join(f"{e[1]} AS {n}" for n, e in exprs().items())
    return f"{SQL_NAMES[name]} AS (SELECT {columns} FROM {source})"


def with_tables(body: str, *names: str, extra: tuple[str, ...] = ()) -> str:
    """Oracle query over derived tables."""
    parts = [cte(n) for n in names] + list(extra)
    return f"WITH {', '.join(parts)} {body}"


def with_exif(captures: DataFrame) -> DataFrame:
    """The EXIF map of a capture; empty values stay out."""
    entry = lambda k, v: F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))
    software = F.when(F.col("software") != "", F.col("software"))
    entries = F.array(
        entry("Software", software),
        entry("HostComputer", F.when(software.isNull() & (F.col("part") % 16 == 2), F.lit("canon host"))),
        entry("Make", F.when(F.col("supp") % 4 == 0, F.lit("Acme"))),
        entry("GPSInfo", F.when(F.col("gps"), F.lit("x"))),
        entry("ColorSpace", F.when(F.col("odd_colour"), F.lit("65535")).otherwise("1")),
        entry("DateTimeOriginal", F.when(F.col("stamp") != "", F.col("stamp"))),
    )
    present = F.filter(entries, lambda e: e["v"].isNotNull())
    full = F.map_from_entries(present)
    return captures.withColumn("exif", F.when(F.col("no_exif"), F.expr("cast(map() as map<string,string>)")).otherwise(full))


def with_detections(captures: DataFrame) -> DataFrame:
    from credence.operators.capture import detection

    one, two = detection(F.col("class_1"), F.col("conf_1")), detection(F.col("class_2"), F.col("conf_2"))
    return captures.withColumn("detections", F.slice(F.array(one, two), F.lit(1), F.col("n_detections")))
