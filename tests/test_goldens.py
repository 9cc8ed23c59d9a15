"""Hand-computed results of the rules on invented records."""

import pytest
from pyspark.sql import functions as F

from credence.functions import links as L
from credence.functions import names as N
from credence.functions import text as X
from credence.operators import capture, consistency, evaluation, listings, numbers, persons
from credence.operators.content import with_content_check, with_name_match
from credence.operators.duplicates import duplicate_outcome, duplicate_pairs
from credence.operators.fusion import fuse
from credence.operators.links import printed_link, with_link_check, with_portal_verdict
from credence.operators.provider import with_provider_check


def values(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def one(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_reference_numbers(spark):
    rows = [
        ("nid", "ID 1199880012345678", True, True, 10), ("nid", "ID 2201570012345678", True, False, -20),
        ("nid", "ID 3199880012345678", True, False, -20), ("nid", "no number", False, False, 0),
        ("nesa", "NESA/2019/123456", True, True, 10), ("nesa", "REB-2031-12345", True, False, -10),
        ("nesa", "code 123456789", True, True, 5), ("nesa", "nothing", False, False, 0),
        ("uni", "ULK/2018/12345", True, True, 10), ("uni", "MKU 12", False, False, -10), ("uni", "MKU/12345", True, True, 10),
    ]
    df = values(spark, "kind string, text string, f boolean, v boolean, a int", rows).withColumn("u", F.upper("text"))
    for kind, check in (
        ("nid", numbers.national_id_check(numbers.national_id_value(F.col("text")))),
        ("nesa", numbers.exam_number_check(F.col("u"))),
        ("uni", numbers.university_number_check(F.col("u"), numbers.university_code(F.col("u")))),
    ):
        for r in df.where(F.col("kind") == kind).withColumn("r", check).collect():
            assert (r.r.number_found, r.r.format_valid, r.r.score_adjustment) == (r.f, r.v, r.a), r.text


def test_number_router(spark):
    rows = [("hereby confirmed by the office", "", "nesa"), ("UR degree of arts", "certificate", "university"), ("short", "", None), ("National ID card text", "certificate", None)]
    df = numbers.with_number_check(values(spark, "text string, hint string, want string", rows), doc_type_hint="hint")
    names = {"nesa": "NESA / Rwanda Education Board", "university": "University (Rwanda)", None: None}
    for r in df.collect():
        assert r.number.institution == names[r.want] and r.number.checked == (r.want is not None)


def test_serial_repair(spark):
    rows = [("A1234567O", "A12345670"), ("A12 345 678", "A12345678"), ("AXYZ", None), ("A1S34B678", "A15348678")]
    df = values(spark, "t string, want string", rows).withColumn("got", L.exam_serial(F.col("t")))
    assert all(r.got == r.want for r in df.collect())


def test_names_match(spark):
    rows = [("ALPHA BRAVO", "alpha bravo", True), ("ALPHA BRAVO CHARLIE", "ALPHA BRAVO", True), ("ALPHA BRAVO", "DELTA ECHO", False), ("AB CD", "ALPHA", None), (None, "ALPHA", None)]
    df = values(spark, "a string, b string, want boolean", rows).withColumn("got", N.names_match(F.col("a"), F.col("b")))
    assert all(r.got == r.want for r in df.collect())


def test_person_name_cleaning(spark):
    rows = [("alpha_bravo", "ALPHA BRAVO"), ("alpha%20bravo+charlie", "ALPHA BRAVO CHARLIE"), ("ALPHA BRAVO Faculty of X", "ALPHA BRAVO"),
            ("verify online", None), ("alpha", None), ("a b c d", None), ("one two three four five six", None), (None, None)]
    df = values(spark, "t string, want string", rows).withColumn("got", N.clean_person_name(F.col("t")))
    assert all(r.got == r.want for r in df.collect())


def test_domains(spark):
    rows = [("https://graduate.rp.ac.rw/?certificate_no=1", True, True, "Rwanda Polytechnic"), ("https://x.example.com/", False, False, None),
            ("https://evil.example/?u=ur.ac.rw", True, False, "University of Rwanda")]
    df = values(spark, "u string, t boolean, h boolean, i string", rows)
    for r in df.withColumns({"gt": L.is_trusted(F.col("u")), "gh": L.is_trusted_host(F.col("u")), "gi": L.institution_of(F.col("u"))}).collect():
        assert (r.gt, r.gh, r.gi) == (r.t, r.h, r.i)


def test_duplicates(spark):
    docs = values(spark, "id long, candidate_id long, file_hash string",
                  [(1, 10, "h1"), (2, 10, "h1"), (3, 11, "h2"), (4, 12, "h2"), (5, 13, "h3"), (6, None, "h4"), (7, None, "h4"), (8, 14, None)])
    got = {r.id: r for r in duplicate_outcome(duplicate_pairs(docs)).collect()}
    assert len(got) == 8
    want = {1: (True, True, 0), 2: (True, True, 0), 3: (True, False, -60), 4: (True, False, -60), 5: (False, False, 0), 6: (True, False, -60), 8: (False, False, 0)}
    for k, w in want.items():
        d = got[k].duplicate
        assert (d.found, d.same_candidate, d.score_adjustment) == w, k
    assert got[3].other_id == 4 and got[4].other_id == 3


def test_person_keeper(spark):
    people = values(spark, "id int, full_name string, email string", [(1, "Ann Bee", None), (2, " ann bee ", ""), (3, "ANN BEE", "a@x.org"),
        (4, "José Noël", "j@x.org"), (5, "JOSE NOEL ", "J@X.org"), (6, None, None), (7, None, None)])
    assert one(persons.keeper_map(people), "duplicate_id", "keeper_id") == [(2, 1), (5, 4)]


def test_report(spark):
    cand = values(spark, "id int", [(1,), (2,), (3,)])
    ver = values(spark, "candidate_id int, authenticity_score int, status string",
                 [(1, 100, "Verified"), (1, 50, "Suspicious"), (2, 100, "Verified"), (2, 0, "Fake"), (2, 50, "Suspicious")])
    got = {r.id: (r.n_docs, r.avg_score, r.overall_status) for r in listings.candidate_report(cand, ver).collect()}
    assert got == {1: (2, 75, "Suspicious"), 2: (3, 50, "Fake"), 3: (0, 0, "Verified")}


def test_cross_consistency(spark):
    groups = [["ALPHA born 01/02/1990", "Alpha 01/02/1990"], ["ALPHA 01/02/1990", "ALPHA 03/02/1990"], ["ALPHA 01/02/1990", "BRAVO 03/02/1990"], ["one text"]]
    rows = [(g, t) for g, texts in enumerate(groups) for t in texts]
    got = {r.g: r.score for r in consistency.cross_consistency(values(spark, "g int, t string", rows), "g", "t").collect()}
    assert got == {0: 100, 1: 75, 2: 45, 3: 100}


def test_metadata(spark):
    rows = [({"Software": "GIMP 2.10"}, "editing", 60), ({"Software": "EPSON Scan"}, "scanner", 100), ({}, "unknown", 90), ({"Software": "FooTool", "GPSInfo": "x"}, "unknown", 90)]
    df = values(spark, "exif map<string,string>, kind string, score int", rows)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    df = df.withColumns({"file_size_kb": F.lit(200.0), "created": at, "modified": at})
    for r in capture.with_metadata_check(df).collect():
        assert (r.metadata.software_type, r.metadata.score) == (r.kind, r.score)


FUSION = [
    ("none", None, False, False, "none", 100, "Verified"), ("online", True, False, False, "none", 100, "Verified"),
    ("untrusted", None, False, False, "none", 90, "Verified"), ("untrusted", False, False, False, "none", 50, "Suspicious"),
    ("none", None, True, False, "none", 50, "Suspicious"), ("online", True, True, False, "none", 100, "Verified"),
    ("none", None, False, True, "none", 30, "Fake"), ("none", None, False, False, "same", 100, "Verified"), ("none", None, False, False, "other", 30, "Fake"),
]


def fusion_rows(spark, rows, confidence=80.0, kind="degree"):
    df = values(spark, "qr string, nm boolean, ocr boolean, sw boolean, dup string, score int, status string", rows)
    q, empty = F.col("qr"), X.no_texts()
    return df.withColumns({
        "doc_type": F.lit("certificate"), "pdf_failed": F.lit(False), "pdf_converted": F.lit(False), "candidate_name": F.lit("ALPHA"),
        "detect": F.struct(F.lit(True).alias("verified"), F.lit("UR Degree").alias("class"), F.lit(kind).alias("type"), F.lit("x").alias("description"),
                           F.lit(confidence).alias("confidence"), F.lit("").alias("hint")),
        "link": F.struct((q != "none").alias("found"), (q == "online").alias("trusted"), (q == "online").alias("verified_online"), F.col("nm").alias("name_match"),
                         F.lit("I").alias("institution"), empty.alias("issues"), empty.alias("positives")),
        "metadata": F.struct(F.lit("GIMP").alias("software"), F.col("sw").alias("software_suspicious")),
        "duplicate": F.struct((F.col("dup") != "none").alias("found"), (F.col("dup") == "same").alias("same_candidate"), F.lit("Z").alias("other_name"),
                              F.when(F.col("dup") == "other", -60).otherwise(0).alias("score_adjustment"), empty.alias("issues"), empty.alias("positives")),
        "printed": F.struct(F.col("ocr").alias("mismatch"), F.lit(False).alias("match"), empty.alias("found_names")),
    })


def test_fusion(spark):
    for r in fuse(fusion_rows(spark, FUSION)).collect():
        assert (r.verdict.score, r.verdict.status) == (r.score, r.status), r


@pytest.mark.parametrize("change", [{"confidence": 39.9}, {"kind": "transcript"}])
def test_fusion_refuses_weak_or_wrong_type(spark, change):
    assert {(r.verdict.score, r.verdict.status) for r in fuse(fusion_rows(spark, FUSION, **change)).collect()} == {(0, "Fake")}


def test_fusion_is_monotone(spark):
    """A further penalty never raises the score, except a name mismatch, which sets it to 50."""
    rows = [(q, nm, o, s, d, 0, "") for q in ("none", "online", "untrusted") for nm in (None, False) for o in (False, True) for s in (False, True) for d in ("none", "other")]
    got = {(r.qr, r.nm, r.ocr, r.sw, r.dup): r.verdict.score for r in fuse(fusion_rows(spark, rows)).collect()}
    assert all(0 <= v <= 100 for v in got.values())
    for (q, nm, o, s, d), v in got.items():
        assert got[(q, nm, True, s, d)] <= v and got[(q, nm, o, True, d)] <= v and got[(q, nm, o, s, "other")] <= v
        assert got[(q, False, o, s, d)] <= 50


def test_provider(spark):
    full = '{"result":{"Actions":{"Verify_Document":"Passed","Return_Personal_Info":"Returned"},"FullName":"ALPHA BRAVO","DOB":"x","IDNumber":"1"}}'
    rows = [(full, 200, "ALPHA BRAVO", 100), ('{"result":{"Actions":{"Verify_Document":"Failed"}}}', 200, "A", 20),
            ('{"result":{"Actions":{"Verify_Document":"Caution"}}}', 200, "A", 40), ("{}", 500, "A", 50)]
    for r in with_provider_check(values(spark, "body string, http_status int, candidate_name string, want int", rows)).collect():
        assert r.provider.score == r.want


def test_confusion_rates(spark):
    rows = [(0, 0)] * 24 + [(0, 1)] * 5 + [(1, 0)] * 2 + [(1, 1)] * 27
    preds = values(spark, "label int, prediction int", rows)
    assert one(evaluation.confusion(preds), "true_fake", "false_real", "false_fake", "true_real") == [(24, 5, 2, 27)]
    assert one(evaluation.accuracy(preds), "accuracy") == [(87.93,)]
    assert one(evaluation.detection_rates(preds), "fake_detection_rate", "real_detection_rate") == [(82.76, 93.1)]
    empty = preds.where("label > 1")
    assert one(evaluation.fake_set_summary(empty), "total_fake", "detection_rate") == [(0, 0.0)]


def test_fold_stats(spark):
    folds = values(spark, "accuracy double", [(0.9138,), (0.9310,), (0.8966,), (0.8621,), (0.8793,)])
    assert one(evaluation.fold_stats(folds), "cv_mean", "cv_std") == [(89.66, 2.44)]


def test_error_levels(spark):
    rows = [(13.0, 5.0, 0.2, "forgery", -40, 20), (9.0, 19.0, 0.01, "suspicious", -20, 50), (13.0, 5.0, 0.01, "warning", -10, 70), (2.0, 3.0, 0.0, "clean", 0, 100)]
    df = values(spark, "m double, s double, r double, l string, a int, sc int", rows)
    for r in df.withColumn("e", capture.error_level_check(F.col("m"), F.col("s"), F.col("r"))).collect():
        assert (r.e.level, r.e.score_adjustment, r.e.score) == (r.l, r.a, r.sc)


def test_name_on_document(spark):
    rows = [
        ("Certificate of ALPHA BRAVO given", "ALPHA BRAVO", 15), ("nothing here RENE was 1", "RENE THE", 12), ("nothing here RENE was 1", "RENE", 15), ("THREE REQUIREMENTS", "RENE", -70),
        ("ALEXENDERSON LIMA 12 and words 3", "ALEXANDERSON LIMA", 10), ("BRAVO lives at 12 main", "ALPHA BRAVO CHARLIE", -40),
        ("ALPHA x BRAVO 12 ok", "ALPHA BRAVO CHARLIE", -5), ("no such person 1", "ALPHA BRAVO", -70), ("any text", None, 0), ("any text", "AB", 0), ("any text", "THE", 0),
    ]
    df = with_name_match(values(spark, "t string, c string, want int", rows), "t", "c")
    for r in df.collect():
        assert r.name_check.adjustment == r.want, (r.t, r.c, r.name_check)


def test_holder_names(spark):
    rows = [
        ("confers upon you\nALPHA BRAVO\nthe degree of X", ["ALPHA BRAVO"]), ("AMAZINA: KILO LIMA", ["KILO LIMA"]),
        ("DELTA ECHO\nBACHELOR SCIENCE\nx1 GOLF HOTEL", ["DELTA ECHO"]), ("ab cd", []),
    ]
    for r in values(spark, "t string, want array<string>", rows).withColumn("got", N.holder_names(F.col("t"))).collect():
        assert r.got == r.want, r.t


def test_content_score_89(spark):
    """100 + 5 for the institution, - 8 without a role, - 8 without a year."""
    text = "RWANDA POLYTECHNIC certificate diploma degree award academic graduation"
    r = with_content_check(values(spark, "text string", [(text,)])).collect()[0].content
    assert (r.detected_type, r.content_score, r.institution_category) == ("certificate", 89, "polytechnics")


def test_link_verdicts(spark):
    pages = values(spark, "url string, http_status int, html string", [
        ("https://graduate.rp.ac.rw/?certificate_no=7", 200, "<p>Student Name</p><p>ALPHA BRAVO</p><p>Valid certificate</p>"),
        ("https://graduate.nesa.gov.rw/?serial=A12345678", 200, "<b>GRADUATE NAME: ALPHA BRAVO INDEX NUMBER 1</b> VALID"),
        ("https://www.ulk.ac.rw/c/9", 404, "gone"),
    ])
    rows = [
        (1, "https://graduate.rp.ac.rw/?certificate_no=7", "ALPHA BRAVO", True, True, True), (2, "https://graduate.rp.ac.rw/?certificate_no=7", "DELTA ECHO", False, True, False),
        (3, "see https://graduate.nesa.gov.rw/?serial=A1234567B ok".replace("B ", "8 "), "ALPHA BRAVO", True, True, True), (4, "https://www.ulk.ac.rw/c/9", "ALPHA BRAVO", False, False, None),
        (5, "https://www.ulk.ac.rw/other", "ALPHA BRAVO", True, False, None), (6, "https://x.example.com/", "ALPHA BRAVO", False, False, None),
        (7, "MKU BIT/2018/12345 ALPHA BRAVO BACHELOR", "ALPHA BRAVO", True, False, True), (8, "MKU BIT/2031/12345 ALPHA BRAVO BACHELOR", "ALPHA BRAVO", False, False, True),
        (9, None, "ALPHA BRAVO", False, False, None), (10, "no address", "ALPHA BRAVO", False, False, None),
    ]
    df = values(spark, "id int, payload string, candidate_name string, trusted boolean, online boolean, nm boolean", rows)
    got = with_link_check(df, with_portal_verdict(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.link.trusted, r.link.verified_online, r.link.name_match) == (r.trusted, r.online, r.nm), (r.id, r.link)


def test_link_and_serial_printed_in_the_text(spark):
    pages = values(spark, "url string, http_status int, html string", [
        ("https://graduate.rp.ac.rw/?certificate_no=7", 200, "<p>Certificate verified</p><p>Student Name</p><p>ALPHA BRAVO</p>"),
        ("https://graduate.nesa.gov.rw/api/x", 200, "none"),
    ])
    rows = [
        (1, None, "Scan to check\nhttps://graduate.rp.ac.rw/?certificate_no=7", True, "https://graduate.rp.ac.rw/?certificate_no=7"),
        (2, "", "see https://graduate.rp.ac.rw/ ?certificate_no=7", True, "https://graduate.rp.ac.rw/?certificate_no=7"),
        (3, "", "Visit Graduate . nesa . gov . rw, serial A 1234 5678", True, "https://graduate.nesa.gov.rw"),
        (4, "no address", "https://graduate.rp.ac.rw/?certificate_no=7", False, None),
        (5, None, None, False, None),
    ]
    df = values(spark, "id int, payload string, body string, trusted boolean, url string", rows).withColumn("candidate_name", F.lit("ALPHA BRAVO"))
    portal = with_portal_verdict(pages)
    whole = {r.id: r for r in with_link_check(df, portal, printed_text="body").collect()}
    early = df.withColumn("early", printed_link(F.col("body"), F.col("payload"))).drop("body")
    assert {r.id: r.early.serial for r in early.collect()} == {1: None, 2: None, 3: "A12345678", 4: None, 5: None}
    parts = {r.id: r for r in with_link_check(early, portal, printed="early").collect()}
    for id_, _, _, trusted, url in rows:
        assert whole[id_].link == parts[id_].link
        assert (whole[id_].link.trusted, whole[id_].link.url) == (trusted, url), (id_, whole[id_].link)


def test_a_null_text_is_an_empty_one_to_the_name_check(spark):
    df = values(spark, "id int, body string, candidate_name string", [(1, None, "ALPHA BRAVO"), (2, "", "ALPHA BRAVO")])
    got = {r.id: r.name_check for r in with_name_match(df, "body", "candidate_name").collect()}
    assert got[1] == got[2]


def test_list_helpers(spark):
    df = values(spark, "s string", [(" a ;; b;",)])
    assert one(df, X.split_issues(F.col("s")).alias("x")) == [(["a", "b"],)]
    df = values(spark, "a array<string>", [(["x", "RP", "x", "UR", "y"],)])
    assert one(df, X.priority_first(F.col("a"), ["UR", "RP"]).alias("x")) == [(["UR", "RP", "x", "y"],)]
    assert one(values(spark, "s string", [("driving_license",)]), X.labelize(F.col("s")).alias("x")) == [("Driving license",)]


def test_listing_helpers(spark):
    docs = values(spark, "id int", [(1,), (2,), (3,)])
    ver = values(spark, "document_id int, status string", [(1, "Fake"), (3, "Fake")])
    assert one(listings.pending_documents(docs, ver), "id") == [(2,)]
    assert one(listings.status_counts(ver), "status", "n") == [("Fake", 2)]
    people = values(spark, "a string, b string, want boolean", [(" Ann", "ANN ", True), ("Ann", "Anne", False)])
    same = listings.same_person(F.col("a"), F.lit(None).cast("string"), F.col("b"), F.lit(""))
    assert all(r.got == r.want for r in people.withColumn("got", same).collect())


def test_printed_name_is_gated(spark):
    """Only the listed classes are compared, and only with a candidate name."""
    from credence.operators.verification import with_printed_name

    rows = [("UR Degree", "ALPHA BRAVO", "no such person 1", True, False), ("RP Degree", "ALPHA BRAVO", "no such person 1", False, False),
            ("UR Degree", None, "no such person 1", False, False), ("ULK Transcript", "ALPHA BRAVO", "to ALPHA BRAVO 1", False, True)]
    df = values(spark, "c string, candidate_name string, text string, bad boolean, good boolean", rows)
    for r in with_printed_name(df.withColumn("detect", F.struct(F.col("c").alias("class")))).collect():
        assert (r.printed.mismatch, r.printed.match) == (r.bad, r.good), r


def test_links_without_address_are_kept(spark):
    """Rows without a link survive the page join, however many there are."""
    pages = with_portal_verdict(values(spark, "url string, http_status int, html string", [("https://x.rw/1", 200, "Diploma")]))
    rows = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, "https://x.rw/1").alias("payload"), F.lit("A B").alias("candidate_name"))
    got = with_link_check(rows, pages)
    assert got.count() == 300 and got.where("link.verified_online").count() == 100 and got.where("link.found").count() == 100
