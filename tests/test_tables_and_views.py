"""Tables that change together, duplicates and verifications kept up to date by streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from credence.operators import capture, persons
from credence.operators.verification import verify, verification_rows
from credence.plans.corpus_queries import submissions
from credence.plans.tables import derived
from credence.sources import tableset
from credence.sources.sinks import BatchLog
from credence.sources.tableset import Conflict, TableSet
from credence.streaming import verify_stream as streams
from credence.streaming.verification_view import VerificationView, two_lowest


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def started(spark, name, rows, key="id", buckets=8):
    tables = TableSet.new(spark, "set")
    change = tables.begin()
    change.create(name, rows, key, buckets)
    change.commit()
    return tables


def test_an_upsert_keeps_the_files_of_other_buckets(spark):
    tables = started(spark, "t", spark.range(200).select("id", F.lit("old").alias("s")))
    before = tables.manifest()["tables"]["t"]["files"]
    for _ in range(2):  # the second time changes nothing more
        change = tables.begin()
        change.upsert("t", spark.createDataFrame([(5, "new"), (900, "new")], "id int, s string"))  # a key of another type finds its bucket
        change.commit()
    after = tables.manifest()["tables"]["t"]["files"]
    assert sum(before[b] == after[b] for b in before) >= 6 and before.keys() == after.keys()
    assert {r.id: r.s for r in tables.read("t").collect()} == {**{i: "old" for i in range(200)}, 5: "new", 900: "new"}
    assert tables.read("t", version=1).where("s = 'new'").count() == 0
    assert sum(n for _, n in after.values()) == 201


def test_of_two_writers_one_commits(spark):
    tables = started(spark, "t", spark.range(20).select("id", F.lit(0).alias("v")))
    first, second = tables.begin(), tables.begin()
    first.upsert("t", spark.createDataFrame([(1, 1)], "id long, v int"))
    second.upsert("t", spark.createDataFrame([(2, 2)], "id long, v int"))
    assert second.commit() == 2
    with pytest.raises(Conflict):
        first.commit()
    assert {r.id: r.v for r in tables.read("t").where("v > 0").collect()} == {2: 2}
    assert tables.versions() == [1, 2]
    again = tables.begin()  # what lost is done anew on the new version
    again.upsert("t", spark.createDataFrame([(1, 1)], "id long, v int"))
    again.commit()
    assert {r.id: r.v for r in tables.read("t").where("v > 0").collect()} == {1: 1, 2: 2}


def test_lookup_delete_and_empty_tables(spark):
    tables = started(spark, "t", spark.range(50).select("id", F.col("id").cast("string").alias("s")))
    change = tables.begin()
    keys = spark.createDataFrame([(3,), (3,), (None,), (77,)], "id long")
    assert [tuple(r) for r in change.lookup("t", keys).collect()] == [(3, "3")]
    assert change.lookup("t", keys.limit(0)).count() == 0
    change.delete("t", keys)
    change.upsert("t", spark.createDataFrame([], "id long, s string"))
    change.create("none", spark.createDataFrame([], "k string, v struct<a:int,b:array<string>>"), "k")
    change.commit()
    assert tables.read("t").count() == 49 and tables.read("none").count() == 0
    change = tables.begin()
    change.upsert("none", spark.sql("select 'x' k, named_struct('a', 1, 'b', array('y')) v"))
    change.delete("t", spark.range(50))
    change.commit()
    assert tables.read("none").first().v.b == ["y"] and tables.read("t").count() == 0


def test_a_full_table_gets_more_buckets(spark, monkeypatch):
    monkeypatch.setattr(tableset, "ROWS_PER_BUCKET", 10)
    tables = started(spark, "t", spark.range(50).select("id", F.lit("a").alias("s")), buckets=2)
    assert tables.manifest()["tables"]["t"]["buckets"] == 8
    change = tables.begin()
    change.upsert("t", spark.range(40, 200).select("id", F.lit("b").alias("s")))
    change.commit()
    assert tables.manifest()["tables"]["t"]["buckets"] == 32
    assert {r.id: r.s for r in tables.read("t").collect()} == {i: "a" if i < 40 else "b" for i in range(200)}


def test_vacuum_keeps_what_is_read(spark):
    tables = started(spark, "t", spark.range(20).select("id", F.lit(0).alias("v")))
    for k in range(3):
        change = tables.begin()
        change.upsert("t", spark.createDataFrame([(k, k + 1)], "id long, v int"))
        change.commit()
    assert tables.vacuum(keep=1) == 0  # all too young
    assert tables.vacuum(keep=1, older_than_s=-60) > 0
    assert tables.versions() == [4] and tables.read("t").agg(F.sum("v")).first()[0] == 6 and tables.read("t").count() == 20


def application(spark):
    tables = TableSet.new(spark, "application")
    change = tables.begin()
    change.create("candidates", spark.createDataFrame([(1, "Ann Bee", None), (2, "ann bee", ""), (3, "Cy", None), (4, " ANN BEE", None)], "id long, full_name string, email string"), "id")
    change.create("documents", spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 4)], "id long, candidate_id long"), "id")
    change.create("verifications", spark.createDataFrame([(1, 4), (2, 1)], "id long, candidate_id long"), "id")
    change.commit()
    return tables


def test_a_merge_changes_three_tables_or_none(spark, monkeypatch):
    tables = application(spark)
    old = {name: rows_of(tables.read(name)) for name in persons.TABLES}
    # the second table fails after the first has been written
    real, calls = tableset.Change.upsert, []

    def failing(self, name, rows):
        calls.append(name)
        if len(calls) == 2:
            raise OSError("executor lost")
        real(self, name, rows)

    monkeypatch.setattr(tableset.Change, "upsert", failing)
    with pytest.raises(OSError):
        persons.apply_merge(tables)
    assert calls == ["documents", "verifications"]
    assert {name: rows_of(tables.read(name)) for name in persons.TABLES} == old and tables.versions() == [1]
    monkeypatch.undo()
    for _ in range(2):  # a second merge finds nothing
        persons.apply_merge(tables)
        assert {r.id for r in tables.read("candidates").collect()} == {1, 3}
        assert {(r.id, r.candidate_id) for r in tables.read("documents").collect()} == {(1, 1), (2, 3), (3, None), (4, 1)}
        assert {(r.id, r.candidate_id) for r in tables.read("verifications").collect()} == {(1, 1), (2, 1)}


def test_a_batch_reads_only_the_buckets_of_its_files(spark, tmp_path, monkeypatch):
    """Twenty batches of a few files each: the table grows, what a batch reads of it does not."""
    monkeypatch.setattr(tableset, "ROWS_PER_BUCKET", 4)
    seen, found = TableSet(spark, f"{tmp_path}/seen"), BatchLog(spark, f"{tmp_path}/found")
    read, real = [], tableset.Change.lookup

    def measured(self, name, keys):
        touched = {str(b) for b in self._touched(name, keys)}
        read.append(sum(n for b, (_, n) in self.state["tables"][name]["files"].items() if b in touched))
        return real(self, name, keys)

    monkeypatch.setattr(tableset.Change, "lookup", measured)
    dice, arrived = random.Random(4), []
    for k in range(20):
        # mostly new files, some seen before
        rows = [(k * 6 + i, f"h{dice.randrange(k * 6 + 1) if i == 0 else k * 6 + i}") for i in range(6)]
        arrived += rows
        spark.createDataFrame(rows, "id long, file_hash string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    one_file = spark.readStream.schema("id long, file_hash string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.duplicates_on_arrival(one_file, seen, found)
    first, want = {}, set()
    for i, h in arrived:
        if first.setdefault(h, i) != i:
            want.add((i, first[h]))
    assert {(r.id, r.earlier_id) for r in found.read().collect()} == want and want
    assert {r.file_hash: r.first_id for r in seen.read("files").collect()} == first
    assert len(read) == 20 and max(read[10:]) <= 2 * max(read[3:10]) and max(read) <= 6 * 12
    assert sum(n for _, n in seen.manifest()["tables"]["files"]["files"].values()) == len(first) > 90


def test_a_replayed_batch_is_counted_once(spark, tmp_path):
    schema = "id long, file_hash string"
    seen, found = TableSet(spark, f"{tmp_path}/seen"), BatchLog(spark, f"{tmp_path}/found")
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], schema).write.parquet(f"{tmp_path}/in")
    streams.duplicates_on_arrival(stream(), seen, found)
    os.remove(f"{tmp_path}/seen/progress/commits/0")  # the driver died after the tables were committed, before the stream noted it
    crc = f"{tmp_path}/seen/progress/commits/.0.crc"
    if os.path.exists(crc):
        os.remove(crc)
    streams.duplicates_on_arrival(stream(), seen, found)
    assert sorted(map(tuple, seen.read("files").collect())) == [("a", 1, 2), ("b", 3, 1)]
    assert [(r.id, r.earlier_id) for r in found.read().collect()] == [(2, 1)]


def test_two_lowest(spark):
    rows = [("a", 5, 1), ("a", 3, None), ("a", 9, 2), ("b", 1, 7)]
    got = {r.file_hash: (r.low.id, r.low.owner, r.next and (r.next.id, r.next.owner)) for r in two_lowest(spark.createDataFrame(rows, "file_hash string, id long, owner long")).collect()}
    assert got == {"a": (3, None, (5, 1)), "b": (1, 7, None)}


def at():
    return F.lit("2026-06-01 00:00:00").cast("timestamp")


def few_documents(spark, folder):
    """Two dozen given documents, and copies of some under other ids, lower ones included."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(24).collect()
    rows = [(d.doc_id + 100, d.text, d.lang, d.source, d.n_chars) for d in docs]
    copies = [(3, 0), (1, 0), (500, 0), (2, 5), (600, 5), (601, 5), (700, 9), (5, 12), (4, 12)]
    rows += [(i, docs[k].text, docs[k].lang, docs[k].source, docs[k].n_chars) for i, k in copies]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_the_view_equals_the_batch(spark, folder, monkeypatch):
    """Two batches in no order of id, one of them lost half-way and one replayed; then two documents are submitted again."""
    docs = few_documents(spark, folder).cache()
    pages, owners = derived(spark, folder, "portal_pages"), derived(spark, folder, "candidates").select("id", "full_name")
    whole = lambda rows: rows_of(verification_rows(verify(submissions(rows), pages, owners, at()), at()))
    split = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    view = VerificationView(TableSet.new(spark, "view"), at(), at()).start(pages, owners, buckets=2)
    view.apply(submissions(docs.where(split == 0)), 0)
    before, real = rows_of(view.read()), tableset.Change.upsert

    def failing(self, name, rows):
        real(self, name, rows)
        if name == "evidence":
            raise OSError("executor lost")

    monkeypatch.setattr(tableset.Change, "upsert", failing)
    with pytest.raises(OSError):
        view.apply(submissions(docs.where(split == 1)), 1)
    monkeypatch.undo()
    assert rows_of(view.read()) == before and view.tables.begin().applied("verify") == 0
    for _ in range(2):  # the second time is a replay
        view.apply(submissions(docs.where(split == 1)), 1)
    assert rows_of(view.read()) == whole(docs)
    again = docs.where("doc_id in (1, 100)").withColumn("text", F.concat(F.lit("other "), "text"))
    view.apply(submissions(again), 2)  # both leave their files
    assert rows_of(view.read()) == whole(docs.where("doc_id not in (1, 100)").unionByName(again))


def test_a_stale_downgrade_is_refused(spark):
    from credence.operators.recheck import write_back

    stored = spark.createDataFrame([(1, 90, "Verified", "old", "keep"), (2, 80, "Verified", None, "keep"), (3, 70, "Verified", "old", "keep")],
                                   "document_id long, authenticity_score int, status string, issues string, recommendation string")
    tables = started(spark, "verifications", stored, "document_id", 2)
    seen = spark.createDataFrame([(1, "national_id", "UR Degree", 0.99, False), (2, "certificate", "UR Degree", 0.99, False), (3, "national_id", "UR Degree", 0.99, True)],
                                 "document_id long, doc_type string, class string, conf double, is_pdf boolean")
    detected = capture.with_detect_check(seen.withColumn("detections", F.array(capture.detection(F.col("class"), F.col("conf"))))).withColumn("detect_ok", F.lit(True))
    shown = tables.begin()  # the page was read here
    change = tables.begin()
    change.upsert("verifications", spark.createDataFrame([(1, 100, "Verified", "", "new")], stored.schema))
    change.commit()
    with pytest.raises(Conflict):
        write_back(tables, detected, read=shown)
    assert tables.read("verifications").where("document_id = 1").first().recommendation == "new" and tables.versions() == [1, 2]
    assert write_back(tables, detected) == 3
    rows = {r.document_id: r for r in tables.read("verifications").collect()}
    assert (rows[1].authenticity_score, rows[1].status) == (0, "Fake") and rows[1].issues.startswith("Document type mismatch")
    assert rows[2].status == "Verified" and rows[3].status == "Verified"  # the type fits; a file of pages is left alone
    assert write_back(tables, detected.where("document_id > 1")) is None and tables.versions() == [1, 2, 3]


def test_link_keys_like_a_query_parser(spark):
    """Values of name and serial keys in the order in which they are tried, against the standard library's parser."""
    from urllib.parse import parse_qs, urlparse

    from credence import fixed_values as fv
    from credence.functions import links

    dice = random.Random(8)
    keys = [*fv.NAME_KEYS, *fv.SERIAL_KEYS, "NAME", "Name", "SERIAL", "Serial", "x", "first_name", "LAST_NAME", "lastname", ""]
    urls = []
    for _ in range(400):
        pairs = "&".join(f"{dice.choice(keys)}{dice.choice(['=', '=', '=', ''])}{dice.choice(['a+b', 'C%20D', '', 'é', '1=2', 'x'])}" for _ in range(dice.randint(0, 5)))
        urls.append(f"https://h.rw/p/q{dice.choice(['?', '?', '?', ''])}{pairs}{dice.choice(['', '#name=z&serial=1'])}")

    def tried(url):
        query = parse_qs(urlparse(url).query)
        folded = {k.lower(): v for k, v in query.items()}
        names = [v for k in fv.NAME_KEYS for v in folded.get(k, [])]
        first, last = (folded.get(f"{part}_name") or folded.get(f"{part}name") or [] for part in ("first", "last"))
        serials = [v for k in fv.SERIAL_KEYS for v in query.get(k) or query.get(k.upper()) or []]
        return names + ([f"{first[0]} {last[0]}"] if first and last else []), serials

    rows = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("pairs", links.query_pairs(F.col("url")))
    for r in rows.select("url", links._names(F.col("pairs")).alias("names"), links._serials(F.col("pairs")).alias("serials")).collect():
        assert (r.names, r.serials) == tried(r.url), r.url


def test_texts_in_bounded_arrays(spark):
    from credence.sources.records import pack_texts, text_batches

    rows = [("hot", i, f"t{i}") for i in range(1000)] + [("a", 0, None), ("a", 5, 'q"\n'), ("b", 7, "z")]
    packed = pack_texts(spark.createDataFrame(rows, "g string, pos long, text string"), "g", "pos", "text", 64)
    assert {r.g: r["count"] for r in packed.groupBy("g").count().collect()} == {"hot": 16, "a": 1, "b": 1}
    back = {(r.g, r.chunk * 64 + r.pos): r.text for r in text_batches(packed, "batch").collect()}
    assert all(back[g, p] == t for g, p, t in rows) and {k for k, v in back.items() if v is not None} == {(g, p) for g, p, t in rows if t is not None}
