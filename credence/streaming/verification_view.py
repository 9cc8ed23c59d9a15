"""The verifications of all documents, kept up to date as documents arrive in any batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence.operators.duplicates import duplicate_outcome
from credence.operators.fusion import fuse
from credence.operators.links import newest_pages, with_link_address, with_link_verdict, with_portal_verdict
from credence.operators.verification import evidence, verification_rows
from credence.session import cut_lineage
from credence.sources.tableset import Change, TableSet
from credence.streaming.verify_stream import run_available

_FILE = "file_hash string, low struct<id:bigint,owner:bigint>, next struct<id:bigint,owner:bigint>, n bigint"


class VerificationView:
    """Table ``verifications`` equals ``verify`` over all documents that arrived, whatever the batches were.

    Beside it, under the same manifest, stand ``evidence`` (by id: all of a document's checks that need no other document),
    ``files`` (by hash: the two lowest ids and their owners, which settle every document's duplicate), and what is looked up:
    ``portal`` (by address: judged pages) and ``owners`` (by id).  A batch is checked once; then the documents whose first other
    document of the same file has become another one are judged again from their evidence.  When documents arrive
    in order of id that is one document per file, found by its id; a lower id that comes late changes all of its
    file, which are found by a scan of the evidence for that hash.
    """

    def __init__(self, tables: TableSet, as_of: Column | None = None, verified_at: Column | None = None) -> None:
        self.tables, self.as_of, self.verified_at = tables, as_of, verified_at

    def start(self, pages: DataFrame, owners: DataFrame, buckets: int = 16) -> VerificationView:
        """Stores the fetched pages, judged once, and the candidates' names.  ``pages``: url, http_status, html and, if known, fetched_at."""
        change = self.tables.begin()
        judged = with_portal_verdict(newest_pages(pages)).select("url", "portal")
        change.create("portal", judged.where("url is not null"), "url", buckets)
        change.create("owners", owners.select("id", "full_name"), "id", buckets)
        change.create("files", self.spark.createDataFrame([], _FILE), "file_hash", buckets)
        change.commit()
        return self

    @property
    def spark(self) -> SparkSession:
        return self.tables.spark

    def follow(self, stream: DataFrame) -> None:
        """Takes in all that has arrived; progress is kept beside the tables."""
        run_available(stream, self.apply, "verify", progress=f"{self.tables.root}/progress")

    def read(self) -> DataFrame:
        return self.tables.read("verifications")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Takes in one batch of submissions, at most once per number; an id that comes again replaces its earlier submission."""
        change = self.tables.begin()
        if number <= change.applied("verify"):
            return
        narrow = cut_lineage(evidence(batch.dropDuplicates(["id"]), self.as_of))
        addressed = with_link_address(narrow, printed="printed_link")
        pages = change.lookup("portal", addressed.select(F.col("_key").alias("url")))
        fresh = cut_lineage(with_link_verdict(addressed, pages).withColumn("file_hash", _own_file()))
        if "evidence" not in change.state["tables"]:
            change.create("evidence", fresh.limit(0), "id", change.state["tables"]["portal"]["buckets"])
        files, judged = self._refiled(change, fresh)
        rows = verification_rows(fuse(self._with_duplicates(change, judged, files)), self.verified_at)
        if "verifications" not in change.state["tables"]:
            change.create("verifications", rows.limit(0), "document_id", change.state["tables"]["portal"]["buckets"])
        change.upsert("verifications", rows)
        change.upsert("evidence", fresh)
        change.upsert("files", files)
        change.commit("verify", number)

    def _refiled(self, change: Change, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The new rows of ``files``, and the evidence of all documents that have to be judged."""
        mine = fresh.select("id", F.col("candidate_id").alias("owner"), "file_hash")
        earlier = cut_lineage(change.lookup("evidence", fresh.select("id")).select("id", F.col("file_hash").alias("old_hash")))
        mine = mine.join(earlier, "id", "left")
        left = earlier.join(fresh.select("id", "file_hash"), "id").where("old_hash <> file_hash").select(F.col("old_hash").alias("file_hash"))
        hashes = fresh.select("file_hash").union(left).distinct()
        old = cut_lineage(change.lookup("files", hashes))
        new = mine.groupBy("file_hash").agg(F.min("id").alias("least"), F.count_if(F.col("old_hash").isNull() | (F.col("old_hash") != F.col("file_hash"))).alias("added"))
        # where a document left its file, or a lower id came to a file of more than two, all of the file are needed
        late = old.join(new, "file_hash").where("least < low.id and n > 2").select("file_hash")
        whole = cut_lineage(left.union(late).distinct())
        stored = change.table("evidence")
        members = cut_lineage(stored.join(whole, "file_hash", "left_semi").join(fresh.select("id"), "id", "left_anti"))
        kept = old.join(whole, "file_hash", "left_anti")
        pair = lambda c: F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.owner").alias("owner"))
        known = kept.select("file_hash", F.explode(F.array(pair("low"), pair("next"))).alias("d")).where("d.id is not null").select("d.id", "d.owner", "file_hash")
        known = known.join(fresh.select("id"), "id", "left_anti")
        pairs = known.unionByName(members.select("id", F.col("candidate_id").alias("owner"), "file_hash")).unionByName(mine.select("id", "owner", "file_hash"))
        counted = (kept.select("file_hash", "n").unionByName(members.groupBy("file_hash").agg(F.count(F.lit(1)).alias("n")))
                   .unionByName(new.join(whole, "file_hash", "left_anti").select("file_hash", F.col("added").alias("n")))
                   .unionByName(mine.join(whole, "file_hash", "left_semi").groupBy("file_hash").agg(F.count(F.lit(1)).alias("n"))))
        files = cut_lineage(two_lowest(pairs).join(counted.groupBy("file_hash").agg(F.sum("n").alias("n")), "file_hash"))
        # of other files only the lowest two can have got another first fellow
        turned = old.select("file_hash", F.col("low").alias("was_low"), F.col("next").alias("was_next")).join(files, "file_hash").where(
            "not (low.id <=> was_low.id and next.id <=> was_next.id and low.owner <=> was_low.owner and next.owner <=> was_next.owner)")
        few = turned.select(F.explode(F.array("was_low.id", "was_next.id", "low.id")).alias("id")).where("id is not null").distinct().join(fresh.select("id"), "id", "left_anti")
        again = change.lookup("evidence", few).join(members.select("id"), "id", "left_anti")
        return files, fresh.unionByName(members.select(fresh.columns)).unionByName(again.select(fresh.columns))

    def _with_duplicates(self, change: Change, docs: DataFrame, files: DataFrame) -> DataFrame:
        files = files.unionByName(change.lookup("files", docs.select("file_hash")).join(files, "file_hash", "left_anti"))
        joined = docs.join(files, "file_hash")
        other = F.when(F.col("id") == F.col("low.id"), F.col("next")).otherwise(F.col("low"))
        joined = joined.withColumns({"other_id": other["id"], "other_candidate": other["owner"]}).drop("low", "next", "n")
        owners = files.select(F.explode(F.array("low.owner", "next.owner")).alias("id"))
        names = change.lookup("owners", owners).select(F.col("id").alias("other_candidate"), F.col("full_name").alias("other_name"))
        return duplicate_outcome(joined.join(names, "other_candidate", "left")).drop("other_id", "other_candidate", "other_name")


def _own_file() -> Column:
    """The file of a document; one without a hash is alone."""
    return F.coalesce(F.col("file_hash"), F.concat(F.lit("none:"), F.col("id").cast("string")))


def two_lowest(pairs: DataFrame) -> DataFrame:
    """(file_hash, low, next): the documents of lowest and second lowest id of every file, from rows (id, owner, file_hash).

    Two plain minima: nothing gathers the documents of a file.
    """
    one = F.struct(F.col("id").cast("bigint").alias("id"), F.col("owner").cast("bigint").alias("owner"))
    low = pairs.groupBy("file_hash").agg(F.min(one).alias("low"))
    rest = pairs.join(low, "file_hash").where("id > low.id").groupBy("file_hash").agg(F.min(one).alias("next"))
    return low.join(rest, "file_hash", "left")
