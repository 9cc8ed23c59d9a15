"""Verification links on documents: embedded data, trust, portal page, holder name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions import links as L
from credence.functions.names import names_match, page_name_match
from credence.functions.text import contains_any, first_group, no_texts, texts, uni
from credence.operators.outcome import fmt

EXAM_PORTAL = "https://graduate.nesa.gov.rw/?serial="


def embedded_certificate(payload: Column, as_of_year: int = fv.AS_OF_YEAR) -> Column:
    """A code that carries certificate data instead of an address; NULL for any other payload."""
    number = F.coalesce(*[first_group(payload, p, 0) for p in fv.EMBEDDED_CERT_PATTERNS])
    year = F.coalesce(*[first_group(payload, p, 2) for p in fv.EMBEDDED_CERT_PATTERNS]).try_cast("int")
    year_ok = (year == 0) | year.between(1990, as_of_year)
    tail = F.trim(F.substr(payload, F.position(number, payload) + F.length(number)))
    titled = first_group(F.upper(tail), fv.EMBEDDED_NAME)
    words = F.filter(F.split(tail, uni(r"\s+")), lambda w: w.rlike(uni(r"^\p{L}{2,}$")))
    plain = F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 3), " "))
    holder = F.when(number.isNotNull(), F.coalesce(F.trim(titled), plain))
    message = (
        F.when(number.isNull(), "MKU QR detected but certificate number not found")
        .when(year_ok, fmt("MKU certificate number validated from QR: %s", number))
        .otherwise(fmt("MKU certificate year %s is out of valid range", year))
    )
    struct = F.struct(
        number.alias("cert_number"), F.when(number.isNotNull(), year).alias("cert_year"), holder.alias("holder"),
        (number.isNotNull() & year_ok).alias("format_valid"), message.alias("message"),
    )
    return F.when(contains_any(F.upper(payload), fv.EMBEDDED_CERT_WORDS), struct)


def with_portal_verdict(pages: DataFrame, out: str = "portal") -> DataFrame:
    """Judges every fetched page once: struct of reachable, record_found, holder, message.

    ``pages`` has url, http_status, html.  The rules depend on the portal the address belongs to.
    """
    url = F.col("url")
    exam = F.contains(url, F.lit("nesa.gov.rw"))
    poly = ~exam & F.contains(url, F.lit("graduate.rp.ac.rw"))
    spaced, joined = L.html_text(F.col("html"), "\n"), L.html_text(F.col("html"), "")
    step = pages.withColumns({
        "_kind": F.when(exam, "exam").when(poly, "poly").otherwise("any"),
        "_up": F.upper(F.when(exam | poly, spaced).otherwise(joined)),
    })
    up, kind = F.col("_up"), F.col("_kind")
    ok = F.col("http_status") == 200
    record = (
        F.when(kind == "exam", L.exam_verdict(up))
        .when(~ok, False)
        .when(kind == "poly", L.polytechnic_verdict(up))
        .otherwise(L.page_verdict(up))
    )
    step = step.withColumn("_record", record)
    holder = F.when(kind == "exam", L.name_on_exam_page(up)).when(
        ok & ((kind == "poly") | F.col("_record")), L.name_on_page(up)
    )
    confirmed = F.when(
        (kind == "exam") & F.contains(up, F.lit("VALID")) & F.contains(up, F.lit("GRADUATE NAME")), "NESA certificate verified online"
    ).when(kind == "exam", "NESA record not confirmed")
    message = (
        F.when(kind == "exam", confirmed)
        .when(~ok, fmt("HTTP %s", F.col("http_status")))
        .when((kind == "poly") & F.col("_record"), "Certificate verified by Rwanda Polytechnic portal")
        .when(kind == "poly", "Record not confirmed")
        .when(F.col("_record"), "Certificate record found online")
        .when(~F.col("_record"), "Record not found — possible fake")
        .otherwise("URL reachable but could not confirm record")
    )
    struct = F.struct(F.col("_record").alias("record_found"), holder.alias("holder"), message.alias("message"), kind.alias("kind"))
    return step.withColumn(out, struct).drop("_kind", "_up", "_record")


_PRINTED = "struct<url:string,serial:string>"


def printed_link(text: Column, payload: Column) -> Column:
    """What a text prints of its link: the address where there is no payload, the serial where the exam portal may be meant."""
    blank = F.coalesce(payload, F.lit("")) == ""
    exam = blank | F.contains(payload, F.lit("nesa.gov.rw"))
    return F.struct(F.when(blank, L.url_in_text(text)).alias("url"), F.when(exam, L.exam_serial(text)).alias("serial"))


def newest_pages(pages: DataFrame) -> DataFrame:
    """One page per address: the one fetched last, by fetched_at if the pages have it (then by status and content)."""
    order = [c for c in ("fetched_at", "http_status", "html") if c in pages.columns]
    found = pages.groupBy("url").agg(F.max_by(F.struct("http_status", "html"), F.struct(*order)).alias("_page"))
    return found.select("url", "_page.http_status", "_page.html")


def with_linked_pages(docs: DataFrame, pages: DataFrame, **names) -> DataFrame:
    """:func:`with_link_check` that judges only those of the fetched ``pages`` that some document links to."""
    addressed = with_link_address(docs, **{k: v for k, v in names.items() if k not in ("candidate", "out")})
    wanted = addressed.select(F.col("_key").alias("url")).distinct()
    judged = with_portal_verdict(newest_pages(pages.join(wanted, "url", "left_semi")))
    return with_link_verdict(addressed, judged, **{k: v for k, v in names.items() if k in ("candidate", "out")})


def with_link_check(docs: DataFrame, portal: DataFrame, candidate: str = "candidate_name", out: str = "link", **names) -> DataFrame:
    """Full verdict on a document's verification link; ``portal`` is the output of :func:`with_portal_verdict` (url unique).

    Other arguments are those of :func:`with_link_address`.
    """
    return with_link_verdict(with_link_address(docs, **names), portal, candidate, out)


def with_link_address(
    docs: DataFrame, payload: str = "payload", printed_text: str | None = None, printed: str | None = None, domains=None, institutions=None, as_of_year: int = fv.AS_OF_YEAR,
) -> DataFrame:
    """What a link says by itself, in helper columns; ``_key`` is the address of its page.

    Without a payload the address printed in the text counts, and so does a serial printed there where the
    address has none: taken from ``printed_text``, or from ``printed``, a column of :func:`printed_link` computed
    where the text is at hand.
    """
    raw = F.col(payload)
    if printed_text:
        docs = docs.withColumn("_printed", printed_link(F.col(printed_text), raw))
    elif printed:
        docs = docs.withColumn("_printed", F.col(printed))
    else:
        docs = docs.withColumn("_printed", F.lit(None).cast(_PRINTED))
    step = docs.withColumn("_code", F.when(F.coalesce(raw, F.lit("")) != "", raw))
    step = step.withColumn("_data", F.coalesce(F.col("_code"), F.col("_printed.url")))
    step = step.withColumn("_embedded", embedded_certificate(F.col("_data"), as_of_year))
    is_embedded = F.col("_embedded").isNotNull()
    step = step.withColumn("_url", F.when(~is_embedded, L.first_url(F.col("_data"))))
    step = step.withColumn("_facts", L.link_facts(F.col("_url")))
    step = step.withColumns({
        "_link_name": F.col("_facts.name"),
        "_serial": F.col("_facts.serial"),
        "_trusted": L.is_trusted(F.col("_url"), domains),
        "_inst": L.institution_of(F.col("_url"), institutions),
        "_domain": L.matched_domain(F.col("_url"), institutions),
    })
    step = step.withColumn("_serial", F.coalesce(F.col("_serial"), F.col("_printed.serial")))
    exam = F.contains(F.col("_url"), F.lit("nesa.gov.rw"))
    key = F.when(exam, F.concat(F.lit(EXAM_PORTAL), F.col("_serial"))).otherwise(F.col("_url"))
    # rows without an address match nothing: their join key only spreads them over the tasks
    spread = F.concat(F.lit(" "), F.spark_partition_id().cast("string"))
    return step.withColumn("_key", F.coalesce(key, spread))


def with_link_verdict(step: DataFrame, portal: DataFrame, candidate: str = "candidate_name", out: str = "link") -> DataFrame:
    """Joins the judged pages to rows of :func:`with_link_address` and settles the verdict.

    Pages are judged before the join, so the join carries only small columns; an address shared by many
    documents sits on the left side, which adaptive execution can split.
    """
    step = step.join(portal.select(F.col("url").alias("_key"), F.col("portal").alias("_portal")), "_key", "left")

    cand = F.coalesce(F.col(candidate), F.lit(""))
    url, link_name = F.col("_url"), F.col("_link_name")
    exam = F.coalesce(F.contains(url, F.lit("nesa.gov.rw")), F.lit(False))
    # without a serial the exam portal answers, but confirms nothing
    no_serial = exam & F.col("_serial").isNull()
    reached = F.col("_portal").isNotNull() | no_serial
    record = F.col("_portal.record_found")
    confirmed = F.coalesce(record, F.lit(False))
    trusted_name = F.when(F.col("_trusted"), link_name)
    # an unconfirmed general page still lends the holder name of a trusted link
    page_holder = F.coalesce(F.col("_portal.holder"), F.when(~exam, trusted_name))
    holder = F.when(confirmed, F.coalesce(page_holder, link_name)).otherwise(link_name)
    by_page = F.when(
        F.col("_portal.holder").isNotNull() & (F.col("_portal.kind") != "exam"), page_name_match(F.col("_portal.holder"), cand)
    ).otherwise(names_match(page_holder, cand))
    online_match = F.when(confirmed & (cand != ""), F.coalesce(by_page, names_match(holder, cand)))
    late_match = F.when(online_match.isNull() & holder.isNotNull() & (cand != ""), names_match(holder, cand))
    step = step.withColumns({"_reached": reached, "_record": record, "_holder": holder, "_online": online_match, "_late": late_match})
    step = step.withColumn("_match", F.coalesce("_online", "_late"))
    step = step.withColumn("_verified", F.col("_reached") & F.coalesce("_record", F.lit(False)))
    emb = F.col("_embedded")
    emb_match = F.when((F.coalesce(emb["holder"], F.lit("")) != "") & (cand != ""), names_match(emb["holder"], cand))
    step = step.withColumn("_ematch", emb_match)

    verified, match, trusted = F.col("_verified"), F.col("_match"), F.col("_trusted")
    reached, record, holder = F.col("_reached"), F.col("_record"), F.col("_holder")
    online, ematch = F.col("_online"), F.col("_ematch")
    page_side = F.col("_portal.holder").isNotNull() & (F.col("_portal.kind") != "exam")
    detail = fmt("Name on certificate: '%s' %s %s candidate '%s'", holder, F.when(page_side, "—").otherwise("-"),
                 F.when(online, "MATCHES").otherwise("DOES NOT MATCH"), cand)
    found_text = F.when(F.col("_code").isNotNull(), "QR code detected on document").otherwise("Verification link found on document")
    late_case = online.isNull() & holder.isNotNull() & (cand != "")
    url_issues = texts(
        F.when(~trusted, fmt("QR URL domain is NOT recognized: %s", url)),
        F.when(verified & (online == F.lit(False)), F.concat(F.lit("⚠ NAME MISMATCH ONLINE: "), detail,
                                                            F.lit(" — This may be a borrowed certificate!"))),
        F.when(reached & (record == F.lit(False)),
               "Online check: Certificate not found in institution records — possible fake or altered document"),
        F.when(late_case & ~F.coalesce(match, F.lit(False)),
               fmt("Name mismatch from QR link: QR shows '%s' but candidate is '%s'", holder, cand)),
    )
    url_positives = texts(
        found_text,
        F.concat(F.lit("QR code links to: "), F.left(url, F.lit(70))),
        fmt("Certificate holder from QR link: %s", link_name),
        F.when(trusted & F.col("_inst").isNotNull(), fmt("QR URL belongs to trusted institution: %s", F.col("_inst")))
        .when(trusted, "QR URL belongs to a trusted Rwandan government domain"),
        F.when(verified, fmt("✓ ONLINE VERIFIED: Certificate record confirmed at %s", F.coalesce(F.col("_domain"), url))),
        F.when(verified & online, F.concat(F.lit("✓ NAME VERIFIED ONLINE: "), detail))
        .when(verified & holder.isNotNull() & online.isNull(), fmt("Certificate holder: %s", holder))
        .when(verified & holder.isNull() & (cand != ""),
              "Certificate verified online — name extraction not available (manual name check recommended)"),
        F.when(reached & record.isNull(), F.concat(F.lit("QR URL reachable — verify manually at: "), url))
        .when(~reached, F.concat(F.lit("QR URL could not be reached (network issue) — verify manually at: "), url)),
        F.when(late_case & match, fmt("Name from QR link matches candidate: %s", holder)),
    )
    emb_issues = texts(
        F.when(ematch == F.lit(False), fmt("⚠ NAME MISMATCH via MKU QR: QR shows '%s' but candidate is '%s' — "
                                           "possible borrowed certificate!", emb["holder"], cand)),
        F.when(~emb["format_valid"], emb["message"]),
    )
    emb_positives = texts(
        found_text,
        F.when(ematch, fmt("✓ NAME VERIFIED via MKU QR: '%s' matches candidate", emb["holder"])),
        F.when(emb["format_valid"], fmt("✓ MKU certificate number validated from QR: %s", emb["cert_number"])),
        F.when(emb["format_valid"], "Mount Kenya University certificate data verified from embedded QR"),
    )
    is_embedded, has_data, has_url = emb.isNotNull(), F.col("_data").isNotNull(), url.isNotNull()
    no_mismatch = ~F.coalesce(match == F.lit(False), F.lit(False))
    final_trust = trusted & (verified | ~F.coalesce(record == F.lit(False), F.lit(False))) & no_mismatch
    struct = F.struct(
        has_data.alias("found"),
        F.when(is_embedded, emb["format_valid"] & ~F.coalesce(ematch == F.lit(False), F.lit(False)))
        .otherwise(F.coalesce(final_trust, F.lit(False))).alias("trusted"),
        F.when(is_embedded | ~has_url, False).otherwise(verified).alias("verified_online"),
        F.when(is_embedded, ematch).when(has_url, match).alias("name_match"),
        F.when(is_embedded, emb["holder"]).when(has_url, holder).alias("holder"),
        F.when(is_embedded, "Mount Kenya University").otherwise(F.col("_inst")).alias("institution"),
        F.when(is_embedded, "mku.ac.ke").otherwise(F.col("_domain")).alias("matched_domain"),
        url.alias("url"),
        F.left(F.col("_data"), F.lit(200)).alias("data"),
        F.when(has_url, F.col("_serial")).alias("serial"),
        F.when(is_embedded, emb["message"])
        .when(has_url, F.coalesce(F.col("_portal.message"),
                                  F.when(no_serial, "NESA verification page requires certificate number"), F.lit("not fetched")))
        .otherwise("").alias("online_status"),
        F.when(is_embedded, emb_issues).when(has_url, url_issues)
        .when(has_data, texts("QR code found but contains no recognizable URL")).otherwise(no_texts()).alias("issues"),
        F.when(is_embedded, emb_positives).when(has_url, url_positives)
        .when(has_data, texts(found_text)).otherwise(no_texts()).alias("positives"),
    )
    helpers = ["_key", "_code", "_printed", "_data", "_embedded", "_url", "_facts", "_link_name", "_serial", "_trusted", "_inst", "_domain",
               "_portal", "_reached", "_record", "_holder", "_online", "_late", "_match", "_verified", "_ematch"]
    return step.withColumn(out, struct).drop(*helpers)
