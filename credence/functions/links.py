"""Links and pages: URL extraction, query parts, trust, serial repair, HTML to text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.names import clean_person_name
from credence.functions.text import bind, contains_any, first_group, first_listed, literal_list, no_texts, none_if_empty, text_lines, uni


def first_url(payload: Column) -> Column:
    """First http(s) address, else a bare national domain with https in front."""
    full = F.regexp_extract(payload, uni(r"https?://[^\s\"'<>]+"), 0)
    # the domain pattern is slow on long unbroken text, so its ending is looked for first
    national = contains_any(payload, [".rw", ".ke"])
    bare = F.when(national, F.regexp_extract(payload, uni(r"(?:www\.)?[\w\-]+\.(?:ac\.rw|gov\.rw|rw|ke)[^\s]*"), 0))
    return F.coalesce(none_if_empty(full), F.concat(F.lit("https://"), none_if_empty(bare)))


def url_in_text(text: Column) -> Column:
    """Address printed on a document: all white space removed first."""
    compact = F.regexp_replace(text, uni(r"\s+"), "")
    exam_site = compact.rlike(r"(?i)graduate\.?nesa\.?gov\.?rw")
    return F.when(exam_site, F.lit("https://graduate.nesa.gov.rw")).otherwise(first_url(compact))


def query_pairs(url: Column) -> Column:
    """Array of (key, value) of the query part, decoded, in order; pairs without a value are left out."""
    whole = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    decoded = lambda c: F.coalesce(F.try_url_decode(c), F.translate(c, "+", " "))
    parts = F.filter(F.split(whole, "&"), lambda p: p.rlike("=."))
    pair = lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("key"), decoded(F.substr(p, F.position(F.lit("="), p) + 1)).alias("value"))
    return F.transform(F.when(F.contains(url, F.lit("?")), parts).otherwise(no_texts()), pair)


def path_parts(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def certificate_no(url: Column) -> Column:
    return first_group(url, r"certificate_no=(\w+)")


def is_trusted(url: Column, domains=None) -> Column:
    """A trusted domain anywhere in the address."""
    return contains_any(F.lower(url), domains or fv.TRUSTED_DOMAINS)


def is_trusted_host(url: Column, domains=None) -> Column:
    """The safe variant: the host is a trusted domain or lies below one."""
    name = host(url)
    found = F.lit(False)
    for domain in domains or fv.TRUSTED_DOMAINS:
        found = found | (name == domain) | name.endswith("." + domain)
    return found


def institution_of(url: Column, pairs=None) -> Column:
    return first_listed(F.lower(url), pairs or fv.INSTITUTION_BY_DOMAIN)


def matched_domain(url: Column, pairs=None) -> Column:
    return first_listed(F.lower(url), [(d, d) for d, _ in pairs or fv.INSTITUTION_BY_DOMAIN])


def _repaired(compact: Column) -> Column:
    """Serial out of compact upper-case letters and digits."""
    runs = F.regexp_extract_all(compact, F.lit("A[A-Z0-9]{6,12}"), F.lit(0))
    heads = F.transform(runs, lambda r: F.left(r, F.lit(9)))
    digital = F.filter(heads, lambda h: F.regexp_count(h, F.lit("[0-9]")) >= 4)
    fixed = F.transform(digital, lambda h: F.translate(h, fv.SERIAL_LETTERS, fv.SERIAL_DIGITS))
    return F.get(F.filter(fixed, lambda s: s.rlike(r"^A[0-9]{8}$")), F.lit(0))


def exam_serial(text: Column) -> Column:
    """Certificate serial A + 8 digits, misread letters repaired."""
    whole = _repaired(F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", "")))
    spaced = F.regexp_extract(F.upper(text), r"A\s*([0-9OQILNZSBE]\s*){8}", 0)
    return F.coalesce(whole, _repaired(F.regexp_replace(spaced, "[^A-Z0-9]", "")))


def is_exam_serial(text: Column) -> Column:
    return F.upper(F.trim(text)).rlike(r"^A[0-9]{8}$")


def _first_made(values: Column, make) -> Column:
    """First value the function makes something of."""
    return F.get(F.filter(F.transform(values, make), lambda v: v.isNotNull()), F.lit(0))


def _in_key_order(pairs: Column, keys: list[str], fold) -> Column:
    """Values of the listed keys, key by key in listed order; ``fold`` makes a key as listed, or NULL."""
    listed = literal_list(keys)
    placed = F.transform(pairs, lambda p, i: F.struct(F.array_position(listed, fold(p["key"])).alias("at"), i.alias("i"), p["value"].alias("value")))
    return F.transform(F.array_sort(F.filter(placed, lambda p: p["at"] > 0)), lambda p: p["value"])


def _last_spelling(pairs: Column) -> Column:
    """Of keys that differ in case only, the pairs of the spelling that came up last."""
    def newest(pair):
        same = F.filter(pairs, lambda p: F.lower(p["key"]) == F.lower(pair["key"]))
        return F.element_at(F.array_distinct(F.transform(same, lambda p: p["key"])), -1) == pair["key"]

    return F.when(F.size(pairs) > 1, F.filter(pairs, newest)).otherwise(pairs)


def _serials(pairs: Column) -> Column:
    """Values of the serial keys as listed, else of the same key in capitals."""
    lower = F.transform(pairs, lambda p: p["key"])
    fold = lambda k: F.when((k == F.lower(k)) | ((k == F.upper(k)) & ~F.array_contains(lower, F.lower(k))), F.lower(k))
    return _in_key_order(pairs, fv.SERIAL_KEYS, fold)


def _names(pairs: Column) -> Column:
    """Values of the name keys in any case, then first and last name."""
    def named(live):
        value = lambda *keys: F.get(_in_key_order(live, list(keys), F.lower), F.lit(0))
        both = F.concat(value("first_name", "firstname"), F.lit(" "), value("last_name", "lastname"))
        return F.array_compact(F.concat(_in_key_order(live, fv.NAME_KEYS, F.lower), F.array(both)))

    return bind(_last_spelling(pairs), named)


def link_facts(url: Column) -> Column:
    """Struct of name and serial in an address; query and path are parsed once.

    The name comes from the name keys, first and last name, or a part of the path from its end; the
    serial from the serial keys or a part of the path.
    """
    def facts(link):
        pairs, path = link["pairs"], link["path"]
        keyed = F.size(pairs) > 0
        names = F.when(keyed, _names(pairs)).otherwise(no_texts())
        serials = F.when(keyed, _serials(pairs)).otherwise(no_texts())
        return F.struct(
            _first_made(F.concat(names, F.reverse(path)), clean_person_name).alias("name"),
            _first_made(F.concat(serials, path), exam_serial).alias("serial"))

    parsed = F.struct(query_pairs(url).alias("pairs"), path_parts(url).alias("path"))
    return F.when(url.isNotNull(), bind(parsed, facts))


def exam_serial_of_url(url: Column) -> Column:
    return link_facts(url)["serial"]


def name_in_url(url: Column) -> Column:
    """Holder name from query keys, first + last name, or path parts from the end."""
    return link_facts(url)["name"]


def html_text(html: Column, separator: str = "\n") -> Column:
    """Visible text of a page; tags become the separator."""
    visible = F.regexp_replace(html, r"(?is)<(script|style|template)\b.*?</(script|style|template)\s*>", "")
    visible = F.regexp_replace(visible, r"(?s)<!--.*?-->|<![^>]*>", "")
    plain = F.regexp_replace(visible, r"<[^>]*>", separator)
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return plain


def page_verdict(upper: Column) -> Column:
    """General page: certificate words win, errors alone mean not found, neither is unknown."""
    good, bad = contains_any(upper, fv.PAGE_WORDS), contains_any(upper, fv.PAGE_ERRORS)
    return F.when(good, True).when(bad, False)


def polytechnic_verdict(upper: Column) -> Column:
    good = contains_any(upper, fv.POLYTECHNIC_PAGE_WORDS)
    return good & ~contains_any(upper, fv.POLYTECHNIC_PAGE_ERRORS)


def exam_verdict(upper: Column) -> Column:
    good = F.contains(upper, F.lit("VALID")) & F.contains(upper, F.lit("GRADUATE NAME"))
    return good & ~contains_any(upper, fv.EXAM_PAGE_ERRORS)


def page_lines(text: Column) -> Column:
    lines = F.transform(text_lines(text), lambda s: F.trim(F.regexp_replace(s, uni(r"\s+"), " ")))
    return F.filter(lines, lambda s: s != "")


def _positions(lines: Column, last_offset: int) -> Column:
    """0 up to the size less the offset; empty for fewer lines."""
    return F.when(F.size(lines) >= last_offset, F.sequence(F.lit(0), F.size(lines) - last_offset)).otherwise(
        F.array().cast("array<int>")
    )


def _label_name(lines: Column) -> Column:
    def candidate(i):
        label = F.trim(F.regexp_replace(F.get(lines, i), ":+$", ""))
        return F.when(label.isin(fv.PAGE_NAME_LABELS), clean_person_name(F.get(lines, i + 1)))

    return _first_made(_positions(lines, 2), candidate)


def _registration_name(lines: Column) -> Column:
    def candidate(i):
        before = F.reverse(F.slice(lines, F.greatest(i - 4, F.lit(1)), F.least(i, F.lit(5))))
        return F.when((i > 0) & F.get(lines, i).rlike(uni(fv.REGISTRATION_LINE)), _first_made(before, clean_person_name))

    return _first_made(_positions(lines, 1), candidate)


def name_after_label(lines: Column) -> Column:
    """Name on the line after a line that is only a label."""
    return bind(lines, _label_name)


def name_before_registration(lines: Column) -> Column:
    """Nearest name on the five lines before a registration-number line."""
    return bind(lines, _registration_name)


def name_on_page(upper: Column) -> Column:
    """Holder name printed on a verification page: label line, phrases, then before a registration line."""
    phrases = F.array(*[
        F.when(contains_any(upper, needed), none_if_empty(F.regexp_extract(upper, "(?mdU)" + p, 1))) for needed, p in fv.PAGE_NAME_PATTERNS
    ])
    labelled = F.when(contains_any(upper, ["NAME", "GRADUATE"]), name_after_label(page_lines(upper)))
    registration = F.when(F.contains(upper, F.lit("REG")), name_before_registration(page_lines(upper)))
    return F.coalesce(labelled, _first_made(phrases, clean_person_name), registration)


def name_on_exam_page(upper: Column) -> Column:
    """Holder name of the examination portal: the labelled phrase, else the rest of or the line after the label."""
    labelled = F.contains(upper, F.lit("GRADUATE"))
    phrase = F.when(labelled, none_if_empty(F.regexp_extract(upper, "(?mdU)" + fv.EXAM_PAGE_NAME, 1)))

    def by_line(lines):
        def candidate(i):
            tail = F.trim(F.get(F.split(F.get(lines, i), r"[:\-]", 2), F.lit(1)))
            own = F.when(F.coalesce(tail, F.lit("")) != "", tail)
            return _first_made(F.array(own, F.get(lines, i + 1)), clean_person_name)

        at = F.filter(_positions(lines, 2), lambda i: F.get(lines, i).rlike(uni(r"GRADUATE\s+NAME")))
        return bind(F.get(at, F.lit(0)), candidate)

    return F.coalesce(clean_person_name(phrase), F.when(labelled, bind(page_lines(upper), by_line)))
