"""Person-name columns: normal forms, holder-name extraction and comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence import fixed_values as fv
from credence.functions.text import all_groups, bind, contains_any, literal_list, no_texts, text_lines, uni


WHITE_SPACE = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029"


def normal_name(c: Column) -> Column:
    """Upper case, anything but letters, spaces and apostrophes to one space, trimmed."""
    return F.btrim(F.regexp_replace(F.upper(c), uni(r"[^A-Z\s']+"), " "), F.lit(WHITE_SPACE))


def name_parts(c: Column) -> Column:
    """Words of two letters or more that are not stop words."""
    words = all_groups(F.upper(c), r"\b[A-Z']{2,}\b")
    return F.filter(words, lambda w: ~w.isin(fv.NAME_STOP_WORDS))


def letters_only(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z]+", "")


def phrase_in_text(phrase: Column, text: Column) -> Column:
    """The phrase between word boundaries; an empty phrase is never found."""
    clean = F.trim(phrase)
    bounded = F.concat(F.lit(r"(?U)\b\Q"), clean, F.lit(r"\E\b"))
    return (clean != "") & text.contains(clean) & F.rlike(text, bounded)


def _holder_words(raw: Column) -> Column:
    words = F.split(F.regexp_replace(raw, uni(r"[^A-Z\s']+"), " "), uni(r"\s+"))
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(fv.NAME_STOP_WORDS))


def anchored_holder(upper: Column) -> Column:
    """Name inside one of the certificate phrases; first phrase giving 2 to 4 words."""
    found = []
    for needed, pattern in fv.HOLDER_ANCHORS:
        present = F.lit(True)
        for word in needed:
            present = present & upper.contains(word)
        words = F.when(present, _holder_words(F.regexp_extract(upper, uni(pattern), 1)))
        found.append(F.when(F.size(words).between(2, 4), F.array_join(words, " ")))
    return F.coalesce(*found)


def labelled_holders(upper: Column) -> Column:
    """Names after a label such as NAME:."""
    lists = []
    for pattern in fv.HOLDER_LABELS:
        guard = contains_any(upper, ["NAME", "NOM", "AMAZINA", "IZINA"])
        raw = F.when(guard, all_groups(upper, pattern, 1)).otherwise(no_texts())
        lists.append(F.transform(raw, lambda r: F.array_join(_holder_words(r), " ")))
    return F.filter(F.concat(*lists), lambda n: F.length(n) > 1)


def line_names(upper: Column) -> Column:
    """Lines that read like a name: 2 to 4 words, no digit, no field of study."""
    lines = F.filter(text_lines(upper), lambda s: ~s.rlike(uni(r"\d")) & (F.trim(s) != ""))
    as_words = F.transform(lines, name_parts)
    kept = F.filter(
        as_words,
        lambda ws: F.size(ws).between(2, 4)
        & ~F.arrays_overlap(ws, literal_list(fv.FIELD_OF_STUDY_WORDS))
        & ~F.exists(ws, lambda w: (F.length(w) > 12) & ~w.rlike("[AEIOU]")),
    )
    return F.transform(kept, lambda ws: F.array_join(ws, " "))


def holder_names(text: Column) -> Column:
    """Person names on a document: the anchored one, else at most 4 in alphabetical order."""
    upper = F.upper(text)
    candidates = F.array_distinct(F.concat(labelled_holders(upper), line_names(upper)))
    full = F.filter(candidates, lambda n: ~n.rlike(uni(r"(^|\s)\S{1,2}(\s|$)")))
    # a one-element list, NULL when there is no anchored name; the text is searched once
    anchored = F.split(anchored_holder(upper), "\n")
    return F.coalesce(anchored, F.slice(F.array_sort(full), 1, 4))


def clean_person_name(raw: Column) -> Column:
    """A person name out of a link part or page line, NULL when it does not look like one."""
    decoded = F.coalesce(F.try_url_decode(raw), raw)
    spaced = F.translate(decoded, "+_-", "   ")
    letters = F.regexp_replace(spaced, uni(r"[^A-Za-z\s']"), " ")
    single = F.trim(F.regexp_replace(letters, uni(r"\s+"), " "))
    head = F.trim(F.element_at(F.split(single, "(?iU)" + fv.PERSON_NAME_END, 2), 1))

    def judge(words: Column) -> Column:
        blocked = F.arrays_overlap(words, literal_list(fv.PERSON_NAME_BLOCKED))
        return F.when(F.size(words).between(2, 5) & ~blocked, F.array_join(words, " "))

    def name(h: Column) -> Column:
        words = F.filter(F.split(F.upper(h), " "), lambda w: F.length(w) > 1)
        return F.when(F.length(h) >= 4, bind(words, judge))

    return bind(head, name)


def _long_parts(name: Column) -> Column:
    return F.filter(F.split(F.trim(F.upper(name)), uni(r"\s+")), lambda p: F.length(p) > 2)


def names_match(certificate: Column, candidate: Column) -> Column:
    """Three-valued: share of the certificate's name parts found in the candidate name."""
    left, right = F.trim(F.upper(certificate)), F.trim(F.upper(candidate))
    ours, theirs = _long_parts(certificate), _long_parts(candidate)
    hits = F.size(F.filter(ours, lambda p: F.contains(right, p)))
    given = (F.coalesce(certificate, F.lit("")) != "") & (F.coalesce(candidate, F.lit("")) != "")
    return (
        F.when(~given, None)
        .when(left == right, True)
        .when((F.size(ours) == 0) | (F.size(theirs) == 0), None)
        .otherwise(hits / F.size(ours) >= 0.6)
    )


def page_name_match(extracted: Column, candidate: Column) -> Column:
    """Three-valued, the other direction: share of the candidate's parts found in the page name."""
    parts = _long_parts(candidate)
    hits = F.size(F.filter(parts, lambda p: F.contains(extracted, p)))
    given = (F.coalesce(extracted, F.lit("")) != "") & (F.coalesce(candidate, F.lit("")) != "")
    ratio = F.when(F.size(parts) > 0, hits / F.size(parts)).otherwise(0.0)
    return F.when(given, ratio >= 0.6)
