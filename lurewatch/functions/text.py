"""E-mail text features as column expressions."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv
from lurewatch.functions.strings import (
    SPACE, contains_any, count_true, first_filled, let, strip, words)
from lurewatch.functions.urls import normalize_links


# Runs of two or more spaces, or a lone one that is not a blank.
UNEVEN_SPACE = SPACE + "{2,}|[" + SPACE + "&&[^ ]]"


def line_pattern(pattern: str) -> str:
    """Unicode, case-free, line-anchored Java form; ``\\s`` also covers U+001C to U+001F."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        if pattern.startswith(r"\s", i):
            out.append(r"\s\x1c-\x1f" if inside else r"[\s\x1c-\x1f]")
            i += 2
            continue
        if pattern[i] == "\\":
            out.append(pattern[i:i + 2])
            i += 2
            continue
        inside = {"[": True, "]": False}.get(pattern[i], inside)
        out.append(pattern[i])
        i += 1
    return "(?iumUd)" + "".join(out)


# Letters outside ASCII that a pattern without regard to case takes for i, s and k.
FOLDED = ["\u0131", "\u0130", "\u017f", "\u212a"]


def matches_any(c: Column, patterns: list[str], needs: dict[str, Column] | None = None) -> Column:
    """``needs`` holds cheap conditions that every match of a pattern meets; only where they hold is it searched."""
    out = F.lit(False)
    for pattern in patterns:
        found = c.rlike(line_pattern(pattern))
        out = out | (needs[pattern] & found if pattern in (needs or {}) else found)
    return out


def preprocess(c: Column) -> Column:
    """Lower-case, cut through ``subject:``, one-space words, URLs to ``URL``, single punctuation.

    HTML mails must be turned into text first (see ``html.visible_text``).
    """
    lowered = let(F.lower(F.coalesce(c, F.lit(""))), _cut_headers)
    spaced = F.trim(F.regexp_replace(lowered, UNEVEN_SPACE, " "))  # only lone blanks are left
    linked = F.regexp_replace(spaced, fv.URL_PATTERN, "URL")
    return F.regexp_replace(linked, r"([!?.]){2,}", "$1")


def _cut_headers(low: Column) -> Column:
    """Drop each stretch from a line start through ``subject:``; only the part up to the last
    mark is searched, so long mails stay linear."""
    tail = F.substring_index(low, "subject:", -1)
    upto = F.substring(low, F.lit(1), F.length(low) - F.length(tail))
    return F.when(F.contains(low, F.lit("subject:")), F.concat(
        F.regexp_replace(upto, r"(?msd)^.*?subject:", ""), tail)).otherwise(low)


def extract_html(c: Column) -> Column:
    """From the first ``<html`` to the last ``</html>``; without a closing tag the end is 6."""
    low = F.lower(c)
    start = F.locate("<html", low)
    tail = F.length(F.substring_index(low, "</html>", -1))
    end = F.when(F.contains(low, F.lit("</html>")), F.length(c) - tail).otherwise(F.lit(6))
    return F.when((start > 0) & (end > start - 1),
                  F.substring(c, start, end - start + 1)).otherwise(F.lit(""))


def basic_stats(c: Column, one_line: bool = False) -> Column:
    """struct(text_length, word_count, avg_word_length); with ``one_line`` blanks tell the words."""
    if one_line:
        return let(F.struct(F.length(c).alias("all"), F.length(F.replace(c, F.lit(" "))).alias("letters")), lambda n:
                   let(F.when(c != "", n["all"] - n["letters"] + 1).otherwise(F.lit(0)), lambda w: F.struct(
                       n["all"].alias("text_length"), w.alias("word_count"),
                       F.when(w > 0, n["letters"] / w).otherwise(F.lit(0.0)).alias("avg_word_length"))))
    return let(words(c), lambda w: F.struct(
        F.length(c).alias("text_length"),
        F.size(w).alias("word_count"),
        F.when(F.size(w) > 0, F.length(F.array_join(w, "")) / F.size(w))
        .otherwise(F.lit(0.0)).alias("avg_word_length")))


def char_ratios(c: Column) -> Column:
    n = F.greatest(F.length(c), F.lit(1))
    return F.struct(
        (F.regexp_count(c, F.lit(r"\p{IsUppercase}")) / n).alias("uppercase_ratio"),
        (F.regexp_count(c, F.lit(r"[\p{Nd}²³¹]")) / n).alias("digit_ratio"),
        (F.regexp_count(c, F.lit(r"[!-/:-@\[-`{-~]")) / n).alias("punctuation_ratio"))


def lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def head(ls: Column) -> Column:
    return F.array_join(F.slice(ls, 1, 5), "\n")


def foot(ls: Column) -> Column:
    return F.array_join(F.slice(ls, F.greatest(F.size(ls) - 4, F.lit(1)), F.lit(5)), "\n")


def _greeting(ls: Column, one_line: Column | None = None) -> Column:
    """From the lines, or from a text of ``one_line``."""
    needs = {} if one_line is None else dict.fromkeys(fv.GREETINGS, _starts(one_line, GREETING_STARTS))
    return let(head(ls) if one_line is None else one_line, lambda h: let(
        matches_any(h, fv.GREETINGS, needs), lambda g: F.struct(
            g.cast("int").alias("has_greeting"),
            (g & matches_any(h, [fv.PERSONAL_GREETING])).cast("int").alias("has_personal_greeting"))))


GREETING_STARTS = ["hi", "dear", "hello", "good", "greetings", "to"]


def _starts(c: Column, words_: list[str]) -> Column:
    """False only for texts that begin with none of the words (of at most 12 letters), in any case."""
    first = F.substring(c, 1, 12)
    out = F.octet_length(first) != F.length(first)
    for word in words_:
        out = out | F.lower(first).startswith(word)
    return out


def _signature(ls: Column, one_line: Column | None = None) -> Column:
    """From the lines, or from a text of ``one_line``."""
    text = foot(ls) if one_line is None else one_line
    marks = lambda f: F.struct(f.alias("f"), F.lower(f).alias("low"), contains_any(f, FOLDED).alias("folded"))

    def flags(m: Column) -> Column:
        low, folded = m["low"], m["folded"]
        company = {p: folded | contains_any(low, words_) for p, words_ in COMPANY_WORDS.items()}
        needs = {} if one_line is None else _signature_needs(low, folded)
        return let(matches_any(m["f"], fv.SIGNATURES, needs), lambda g: F.struct(
            g.cast("int").alias("has_signature"),
            (g & matches_any(m["f"], fv.COMPANY_SIGNATURES, company)).cast("int").alias("has_company_signature")))

    return let(text, lambda f: let(marks(f), flags))


COMPANY_WORDS = dict(zip(fv.COMPANY_SIGNATURES, (
    ["inc.", "corp.", "ltd.", "limited", "company"], ["department", "division", "team"], ["www."])))
SIGNATURE_ENDS = ["regards", "sincerely", "yours", "best", "cheers"]
SIGNATURE_STARTS = ["office:", "cell:", "tel:", "fax:", "email:"]


def _signature_needs(low: Column, folded: Column) -> dict[str, Column]:
    """What a match of each signature pattern needs in a text of one line, without a line end."""
    ends = F.rtrim(low, F.lit(", "))
    any_of = lambda tests: functools.reduce(lambda a, b: a | b, tests, folded)
    none = F.lit(False)
    return dict(zip(fv.SIGNATURES, (
        F.contains(low, F.lit("\u00a9")), any_of([F.contains(low, F.lit("system-generated"))]),
        let(ends, lambda e: any_of([e.endswith(w) for w in SIGNATURE_ENDS])), none, none, none,
        any_of([low.startswith(w) for w in SIGNATURE_STARTS]), low.startswith("www.")), strict=True))


def greeting(c: Column) -> Column:
    """struct(has_greeting, has_personal_greeting) from the first five lines."""
    return let(lines(c), lambda ls: _greeting(ls))


def signature(c: Column) -> Column:
    """struct(has_signature, has_company_signature) from the last five lines."""
    return let(lines(c), lambda ls: _signature(ls))


def lexicon_counts(c: Column, lexicon: dict[str, list[str]] | None = None) -> Column:
    """Per category the number of distinct phrases contained, and a flag."""
    terms = {category: [p.lower() for p in phrases] for category, phrases in (lexicon or fv.LEXICON).items()}
    every = sorted({p for phrases in terms.values() for p in phrases}, key=lambda p: (len(p), p))
    # A phrase that holds a shorter one is only searched where that one was found.
    part = {p: next((q for q in every if q in p), p) for p in every}
    name = {p: f"p{i}" for i, p in enumerate(every)}

    def counts(low: Column) -> Column:
        has = lambda p: F.contains(low, F.lit(p))
        short = F.struct(*[has(p).alias(name[p]) for p in every if part[p] == p])
        return let(short, lambda s: let(
            F.struct(*[(s[name[p]] if part[p] == p else s[name[part[p]]] & has(p)).alias(name[p]) for p in every]),
            lambda found: F.struct(*[count_true([found[name[p]] for p in phrases]).alias(category)
                                     for category, phrases in terms.items()])))

    def fields(n: Column) -> Column:
        out = []
        for category in terms:
            out += [n[category].alias(f"{category}_count"),
                    (n[category] > 0).cast("int").alias(f"contains_{category}")]
        return F.struct(*out)

    # The counts are bound: a count used twice would search the text twice.
    return let(let(F.lower(c), counts), fields)


def sensitive(c: Column) -> Column:
    return contains_any(F.lower(c), fv.SENSITIVE_KEYWORDS)


def html_features(html: Column) -> Column:
    filled = F.coalesce(html, F.lit(""))
    return F.struct(
        (filled != "").cast("int").alias("contains_html"),
        F.regexp_count(filled, F.lit("<[^>]+>")).alias("html_tag_count"))


def url_ratio(links: Column, word_count: Column) -> Column:
    n = F.size(links)
    return F.struct(
        n.alias("url_count"),
        F.size(F.filter(links, lambda x: x["suspicious"])).alias("suspicious_url_count"),
        F.when(word_count > 0, n / word_count).otherwise(F.lit(0.0)).alias("url_to_text_ratio"))


def link_manipulation(text: Column, html: Column, urls: Column) -> Column:
    """0-4: IP host, @ in URL, any URL above 100 characters, shortener host."""
    page = F.coalesce(html, F.lit(""))
    url = lambda c, pattern: F.contains(c, F.lit("://")) & c.rlike(pattern)
    return count_true([
        url(text, fv.IP_URL) | url(page, fv.IP_URL),
        url(text, fv.AT_URL) | url(page, fv.AT_URL),
        F.exists(urls, lambda u: F.length(u) > 100),
        let(F.lower(text), lambda low: contains_any(low, fv.SHORTENERS))
        | let(F.lower(page), lambda low: contains_any(low, fv.SHORTENERS)),
    ])


def features(text: Column, html: Column, links: Column, one_line: bool = False) -> Column:
    """The whole feature record. Empty text keeps every default except its length.

    Each part is bound once: field access on an unbound part would evaluate it per field. ``one_line`` says
    that the text is as ``preprocess`` leaves it: words between lone blanks, no other space.
    """
    zero = {"avg_word_length": 0.0, "url_to_text_ratio": 0.0, "uppercase_ratio": 0.0,
            "digit_ratio": 0.0, "punctuation_ratio": 0.0}
    empty = F.struct(*[
        (F.length(text) if k == "text_length" else F.lit(zero.get(k, 0))).alias(k)
        for k in FEATURE_FIELDS])

    def record(s: Column) -> Column:
        where = {**dict.fromkeys(("text_length", "word_count", "avg_word_length"), "basic"),
                 **dict.fromkeys(("has_greeting", "has_personal_greeting"), "greeting"),
                 **dict.fromkeys(("has_signature", "has_company_signature"), "signature"),
                 **dict.fromkeys(("uppercase_ratio", "digit_ratio", "punctuation_ratio"), "chars"),
                 **dict.fromkeys(("contains_html", "html_tag_count"), "markup"),
                 **{k: "lexicon" for c in fv.LEXICON for k in (f"contains_{c}", f"{c}_count")}}
        lex, urls, words_found = s["lexicon"], s["urls"], s["basic"]["word_count"]
        derived = {
            "url_count": urls["n"], "suspicious_url_count": urls["suspicious"],
            "url_to_text_ratio": F.when(words_found > 0, urls["n"] / words_found)
            .otherwise(F.lit(0.0)),
            "mismatched_links": s["manipulated"],
            "has_urgent_count": lex["urgent_count"], "has_threat_count": lex["threat_count"],
            "sensitive_info_requested":
                ((lex["financial_count"] + lex["personal_count"]) > 0).cast("int")}
        return F.struct(*[
            (derived[k] if k in derived else s[where[k]][k]).alias(k) for k in FEATURE_FIELDS])

    line = text if one_line else None

    def parts(ls: Column) -> Column:
        blank = text == "" if one_line else F.size(ls) == 0
        return F.when(blank, empty).otherwise(let(F.struct(
            basic_stats(text, one_line).alias("basic"), lexicon_counts(text).alias("lexicon"),
            _greeting(ls, line).alias("greeting"), _signature(ls, line).alias("signature"),
            char_ratios(text).alias("chars"), html_features(html).alias("markup"),
            F.struct(F.size(links).alias("n"), F.size(F.filter(links, lambda x: x["suspicious"]))
                     .alias("suspicious")).alias("urls"),
            link_manipulation(text, html, F.transform(links, lambda x: x["url"]))
            .alias("manipulated")), record))

    return parts(text) if one_line else let(lines(text), parts)


FEATURE_FIELDS = [
    "text_length", "word_count", "avg_word_length", "has_greeting", "has_personal_greeting",
    "has_signature", "has_company_signature", "url_count", "suspicious_url_count",
    "url_to_text_ratio", "uppercase_ratio", "digit_ratio", "punctuation_ratio", "contains_html",
    "html_tag_count", "mismatched_links", "has_urgent_count", "has_threat_count",
    "sensitive_info_requested",
    *[k for c in fv.LEXICON for k in (f"contains_{c}", f"{c}_count")],
]


def service_email(body: Column, sender: Column) -> Column:
    """At least three of five marks of a legitimate service mail."""
    def marks(low: Column) -> Column:
        found = lambda p: body.rlike("(?i)" + p)
        return count_true([
            F.coalesce(sender, F.lit("")).rlike(fv.SERVICE_SENDER),
            *[contains_any(low, SERVICE_WORDS[p]) & found(p) if p in SERVICE_WORDS else found(p) for p in fv.SERVICE_BODY],
        ]) >= 3

    return let(F.lower(body), marks)


# A match of the pattern holds one of the words.
SERVICE_WORDS = {
    fv.SERVICE_BODY[0]: ["account information", "your account"],
    fv.SERVICE_BODY[1]: ["help center", "customer support", "contact us"],
    fv.SERVICE_BODY[3]: ["unsubscribe", "opt"],
}


def service_language(body: Column) -> Column:
    return count_true([F.lower(body).rlike(p) for p in fv.SERVICE_LANGUAGE]) >= 2


def header_findings(headers: Column) -> Column:
    """Findings about a header map; empty for an empty or missing map."""
    value = lambda k: F.try_element_at(headers, F.lit(k))
    found = [F.when(~F.map_contains_key(headers, k), F.lit(f"Missing {k} header"))
             for k in fv.REQUIRED_HEADERS]
    found.append(F.when(
        F.map_contains_key(headers, "Return-Path")
        & ~value("Return-Path").eqNullSafe(F.coalesce(value("From"), F.lit(""))),
        F.lit("Mismatched Return-Path and From headers")))
    found += [F.when(F.map_contains_key(headers, k), F.lit(f"Suspicious header found: {k}"))
              for k in fv.SUSPICIOUS_HEADERS]
    return F.when(headers.isNull() | (F.size(headers) == 0), F.array().cast("array<string>")) \
        .otherwise(F.array_compact(F.array(*found)))


def attachment_info(attachments: Column) -> Column:
    """Size and digests of attachments given as struct(filename, content_type, data)."""
    return F.transform(attachments, lambda a: F.struct(
        a["filename"].alias("filename"),
        F.octet_length(a["data"]).cast("bigint").alias("size"),
        a["content_type"].alias("content_type"),
        F.struct(F.md5(a["data"]).alias("md5"), F.sha1(a["data"]).alias("sha1"),
                 F.sha2(a["data"], 256).alias("sha256")).alias("hash")))


def tokens(c: Column) -> Column:
    """Words of two or more characters, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


# Link items may be text or objects, so they arrive as text and are parsed item by item.
PAYLOAD = (
    "subject string, `from` string, sender string, body string, text string, html string, "
    "html_content string, headers struct<subject:string,fromEmail:string>, "
    "links array<string>, attachments array<string>")
LINK_ITEM = "text string, url string, href string, safeRedirectUrl string"


def parse_payload(content: Column) -> Column:
    """E-mail payload JSON to struct(subject, sender, body, html, links, attachments).

    Several key spellings are accepted; text that is not a JSON object becomes the body.
    """
    def record(p: Column) -> Column:
        links = F.transform(
            F.coalesce(p["links"], F.array().cast("array<string>")),
            lambda raw: F.when(raw.startswith("{"), F.from_json(raw, LINK_ITEM)).otherwise(
                F.struct(F.lit("").alias("text"), raw.alias("url"),
                         F.lit("").alias("href"), F.lit("").alias("safeRedirectUrl"))))
        return F.struct(
            first_filled(p["subject"], p["headers"]["subject"]).alias("subject"),
            first_filled(p["from"], p["sender"], p["headers"]["fromEmail"]).alias("sender"),
            F.when(is_object, first_filled(p["body"], p["text"]))
            .otherwise(content).alias("body"),
            first_filled(p["html"], p["html_content"]).alias("html"),
            normalize_links(links).alias("links"),
            F.coalesce(p["attachments"], F.array().cast("array<string>")).alias("attachments"))

    is_object = F.json_object_keys(F.when(content.rlike(r"^\s*\{"), content)).isNotNull()
    return let(F.from_json(content, PAYLOAD), record)
