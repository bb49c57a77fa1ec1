"""URL parsing, suspicion rules and link helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv
from lurewatch.functions.strings import blank_to_null, contains_any, count_true, let, strip

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def split_url(c: Column) -> Column:
    """Lenient split into struct(scheme, netloc, path, query, malformed)."""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(u: Column) -> Column:
        after = F.regexp_replace(u, SCHEME, "")
        located = let(after, lambda r: F.struct(
            F.regexp_extract(r, r"^//([^/?#]*)", 1).alias("netloc"),
            F.regexp_replace(r, r"^//[^/?#]*", "").alias("tail")))
        return let(located, lambda s: F.struct(
            F.lower(F.regexp_extract(u, SCHEME, 1)).alias("scheme"),
            s["netloc"].alias("netloc"),
            F.regexp_replace(F.regexp_replace(s["tail"], r"(?s)[?#].*", ""),
                             r"^(.*/)?([^/;]*);[^/]*$", "$1$2").alias("path"),
            F.regexp_extract(s["tail"], r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"),
            (F.contains(s["netloc"], F.lit("[")) != F.contains(s["netloc"], F.lit("]")))
            .alias("malformed")))

    return let(cleaned, parts)


def suspicious_by_model(url: Column) -> Column:
    """Ten indicators; two or more (or an unparseable URL) make the URL suspicious."""
    return let(split_url(url), lambda p: p["malformed"] | (count_true([
        F.length(F.regexp_replace(p["netloc"], r"[^.]", "")) > 3,
        contains_any(F.lower(p["netloc"]), fv.MODEL_TLDS),
        url.rlike(r"[0-9]{10,}"),
        url.rlike(r"[^\x00-\x7F]"),
        F.length(url) > 100,
        F.lower(p["path"]).rlike(fv.MODEL_PATH_WORDS),
        F.lower(p["path"]).rlike(fv.MODEL_ACTION_PAGE),
        F.contains(url, F.lit("@")),
        F.contains(p["path"], F.lit("//")),
        F.length(F.regexp_replace(p["netloc"], r"[^\-]", "")) > 2,
    ]) >= 2))


def suspicious_by_parser(url: Column) -> Column:
    """Eight indicators of the mail-file reader; two or more make the URL suspicious."""
    return let(split_url(url), lambda p: p["malformed"] | (count_true([
        p["netloc"] != F.regexp_replace(p["path"], r"^/+|/+$", ""),
        F.size(F.split(p["netloc"], r"\.")) > 3,
        p["netloc"].rlike(r"[@_\-]"),
        p["netloc"].rlike(r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"),
        F.length(url) > 100,
        F.lower(p["path"]).rlike(fv.PARSE_PATH_WORDS),
        p["scheme"] == "http",
        p["netloc"].rlike(r"[A-Z]{4,}"),
    ]) >= 2))


def normalize_url(c: Column) -> Column:
    return F.when(c.rlike(r"^(?:https?|ftp)://"), c).otherwise(F.concat(F.lit("http://"), c))


def preprocess_url(c: Column) -> Column:
    """Trim, default to http, and make sure there is a path."""
    s = strip(c)
    full = F.when(s.rlike(r"^https?://"), s).otherwise(F.concat(F.lit("http://"), s))
    return F.when(full.rlike(r"(?s)^[^:]*://.*/"), full).otherwise(F.concat(full, F.lit("/")))


def analyzable(c: Column) -> Column:
    """False for URLs that only mean something inside a browser."""
    return ~split_url(c)["scheme"].isin(fv.BROWSER_SCHEMES)


def url_id(c: Column) -> Column:
    """URL-safe base64 without padding, as one line."""
    return F.rtrim(
        F.translate(F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", ""), "+/", "-_"),
        F.lit("="))


def is_url(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull()


def _percent_decode(c: Column) -> Column:
    """Decode; a percent sign without two hex digits stands for itself."""
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def unwrap_redirect(c: Column) -> Column:
    """Target of a ``?url=`` redirect, decoded twice; the URL itself if there is none."""
    value = F.regexp_extract(split_url(c)["query"], r"(?:^|&)url=([^&]+)", 1)
    once = _percent_decode(value)
    twice = _percent_decode(F.replace(once, F.lit("+"), F.lit("%2B")))
    return F.coalesce(blank_to_null(twice), c)


def link_parts(c: Column) -> Column:
    """Display parts: protocol, domain, path (N/A when absent) and length."""
    rest = F.get(F.split(c, "://"), F.lit(1))
    return F.struct(
        F.get(F.split(c, "://"), F.lit(0)).alias("protocol"),
        F.coalesce(F.substring_index(rest, "/", 1), F.lit("N/A")).alias("domain"),
        F.when(F.contains(rest, F.lit("/")),
               F.concat(F.lit("/"), F.regexp_replace(rest, r"(?s)^[^/]*/", "")))
        .otherwise(F.lit("N/A")).alias("path"),
        F.length(c).alias("length"))


def text_urls(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({fv.URL_PATTERN})"), F.lit(1))


def base_url(text: Column) -> Column:
    """scheme://netloc of the first URL in a text, null when there is none."""
    first = blank_to_null(F.regexp_extract(text, f"({fv.URL_PATTERN})", 1))
    return F.regexp_extract(first, r"^(https?://[^/?#]*)", 1)


def normalize_links(links: Column) -> Column:
    """Links as struct(text, url, href, safeRedirectUrl) to struct(text, url), redirects unwrapped."""
    picked = F.transform(links, lambda x: F.struct(
        F.coalesce(strip(x["text"]), F.lit("")).alias("text"),
        unwrap_redirect(strip(F.coalesce(
            blank_to_null(x["url"]), blank_to_null(x["href"]),
            blank_to_null(x["safeRedirectUrl"]), F.lit("")))).alias("url")))
    return F.filter(picked, lambda x: x["url"] != "")
