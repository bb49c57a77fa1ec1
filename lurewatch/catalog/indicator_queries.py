"""Registered queries over indicator, URL, link and display functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.catalog.registry import query
from lurewatch.functions import fixed_values as fv
from lurewatch.functions import indicators, strings, urls
from lurewatch.operators.reputation import metadata_by_type
from lurewatch.operators.stats import text_entropy
from lurewatch.sources import fixtures as fx
from lurewatch.sources.tables import read_table

# Every indicator in five spellings, so that each classification branch is met.
SPELLED = """spelled AS (SELECT unnest([input, '  ' || upper(input) || ' ',
  regexp_replace(input, '^https?://', ''), 'www.' || input, input || ':80']) AS input FROM input_fx),
trimmed AS (SELECT input, trim(input) AS s FROM spelled)"""
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IS_IP = f"regexp_full_match(s, '{OCTET}\\.{OCTET}\\.{OCTET}\\.{OCTET}')"
IS_HASH = "regexp_full_match(s, '[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64}')"
SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"


def spelled(spark, d):
    i = F.col("input")
    return fx.inputs(spark, d).select(F.explode(F.array(
        i, F.concat(F.lit("  "), F.upper(i), F.lit(" ")), F.regexp_replace(i, "^https?://", ""),
        F.concat(F.lit("www."), i), F.concat(i, F.lit(":80")))).alias("input"))


def typed(spark, d, variant):
    t = spelled(spark, d).withColumn("t", indicators.detect_type(F.col("input"), variant))
    return t.select("input", F.col("t.type").alias("input_type"), F.col("t.value").alias("value"))


@query("fn_detect_type", f"""
WITH {SPELLED}
SELECT input, CASE WHEN s = '' THEN 'unknown' WHEN {IS_HASH} THEN 'hash' WHEN {IS_IP} THEN 'ip'
    WHEN regexp_matches(s, '^{SCHEME}') THEN 'url' WHEN regexp_matches(s, '{fv.DOMAIN_PATTERN}') THEN 'domain'
    WHEN regexp_matches(s, '[/?&=]') OR starts_with(s, 'www.') THEN 'url'
    WHEN contains(s, '.') THEN 'domain' ELSE 'unknown' END AS input_type,
  CASE WHEN {IS_HASH} THEN lower(s) WHEN {IS_IP} OR regexp_matches(s, '^{SCHEME}')
      OR regexp_matches(s, '{fv.DOMAIN_PATTERN}') THEN s
    WHEN (regexp_matches(s, '[/?&=]') AND NOT starts_with(s, 'http')) OR
      (NOT regexp_matches(s, '[/?&=]') AND starts_with(s, 'www.')) THEN 'http://' || s ELSE s END AS value
FROM trimmed""", "input_fx")
def _(spark, d):
    return typed(spark, d, "live")


@query("fn_detect_type_v2", f"""
WITH {SPELLED}
SELECT input, CASE WHEN {IS_HASH} THEN 'hash' WHEN {IS_IP} THEN 'ip'
    WHEN (contains(s, '//') OR starts_with(s, 'ftp:')) AND regexp_matches(s, '^{SCHEME}//[^/?#]') THEN 'url'
    WHEN regexp_matches(s, '{fv.DOMAIN_PATTERN}') THEN 'domain'
    WHEN regexp_matches(s, '[/?]') THEN 'url' ELSE 'unknown' END AS input_type,
  CASE WHEN {IS_HASH} THEN lower(s) ELSE s END AS value
FROM trimmed""", "input_fx")
def _(spark, d):
    return typed(spark, d, "strict")


@query("fn_type_hint", f"""
WITH {SPELLED}
SELECT input, CASE WHEN regexp_matches(s, '{fv.HINT_HASH}') THEN 'hash'
    WHEN regexp_matches(s, '{fv.HINT_IP}') THEN 'ip' WHEN regexp_matches(s, '{fv.HINT_URL}') THEN 'url'
    WHEN regexp_matches(s, '{fv.HINT_DOMAIN}') THEN 'domain' ELSE 'unknown' END AS input_type, s AS value
FROM trimmed""", "input_fx")
def _(spark, d):
    return typed(spark, d, "hint")


@query("fn_ipv6_canonical", """
WITH g AS (SELECT event_id, event_id % 65536 AS y, user_id % 65536 AS x FROM events),
h AS (SELECT event_id, x, y, printf('%x', x) AS hx, printf('%x', y) AS hy FROM g)
SELECT event_id, CASE event_id % 4
  WHEN 0 THEN '2001:DB8::' || upper(hy)
  WHEN 1 THEN 'FE80:0:0:' || upper(hx) || ':0:0:0:' || hy
  WHEN 2 THEN '1:0:0:2:0:0:' || printf('%04x', x) || ':' || printf('%04x', y)
  ELSE '64:ff9b::' || (y % 256) || '.' || (x % 256) || '.0.1' END AS input,
CASE event_id % 4
  WHEN 0 THEN '2001:db8::' || CASE WHEN y = 0 THEN '' ELSE hy END
  WHEN 1 THEN CASE WHEN x = 0 THEN 'fe80::' || CASE WHEN y = 0 THEN '' ELSE hy END
              WHEN y = 0 THEN 'fe80:0:0:' || hx || '::' ELSE 'fe80:0:0:' || hx || '::' || hy END
  WHEN 2 THEN CASE WHEN x = 0 AND y = 0 THEN '1:0:0:2::' WHEN x = 0 THEN '1:0:0:2::' || hy
              ELSE '1::2:0:0:' || hx || ':' || hy END
  ELSE '64:ff9b::' || CASE WHEN (y % 256) * 256 + x % 256 = 0 THEN '' ELSE
       printf('%x', (y % 256) * 256 + x % 256) || ':' END || '1' END AS canonical
FROM h""")
def _(spark, d):
    e = read_table(spark, d, "events")
    y, x = F.col("event_id") % 65536, F.col("user_id") % 65536
    text = (F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("2001:DB8::"), F.hex(y)))
            .when(F.col("event_id") % 4 == 1, F.concat(
                F.lit("FE80:0:0:"), F.hex(x), F.lit(":0:0:0:"), F.lower(F.hex(y))))
            .when(F.col("event_id") % 4 == 2, F.concat(
                F.lit("1:0:0:2:0:0:"), F.lower(F.lpad(F.hex(x), 4, "0")), F.lit(":"),
                F.lower(F.lpad(F.hex(y), 4, "0"))))
            .otherwise(F.concat(F.lit("64:ff9b::"), y % 256, F.lit("."), x % 256, F.lit(".0.1"))))
    staged = e.select("event_id", text.alias("input"))
    return staged.withColumn("canonical", indicators.ipv6(F.col("input")))


@query("fn_validators", f"""
WITH {SPELLED}
SELECT input, regexp_matches(s, '^{SCHEME}') AS is_url, regexp_matches(s, '{fv.HINT_IP}') AS is_ip,
  regexp_matches(s, '{fv.HINT_HASH}') AS is_hash FROM trimmed""", "input_fx")
def _(spark, d):
    s = strings.strip(F.col("input"))
    return spelled(spark, d).select("input", urls.is_url(s).alias("is_url"),
                                    indicators.looks_like_ip(s).alias("is_ip"),
                                    indicators.looks_like_hash(s).alias("is_hash"))


@query("fn_normalize_url", f"""
WITH {SPELLED}
SELECT s AS input, CASE WHEN regexp_matches(s, '^(http|https|ftp)://') THEN s ELSE 'http://' || s END AS url
FROM trimmed""", "input_fx")
def _(spark, d):
    s = spelled(spark, d).select(strings.strip(F.col("input")).alias("input"))
    return s.withColumn("url", urls.normalize_url(F.col("input")))


@query("fn_preprocess_url", f"""
WITH {SPELLED}, full_url AS (SELECT input, CASE WHEN starts_with(s, 'http://') OR starts_with(s, 'https://')
  THEN s ELSE 'http://' || s END AS u FROM trimmed)
SELECT input, CASE WHEN contains(regexp_replace(u, '^https?://', ''), '/') THEN u ELSE u || '/' END AS url
FROM full_url""", "input_fx")
def _(spark, d):
    return spelled(spark, d).withColumn("url", urls.preprocess_url(F.col("input")))


@query("flt_analyzable_url", """
SELECT event_id, u AS url FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://a.example/' || event_id
  WHEN 1 THEN 'chrome://settings/' || event_id WHEN 2 THEN 'about:blank' WHEN 3 THEN 'data:text/plain,' || event_id
  ELSE 'ftp://b.example/' || event_id END AS u FROM events)
WHERE regexp_extract(u, '^([a-z-]+):', 1) NOT IN
  ('chrome', 'chrome-extension', 'about', 'data', 'javascript', 'file')""")
def _(spark, d):
    i = F.col("event_id")
    u = (F.when(i % 5 == 0, F.concat(F.lit("https://a.example/"), i))
         .when(i % 5 == 1, F.concat(F.lit("chrome://settings/"), i))
         .when(i % 5 == 2, F.lit("about:blank")).when(i % 5 == 3, F.concat(F.lit("data:text/plain,"), i))
         .otherwise(F.concat(F.lit("ftp://b.example/"), i)))
    return read_table(spark, d, "events").select("event_id", u.alias("url")).filter(
        urls.analyzable(F.col("url")))


@query("fn_url_id", """
SELECT input, rtrim(translate(base64(encode(input)), '+/', '-_'), '=') AS url_id FROM input_fx""", "input_fx")
def _(spark, d):
    return fx.inputs(spark, d).withColumn("url_id", urls.url_id(F.col("input")))


# Each URL in spellings that raise different indicators.
BENT = """bent AS (SELECT unnest([input, 'http://' || regexp_replace(input, '^https?://', '') || '/login',
  replace(input, 'example', 'a-b-c-d.x.y') || '//verify/secure.php;v=1?n=12345678901',
  replace(input, '.example.', '.gq.') || '@' || upper(input) || '/' || repeat('x', 90)]) AS url FROM input_fx),
parts AS (SELECT url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
  regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\\-]*:', '') AS rest FROM bent),
split AS (SELECT url, scheme, regexp_extract(rest, '^//([^/?#]*)', 1) AS netloc,
  regexp_replace(regexp_replace(regexp_replace(rest, '^//[^/?#]*', ''), '[?#].*', ''),
    '^(.*/)?([^/;]*);[^/]*$', '\\1\\2') AS path FROM parts)"""


def bent(spark, d):
    i = F.col("input")
    return fx.inputs(spark, d).select(F.explode(F.array(
        i, F.concat(F.lit("http://"), F.regexp_replace(i, "^https?://", ""), F.lit("/login")),
        F.concat(F.replace(i, F.lit("example"), F.lit("a-b-c-d.x.y")),
                 F.lit("//verify/secure.php;v=1?n=12345678901")),
        F.concat(F.replace(i, F.lit(".example."), F.lit(".gq.")), F.lit("@"), F.upper(i), F.lit("/"),
                 F.lit("x" * 90)))).alias("url"))


@query("fn_suspicious_url_model", f"""
WITH {BENT}
SELECT url, CAST(length(regexp_replace(netloc, '[^.]', '', 'g')) > 3 AS INT)
  + CAST(regexp_matches(lower(netloc), '\\.(tk|ml|ga|cf|gq)') AS INT)
  + CAST(regexp_matches(url, '[0-9]{{10,}}') AS INT) + CAST(regexp_matches(url, '[^\\x00-\\x7F]') AS INT)
  + CAST(length(url) > 100 AS INT) + CAST(regexp_matches(lower(path), '{fv.MODEL_PATH_WORDS}') AS INT)
  + CAST(regexp_matches(lower(path), '{fv.MODEL_ACTION_PAGE}') AS INT) + CAST(contains(url, '@') AS INT)
  + CAST(contains(path, '//') AS INT) + CAST(length(regexp_replace(netloc, '[^-]', '', 'g')) > 2 AS INT)
  >= 2 AS suspicious FROM split""", "input_fx")
def _(spark, d):
    return bent(spark, d).withColumn("suspicious", urls.suspicious_by_model(F.col("url")))


@query("fn_suspicious_url_parse", f"""
WITH {BENT}
SELECT url, CAST(netloc <> trim(path, '/') AS INT) + CAST(len(string_split(netloc, '.')) > 3 AS INT)
  + CAST(regexp_matches(netloc, '[@_-]') AS INT)
  + CAST(regexp_matches(netloc, '\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}') AS INT)
  + CAST(length(url) > 100 AS INT) + CAST(regexp_matches(lower(path), '{fv.PARSE_PATH_WORDS}') AS INT)
  + CAST(scheme = 'http' AS INT) + CAST(regexp_matches(netloc, '[A-Z]{{4,}}') AS INT) >= 2 AS suspicious
FROM split""", "input_fx")
def _(spark, d):
    return bent(spark, d).withColumn("suspicious", urls.suspicious_by_parser(F.col("url")))


@query("fn_unwrap_redirect", """
SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 'https://g.example/r?url=' ELSE 'https://s' || (event_id % 97)
  || '.example.com/p/' || event_id || '?a=b&c=' || event_id END AS target FROM events""")
def _(spark, d):
    i = F.col("event_id")
    plain = F.concat(F.lit("https://s"), i % 97, F.lit(".example.com/p/"), i, F.lit("?a=b&c="), i)
    wrapped = F.when(i % 6 == 0, F.lit("https://g.example/r?url=")).otherwise(
        F.concat(F.lit("https://g.example/r?q=1&url="), F.url_encode(F.url_encode(plain))))
    return read_table(spark, d, "events").select(
        "event_id", urls.unwrap_redirect(wrapped).alias("target"))


@query("fn_normalize_links", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'go=https://a.example/' || event_id WHEN 1 THEN '=https://b.example/' || event_id
  WHEN 2 THEN 'x=https://c.example/' || event_id ELSE '' END AS links FROM events""")
def _(spark, d):
    i = F.col("event_id")
    null = F.lit(None).cast("string")
    item = F.struct(
        F.when(i % 4 == 0, F.lit(" go ")).when(i % 4 == 2, F.lit("x")).alias("text"),
        F.when(i % 4 == 0, F.concat(F.lit("https://a.example/"), i)).when(i % 4 == 3, F.lit(" "))
        .alias("url"),
        F.when(i % 4 == 1, F.concat(F.lit("https://b.example/"), i)).otherwise(null).alias("href"),
        F.when(i % 4 == 2, F.concat(F.lit("https://g.example/?url=https%3A%2F%2Fc.example%2F"), i))
        .alias("safeRedirectUrl"))
    links = urls.normalize_links(F.array(item))
    return read_table(spark, d, "events").select("event_id", F.array_join(F.transform(
        links, lambda x: F.concat_ws("=", x["text"], x["url"])), "|").alias("links"))


@query("fn_link_parts", """
SELECT input, string_split(input, '://')[1] AS protocol,
  coalesce(string_split(string_split(input, '://')[2], '/')[1], 'N/A') AS domain,
  CASE WHEN contains(string_split(input, '://')[2], '/')
    THEN '/' || regexp_replace(string_split(input, '://')[2], '^[^/]*/', '') ELSE 'N/A' END AS path,
  CAST(length(input) AS INTEGER) AS length FROM input_fx""", "input_fx")
def _(spark, d):
    return fx.inputs(spark, d).withColumn("p", urls.link_parts(F.col("input"))).select("input", "p.*")


@query("fn_base_url", """
SELECT id, coalesce(regexp_extract(nullif(regexp_extract(body, 'https?://[!$-_a-z]+'), ''), '^https?://[^/?#]*'), '-')
  AS base FROM email_fx""", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select(
        "id", F.coalesce(urls.base_url(F.col("body")), F.lit("-")).alias("base"))


@query("fn_to_local_time", """
SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'at ' || event_id
  ELSE strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') END AS local_time FROM events""")
def _(spark, d):
    stored = F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("at "), F.col("event_id"))).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return read_table(spark, d, "events").select(
        "event_id", strings.to_local_time(stored).alias("local_time"))


@query("fn_shannon_entropy_short", """
SELECT input, round(-sum(p * log2(p)), 6) AS entropy FROM (
  SELECT rn, any_value(input) AS input, count(*) / any_value(length(input)) AS p
  FROM (SELECT rn, input, unnest(string_split(input, '')) AS ch
        FROM (SELECT row_number() OVER () AS rn, input FROM input_fx)) GROUP BY rn, ch)
GROUP BY rn, input""", "input_fx")
def _(spark, d):
    return fx.inputs(spark, d).select(
        "input", (F.round(strings.entropy(F.col("input")), 6) + 0.0).alias("entropy"))


@query("fn_shannon_entropy", """
SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (
  SELECT doc_id, count(*) / any_value(length(text)) AS p
  FROM (SELECT doc_id, text, unnest(string_split(text, '')) AS ch FROM documents) GROUP BY doc_id, ch)
GROUP BY doc_id""")
def _(spark, d):
    rows = text_entropy(read_table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.round("entropy", 6).alias("entropy"))


SIZE = "n_chars * n_chars * (doc_id % 50)"


def _scaled(power):
    return f"printf('%.2f', floor(size / {1024**power} * 100 + 0.5) / 100)"


@query("fn_format", f"""
SELECT doc_id, format('{{:,}}', size) AS thousands,
  CASE WHEN size = 0 THEN 'N/A' WHEN size < 1024 THEN {_scaled(0)} || ' B' WHEN size < 1048576 THEN {_scaled(1)} || ' KB'
    WHEN size < 1073741824 THEN {_scaled(2)} || ' MB' ELSE {_scaled(3)} || ' GB' END AS shown_size,
  CASE WHEN size = 0 THEN 'N/A' ELSE strftime(make_timestamp(size * 1000000), '%-m/%-d/%Y') END AS shown_date,
  array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[^A-Za-z0-9_]+'),
    lambda p: CASE WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE p END), '') AS title,
  CASE WHEN length(text) > 40 THEN text[1:37] || '...' ELSE text END AS short
FROM (SELECT *, {SIZE} AS size FROM documents)""")
def _(spark, d):
    staged = read_table(spark, d, "documents").withColumn(
        "size", F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 50))
    size, text = F.col("size"), F.col("text")
    return staged.select(
        "doc_id", strings.thousands(size).alias("thousands"),
        strings.byte_size(size).alias("shown_size"), strings.epoch_date(size).alias("shown_date"),
        strings.title_case(text).alias("title"), strings.truncate(text, 40).alias("short"))


@query("fn_strip_tags", "SELECT page_id, regexp_replace(html, '<[^>]*>', '', 'g') AS text FROM pages")
def _(spark, d):
    return read_table(spark, d, "pages").select("page_id", strings.strip_tags(F.col("html")).alias("text"))


@query("fn_json_fields", """
SELECT key, CASE WHEN indicator_type = 'url' THEN indicator || '/final' ELSE 'N/A' END AS final_url,
  CASE WHEN indicator_type = 'url' THEN 'Unknown' ELSE 'N/A' END AS serving_ip,
  CASE indicator_type WHEN 'url' THEN 'final_url,serving_ip' WHEN 'domain' THEN 'creation_date,last_dns_records'
    WHEN 'ip' THEN 'country' WHEN 'hash' THEN 'size' ELSE '' END AS fields
FROM reports_fx""", "reports_fx")
def _(spark, d):
    reports = fx.reports(spark, d)
    meta = reports.select("key", metadata_by_type(reports).alias("metadata"))
    known = F.map_filter(F.from_json("metadata", "map<string,string>"), lambda k, v: v.isNotNull())
    return meta.select(
        "key", F.coalesce(F.get_json_object("metadata", "$.final_url"), F.lit("N/A")).alias("final_url"),
        F.coalesce(F.get_json_object("metadata", "$.serving_ip"), F.lit("N/A")).alias("serving_ip"),
        F.array_join(F.array_sort(F.map_keys(known)), ",").alias("fields"))
