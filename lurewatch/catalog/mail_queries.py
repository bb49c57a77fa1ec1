"""Registered queries over mail text, links, features and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.catalog.registry import query
from lurewatch.catalog.views import (
    any_of, lines, model_rule, phrases, processed, words)
from lurewatch.functions import explain, fixed_values as fv, html, text, urls
from lurewatch.operators import mail, stats
from lurewatch.session import shared_path
from lurewatch.sources import fixtures as fx
from lurewatch.sources import mail as mail_source
from lurewatch.sources import sinks
from lurewatch.sources.tables import read_table


def joined(c):
    return F.array_join(c, " | ")


@query("txt_preprocess", f"SELECT id, {processed('body')} AS processed FROM email_fx", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", text.preprocess(F.col("body")).alias("processed"))


TAGS = (r"(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<!DOCTYPE[^>]*>|<[^>]+>")


@query("txt_html_to_text", rf"""
SELECT page_id, replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(html, '{TAGS}', '', 'g'), '&copy;', '©'), '&middot;', '·'), '&nbsp;', chr(160)), '&lt;', '<'),
  '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS text FROM pages""")
def _(spark, d):
    return read_table(spark, d, "pages").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("txt_extract_html", """
SELECT id, CASE WHEN id % 3 = 0 THEN '' ELSE regexp_extract(html, '(?s)<html.*</html>') END AS part
FROM email_fx""", "email_fx")
def _(spark, d):
    mixed = F.when(F.col("id") % 3 == 0, F.replace("html", F.lit("</html>"), F.lit(""))).otherwise(
        F.concat_ws("\n", "body", "html", F.lit("--")))
    return fx.emails(spark, d).select("id", text.extract_html(mixed).alias("part"))


@query("txt_extract_urls", """
SELECT id, array_to_string(regexp_extract_all(body, 'https?://[!$-_a-z]+'), ' | ') AS urls FROM email_fx""",
       "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", joined(urls.text_urls(F.col("body"))).alias("urls"))


@query("set_url_union", "SELECT id, array_to_string(urls, ' | ') AS urls FROM raw_fx", "raw_fx")
def _(spark, d):
    paged = mail.with_page_links(fx.emails(spark, d))
    return paged.select("id", joined(html.found_urls(F.col("body"), F.col("page"))).alias("urls"))


@query("txt_extract_links_html", f"""
SELECT id, array_to_string(list_transform(urls, lambda u: u || '=' || {model_rule('u')}), ' | ') AS links
FROM raw_fx""", "raw_fx")
def _(spark, d):
    linked = mail.with_links(fx.emails(spark, d))
    return linked.select("id", joined(F.transform(
        "links", lambda x: F.concat_ws("=", x["url"], x["suspicious"].cast("string")))).alias("links"))


@query("txt_links_parse", """
WITH a AS (SELECT id, body, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs,
  regexp_extract_all(html, '<a href="[^"]*">([^<]*)<', 1) AS labels,
  regexp_extract_all(body, 'https?://[!$-_a-z]+') AS us FROM email_fx)
SELECT id, array_to_string(list_concat(list_transform(list_zip(hrefs, labels), lambda z: z[1] || '=' || z[2]),
  list_transform(us, lambda u: u || '=' || u)), ' | ') AS links, len(hrefs) + len(us) AS n FROM a""", "email_fx")
def _(spark, d):
    linked = mail.with_parser_links(fx.emails(spark, d))
    return linked.select(
        "id", joined(F.transform("links", lambda x: F.concat_ws("=", x["url"], x["text"]))).alias("links"),
        F.size("links").cast("bigint").alias("n"))


@query("txt_basic_stats", f"""
SELECT id, CAST(length(body) AS INTEGER) AS text_length, CAST(len(ws) AS INTEGER) AS word_count,
  length(array_to_string(ws, '')) / len(ws) AS avg_word_length
FROM (SELECT id, body, {words('body')} AS ws FROM email_fx)""", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", text.basic_stats(F.col("body")).alias("s")).select("id", "s.*")


@query("txt_char_ratios", r"""
SELECT id, length(regexp_replace(body, '[^\p{Lu}]', '', 'g')) / length(body) AS uppercase_ratio,
  length(regexp_replace(body, '[^\p{Nd}²³¹]', '', 'g')) / length(body) AS digit_ratio,
  length(regexp_replace(body, '[^!-/:-@\[-`{-~]', '', 'g')) / length(body) AS punctuation_ratio
FROM email_fx""", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", text.char_ratios(F.col("body")).alias("s")).select("id", "s.*")


@query("txt_greeting", f"""
SELECT id, CAST({any_of('head', fv.GREETINGS)} AS INTEGER) AS has_greeting,
  CAST({any_of('head', fv.GREETINGS)} AND {any_of('head', [fv.PERSONAL_GREETING])} AS INTEGER) AS has_personal_greeting
FROM (SELECT id, array_to_string(({lines('body')})[1:5], chr(10)) AS head FROM email_fx)""", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", text.greeting(F.col("body")).alias("s")).select("id", "s.*")


@query("txt_signature", f"""
SELECT id, CAST({any_of('foot', fv.SIGNATURES)} AS INTEGER) AS has_signature,
  CAST({any_of('foot', fv.SIGNATURES)} AND {any_of('foot', fv.COMPANY_SIGNATURES)} AS INTEGER) AS has_company_signature
FROM (SELECT id, array_to_string(ls[greatest(len(ls) - 4, 1):], chr(10)) AS foot
      FROM (SELECT id, {lines('body')} AS ls FROM email_fx))""", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", text.signature(F.col("body")).alias("s")).select("id", "s.*")


@query("txt_lexicon", "SELECT id, " + ", ".join(
    f"{phrases('lower(body)', c)} AS {c}_count, CAST({phrases('lower(body)', c)} > 0 AS INTEGER) AS contains_{c}"
    for c in fv.LEXICON) + " FROM email_fx", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", text.lexicon_counts(F.col("body")).alias("s")).select("id", "s.*")


@query("txt_sensitive_keywords", "SELECT doc_id, " + " OR ".join(
    f"contains(lower(t), '{k}')" for k in fv.SENSITIVE_KEYWORDS) + """ AS sensitive
FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN ' Bank Account' WHEN 1 THEN ' PASSWORD' ELSE '' END AS t
      FROM documents)""")
def _(spark, d):
    i = F.col("doc_id")
    t = F.concat("text", F.when(i % 4 == 0, F.lit(" Bank Account")).when(i % 4 == 1, F.lit(" PASSWORD"))
                 .otherwise(F.lit("")))
    return read_table(spark, d, "documents").select("doc_id", text.sensitive(t).alias("sensitive"))


@query("txt_html_features", """
SELECT page_id, CAST(html <> '' AS INTEGER) AS contains_html,
  CAST(len(regexp_extract_all(html, '<[^>]+>')) AS INTEGER) AS html_tag_count FROM pages""")
def _(spark, d):
    return read_table(spark, d, "pages").select(
        "page_id", text.html_features(F.col("html")).alias("s")).select("page_id", "s.*")


@query("txt_url_ratio", """
SELECT id, CAST(url_count AS INTEGER) AS url_count, CAST(suspicious_url_count AS INTEGER) AS suspicious_url_count,
  CAST(url_to_text_ratio AS DOUBLE) AS url_to_text_ratio FROM raw_fx""", "raw_fx")
def _(spark, d):
    linked = mail.with_links(fx.emails(spark, d))
    ratio = text.url_ratio(F.col("links"), F.size(text.words(F.col("body"))))
    return linked.select("id", ratio.alias("s")).select("id", "s.*")


@query("fn_link_manipulation", "SELECT id, mismatched_links FROM raw_fx", "raw_fx")
def _(spark, d):
    paged = mail.with_page_links(fx.emails(spark, d))
    staged = paged.withColumn("urls", html.found_urls(F.col("body"), F.col("page")))
    return staged.select("id", text.link_manipulation(
        F.col("body"), F.col("html"), F.col("urls")).alias("mismatched_links"))


RATIOS = ["avg_word_length", "url_to_text_ratio", "uppercase_ratio", "digit_ratio", "punctuation_ratio"]
FEATURE_SQL = ", ".join(f"CAST({k} AS {'DOUBLE' if k in RATIOS else 'INTEGER'}) AS {k}" for k in text.FEATURE_FIELDS)


@query("txt_features", f"SELECT id, {FEATURE_SQL} FROM feats_fx", "feats_fx")
def _(spark, d):
    return mail.featurize(fx.emails(spark, d)).select("id", "f.*")


@query("txt_features_raw", f"SELECT id, {FEATURE_SQL} FROM raw_fx", "raw_fx")
def _(spark, d):
    return mail.featurize(fx.emails(spark, d), raw_text=True).select("id", "f.*")


SERVICE = (r"(CAST(regexp_matches(sender, '^.*?support@[a-zA-Z0-9-]+\.[a-zA-Z]{2,}$') AS INTEGER) + "
           + " + ".join(f"CAST(regexp_matches(body, '(?i){p}') AS INTEGER)" for p in fv.SERVICE_BODY) + " >= 3)")


@query("txt_service_email", f"SELECT id, {SERVICE} AS is_service FROM email_fx", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select(
        "id", text.service_email(F.col("body"), F.col("sender")).alias("is_service"))


@query("txt_service_patterns", "SELECT id, " + " + ".join(
    f"CAST(regexp_matches(lower(body), '{p}') AS INTEGER)".replace("you're", "you''re")
    for p in fv.SERVICE_LANGUAGE) + " >= 2 AS is_service FROM email_fx", "email_fx")
def _(spark, d):
    return fx.emails(spark, d).select("id", text.service_language(F.col("body")).alias("is_service"))


@query("txt_headers", """
SELECT event_id, concat_ws(' | ', CASE WHEN event_id % 2 = 0 THEN 'Missing From header' END,
  'Missing To header', CASE WHEN event_id % 3 <> 0 THEN 'Missing Subject header' END, 'Missing Date header',
  CASE WHEN event_id % 2 = 0 OR event_id % 5 <> 0 THEN 'Mismatched Return-Path and From headers' END,
  CASE WHEN event_id % 7 = 0 THEN 'Suspicious header found: X-Mailer' END) AS findings FROM events""")
def _(spark, d):
    i = F.col("event_id")
    sender = F.concat(F.lit("u"), F.col("user_id"), F.lit("@example.net"))
    entry = lambda name, value: F.struct(F.lit(name).alias("k"), value.alias("v"))
    headers = F.map_from_entries(F.array_compact(F.array(
        F.when(i % 2 == 1, entry("From", sender)), F.when(i % 3 == 0, entry("Subject", F.lit("s"))),
        entry("Return-Path", F.when(i % 5 == 0, sender).otherwise(F.lit("x@example.org"))),
        F.when(i % 7 == 0, entry("X-Mailer", F.lit("bulk"))))))
    return read_table(spark, d, "events").select(
        "event_id", joined(text.header_findings(headers)).alias("findings"))


@query("txt_attachments", """
SELECT doc_id, 'doc' || doc_id || '.txt' AS filename, CAST(octet_length(encode(text)) AS BIGINT) AS size,
  md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents""")
def _(spark, d):
    one = F.array(F.struct(
        F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")).alias("filename"),
        F.lit("text/plain").alias("content_type"), F.encode("text", "UTF-8").alias("data")))
    a = F.col("a")
    return read_table(spark, d, "documents").select("doc_id", text.attachment_info(one)[0].alias("a")).select(
        "doc_id", a["filename"].alias("filename"), a["size"].alias("size"),
        a["hash"]["md5"].alias("md5"), a["hash"]["sha1"].alias("sha1"), a["hash"]["sha256"].alias("sha256"))


@query("txt_payload_parse", """
SELECT id, CASE WHEN id % 4 = 3 THEN '' ELSE subject END AS subject, CASE WHEN id % 4 = 3 THEN '' ELSE sender END AS sender,
  body, CASE WHEN id % 4 = 3 THEN '' ELSE html END AS html,
  CASE id % 4 WHEN 0 THEN '=https://a.example/' || id WHEN 1 THEN 'go=https://b.example/' || id ELSE '' END AS links
FROM email_fx""", "email_fx")
def _(spark, d):
    i = F.col("id")
    payload = (
        F.when(i % 4 == 0, F.to_json(F.struct(
            "subject", F.col("sender").alias("from"), "body", "html",
            F.array(F.concat(F.lit("https://a.example/"), i)).alias("links"))))
        .when(i % 4 == 1, F.to_json(F.struct(
            F.struct("subject", F.col("sender").alias("fromEmail")).alias("headers"),
            F.col("body").alias("text"), F.col("html").alias("html_content"),
            F.array(F.struct(F.lit("go").alias("text"),
                             F.concat(F.lit("https://b.example/"), i).alias("href"))).alias("links"))))
        .when(i % 4 == 2, F.to_json(F.struct("subject", "sender", "body", "html")))
        .otherwise(F.col("body")))
    parsed = fx.emails(spark, d).select("id", text.parse_payload(payload).alias("p")).select("id", "p.*")
    return parsed.select("id", "subject", "sender", "body", "html", joined(F.transform(
        "links", lambda x: F.concat_ws("=", x["text"], x["url"]))).alias("links"))


PROBABILITY = "(id % 100) / 100.0::DOUBLE"


def explained(spark, d):
    staged = mail.featurize(fx.emails(spark, d), raw_text=True)
    return staged.withColumn("p", (F.col("id") % 100) / F.lit(100.0)).withColumn(
        "service", text.service_email(F.col("body"), F.col("sender")))


def report(df, record, extra=()):
    e = df.select("id", record.alias("e"), *extra)
    risk = F.col("e")["risk_assessment"]
    return e.select(
        "id", F.col("e")["confidence_level"].alias("confidence_level"),
        joined(F.col("e")["suspicious_indicators"]).alias("suspicious"),
        joined(F.col("e")["safe_indicators"]).alias("safe"),
        *[risk[k].alias(k) for k in ("url_risk", "content_risk", "structure_risk")])


SENSITIVE = ("CASE WHEN contains_financial + contains_personal > 0 THEN 'Requests for sensitive information detected ('"
             " || concat_ws(' and ', CASE WHEN contains_financial > 0 THEN 'financial' END,"
             " CASE WHEN contains_personal > 0 THEN 'personal' END) || ')' END")


@query("exp_model", f"""
WITH base AS (SELECT *, {PROBABILITY} AS p, {SERVICE} AS service,
    urgent_count + has_threat_count + contains_financial + contains_personal + mismatched_links AS weight FROM raw_fx),
lists AS (SELECT *, list_filter([
  CASE WHEN has_greeting = 0 THEN 'Missing proper email greeting (e.g., ''Dear [Name]'', ''Hello [Name]'')' END,
  CASE WHEN has_signature = 0 THEN 'Missing email signature (e.g., sender''s name, contact information)' END,
  CASE WHEN suspicious_url_count > 0 THEN 'Contains ' || suspicious_url_count || ' suspicious URL(s) out of ' || url_count || ' total URLs' END,
  CASE WHEN url_count > 0 AND url_to_text_ratio > 0.1 THEN 'High ratio of URLs to text content' END,
  CASE WHEN urgent_count > 0 THEN 'Contains urgent or time-sensitive language (found ' || urgent_count || ' instances)' END,
  {SENSITIVE},
  CASE WHEN has_threat_count > 0 THEN 'Contains threatening language (found ' || has_threat_count || ' instances)' END,
  CASE WHEN contains_html > 0 AND mismatched_links > 0 THEN 'Contains mismatched or disguised links' END],
  lambda x: x IS NOT NULL) AS bad, list_filter([
  CASE WHEN has_greeting > 0 THEN 'Contains proper email greeting' END,
  CASE WHEN has_personal_greeting > 0 THEN 'Greeting appears to be personalized' END,
  CASE WHEN has_signature > 0 THEN 'Contains proper email signature' END,
  CASE WHEN has_company_signature > 0 THEN 'Contains official company signature' END,
  CASE WHEN url_count > 0 AND suspicious_url_count = 0 THEN 'Contains ' || url_count || ' legitimate URL(s)' END,
  CASE WHEN url_count = 0 THEN 'No URLs found in the email' END,
  CASE WHEN urgent_count = 0 THEN 'No urgent or time-sensitive language detected' END,
  CASE WHEN contains_financial + contains_personal = 0 THEN 'No requests for sensitive information detected' END,
  CASE WHEN service THEN 'Matches patterns of legitimate service email' END], lambda x: x IS NOT NULL) AS good FROM base)
SELECT id, CASE WHEN service AND len(good) > len(bad) THEN 'High' WHEN p > 0.8 THEN 'High' WHEN p > 0.6 THEN 'Medium'
    ELSE 'Low' END AS confidence_level, array_to_string(bad, ' | ') AS suspicious, array_to_string(good, ' | ') AS safe,
  CASE WHEN suspicious_url_count > 0 THEN 'High' WHEN url_count > 0 THEN 'Medium' ELSE 'Low' END AS url_risk,
  CASE WHEN weight > 2 THEN 'High' WHEN weight > 0 THEN 'Medium' ELSE 'Low' END AS content_risk,
  CASE has_greeting + has_signature WHEN 2 THEN 'Low' WHEN 1 THEN 'Medium' ELSE 'High' END AS structure_risk
FROM lists""", "raw_fx")
def _(spark, d):
    df = explained(spark, d)
    return report(df, explain.explain_model(F.col("f"), F.col("p"), F.col("service")))


TWO = ("CASE WHEN p > 0.8 THEN 'High' WHEN p > 0.5 THEN 'Medium' ELSE 'Low' END AS confidence_level")
STRUCTURE = "CASE WHEN has_greeting + has_signature < 2 THEN 'High' ELSE 'Low' END AS structure_risk"


@query("exp_parts", f"""
SELECT id, {TWO}, concat_ws(' | ', CASE WHEN has_greeting = 0 THEN 'Missing email greeting' END,
    CASE WHEN has_signature = 0 THEN 'Missing email signature' END,
    CASE WHEN bad > 0 THEN 'Contains ' || bad || ' suspicious URL(s)' END,
    CASE WHEN urgent_count > 0 THEN 'Contains urgent or time-sensitive language' END,
    CASE WHEN contains_personal + contains_financial > 0 THEN 'Possible request for personal/financial information' END) AS suspicious,
  concat_ws(' | ', CASE WHEN has_greeting > 0 THEN 'Contains proper greeting' END,
    CASE WHEN has_signature > 0 THEN 'Contains proper signature' END,
    CASE WHEN n > 0 AND bad = 0 THEN 'Contains links but none look suspicious' END,
    CASE WHEN n = 0 THEN 'No links found in the email' END,
    CASE WHEN urgent_count = 0 THEN 'No urgent or time-sensitive language detected' END,
    CASE WHEN id % 3 > 0 THEN 'Attachments found' END) AS safe,
  CASE WHEN bad > 0 THEN 'High' ELSE 'Low' END AS url_risk, CASE WHEN p > 0.5 THEN 'High' ELSE 'Low' END AS content_risk,
  {STRUCTURE} FROM (SELECT *, {PROBABILITY} AS p, url_count AS n, suspicious_url_count AS bad FROM raw_fx)""", "raw_fx")
def _(spark, d):
    df = explained(spark, d)
    f = F.col("f")
    return report(df, explain.explain_parts(
        f, F.col("p"), F.col("p") > 0.5, f["url_count"], f["suspicious_url_count"], F.col("id") % 3))


@query("exp_route", f"""
SELECT id, {TWO}, concat_ws(' | ', CASE WHEN has_greeting = 0 THEN 'Missing email greeting' END,
    CASE WHEN has_signature = 0 THEN 'Missing email signature' END,
    CASE WHEN suspicious_url_count > 0 THEN 'Contains ' || suspicious_url_count || ' suspicious URLs' END,
    CASE WHEN urgent_count > 0 THEN 'Contains urgent or time-sensitive language' END,
    CASE WHEN sensitive THEN 'Potential sensitive information requested' END,
    CASE WHEN id % 3 > 0 THEN 'Contains ' || (id % 3) || ' attachment(s)' END) AS suspicious,
  concat_ws(' | ', CASE WHEN has_greeting > 0 THEN 'Contains proper greeting' END,
    CASE WHEN has_signature > 0 THEN 'Contains proper signature' END,
    CASE WHEN url_count > 0 AND suspicious_url_count = 0 THEN 'All URLs appear legitimate' END,
    CASE WHEN url_count = 0 THEN 'No links found in the email' END,
    CASE WHEN urgent_count = 0 THEN 'No urgent or time-sensitive language detected' END,
    CASE WHEN NOT sensitive THEN 'No obvious requests for sensitive information detected' END,
    CASE WHEN id % 3 = 0 THEN 'No attachments found' END,
    CASE WHEN service THEN 'Matches patterns of legitimate service email' END) AS safe,
  CASE WHEN suspicious_url_count > 0 THEN 'High' ELSE 'Low' END AS url_risk,
  CASE WHEN sensitive OR urgent_count > 0 THEN 'High' ELSE 'Low' END AS content_risk, {STRUCTURE}
FROM (SELECT *, {PROBABILITY} AS p, {SERVICE} AS service,
  {' OR '.join(f"contains(lower(body), '{k}')" for k in fv.SENSITIVE_KEYWORDS)} AS sensitive FROM raw_fx)""", "raw_fx")
def _(spark, d):
    df = explained(spark, d)
    return report(df, explain.explain_upload(
        F.col("f"), F.col("p"), text.sensitive(F.col("body")), F.col("id") % 3, F.col("service")))


@query("exp_key_findings", """
SELECT id, concat_ws(' | ', CASE WHEN has_greeting + has_signature = 2 THEN 'Contains proper greeting and signature (Good sign)'
    WHEN has_greeting > 0 THEN 'Contains proper greeting but missing signature (Potential red flag)'
    WHEN has_signature > 0 THEN 'Contains proper signature but missing greeting (Potential red flag)'
    ELSE 'Missing proper greeting and signature (Potential red flag)' END,
  CASE WHEN url_count = 0 THEN 'No links found in the email (Good sign)'
    WHEN suspicious_url_count > 0 THEN 'Contains ' || url_count || ' link(s), including ' || suspicious_url_count || ' suspicious link(s) (Potential red flag)'
    ELSE 'Contains ' || url_count || ' link(s), none of which appear suspicious (Good sign)' END,
  CASE WHEN urgent_count > 0 THEN 'Contains urgent or time-sensitive language (Potential red flag)'
    ELSE 'No urgent or time-sensitive language detected (Good sign)' END,
  CASE WHEN contains_personal + contains_financial > 0
    THEN 'Potential requests for personal or financial information detected (Exercise caution)'
    ELSE 'No obvious requests for sensitive information detected (Good sign)' END,
  CASE WHEN id % 3 > 0 THEN 'Contains ' || (id % 3) || ' attachment(s) (Exercise caution)' ELSE 'No attachments found' END) AS findings
FROM raw_fx""", "raw_fx")
def _(spark, d):
    f = F.col("f")
    return explained(spark, d).select("id", joined(explain.key_findings(
        f, f["url_count"], f["suspicious_url_count"], F.col("id") % 3)).alias("findings"))


@query("exp_summary", f"""
SELECT id, CASE WHEN p > 0.5 THEN 'Potential Phishing' ELSE 'Likely Safe' END AS badge,
  printf('%.1f', round(p * 100, 1)) || '%' AS badge_percent,
  CASE WHEN p > 0.5 THEN 'Likely phishing' ELSE 'Likely Safe' END AS parts,
  printf('%.1f', round(p * 100, 1)) || '%' AS parts_percent,
  CASE WHEN p > 0.5 THEN 'Likely phishing' ELSE 'Likely safe' END AS upload,
  CAST(round(p * 100) AS BIGINT) || '%' AS upload_percent
FROM (SELECT doc_id AS id, (doc_id % 100) / 100.0::DOUBLE AS p FROM documents)""")
def _(spark, d):
    p = (F.col("doc_id") % 100) / F.lit(100.0)
    shown = {n: explain.summary(p > 0.5, p, n) for n in ("extension", "parts", "upload")}
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), *[
        c for out, n in (("badge", "extension"), ("parts", "parts"), ("upload", "upload"))
        for c in (shown[n]["summary"].alias(out), shown[n]["confidence_percentage"].alias(f"{out}_percent"))])


@query("exp_error_record", """
SELECT id, id % 10 = 0 AS empty, CASE WHEN id % 10 = 0 THEN 'Low' ELSE '-' END AS confidence_level,
  CASE WHEN id % 10 = 0 THEN 'Empty or invalid email content' ELSE '-' END AS suspicious,
  CASE WHEN id % 10 = 0 THEN 'Analysis Error' ELSE '-' END AS summary FROM email_fx""", "email_fx")
def _(spark, d):
    body = F.when(F.col("id") % 20 == 0, F.lit("")).when(F.col("id") % 10 != 0, F.col("body"))
    e, dash = F.col("e"), F.lit("-")
    return fx.emails(spark, d).select("id", explain.error_record(body).alias("e")).select(
        "id", e.isNotNull().alias("empty"),
        F.coalesce(e["confidence_level"], dash).alias("confidence_level"),
        F.coalesce(joined(e["suspicious_indicators"]), dash).alias("suspicious"),
        F.coalesce(e["summary"], dash).alias("summary"))


@query("agg_term_df", r"""
SELECT term, CAST(count(DISTINCT id) AS BIGINT) AS document_frequency, count(*) AS term_frequency FROM (
  SELECT id, unnest(regexp_extract_all(lower(body), '[\p{L}\p{M}\p{Nd}_]{2,}')) AS term FROM email_fx)
GROUP BY term""", "email_fx")
def _(spark, d):
    return stats.term_frequencies(fx.emails(spark, d))


@query("agg_dataset_stats", """
SELECT count(*) AS total, count(*) FILTER (class = 1) AS phishing, count(*) - count(*) FILTER (class = 1) AS legitimate,
  count(*) FILTER (class = 1) / count(*) AS phishing_ratio FROM email_fx""", "email_fx")
def _(spark, d):
    return stats.dataset_stats(fx.emails(spark, d))


@query("src_email_csv", "SELECT body AS text, class FROM email_fx WHERE class IS NOT NULL", "email_fx")
def _(spark, d):
    path = shared_path(spark, "corpus")
    names = F.when(F.col("class") == 1, F.lit("Phishing Email")).when(
        F.col("class") == 0, F.lit("Safe Email")).otherwise(F.lit("Other"))
    sinks.write_csv(fx.emails(spark, d).select(
        F.col("body").alias("Email Text"), names.alias("Email Type")), path)
    return mail_source.labelled_only(mail_source.read_labelled_csv(spark, path))


@query("src_email_dir", """
SELECT 'mail-' || id AS path, subject, sender, body || chr(10) AS body, html || chr(10) AS html_content,
  'note.bin' AS filename, CAST(octet_length(encode(subject)) AS BIGINT) AS size, md5(subject) AS md5
FROM email_fx""", "email_fx")
def _(spark, d):
    encoded = lambda c: F.base64(F.encode(c, "UTF-8"))
    part = lambda kind, c, *more: F.concat_ws(
        "\r\n", F.lit("--b1"), F.lit(f"Content-Type: {kind}"),
        F.lit("Content-Transfer-Encoding: base64"), *[F.lit(m) for m in more], F.lit(""), encoded(c))
    raw = F.concat_ws(
        "\r\n", F.concat(F.lit("From: "), "sender"), F.concat(F.lit("Subject: "), "subject"),
        F.lit("MIME-Version: 1.0"), F.lit('Content-Type: multipart/mixed; boundary="b1"'), F.lit(""),
        part("text/plain; charset=utf-8", F.concat("body", F.lit("\n"))),
        part("text/html; charset=utf-8", F.concat("html", F.lit("\n"))),
        part("application/octet-stream", F.col("subject"),
             'Content-Disposition: attachment; filename="note.bin"'), F.lit("--b1--"))
    files = fx.emails(spark, d).select(
        F.concat(F.lit("mail-"), "id").alias("path"), F.encode(raw, "UTF-8").alias("content"))
    a = F.col("attachments")[0]
    return mail_source.parse_messages(files).select(
        "path", "subject", "sender", "body", "html_content", a["filename"].alias("filename"),
        a["size"].alias("size"), a["hash"]["md5"].alias("md5"))
