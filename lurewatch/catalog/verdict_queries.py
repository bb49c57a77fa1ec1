"""Registered queries over vendor verdicts, reports, feeds and curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from lurewatch.catalog.registry import query
from lurewatch.functions import urls as u
from lurewatch.functions import verdicts
from lurewatch.operators import curves, history, reputation, stats
from lurewatch.plans import exports, indicator_check
from lurewatch.schema import REPORT
from lurewatch.session import shared_path
from lurewatch.sources import fixtures as fx

LABEL = """CASE WHEN len(list_distinct(list_transform(vendors, lambda v: v.verdict))) = 1 THEN 'full_agreement'
  WHEN len(list_filter(vendors, lambda v: v.verdict IN ('phishing', 'malicious'))) > 0
   AND len(list_filter(vendors, lambda v: v.verdict = 'clean')) > 0 THEN 'disagreement'
  ELSE 'partial_agreement' END"""
ROLLUP = """CASE WHEN bool_or(verdict = 'phishing') THEN 'phishing' WHEN bool_or(verdict = 'malicious') THEN 'malicious'
  WHEN bool_or(verdict = 'suspicious') THEN 'suspicious' ELSE 'safe' END"""


def list_rollup(vendors: str) -> str:
    has = lambda v: f"len(list_filter({vendors}, lambda x: x.verdict = '{v}')) > 0"
    return (f"CASE WHEN {has('phishing')} THEN 'phishing' WHEN {has('malicious')} THEN 'malicious' "
            f"WHEN {has('suspicious')} THEN 'suspicious' ELSE 'safe' END")


SHARE = ("CASE WHEN len(vendors) = 0 THEN 0.5 ELSE "
         "len(list_filter(vendors, lambda v: v.verdict IN ('malicious', 'phishing'))) / len(vendors) END")
SCORES = f"""scores AS (
  SELECT {SHARE} AS score, is_malicious AS label FROM history_fx
  WHERE vendors IS NOT NULL AND analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY),
counts AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM scores GROUP BY score),
points AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, row_number() OVER w AS position,
    count(*) OVER () AS n, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg,
    lead(pos) OVER w AS next_pos, lead(neg) OVER w AS next_neg
  FROM counts WINDOW w AS (ORDER BY score DESC))"""


@query("agg_vendor_agreement", f"""
SELECT a.agreement, count(h.label) AS n
FROM (VALUES ('full_agreement'), ('partial_agreement'), ('disagreement')) a(agreement)
LEFT JOIN (SELECT {LABEL} AS label FROM history_fx WHERE len(vendors) > 0
  AND analysis_date >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) h ON h.label = a.agreement
GROUP BY a.agreement""", "history_fx")
def _(spark, d):
    return stats.vendor_agreement(fx.history(spark, d), fx.AS_OF)


@query("agg_vendor_agreement_rows", """
SELECT agreement, count(*) AS n FROM (
  SELECT CASE WHEN count(DISTINCT verdict) = 1 THEN 'full_agreement'
    WHEN bool_or(verdict IN ('phishing', 'malicious')) AND bool_or(verdict = 'clean') THEN 'disagreement'
    ELSE 'partial_agreement' END AS agreement FROM vendor_fx GROUP BY key) GROUP BY agreement""",
       "vendor_fx")
def _(spark, d):
    return stats.agreement_from_rows(fx.vendors(spark, d)).groupBy("agreement").agg(
        F.count("*").alias("n"))


@query("agg_vendor_confidence", f"""
SELECT id, CAST({SHARE} AS DOUBLE) AS confidence FROM history_fx WHERE vendors IS NOT NULL""", "history_fx")
def _(spark, d):
    rows = history.with_json(fx.history(spark, d), "vendor_analysis")
    score = verdicts.confidence(verdicts.parse_vendors(F.col("vendor_analysis")))
    return rows.select("id", score.alias("confidence")).filter(F.col("confidence").isNotNull())


@query("agg_roc_curve", f"""
WITH {SCORES}
SELECT CAST(position AS BIGINT) AS position, CAST(fp / all_neg AS DOUBLE) AS fpr,
  CAST(tp / all_pos AS DOUBLE) AS tpr FROM points
WHERE position = 1 OR position = n OR pos <> next_pos OR neg <> next_neg
UNION ALL SELECT 0, 0.0, 0.0""", "history_fx")
def _(spark, d):
    return curves.roc_points(exports.vendor_scores(fx.history(spark, d), fx.AS_OF))


@query("agg_roc_auc", f"""
WITH {SCORES}
SELECT CAST(sum(2 * tp * neg - pos * neg) / (2 * max(all_pos) * max(all_neg)) AS DOUBLE) AS auc FROM points""",
       "history_fx")
def _(spark, d):
    return curves.roc_auc(exports.vendor_scores(fx.history(spark, d), fx.AS_OF))


@query("agg_pr_curve", f"""
WITH {SCORES}
SELECT coalesce(CAST(score AS DOUBLE), 2.0) AS threshold, CAST(tp / (tp + fp) AS DOUBLE) AS precision,
  CAST(tp / all_pos AS DOUBLE) AS recall FROM points
UNION ALL SELECT 2.0, 1.0, 0.0""", "history_fx")
def _(spark, d):
    # The closing point has no threshold; 2 stands for it here.
    return curves.pr_points(exports.vendor_scores(fx.history(spark, d), fx.AS_OF)).fillna(
        2.0, ["threshold"])


@query("agg_main_verdict", f"SELECT key, {ROLLUP} AS main_verdict FROM vendor_fx GROUP BY key", "vendor_fx")
def _(spark, d):
    return stats.main_verdict_from_rows(fx.vendors(spark, d))


@query("agg_main_verdict_list", f"""
SELECT id, {list_rollup('vendors')} AS main_verdict, CASE WHEN vendors IS NULL THEN 'unknown'
  ELSE {list_rollup('vendors')} END AS shown_verdict FROM history_fx""", "history_fx")
def _(spark, d):
    v = verdicts.parse_vendors(F.col("vendor_analysis"))
    return fx.history(spark, d).select(
        "id", verdicts.main_verdict(v).alias("main_verdict"),
        verdicts.main_verdict(v, "unknown").alias("shown_verdict"))


@query("agg_vendors_by_verdict", "SELECT id, " + ", ".join(f"""
array_to_string(list_transform(list_filter(vendors, lambda v: v.verdict = '{b}'), lambda v: v.name), '|')
  AS {b}_vendors""" for b in ("phishing", "malicious", "suspicious", "clean"))
       + " FROM history_fx WHERE vendors IS NOT NULL", "history_fx")
def _(spark, d):
    grouped = stats.vendors_by_verdict(fx.history(spark, d))
    return grouped.select("id", *[F.array_join(c, "|").alias(c) for c in grouped.columns[1:]])


@query("fn_categorize_verdict", """
SELECT key, name, category, result, verdict,
  CASE WHEN category = 'malicious' AND (contains(result, 'phish') OR contains(result, 'scam'))
       THEN 'phishing' WHEN category IN ('malicious', 'suspicious') THEN category ELSE 'clean' END
  AS wide_verdict FROM vendor_fx""", "vendor_fx")
def _(spark, d):
    return fx.vendors(spark, d).withColumn("wide_verdict", verdicts.categorize(
        F.col("category"), F.col("result"), ("phish", "scam")))


@query("agg_community_score", """
SELECT key, malicious || '/' || (malicious + suspicious + harmless + undetected) AS community_score,
  malicious > 0 AS is_malicious FROM reports_fx""", "reports_fx")
def _(spark, d):
    stat = F.col("last_analysis_stats")
    return fx.reports(spark, d).select(
        "key", verdicts.community_score(stat).alias("community_score"),
        verdicts.stats_malicious(stat).alias("is_malicious"))


@query("src_vendor_report", """
SELECT v.key, v.name, v.category, v.result, v.verdict FROM entries_fx v JOIN events ON key = event_id""",
       "entries_fx")
def _(spark, d):
    path = shared_path(spark, "reports")
    fx.reports(spark, d).write.json(path)
    stored = spark.read.schema("key bigint, " + REPORT).json(path)
    return reputation.flatten_reports(stored, "key")


@query("prj_metadata_by_type", """
SELECT key, CAST(CASE indicator_type
  WHEN 'url' THEN json_object('final_url', indicator || '/final', 'serving_ip', 'Unknown')
  WHEN 'domain' THEN json_object('creation_date', '2020-01-01', 'registrar', NULL, 'last_dns_records', [])
  WHEN 'ip' THEN json_object('as_owner', NULL, 'country', 'SG', 'network', NULL)
  WHEN 'hash' THEN json_object('type_description', NULL, 'size', key, 'file_type', NULL)
  ELSE '{}' END AS VARCHAR) AS metadata FROM reports_fx""", "reports_fx")
def _(spark, d):
    reports = fx.reports(spark, d)
    return reports.select("key", reputation.metadata_by_type(reports).alias("metadata"))


INPUTS = """
typed AS (SELECT id, input_string AS input, CASE input_type WHEN 'email' THEN 'domain' ELSE input_type END
  AS input_type FROM rows_fx),
latest AS (SELECT * FROM (SELECT *, CASE indicator_type WHEN 'email' THEN 'domain' ELSE indicator_type END AS it,
  row_number() OVER (PARTITION BY indicator_type, indicator ORDER BY key DESC) AS rn FROM reports_fx) WHERE rn = 1),
joined AS (SELECT t.*, coalesce(malicious || '/' || (malicious + suspicious + harmless + undetected), '0/0')
    AS community_score, coalesce(malicious > 0, FALSE) AS is_malicious, coalesce(vendors, []) AS vendors
  FROM typed t LEFT JOIN latest l ON l.indicator_type = t.input_type AND l.indicator = t.input),
fed AS (SELECT j.*, query_status AS feed_status, threat AS feed_threat,
    coalesce(threat, '') <> '' AND NOT is_malicious AS hit
  FROM joined j LEFT JOIN second_fx s ON s.url = j.input AND j.input_type = 'url'),
merged AS (SELECT * REPLACE (is_malicious OR hit AS is_malicious,
    CASE WHEN hit AND len(list_filter(vendors, lambda v: v.verdict = 'malicious')) = 0
      THEN list_append(vendors, {'name': 'URLhaus', 'verdict': 'malicious'}) ELSE vendors END AS vendors)
  FROM fed)"""


def checked_inputs(spark, d):
    typed = reputation.classify(fx.history_rows(spark, d).select(
        "id", F.col("input_string").alias("input")))
    known = reputation.report_columns(reputation.latest_reports(fx.reports(spark, d), "key"))
    return reputation.join_reputation(typed, known)


def vendor_text(vendors: str = "vendors"):
    return F.array_join(F.transform(
        vendors, lambda v: F.concat_ws("=", v["name"], v["verdict"])), "|")


VENDOR_TEXT = "array_to_string(list_transform(vendors, lambda v: v.name || '=' || v.verdict), '|')"


@query("join_reputation", f"""
WITH {INPUTS}
SELECT id, input, input_type, community_score, is_malicious, {VENDOR_TEXT} AS vendors FROM joined""",
       "rows_fx reports_fx second_fx")
def _(spark, d):
    return checked_inputs(spark, d).select(
        "id", "input", "input_type", "community_score", "is_malicious", vendor_text().alias("vendors"))


@query("join_second_feed", f"""
WITH {INPUTS}
SELECT id, input, is_malicious, {VENDOR_TEXT} AS vendors, coalesce(feed_status, '-') AS feed_status,
  coalesce(feed_threat, '-') AS feed_threat, CASE WHEN input_type = 'url' THEN
    '{{' || concat_ws(',', CASE WHEN community_score <> '0/0' THEN
      '"final_url":"' || input || '/final","serving_ip":"Unknown"' END,
      '"urlhaus_status":"' || feed_status || '"', '"urlhaus_threat":"' || feed_threat || '"') || '}}'
  END AS url_metadata FROM merged""", "rows_fx reports_fx second_fx")
def _(spark, d):
    merged = reputation.join_second_feed(checked_inputs(spark, d), fx.second_feed(spark, d))
    return merged.select("id", "input", "is_malicious", vendor_text().alias("vendors"),
                         F.coalesce("feed_status", F.lit("-")).alias("feed_status"),
                         F.coalesce("feed_threat", F.lit("-")).alias("feed_threat"),
                         F.when(F.col("input_type") == "url", F.col("metadata")).alias("url_metadata"))


@query("plan_indicator_check", f"""
WITH {INPUTS}
SELECT id, input, input_type, community_score, {list_rollup('vendors')} AS main_verdict,
  CASE WHEN {list_rollup('vendors')} = 'safe' THEN 0 ELSE 1 END AS is_malicious FROM merged""",
       "rows_fx reports_fx second_fx")
def _(spark, d):
    checked = indicator_check.check(
        fx.history_rows(spark, d).select("id", F.col("input_string").alias("input")),
        fx.reports(spark, d), fx.second_feed(spark, d))
    return checked.select("id", "input", "input_type", "community_score", "main_verdict", "is_malicious")


@query("join_feed_confidence", """
SELECT url, is_phishing, confidence, reasons FROM (
  SELECT r.input_string AS url, coalesce(malicious, 0) + coalesce(suspicious, 0) AS flagged,
    query_status = 'ok' AND threat IS DISTINCT FROM 'none' AS listed,
    flagged > 0 OR listed AS is_phishing,
    CAST(greatest(CASE WHEN flagged > 0 THEN flagged / (flagged + harmless) ELSE 0 END,
      CASE WHEN listed THEN 0.8 ELSE 0 END) AS DOUBLE) AS confidence,
    concat_ws('|', CASE WHEN flagged > 0 THEN 'VirusTotal: ' || malicious || ' malicious, ' || suspicious
        || ' suspicious detections' END,
      CASE WHEN listed THEN 'URLhaus: Detected as ' || coalesce(threat, 'None') END) AS reasons
  FROM rows_fx r LEFT JOIN reports_fx v ON v.indicator = r.input_string
  LEFT JOIN second_fx s ON s.url = r.input_string WHERE r.input_type = 'url')""",
       "rows_fx reports_fx second_fx")
def _(spark, d):
    wanted = fx.history_rows(spark, d).filter(F.col("input_type") == "url").select(
        F.col("input_string").alias("url"))
    stat = fx.reports(spark, d).withColumnRenamed("indicator", "url")
    fused = reputation.fuse_feeds(wanted, stat, fx.second_feed(spark, d))
    return fused.withColumn("reasons", F.array_join("reasons", "|"))


@query("join_semi_link_merge", """
SELECT id, array_to_string(list_sort(list_distinct(list_concat(
  list_filter([CASE WHEN id % 2 = 0 THEN 'https://bit.ly/x1' END,
               CASE WHEN id % 3 = 0 THEN 'https://news.example.com/u' END], lambda x: x IS NOT NULL),
  regexp_extract_all(body, 'https?://[!$-_a-z]+')))), '|') AS links FROM email_fx""", "email_fx")
def _(spark, d):
    known = F.array_compact(F.array(
        F.when(F.col("id") % 2 == 0, F.lit("https://bit.ly/x1")),
        F.when(F.col("id") % 3 == 0, F.lit("https://news.example.com/u"))))
    mails = fx.emails(spark, d).select(
        "id", F.transform(known, lambda x: F.struct(x.alias("url"), F.lit("link").alias("text")))
        .alias("links"), F.array_distinct(u.text_urls(F.col("body"))).alias("text_urls"))
    merged = reputation.merge_text_links(mails)
    return merged.select("id", F.array_join(F.array_sort(
        F.transform("links", lambda x: x["url"])), "|").alias("links"))


@query("set_feature_weights", """
SELECT *, (SELECT count(*) FROM rows_fx WHERE input_type = 'url') AS n_urls FROM (VALUES ('url_structure - length', 0.15::DOUBLE), ('url_structure - special_chars', 0.10),
  ('url_structure - subdomain_depth', 0.08), ('url_structure - path_depth', 0.07),
  ('domain_analysis - age', 0.12), ('domain_analysis - registration_length', 0.08),
  ('domain_analysis - suspicious_tld', 0.09), ('security_indicators - ssl_valid', 0.10),
  ('security_indicators - whois_privacy', 0.06), ('security_indicators - dns_records', 0.08),
  ('content_analysis - forms_present', 0.07), ('content_analysis - external_links', 0.06),
  ('content_analysis - obfuscation', 0.05)) t(feature, importance)""", "rows_fx")
def _(spark, d):
    # The weights are shown next to the URL checks they belong to.
    checks = fx.history_rows(spark, d).filter(F.col("input_type") == "url")
    return stats.feature_weights(spark).withColumn("n_urls", checks.agg(F.count("*")).scalar())
