"""SQL twins of ``sources.fixtures``, for the checking SQL only."""

from lurewatch.functions import fixed_values as fv

INPUT_TYPE = ("CASE event_id % 5 WHEN 0 THEN 'url' WHEN 1 THEN 'domain' WHEN 2 THEN 'ip' "
              "WHEN 3 THEN 'hash' ELSE 'email' END")
INPUT_TEXT = ("CASE event_id % 5 WHEN 0 THEN 'https://s' || (event_id % 97) || '.example.com/p/' || event_id "
              "WHEN 1 THEN 'd' || (event_id % 31) || '.example.org' "
              "WHEN 2 THEN '10.' || (event_id % 256) || '.' || (user_id % 256) || '.7' "
              "WHEN 3 THEN md5(CAST(event_id AS VARCHAR)) "
              "ELSE 'user' || user_id || '@example.net' END")

WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def processed(c: str) -> str:
    """Preprocessed text of a body without html and without a ``subject:`` line."""
    spaced = rf"trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g'))"
    linked = f"regexp_replace({spaced}, '{fv.URL_PATTERN}', 'URL', 'g')"
    return rf"regexp_replace({linked}, '([!?.]){{2,}}', '\1', 'g')"


def words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '{WS}+'), lambda w: w <> '')"


def lines(c: str) -> str:
    stripped = rf"regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')"
    return f"list_filter(list_transform(string_split({c}, chr(10)), lambda x: {stripped}), lambda x: x <> '')"


def any_of(c: str, patterns: list[str]) -> str:
    quoted = [p.replace("'", "''") for p in patterns]
    return "(" + " OR ".join(f"regexp_matches({c}, '(?im){p}')" for p in quoted) + ")"


def phrases(c: str, category: str) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{p}') AS INTEGER)" for p in fv.LEXICON[category]) + ")"


def model_rule(u: str) -> str:
    """The ten-indicator URL rule for an absolute URL."""
    host = rf"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
    tail = rf"regexp_replace({u}, '^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/?#]*)?', '')"
    path = rf"regexp_replace(regexp_replace({tail}, '[?#].*', ''), '^(.*/)?([^/;]*);[^/]*$', '\1\2')"
    tests = [
        f"length(regexp_replace({host}, '[^.]', '', 'g')) > 3",
        rf"regexp_matches(lower({host}), '\.(tk|ml|ga|cf|gq)')",
        f"regexp_matches({u}, '[0-9]{{10,}}')", rf"regexp_matches({u}, '[^\x00-\x7F]')",
        f"length({u}) > 100", f"regexp_matches(lower({path}), '{fv.MODEL_PATH_WORDS}')",
        f"regexp_matches(lower({path}), '{fv.MODEL_ACTION_PAGE}')", f"contains({u}, '@')",
        f"contains({path}, '//')", f"length(regexp_replace({host}, '[^-]', '', 'g')) > 2"]
    return "(" + " + ".join(f"CAST({t} AS INTEGER)" for t in tests) + " >= 2)"


def features(source: str) -> str:
    """Feature record over column ``source`` (body or processed) of proc_fx.

    Every page anchor of the tables is rooted, so links are text URLs and base + anchor."""
    lex = ", ".join(f"CAST({phrases('low', c)} > 0 AS INTEGER) AS contains_{c}, {phrases('low', c)} AS {c}_count"
                    for c in fv.LEXICON)
    shorteners = any_of("low", [x.replace(".", r"\.") for x in fv.SHORTENERS])
    page_short = any_of("lower(html)", [x.replace(".", r"\.") for x in fv.SHORTENERS])
    return rf"""
SELECT id, body, html, sender, class, urls, src, length(src) AS text_length, len(ws) AS word_count,
  CASE WHEN len(ws) > 0 THEN length(array_to_string(ws, '')) / len(ws) ELSE 0 END AS avg_word_length,
  CAST({any_of('head', fv.GREETINGS)} AS INTEGER) AS has_greeting,
  CAST({any_of('head', fv.GREETINGS)} AND {any_of('head', [fv.PERSONAL_GREETING])} AS INTEGER) AS has_personal_greeting,
  CAST({any_of('foot', fv.SIGNATURES)} AS INTEGER) AS has_signature,
  CAST({any_of('foot', fv.SIGNATURES)} AND {any_of('foot', fv.COMPANY_SIGNATURES)} AS INTEGER) AS has_company_signature,
  len(urls) AS url_count, len(list_filter(urls, lambda u: {model_rule('u')})) AS suspicious_url_count,
  CASE WHEN len(ws) > 0 THEN len(urls) / len(ws) ELSE 0 END AS url_to_text_ratio,
  length(regexp_replace(src, '[^\p{{Lu}}]', '', 'g')) / greatest(length(src), 1) AS uppercase_ratio,
  length(regexp_replace(src, '[^\p{{Nd}}²³¹]', '', 'g')) / greatest(length(src), 1) AS digit_ratio,
  length(regexp_replace(src, '[^!-/:-@\[-`{{-~]', '', 'g')) / greatest(length(src), 1) AS punctuation_ratio,
  CAST(html <> '' AS INTEGER) AS contains_html, len(regexp_extract_all(html, '<[^>]+>')) AS html_tag_count,
  CAST(regexp_matches(src, '{fv.IP_URL}') OR regexp_matches(html, '{fv.IP_URL}') AS INTEGER)
    + CAST(regexp_matches(src, '{fv.AT_URL}') OR regexp_matches(html, '{fv.AT_URL}') AS INTEGER)
    + CAST(len(list_filter(urls, lambda u: length(u) > 100)) > 0 AS INTEGER)
    + CAST({shorteners} OR {page_short} AS INTEGER) AS mismatched_links,
  {phrases('low', 'urgent')} AS has_urgent_count, {phrases('low', 'threat')} AS has_threat_count,
  CAST({phrases('low', 'financial')} + {phrases('low', 'personal')} > 0 AS INTEGER) AS sensitive_info_requested,
  {lex}
FROM (SELECT *, lower(src) AS low, {words('src')} AS ws, array_to_string(ls[1:5], chr(10)) AS head,
        array_to_string(ls[greatest(len(ls) - 4, 1):], chr(10)) AS foot,
        list_sort(list_distinct(list_concat(regexp_extract_all(src, '{fv.URL_PATTERN}'),
          CASE WHEN base <> '' THEN list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1),
            lambda h: base || h) ELSE [] END))) AS urls
      FROM (SELECT *, {source} AS src, {lines(source)} AS ls,
              regexp_extract(regexp_extract({source}, '{fv.URL_PATTERN}'), '^https?://[^/?#]*') AS base
            FROM proc_fx))"""


VIEWS = {
    "users_fx": """
SELECT c_custkey AS id, c_name AS username,
       lower(replace(c_name, '#', '')) || '@example.com' AS email,
       c_custkey % 50 = 0 AS is_admin,
       CASE WHEN c_custkey % 3 = 0 THEN md5(CAST(c_custkey AS VARCHAR)) END AS session_token,
       TIMESTAMP '2024-01-16' + to_days(CAST(c_custkey % 30 - 15 AS INTEGER)) AS session_expiry
FROM customer""",
    "vendor_fx": """
SELECT key, name, category, result,
       CASE WHEN category = 'malicious' AND contains(result, 'phish') THEN 'phishing'
            WHEN category IN ('malicious', 'suspicious') THEN category ELSE 'clean' END AS verdict
FROM (SELECT l_orderkey AS key, 'vendor' || l_suppkey || '_' || l_linenumber AS name,
             CASE WHEN l_returnflag = 'R' THEN 'malicious' WHEN l_returnflag = 'A' THEN 'suspicious'
                  WHEN l_linestatus = 'F' THEN 'harmless' ELSE 'undetected' END AS category,
             CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 1 THEN 'phishing'
                  WHEN l_returnflag = 'R' THEN 'malware' ELSE 'clean' END AS result
      FROM lineitem)""",
    "input_fx": f"""
SELECT {INPUT_TEXT} AS input FROM events UNION ALL SELECT url FROM pages""",
    "rows_fx": f"""
SELECT event_id AS id, {INPUT_TEXT} AS input_string, {INPUT_TYPE} AS input_type,
       CASE WHEN event_type IN ('click', 'purchase', 'error') THEN 1 ELSE 0 END AS is_malicious,
       CASE event_type WHEN 'click' THEN 'suspicious' WHEN 'purchase' THEN 'malicious'
            WHEN 'error' THEN 'phishing' ELSE 'safe' END AS main_verdict,
       props AS metadata, user_id, ts AS analysis_date
FROM events""",
    "lists_fx": """
SELECT key, list({'name': name, 'verdict': verdict} ORDER BY name, verdict) AS vendors,
       count(*) FILTER (verdict IN ('phishing', 'malicious')) AS bad, count(*) AS total
FROM vendor_fx GROUP BY key""",
    "history_fx": """
SELECT r.*,
       CASE WHEN r.id % 11 <> 0 THEN coalesce(vendors, []) END AS vendors,
       CASE WHEN r.id % 11 <> 0 THEN coalesce(CAST(to_json(vendors) AS VARCHAR), '[]') END AS vendor_analysis,
       CASE WHEN input_type <> 'email' THEN coalesce(bad, 0) || '/' || coalesce(total, 0) END AS community_score
FROM rows_fx r LEFT JOIN lists_fx l ON r.id = l.key""",
    "activity_fx": """
SELECT event_id AS id, user_id, username, is_admin,
       CASE WHEN event_type = 'signup' THEN 'login' ELSE 'logout' END AS action, ts AS timestamp
FROM events JOIN users_fx u ON user_id = u.id WHERE event_type IN ('signup', 'view')""",
    "account_fx": """
SELECT event_id AS id, user_id, username, is_admin,
       CASE event_type WHEN 'signup' THEN 'login' WHEN 'view' THEN 'logout' ELSE 'request' END AS action,
       ts AS timestamp
FROM events JOIN users_fx u ON user_id = u.id""",
    "feedback_fx": """
SELECT event_id AS id, user_id,
       CASE event_type WHEN 'error' THEN 'bug_report' WHEN 'purchase' THEN 'feature_request'
            ELSE 'general_feedback' END AS feedback_type,
       CASE WHEN event_id % 13 <> 0 THEN 'in' || (event_id % 3) END AS input_string,
       event_type AS message, ts AS submission_date
FROM events""",
    "url_feedback_fx": f"""
SELECT event_id AS id, {INPUT_TEXT} AS url, value > 50 AS original_prediction,
       value > 40 AS user_feedback, CAST(user_id AS VARCHAR) AS user_id, ts AS feedback_date
FROM events""",
    "email_fx": """
SELECT d.doc_id AS id,
       CASE d.doc_id % 3 WHEN 0 THEN 'Dear Customer,' WHEN 1 THEN 'Hi Team,' ELSE '' END || chr(10)
       || d.text || chr(10)
       || CASE d.doc_id % 5 WHEN 0 THEN 'Urgent: verify your account at http://10.0.0.1/login'
               WHEN 1 THEN 'Your payment was received. Contact us.'
               WHEN 2 THEN 'Click here https://bit.ly/x1'
               WHEN 3 THEN 'Unsubscribe any time at https://news.example.com/u' ELSE '' END || chr(10)
       || CASE WHEN d.doc_id % 2 = 0 THEN 'Regards,' ELSE '' END AS body,
       p.html AS html, 'Mail ' || d.doc_id AS subject,
       CASE WHEN d.doc_id % 7 = 0 THEN 'support@shop' || (d.doc_id % 5) || '.com'
            ELSE 'user' || d.doc_id || '@example.net' END AS sender,
       l.toxic AS class
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
LEFT JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages)""",
    "proc_fx": f"SELECT *, {processed('body')} AS processed FROM email_fx",
    "feats_fx": features("processed"),
    "raw_fx": features("body"),
    "feed_fx": f"""
SELECT {INPUT_TEXT} AS url, CASE WHEN event_id % 3 = 0 THEN 'ok' ELSE 'no_results' END AS query_status,
       CASE event_id % 4 WHEN 0 THEN 'malware_download' WHEN 1 THEN 'none' END AS threat, 2 AS seen
FROM events WHERE event_id % 5 = 0
UNION ALL SELECT {INPUT_TEXT}, 'ok', 'phishing_kit', 1 FROM events WHERE event_id % 10 = 0""",
    "second_fx": """
SELECT url, query_status, threat FROM feed_fx QUALIFY row_number() OVER (PARTITION BY url ORDER BY seen DESC) = 1""",
    "entries_fx": """
SELECT key, name, e.category AS category, e.result AS result,
       CASE WHEN e.category = 'malicious' AND contains(e.result, 'phish') THEN 'phishing'
            WHEN e.category IN ('malicious', 'suspicious') THEN e.category ELSE 'clean' END AS verdict
FROM (SELECT key, name, max({'category': category, 'result': result}) AS e FROM vendor_fx GROUP BY key, name)""",
    "reports_fx": f"""
SELECT e.event_id AS key, {INPUT_TYPE} AS indicator_type, {INPUT_TEXT} AS indicator,
       v.malicious, v.suspicious, v.harmless, v.undetected, v.vendors
FROM events e JOIN (
  SELECT key, list({{'name': name, 'verdict': verdict}} ORDER BY name, verdict) AS vendors,
         count(*) FILTER (category = 'malicious') AS malicious,
         count(*) FILTER (category = 'suspicious') AS suspicious,
         count(*) FILTER (category = 'harmless') AS harmless,
         count(*) FILTER (category = 'undetected') AS undetected
  FROM entries_fx GROUP BY key) v ON v.key = e.event_id""",
}

NEEDS = {
    "lists_fx": ["vendor_fx"],
    "history_fx": ["rows_fx", "lists_fx"],
    "activity_fx": ["users_fx"],
    "account_fx": ["users_fx"],
    "proc_fx": ["email_fx"],
    "feats_fx": ["proc_fx"],
    "raw_fx": ["proc_fx"],
    "entries_fx": ["vendor_fx"],
    "second_fx": ["feed_fx"],
    "reports_fx": ["entries_fx"],
}
