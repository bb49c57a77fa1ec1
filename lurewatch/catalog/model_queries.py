"""Registered queries that fit, store and apply models on the whole labelled corpus."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lurewatch.catalog.registry import query
from lurewatch.catalog.views import processed
from lurewatch.functions import fixed_values as fv
from lurewatch.functions import text
from lurewatch.operators import mail, model, stats
from lurewatch.plans import mail_check, training
from lurewatch.session import shared_path
from lurewatch.sources import fixtures as fx
from lurewatch.sources import mail as mail_source
from lurewatch.sources import sinks
from lurewatch.sources.tables import scan_history


def corpus(spark, d):
    """Labelled mails whose lure follows the class, so that learning has something to find."""
    return fx.emails(spark, d, separable=True).filter(F.col("class").isNotNull()).select(
        "id", "body", "html", "class")


def metrics(trained):
    scored = trained.classifier.transform(trained.test)
    return stats.class_metrics(scored, "class", "prediction")


_stored: dict[tuple[str, str], str] = {}


def stored_model(spark, d):
    """One forest per session and folder, kept in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _stored:
        path = shared_path(spark, "model")
        training.retrain(spark, corpus(spark, d), path, {"forest": model.forest()})
        _stored[key] = path
    return _stored[key]


@query("ml_tfidf")
def _(spark, d):
    return model.with_idf(training.assemble(corpus(spark, d))[0], spark)


TERMS = r"""
WITH labelled AS (SELECT doc_id AS id, toxic FROM labels),
body AS (SELECT l.id, CASE l.id % 3 WHEN 0 THEN 'Dear Customer,' WHEN 1 THEN 'Hi Team,' ELSE '' END || chr(10)
    || text || chr(10) || CASE WHEN toxic = 1 THEN 'Urgent: verify your account at http://10.0.0.1/login'
      ELSE 'Unsubscribe any time at https://news.example.com/u' END || chr(10)
    || CASE WHEN l.id % 2 = 0 THEN 'Regards,' ELSE '' END AS body
  FROM labelled l JOIN documents d ON d.doc_id = l.id),
words AS (SELECT id, regexp_extract_all(lower(""" + processed("body") + r"""), '[\p{L}\p{M}\p{Nd}_]{2,}') AS w FROM body),
terms AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM words),
seen AS (SELECT term, count(DISTINCT id) AS df FROM terms GROUP BY term)
SELECT term, ln((1 + n) / (1 + df)) + 1 AS weight FROM seen, (SELECT count(*) AS n FROM body)
WHERE df >= 5 AND df <= 0.95 * n"""


@query("ml_tfidf_all_terms", TERMS)
def _(spark, d):
    # No stop words and no cut of the vocabulary, so that SQL can state every weight.
    base = mail.featurize(corpus(spark, d)).select("id", "processed")
    return model.term_weights(base, stop_words=[])


STOPS = "the of and to in is it by on not or at from with was are this".split()
CUT_TERMS = TERMS.replace("terms AS (", """kept AS (SELECT id, list_filter(w, lambda x: x NOT IN ("""
                          + ", ".join(f"'{w}'" for w in STOPS) + """)) AS w FROM words),
terms AS (""").replace("""AS term
  FROM words)""", """AS term
  FROM kept)""").replace("count(DISTINCT id) AS df FROM", "count(DISTINCT id) AS df, count(*) AS tf FROM") + """
ORDER BY tf DESC, term LIMIT 2000"""


@query("ml_tfidf_cut", CUT_TERMS)
def _(spark, d):
    # A short stop list, so that SQL can state it; the cut and its ties are those of every model.
    base = mail.featurize(corpus(spark, d)).select("id", "processed")
    return model.with_idf(model.fit_text(base, stop_words=STOPS), spark)


@query("ml_assemble")
def _(spark, d):
    _, vectors = training.assemble(corpus(spark, d))
    values = vector_to_array("features")
    return vectors.select("id", "class", F.size(values).alias("slots"),
                          F.size(F.filter(values, lambda x: x != 0)).alias("filled"))


RANKED = """
WITH ranked AS (SELECT id, class, row_number() OVER (PARTITION BY class ORDER BY md5(id || '-42'), id) AS rank,
  count(*) OVER (PARTITION BY class) AS n FROM email_fx WHERE class IS NOT NULL)"""


@query("ml_split", RANKED + """
SELECT id, class, rank <= floor(n * 0.8) AS is_train, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM ranked""",
       "email_fx")
def _(spark, d):
    return model.stratified_split(fx.emails(spark, d).select("id", "class")).select(
        "id", "class", "is_train", "fold")


@query("ml_class_weight", """
SELECT class, n, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM (
  SELECT class, count(*) AS n FROM email_fx WHERE class IS NOT NULL GROUP BY class)""", "email_fx")
def _(spark, d):
    return model.class_weights(fx.emails(spark, d).select("class"))


@query("ml_random_forest")
def _(spark, d):
    return metrics(training.train(corpus(spark, d), {"forest": model.forest()}))


@query("ml_gbt")
def _(spark, d):
    return metrics(training.train(corpus(spark, d), {"boosted": model.boosted()}))


@query("ml_svm")
def _(spark, d):
    return metrics(training.train(corpus(spark, d), {"svm": model.linear_svc()}))


@query("ml_cv_select")
def _(spark, d):
    return training.train(corpus(spark, d)).cv


@query("agg_class_metrics", """
WITH p AS (SELECT CAST(original_prediction AS INTEGER) AS l, CAST(user_feedback AS INTEGER) AS g FROM url_feedback_fx),
per AS (SELECT c, count(*) FILTER (l = c) AS support, count(*) FILTER (g = c) AS guessed,
    count(*) FILTER (l = c AND g = c) AS hit FROM p, (VALUES (0), (1)) v(c) GROUP BY c),
s AS (SELECT *, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall FROM per),
t AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)
SELECT CAST(c AS VARCHAR) AS "row", precision, recall, f1, support FROM t
UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support),
  CAST(sum(support) AS BIGINT) FROM t
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM t
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM t""", "url_feedback_fx")
def _(spark, d):
    return stats.class_metrics(fx.url_feedback(spark, d), "original_prediction", "user_feedback")


@query("agg_confusion_matrix", """
SELECT CAST(original_prediction AS INTEGER) AS label, CAST(user_feedback AS INTEGER) AS prediction, count(*) AS n
FROM url_feedback_fx GROUP BY ALL""", "url_feedback_fx")
def _(spark, d):
    return stats.confusion_matrix(fx.url_feedback(spark, d), "original_prediction", "user_feedback")


@query("top_feature_importance")
def _(spark, d):
    stages = model.load_model(stored_model(spark, d)).stages
    names = [*stages[4].vocabulary, *fv.MODEL_FEATURES]
    return model.feature_importance(stages[-1], names, spark)


@query("ml_score")
def _(spark, d):
    loaded = model.load_model(stored_model(spark, d))
    scored = model.score(fx.emails(spark, d).drop("class"), loaded)
    return scored.select("id", "is_phishing", "confidence", "is_service_email",
                         F.col("explanation.confidence_level").alias("confidence_level"),
                         F.col("badge.summary").alias("summary"), F.size("links").alias("n_links"))


EMPTY = "r.id % 10 = 0"
MAIL_FLOW = f"""
SELECT r.id, CASE WHEN {EMPTY} THEN '' ELSE r.sender END AS input_string,
  CASE WHEN {EMPTY} THEN '' ELSE 'Mail ' || r.id END AS subject, CASE WHEN {EMPTY} THEN '-' ELSE CAST(f.word_count AS VARCHAR) END AS words,
  CASE WHEN {EMPTY} THEN 0 ELSE len(r.urls) END AS n_links, CASE WHEN r.id % 4 = 0 THEN sha256('Mail ' || r.id) ELSE '-' END AS attached,
  CAST(r.id AS VARCHAR) AS date, CASE WHEN {EMPTY} THEN '' ELSE r.body END AS body,
  CASE WHEN {EMPTY} THEN 0 ELSE len(r.urls) END AS n_payload_links, CASE WHEN r.id % 4 = 0 THEN 1 ELSE 0 END AS n_attached,
  CASE WHEN {EMPTY} THEN 'Analysis Error' ELSE '-' END AS problem, TRUE AS agrees
FROM raw_fx r JOIN feats_fx f ON f.id = r.id"""


@query("ml_mail_flow", MAIL_FLOW, "raw_fx feats_fx")
def _(spark, d):
    i, no_body = F.col("id"), F.col("id") % 10 == 0
    part = F.struct(F.lit("a.pdf").alias("filename"), F.lit("application/pdf").alias("content_type"),
                    F.col("subject").cast("binary").alias("data"))
    none = F.array().cast("array<struct<filename:string,content_type:string,data:binary>>")
    mails = fx.emails(spark, d).drop("class").withColumns({
        "body": F.when(~no_body, F.col("body")), "date": i.cast("string"), "user_id": i % 7,
        "analysis_date": F.lit(fx.AS_OF),
        "attachments": text.attachment_info(F.when(i % 4 == 0, F.array(part)).otherwise(none))})
    out = shared_path(spark, "mails")
    loaded = model.load_model(stored_model(spark, d))
    for _ in range(2):
        told = mail_check.deliver(mails, loaded, out, "all")
    meta = lambda p: F.get_json_object("metadata", p)
    dash = F.lit("-")
    rows = scan_history(spark, told.history).select(
        "id", "input_string", meta("$.subject").alias("subject"), F.coalesce(meta("$.features.word_count"), dash).alias("words"),
        F.json_array_length(meta("$.embedded_links")).cast("bigint").alias("n_links"),
        F.coalesce(meta("$.attachments[0].hash.sha256"), dash).alias("attached"), meta("$.date").alias("date"),
        "is_malicious", "main_verdict", meta("$.confidence").cast("double").alias("told"))
    payload = spark.read.schema("id bigint, body string, embedded_links array<struct<url:string>>, "
                                "attachments array<struct<filename:string>>").json(told.payload).select(
        "id", "body", F.size("embedded_links").cast("bigint").alias("n_payload_links"), F.size("attachments").alias("n_attached"))
    scored = spark.read.parquet(told.scored).select(
        "id", "is_phishing", "confidence", F.coalesce("problem.summary", dash).alias("problem"))
    agrees = ((F.col("is_malicious") == F.col("is_phishing").cast("int")) & (F.col("told") == F.col("confidence"))
              & (F.col("main_verdict") == F.when(F.col("is_phishing"), "phishing").otherwise("safe")))
    return rows.join(payload, "id").join(scored, "id").select(
        "id", "input_string", "subject", "words", "n_links", "attached", "date", "body", "n_payload_links",
        "n_attached", "problem", agrees.alias("agrees"))


@query("snk_model", "SELECT id, TRUE AS same FROM email_fx WHERE class IS NOT NULL", "email_fx")
def _(spark, d):
    first = model.load_model(stored_model(spark, d))
    again = shared_path(spark, "model")
    model.save_model(first, again)
    base = training.stored_features(corpus(spark, d))
    p = lambda m, n: m.transform(base).select("id", vector_to_array("probability")[1].alias(n))
    both = p(first, "a").join(p(model.load_model(again), "b"), "id")
    return both.select("id", (F.col("a") == F.col("b")).alias("same"))


@query("src_model", "SELECT id, TRUE AS scored FROM email_fx", "email_fx")
def _(spark, d):
    loaded = model.load_model(stored_model(spark, d))
    base = model.model_columns(mail.featurize(fx.emails(spark, d)))
    p = vector_to_array("probability")[1]
    return loaded.transform(base).select("id", p.between(0.0, 1.0).alias("scored"))


@query("ml_evaluate")
def _(spark, d):
    trained = training.train(corpus(spark, d), {"forest": model.forest()})
    scored = trained.classifier.transform(trained.test)
    report = stats.class_metrics(scored, "class", "prediction").select("row", "f1", "support")
    matrix = stats.confusion_matrix(scored, "class", "prediction").select(
        F.concat(F.lit("actual "), "label", F.lit(" predicted "), "prediction").alias("row"),
        F.lit(None).cast("double").alias("f1"), F.col("n").alias("support"))
    return report.unionByName(matrix)


@query("ml_retrain")
def _(spark, d):
    path, out = shared_path(spark, "corpus"), shared_path(spark, "model")
    names = F.when(F.col("class") == 1, F.lit("Phishing Email")).otherwise(F.lit("Safe Email"))
    sinks.write_csv(corpus(spark, d).select(F.col("body").alias("Email Text"),
                                            names.alias("Email Type")), path)
    mails = mail_source.labelled_only(mail_source.read_labelled_csv(spark, path)).select(
        F.xxhash64("text").alias("id"), F.col("text").alias("body"), F.lit("").alias("html"), "class")
    trained = training.retrain(spark, mails, out, training.retrain_candidates())
    return metrics(trained)
