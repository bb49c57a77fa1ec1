"""Operators against brute force on small fixtures, edge rows and hot keys."""

import datetime as dt
import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from lurewatch import schema
from lurewatch.operators import curves, history, maintenance, model, prefix, reputation, sessions, spacing, stats
from lurewatch.plans import exports
from lurewatch.sources import mail as mail_source
from lurewatch.sources import sinks
from lurewatch.sources.tables import scan_history

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def greedy(times, horizon):
    last, kept = None, set()
    for s in sorted(set(times)):
        if last is None or s >= last + horizon:
            kept.add(s)
            last = s
    return kept


def test_minute_rule(spark):
    rows = [(i, 1, "a", at(s)) for i, s in enumerate([0, 30, 59, 60, 90, 120])]
    rows += [(100 + i, 1, None, at(s)) for i, s in enumerate([0, 1, 2])]
    df = spark.createDataFrame(rows, "id bigint, u bigint, k string, ts timestamp")
    got = {r["id"]: r["accepted"] for r in spacing.mark_accepted(df, ["u", "k"], "ts", "id", 60).collect()}
    assert [got[i] for i in range(6)] == [True, False, False, True, False, True]
    assert all(got[100 + i] for i in range(3))


@pytest.mark.parametrize("horizon,spread", [(60, 5 * 86400), (3600, 20 * 86400), (21600, 9 * 86400),
                                            (86400, 30 * 86400), (200_000, 60 * 86400), (7, 200_000)])
def test_spacing_equals_brute_force(spark, horizon, spread):
    rng = random.Random(horizon)
    # One key holds most rows, densely enough that decisions run through every chunk.
    hot = [(0, rng.randrange(spread)) for _ in range(6000)]
    cold = [(1 + rng.randrange(40), rng.randrange(spread)) for _ in range(800)]
    rows = [(i, k, at(s)) for i, (k, s) in enumerate(hot + cold)]
    df = spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp").repartition(5)
    seconds = {i: (k, int((t - T0).total_seconds())) for i, k, t in rows}
    kept = {seconds[r["id"]] for r in spacing.accepted_ids(df, ["k"], "ts", "id", horizon).collect()}
    want = {(k, s) for k in range(41)
            for s in greedy([x for kk, x in seconds.values() if kk == k], horizon)}
    assert kept == want


def test_same_second_keeps_the_first(spark):
    rows = [(2, 1, at(0)), (1, 1, at(0) + dt.timedelta(microseconds=5)), (3, 1, at(61))]
    df = spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp")
    assert sorted(r["id"] for r in spacing.accepted_ids(df, ["k"], "ts", "id", 60).collect()) == [2, 3]


def brute_curves(pairs):
    scores = sorted({s for s, _ in pairs}, reverse=True)
    tp = [sum(1 for s, y in pairs if s >= c and y == 1) for c in scores]
    fp = [sum(1 for s, y in pairs if s >= c and y == 0) for c in scores]
    keep = [i for i in range(len(scores)) if i in (0, len(scores) - 1)
            or fp[i - 1] - 2 * fp[i] + fp[i + 1] or tp[i - 1] - 2 * tp[i] + tp[i + 1]]
    roc = [(0.0, 0.0)] + [(fp[i] / fp[-1], tp[i] / tp[-1]) for i in keep]
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(roc, roc[1:]))
    pr = [(tp[i] / (tp[i] + fp[i]), tp[i] / tp[-1]) for i in reversed(range(len(scores)))] + [(1.0, 0.0)]
    return roc, area, pr


@pytest.mark.parametrize("distinct", [1, 2, 30, 20_000])
def test_curves_equal_brute_force(spark, distinct):
    rng = random.Random(distinct)
    pairs = [(rng.randrange(distinct + 1) / (distinct + 1), rng.randrange(2)) for _ in range(1500)]
    df = spark.createDataFrame(pairs, "score double, label int").repartition(7)
    roc, area, pr = brute_curves(pairs)
    flat = lambda points: [x for p in points for x in p]
    got = [(r["fpr"], r["tpr"]) for r in curves.roc_points(df).orderBy("position").collect()]
    assert flat(got) == pytest.approx(flat(roc))
    assert curves.roc_auc(df).first()["auc"] == pytest.approx(area)
    points = curves.pr_points(df).orderBy(F.col("threshold").asc_nulls_last()).collect()
    assert flat((r["precision"], r["recall"]) for r in points) == pytest.approx(flat(pr))


def test_crowded_scores_spread(spark):
    rows = spark.range(20000).select((F.col("id") / 2e8).alias("score"), (F.col("id") % 2).alias("label"))
    ranges = curves._points(curves.score_counts(rows.repartition(8)))
    assert ranges.count() == 20000
    top = ranges.agg(F.max("tp"), F.max("fp")).first()
    assert tuple(top) == (10000, 10000)


def test_feeds_with_repeated_urls(spark):
    checks = spark.createDataFrame([(1, "u", "url", False, [], "{}", None), (2, "u", "url", True, [], '{"a":1}', None),
                                    (3, "w", "url", False, [], "{}", None), (4, "u", "url", False, [], "{}", "failed")],
                                   "id bigint, normalized_input string, input_type string, is_malicious boolean, "
                                   "vendors array<struct<name:string,verdict:string>>, metadata string, error string")
    feed = spark.createDataFrame([("u", "ok", None, 1), ("u", "ok", "kit", 2), ("u", "gone", "kit", 0)],
                                 "url string, query_status string, threat string, seen int")
    got = {r["id"]: r for r in reputation.join_second_feed(checks, feed).collect()}
    assert len(got) == 4 and [got[i]["is_malicious"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[1]["metadata"] == '{"urlhaus_status":"ok","urlhaus_threat":"kit"}'
    assert got[2]["metadata"] == '{"a":1,"urlhaus_status":"ok","urlhaus_threat":"kit"}'
    assert got[3]["metadata"] == got[4]["metadata"] == "{}"
    urls = spark.createDataFrame([("u",), ("u",)], "url string")
    stats_rows = spark.createDataFrame([("u", {"malicious": 1, "harmless": 1}, 1), ("u", {"malicious": 3, "harmless": 1}, 2)],
                                       "url string, last_analysis_stats map<string,bigint>, seen int")
    fused = reputation.fuse_feeds(urls, stats_rows, feed).collect()
    assert [r["confidence"] for r in fused] == [0.8, 0.8] and len(fused) == 2


def test_curve_edges(spark):
    empty = spark.createDataFrame([], "score double, label int")
    assert curves.roc_points(empty).count() == 0
    assert curves.roc_auc(empty).first()["auc"] == 0.0
    one_class = spark.createDataFrame([(0.1, 1), (0.9, 1)], "score double, label int")
    assert {r["fpr"] for r in curves.roc_points(one_class).collect()} == {None}
    assert curves.roc_auc(one_class).first()["auc"] is None


def test_date_filter_excludes_the_end_day(spark):
    rows = [(1, dt.datetime(2024, 1, 20)), (2, dt.datetime(2024, 1, 19, 23, 59, 59)), (3, dt.datetime(2024, 1, 5))]
    df = spark.createDataFrame(rows, "id bigint, analysis_date timestamp")
    got = history.filter_history(df, date_from="2024-01-06", date_to="2024-01-20")
    assert [r["id"] for r in got.collect()] == [2]


def test_paging_edges(spark):
    df = spark.range(23).withColumn("analysis_date", F.lit(T0))
    order = [F.desc("id")]
    last = history.page(df, order, 3, 10).collect()
    assert len(last) == 3 and {(r["total"], r["pages"], r["first_row"], r["last_row"]) for r in last} == {(23, 3, 21, 23)}
    assert history.page(df, order, 4, 10).count() == 0
    assert history.page(df.filter("id < 0"), order, 1, 10).count() == 0


def test_running_sum_across_buckets(spark):
    rng = random.Random(3)
    key = lambda i: "hot" if rng.random() < 0.8 else (None if i % 7 == 0 else f"k{i % 5}")
    rows = [(i, key(i), rng.randrange(1000), rng.randrange(4)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, k string, t bigint, v bigint")
    got = prefix.running_sum(df, ["k"], F.floor(F.col("t") / 50), [F.col("t"), F.col("id")], {"total": F.col("v")})
    totals, want = {}, {}
    for i, k, t, v in sorted(rows, key=lambda r: (r[2], r[0])):
        totals[k] = totals.get(k, 0) + v
        want[i] = totals[k]
    assert {r["id"]: r["total"] for r in got.collect()} == want


def test_sessions(spark):
    day = 86_400
    rows = [(1, at(0)), (1, at(day)), (1, at(2 * day + 1)), (2, at(5))]
    df = spark.createDataFrame(rows, "user_id bigint, timestamp timestamp")
    got = {(r["user_id"], r["session"]): r["requests"] for r in sessions.sliding_sessions(df).collect()}
    assert got == {(1, 1): 2, (1, 2): 1, (2, 1): 1}


def test_single_session(spark):
    rows = [(1, 7, "u", False, "login", at(0)), (2, 7, "u", False, "login", at(100)),
            (3, 7, "u", False, "logout", at(200)), (4, 7, "u", False, "login", at(300)),
            (5, 7, "u", False, "login", at(300 + 86_400)), (6, 8, "a", True, "login", at(0)),
            (7, 8, "a", True, "login", at(1))]
    df = spark.createDataFrame(
        rows, "id bigint, user_id bigint, username string, is_admin boolean, action string, timestamp timestamp")
    got = {r["id"]: r["outcome"] for r in sessions.single_session(df).collect()}
    assert got == {1: "accepted", 2: "refused", 3: "logout", 4: "accepted", 5: "accepted",
                   6: "accepted", 7: "accepted"}


def test_schema_alignment_and_history_sink(spark, tmp_path):
    old = spark.createDataFrame([(1, "http://a", T0)], "id bigint, url string, analysis_date timestamp")
    row = schema.align_schema(old).first()
    assert (row["input_string"], row["main_verdict"], row["timezone"], row["user_id"]) == (
        "http://a", "unknown", "UTC", None)
    path = str(tmp_path / "history")
    sinks.append_history(old, path)
    sinks.append_history(old.withColumn("analysis_date", F.lit(at(3 * 86_400))), path)
    stored = scan_history(spark, path)
    assert stored.count() == 2
    plan = stored.filter(F.col("analysis_day") >= "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(analysis_day" in plan


def test_maintenance(spark):
    users = spark.createDataFrame([(1, "t", T0), (2, "t", at(10)), (3, None, None)],
                                  "id bigint, session_token string, session_expiry timestamp")
    when = at(5).replace(tzinfo=dt.timezone.utc)
    got = {r["id"]: r["session_token"] for r in maintenance.expire_sessions(users, when).collect()}
    assert got == {1: None, 2: "t", 3: None}
    rows = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "id bigint, user_id bigint")
    doomed = users.filter("session_token is not null")
    assert sorted(r["id"] for r in maintenance.drop_users(rows, doomed, "user_id").collect()) == [2, 3]


def test_csv_corpus(spark, tmp_path):
    path = tmp_path / "mails.csv"
    path.write_text('Email Text,Email Type\n"a ""quoted"" text\nwith lines, commas",Phishing Email\n'
                    "plain,Safe Email\nodd,Other\n,Safe Email\n")
    corpus = mail_source.read_labelled_csv(spark, str(path))
    assert corpus.count() == 3
    rows = {r["text"]: r["class"] for r in mail_source.labelled_only(corpus).collect()}
    assert rows == {'a "quoted" text\nwith lines, commas': 1, "plain": 0}
    with pytest.raises(ValueError):
        mail_source.read_labelled_csv(spark, str(path), text="Body")
    assert stats.dataset_stats(corpus).first()["total"] == 3


def test_eml_folder(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(
        b'From: a@example.com\r\nSubject: Hi\r\nContent-Type: multipart/mixed; boundary="x"\r\n\r\n'
        b"--x\r\nContent-Type: text/plain\r\n\r\nbody\r\n--x\r\nContent-Type: text/plain\r\n"
        b'Content-Disposition: attachment; filename="n.txt"\r\n\r\nnote\r\n--x\r\n'
        b'Content-Type: application/pdf\r\nContent-Disposition: attachment; filename="f.pdf"\r\n\r\nPDF\r\n--x--\r\n')
    (tmp_path / "bad.eml").write_bytes(b"Subject: x\r\nContent-Type: text/plain\r\n\r\n\xff\xfe\xff")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in mail_source.read_eml_folder(spark, str(tmp_path)).collect()}
    good = rows["a.eml"]
    assert good["subject"] == "Hi" and good["body"] == "bodynote"
    assert [(x["filename"], x["size"]) for x in good["attachments"]] == [("f.pdf", 3)]
    assert good["headers"]["From"] == "a@example.com" and good["error"] is None
    assert rows["bad.eml"]["error"] and rows["bad.eml"]["body"] is None


def test_split_is_exact_and_stable(spark):
    df = spark.range(1000).withColumn("class", (F.col("id") % 4 == 0).cast("int"))
    first = {r["id"]: (r["is_train"], r["fold"]) for r in model.stratified_split(df).collect()}
    again = {r["id"]: (r["is_train"], r["fold"]) for r in model.stratified_split(df.repartition(13)).collect()}
    assert first == again
    assert sum(t for i, (t, _) in first.items() if i % 4 == 0) == 200
    assert sum(t for i, (t, _) in first.items() if i % 4) == 600


def test_forest_beats_the_majority(spark):
    from lurewatch.catalog import model_queries
    from lurewatch.plans import training

    corpus = model_queries.corpus(spark, "/root/testdata/sf0.01")
    trained = training.train(corpus, {"forest": model.forest(numTrees=30, maxDepth=8)})
    scored = trained.classifier.transform(trained.test)
    rows = {r["row"]: r for r in stats.class_metrics(scored, "class").collect()}
    share = trained.test.filter("class = 0").count() / trained.test.count()
    majority_f1 = share * 2 * share / (1 + share)
    assert rows["weighted avg"]["f1"] > majority_f1


def test_class_metrics_without_predictions(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")
    rows = {r["row"]: r for r in stats.class_metrics(df).collect()}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == (0.0, 0.0, 0.0)
    assert rows["accuracy"]["f1"] == 0.5


def test_empty_history(spark):
    empty = spark.createDataFrame([], schema.HISTORY)
    when = T0.replace(tzinfo=dt.timezone.utc)
    assert stats.admin_metrics(empty, when).first()["safe_rate"] == 0.0
    assert stats.global_stats(empty).first()["threat_percentage"] == 0.0
    assert {r["n"] for r in stats.vendor_agreement(empty, when).collect()} == {0}
    assert exports.vendor_scores(empty, when).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(i, 1 if rng.random() < 0.5 else i % 9, at(rng.randrange(86_400)), "x") for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, user_id bigint, analysis_date timestamp, input_string string")
    pick = lambda d: sorted(map(tuple, history.recent_per_user(d, 5).collect()))
    assert pick(df.repartition(1)) == pick(df.repartition(17))


def test_late_boosting_rounds_still_split(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        x = [rng.random() for _ in range(6)]
        rows.append((i, float(x[0] + x[1] * x[2] + rng.gauss(0, 0.4) > 0.8), Vectors.dense(x)))
    df = spark.createDataFrame(rows, ["id", "class", "features"])
    fitted = model.boosted(maxIter=30).fit(df)
    assert sum(t.numNodes > 1 for t in fitted.trees[-10:]) == 10


def test_vocabulary_ties_go_by_term(spark):
    df = spark.createDataFrame([(i, "bb aa cc dd" if i % 2 else "dd cc aa ee") for i in range(6)], "id int, processed string")
    listed = PipelineModel(model.term_stages([])).transform(df)
    assert model.top_terms(listed, 3, 2, 100) == ["aa", "cc", "dd"]
    assert model.top_terms(listed, 3, 2, 0.5) == ["aa cc", "aa ee", "bb"]
