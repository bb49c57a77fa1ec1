"""Stored current rows and the history writer."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from lurewatch.operators import history
from lurewatch.plans import indicator_check
from lurewatch.sources import current, deletes, sinks
from lurewatch.sources.mail import read_quoted_csv
from lurewatch.sources.tables import scan_history
from lurewatch.streaming import check_stream

T0 = dt.datetime(2024, 1, 1)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path)
            for f in names if f.endswith(".parquet")}


def test_current_rows(spark, tmp_path):
    rng = random.Random(1)
    path, best = str(tmp_path / "current"), {}
    kind = "kind string, name string, version int, value map<string,int>"
    for part in range(4):
        rows = [(rng.choice("ab"), f"n{rng.randrange(60)}", rng.randrange(10 ** 6), {"v": part}) for _ in range(80)]
        rows += [(None, "x", 1, None), ("a", None, 1, None)]
        for k, n, v, value in rows:
            if k and n and (best.get((k, n), (-1,))[0] < v):
                best[k, n] = v, value
        for _ in range(2):
            current.put(spark.createDataFrame(rows, kind), path, ["kind", "name"], ["version"], 16)
    got = {(r.kind, r.name): (r.version, r.value) for r in spark.read.parquet(path).collect()}
    assert got == best
    asked = spark.createDataFrame([("a", "n1"), (None, "n2"), ("zz", "none")], "kind string, name string")
    found = current.get(path, asked, ["kind", "name"], 16)
    assert len(found.inputFiles()) >= 1 and {(r.kind, r.name) for r in found.collect()} <= set(best)
    assert ("a", "n1") not in best or ("a", "n1") in {(r.kind, r.name) for r in found.collect()}
    scanned = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scanned and "bucket" in scanned
    assert current.get(path, asked.where("false"), ["kind", "name"], 16).count() == 0


def test_arrivals_rewrite_their_buckets(spark, tmp_path):
    path = str(tmp_path / "current")
    kind = "name string, version int"
    current.put(spark.createDataFrame([(f"n{i}", 1) for i in range(500)], kind), path, ["name"], ["version"], 32)
    before = files(path)
    current.put(spark.createDataFrame([("n7", 2), ("n7", 0)], kind), path, ["name"], ["version"], 32)
    after = files(path)
    assert len(before) == 32 and len(set(before) - set(after)) == 1
    assert spark.read.parquet(path).where("name = 'n7'").first().version == 2
    assert spark.read.parquet(path).count() == 500


def test_batch_reads_current_rows_only(spark, tmp_path):
    reports, feed, out = (str(tmp_path / n) for n in ("reports", "feed", "out"))
    kind = ("key bigint, indicator_type string, indicator string, last_analysis_stats map<string,bigint>, "
            "last_analysis_results map<string,struct<category:string,result:string>>")
    rows = [(i, "url", f"https://a/{i % 400}", {"malicious": i % 2, "harmless": 2},
             {"v1": ("malicious" if i % 2 else "harmless", "site")}) for i in range(800)]
    every = spark.createDataFrame(rows, kind)
    other = spark.createDataFrame([("https://a/3", "ok", "phish", 1), ("https://a/5", "ok", None, 1),
                                   ("https://a/3", "ok", None, 0)],
                                  "url string, query_status string, threat string, seen int")
    indicator_check.deliver_reports(every.where("key >= 400"), reports)
    indicator_check.deliver_reports(every.where("key < 400"), reports)
    indicator_check.deliver_feed(other, feed)
    message = lambda i: json.dumps({"type": "check_url", "url": f"https://a/{i}", "analyze": True,
                                    "saveToHistory": i % 2 == 0, "user_id": i})
    batch = spark.createDataFrame([(i, T0, message(i)) for i in (2, 3, 5, 9, 999)] + [(7, T0, "{}")],
                                  "id bigint, ts timestamp, message string")
    want = check_stream.respond(batch, every, other)
    columns = ["id", "kind", "main_verdict", "is_malicious", "vendor_analysis", "community_score", "metadata", "save"]
    told = indicator_check.check_stored(check_stream.asked(batch), reports, feed)
    assert sorted(map(tuple, told.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    typed = check_stream.asked(batch).select(F.lit("url").alias("indicator_type"), F.col("input").alias("indicator"))
    read = current.get(reports, typed, ["indicator_type", "indicator"])
    assert 0 < read.select(F.input_file_name()).distinct().count() <= 5
    write = check_stream.writer(out, reports, feed)
    for _ in range(2):
        write(batch, 0)
    assert spark.read.parquet(f"{out}/replies").count() == 6
    assert [r.id for r in scan_history(spark, f"{out}/history").collect()] == [2]


def test_history_files_follow_rows(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.range(1000).select("id", F.lit("x").alias("input_string"), F.lit("url").alias("input_type"), F.expr(
        "timestamp'2024-01-01' + make_dt_interval(if(id < 900, 0, cast(id % 5 as int)))").alias("analysis_date")).repartition(20)
    for _ in range(2):
        sinks.append_history(rows, path, "one", 300)
    per_day = {}
    for f in files(path):
        day = f.split("analysis_day=")[1].split("/")[0]
        per_day[day] = per_day.get(day, 0) + 1
    assert per_day.pop("2024-01-01") <= 4 and set(per_day.values()) == {1}
    stored = scan_history(spark, path)
    assert stored.count() == 1000 and "batch" not in stored.columns
    sinks.append_history(rows, path)
    assert scan_history(spark, path).count() == 2000
    sinks.append_history(rows.where("false"), path, "empty")
    assert scan_history(spark, path).count() == 2000


def history_rows(spark, n=3000):
    return spark.range(n).select(
        "id", F.lit("x").alias("input_string"), F.lit("url").alias("input_type"), (F.col("id") % 40).alias("user_id"),
        F.expr("timestamp'2024-01-01' + make_dt_interval(cast(id % 9 as int), 0, 0, cast(id % 13 as double))")
        .alias("analysis_date"))


def test_deletions(spark, tmp_path):
    path = str(tmp_path / "history")
    sinks.append_history(history_rows(spark).where("id < 1500"), path, 1)
    sinks.append_history(history_rows(spark).where("id >= 1500"), path, 2)
    left = lambda: {r.id for r in deletes.read_history(spark, path).select("id").collect()}
    assert left() == set(range(3000)) and deletes.compact(spark, path) == []
    rows = spark.read.parquet(path)
    before = files(path)
    gone = rows.where("id % 9 = 4 AND id < 700 OR id % 9 = 2 AND id >= 1500")
    expected = set(range(3000)) - {r.id for r in gone.collect()}
    for _ in range(2):
        deletes.delete_rows(gone, path)
    assert left() == expected and files(path) == before
    assert deletes.compact(spark, path) == [dt.date(2024, 1, 3), dt.date(2024, 1, 5)]
    assert left() == expected
    days = lambda found: {f.split("analysis_day=")[1].split("/")[0] for f in found}
    assert days(set(before) - set(files(path))) == {"2024-01-03", "2024-01-05"}
    # All of day 3 in batch 2 is gone: its file stays and is covered by the marks.
    deletes.delete_users(spark, path, spark.createDataFrame([(3,), (3,), (5,)], "id bigint"))
    deletes.compact(spark, path)
    assert left() == {i for i in expected if i % 40 not in (3, 5)}


def test_expired_sessions_rewrite_their_buckets(spark, tmp_path):
    path = str(tmp_path / "users")
    kind = "id bigint, session_token string, session_expiry timestamp"
    rows = [(i, "t", T0 + dt.timedelta(days=0 if i == 17 else 9)) for i in range(400)] + [(900, None, None)]
    deletes.store_users(spark.createDataFrame(rows, kind), path, 0)
    before = files(path)
    deletes.expire_sessions(spark, path, dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc), 1)
    assert len(set(before) - set(files(path))) == 1
    got = {r.id: r.session_token for r in spark.read.parquet(path).collect()}
    assert got.pop(17) is None and got.pop(900) is None and set(got.values()) == {"t"} and len(got) == 399


def test_pages_by_time(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = history_rows(spark).unionByName(history_rows(spark, 15).withColumns(
        {"analysis_date": F.lit(None).cast("timestamp"), "id": F.col("id") + 5000}))
    sinks.append_history(rows, path)
    stored = scan_history(spark, path).select("id", "analysis_date", "analysis_day")
    order = [F.desc("analysis_date"), F.desc("id")]
    columns = ["id", "analysis_date", "total", "pages", "first_row", "last_row"]
    for number, per, most in ((1, 10, 50), (7, 50, 100), (101, 30, 10), (43, 70, 10 ** 6), (302, 10, 5), (301, 10, 20), (400, 10, 5)):
        want = history.page(stored, order, number, per).select(*columns).collect()
        got = history.page_by_time(stored, number, per, most=most).select(*columns).collect()
        assert list(map(tuple, got)) == list(map(tuple, want))
    deep = history.page_by_time(stored, 55, 20, most=50)
    assert "PartitionFilters: [isnotnull(analysis_day" in deep._jdf.queryExecution().executedPlan().toString()
    assert history.page_by_time(stored.where("false")).count() == 0


def test_csv_in_splits(spark, tmp_path):
    rng = random.Random(3)
    folder = tmp_path / "mails"
    folder.mkdir()
    cells, rows = ["plain", "two\nlines", 'a "quoted" word', "comma, and\n\n\nmore", "", "x" * 300, "end\n", '"', "é\r\nü"], []
    for name, end in (("one.csv", "\n"), ("two.csv", "\r\n")):
        part = [(str(i), rng.choice(cells), rng.choice(cells)) for i in range(400)]
        rows += part
        quoted = lambda c: '"' + c.replace('"', '""') + '"' if c else c
        text = end.join(["n,Email Text,Email Type"] + [",".join(map(quoted, r)) for r in part]) + end
        (folder / name).write_bytes(text.encode())
    whole = spark.read.csv(str(folder), header=True, multiLine=True, escape='"', quote='"')
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = read_quoted_csv(spark, str(folder))
        assert lines.columns == ["n", "Email Text", "Email Type"]
        tell = lambda df: sorted(tuple((c or "").replace("\r\n", "\n") for c in r) for r in df.collect())
        got = tell(lines)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == tell(whole) == sorted(tuple(c.replace("\r\n", "\n") for c in r) for r in rows)
