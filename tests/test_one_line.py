"""A preprocessed text is one line: its record needs no lines, and patterns are searched only where they can match."""

from pyspark.sql import functions as F

from lurewatch.functions import fixed_values as fv, html, text

TEXTS = ["hi team, see the notes regards,", "Dear sir", "hey bob yours ,,", "we met ſincerely", "all the best", "best not",
         "copyright © all rights reserved", "this is a system-generated mail", "office: 12", "EMAIL:a@b", "emaıl: x cheers",
         "see www.a.com", "www.a-b.com inc. regards", "the lımited one regards", "lİmited yours", "good morning,, all, best",
         "to whom it may concern cheers", "greetings department sincerely", "verify now, account suspended", "blocked", "", "URL"]


def test_one_line_gives_the_record_of_the_lines(spark):
    c, none = F.col("c"), F.array().cast("array<struct<url:string,text:string,suspicious:boolean>>")
    df = spark.createDataFrame([(t,) for t in TEXTS], "c string").select(
        "c", text.features(c, F.lit("<p>"), none).alias("lines"), text.features(c, F.lit("<p>"), none, one_line=True).alias("line"))
    rows = df.collect()
    assert [r.line for r in rows] == [r.lines for r in rows]
    assert [r.line.has_signature for r in rows[:8]] == [1, 0, 1, 1, 1, 0, 1, 1]
    assert [r.line.has_greeting for r in rows[:3]] == [1, 1, 0] and rows[13].line.has_company_signature == 1
    assert rows[18].line.urgent_count == 2 and rows[19].line.threat_count == 2


def test_needs_keep_every_match(spark):
    df = spark.createDataFrame([("x\nBest,\nJohn",), ("a lımited b\nregards",), ("K\nregards\ncompany",), (None,)], "c string")
    plain = {p: text.line_pattern(p) for p in fv.SIGNATURES + fv.COMPANY_SIGNATURES}
    any_of = lambda patterns: F.greatest(*[F.col("c").rlike(plain[p]).cast("int") for p in patterns])
    got = df.select(text.signature(F.col("c")).alias("s"), any_of(fv.SIGNATURES).alias("a"), any_of(fv.COMPANY_SIGNATURES).alias("b")).collect()
    assert [(r.s.has_signature, r.s.has_company_signature) for r in got[:3]] == [(r.a, r.a * r.b) for r in got[:3]] == [(1, 0), (1, 1), (1, 1)]


def test_the_base_of_links_is_searched_once_a_mail(spark):
    page = F.struct(F.col("anchors"), F.array().cast("array<string>").alias("attributes"))
    assert str(html.found_urls(F.col("body"), page)).count("regexp_extract(") <= 2
    df = spark.createDataFrame([("see https://a.com/x", [("/y", "/y", "t"), ("//h/z", "//h/z", "t"), ("q", "q", "t")]), ("", [("/y", "/y", "t")])],
                               "body string, anchors array<struct<href:string,target:string,text:string>>")
    assert [r[0] for r in df.select(html.found_urls(F.col("body"), page)).collect()] == [
        ["https://a.com/x", "https://a.com/y", "https://h/z"], []]


def test_plain_tags_close_without_a_list_of_places(monkeypatch):
    pages = ["<a href='/x>y'>t</a><b class=\"p\">", "<a href=\"/open>t</a>", "<p x='1\">z'>", "<q " + "y='1' " * 200 + ">e", "<a '\"'>", "<a"]
    near = [list(html.tags(p)) for p in pages]
    scan = html.Scanner(pages[0])
    assert scan.tag_close(2) == 14 and "places" not in vars(scan)
    monkeypatch.setattr(html, "NEAR", 0)
    assert [list(html.tags(p)) for p in pages] == near


def test_links_of_pages_come_as_arrow_columns(spark):
    df = spark.createDataFrame([("<a href='/a/../b'>x &amp; y</a><div style='background:url(http://c.d/e)'>",), (None,), ("<p>",), ("z",)], "h string")
    got = [r[0].asDict(True) for r in df.coalesce(1).select(html.page_links(F.col("h"))).collect()]
    assert got[0] == {"anchors": [{"href": "/a/../b", "target": "/b", "text": "x & y"}], "attributes": ["background:url(http://c.d/e)"]}
    assert got[1:] == [{"anchors": [], "attributes": []}] * 3
