import time

import pytest

from lurewatch.llm import html_text as ht

LONG = ("The reader of the text is told that it was written for him and that this is the way in which "
        "the words of a page are to be found by those who look for them with care. ")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{body}</body></html>"


def test_article_with_everything_around():
    html = page(
        "<header>Site name</header><nav><ul><li><a href=/a>Home</a></li></ul></nav>"
        "<div class='cookie-notice'>" + LONG + "</div><div class=ad>" + LONG + "</div>"
        "<article><h1>A &amp; B</h1><p>" + LONG + "<p>Short.</p><script>var t='</p>'</script>"
        "<p>x&nbsp;y <b>z\n\t w</b><br>v</p><ul><li>one<li>two</ul>"
        "<form><input value=q><label>Mail</label></form>"
        "<div class='comments'><p>" + LONG + "</p></div></article>"
        "<aside>" + LONG + "</aside><section id=comments>" + LONG + "</section>"
        "<footer>&copy; x</footer>")
    assert ht.main_text(html).split("\n") == [
        "A & B", LONG.strip(), "Short.", "x y z w v", "one", "two"]


def test_without_any_container():
    html = page("<div><a href=1>Home</a> <a href=2>News</a> <a href=3>About</a></div><h1>Heading here</h1>"
                "<p>" + LONG * 3 + "</p><p>So it is.</p><p>" + LONG * 3 + "</p>"
                "<div>Terms | <a href=x>Privacy and legal</a></div><div>(c) somebody</div>")
    assert ht.main_text(html).split("\n") == [
        "Heading here", (LONG * 3).strip(), "So it is.", (LONG * 3).strip()]


def test_a_mark_wins_only_with_the_good_blocks():
    story = [f"{k} {LONG * 2}".strip() for k in range(3)]
    told = "".join(f"<p>{x}</p>" for x in story)
    cards = "".join(f"<article class=card><h3>Other {k}</h3><p>{LONG[:120]}</p></article>" for k in range(40))
    for html in (f"<main>{told}</main>{cards}", f"<div>{told}</div>{cards}", f"<main>{told}{cards}</main>",
                 f"{cards}<div>{told}</div>"):
        assert ht.main_text(page(html)).split("\n") == story
    # A mark that wins has its rules of links too, and does not drop good text outside.
    links = "<ul><li><a href=1>Other news that is linked</a></li></ul>"
    assert ht.main_text(page(f"<article>{told}{links}</article><div>{story[0]}</div>")).split("\n") \
        == [*story, story[0]]


@pytest.mark.parametrize("start, end", [
    ("<div class='layout has-sidebar'>", "</div>"), ("<div id=page class='no-comments'>", "</div>"),
    ("<article class='post tag-social category-reviews'>", "</article>"),
    ("<div class='content-sidebar-wrap'><div class=promoted>", "</div></div>"), ("<div class=top-story>", "</div>")])
def test_names_do_not_empty_a_page(start, end):
    story = [f"{k} {LONG * 2}".strip() for k in range(3)]
    inner = "".join(f"<p>{x}</p>" for x in story)
    ad = f"<div class=ad>{LONG * 2}</div><section id=comments><p>{LONG * 2}</p></section>"
    assert ht.main_text(page(start + inner + ad + end)).split("\n") == story


def test_names_still_count():
    story = [f"{k} {LONG * 2}".strip() for k in range(2)]
    said = "".join(f"<div class=comment><p>{LONG * 2}</p></div>" for _ in range(30))
    for name in ("comment-list", "comments", "site-footer", "cookie-notice", "main-nav"):
        html = page(f"<div><p>{story[0]}</p><p>{story[1]}</p></div><div class='{name}'>{said}</div>")
        assert ht.main_text(html).split("\n") == story, name


def test_other_languages_tables_and_code():
    menu = "<div>This is the menu of the site</div><ul><li><a href=1>About the site and us</a></li></ul>"
    russian = "Вчера вечером жители города собрались около старого театра чтобы обсудить новый закон " * 3
    polish = "Wczoraj wieczorem mieszkańcy miasta zebrali się przed starym teatrem i rozmawiali o prawie " * 3
    for text in (russian, polish):
        got = ht.main_text(page(menu + f"<div><p>{text}</p><p>{text[:100]}</p><p>{text}</p></div>"))
        assert got.split("\n")[-3:] == [text.strip(), text[:100].strip(), text.strip()]
    code = "for (int k = 0; k < size; k++) { total += values[k] * factor[k]; print(total, k, size); } " * 3
    got = ht.main_text(page(f"<div><p>{LONG * 2}</p><pre>{code.replace('<', '&lt;')}</pre>"
                            f"<p>{LONG * 2}</p><p>{russian}</p><p>{LONG * 2}</p></div>"))
    assert got.split("\n") == [(LONG * 2).strip(), code.strip(), (LONG * 2).strip(), russian.strip(),
                               (LONG * 2).strip()]


def test_broken_markup():
    assert ht.main_text("<article><p>a < b && c<p>d<!-- e --><!--> f</article>") == "a < b && c\nd f"
    assert ht.main_text("<article>a<script>var x = 1; b") == "a"
    assert ht.main_text("<article><p title='>'>a</p><p title=\"x>b</p>") == "a\nb"
    assert ht.main_text("") == "" and ht.main_text(None) == ""
    assert ht.main_text("<b><article>x</b><p>y</article>z") == "x\ny"


@pytest.mark.parametrize("piece", ["<a href=\"x ", "<!-- ", "<script>", "<", "</", "<p ", "&amp", "<li><p>",
                                   "<textarea>", "<div class='a", "<title", "<a x='>' "])
def test_time_grows_in_step(piece):
    def seconds(n):
        text = "<article>" + piece * (n // len(piece))
        start = time.process_time()
        ht.main_text(text)
        return time.process_time() - start

    assert seconds(1 << 20) < 12 * max(seconds(1 << 18), 0.05)


def test_table(spark, table):
    rows = [(1, "u", page("<article><p>" + LONG + "</article>"), "a"), (2, None, None, "b"),
            (2, None, None, "b"), (None, "w", "", "c")]
    df = table(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.text, r.n_chars) for r in ht.extract(df).collect()),
                 key=str)
    text = LONG.strip()
    assert got == [(0, "w", "", 0), (1, "u", text, len(text)), (2, None, "", 0), (2, None, "", 0)]
    assert ht.extract(df.where("false")).count() == 0


STORY = ["The council of the town said on Monday that it would not build the road, and that the money was to go to "
         "the school by the river, which has been in need of a new roof for as long as anyone in the town can say.",
         "It was the first time in years that the plans of the mayor were not what the council had in mind for it, and "
         "those who had come to the hall to hear of it were as much in doubt as the members who had to vote on it.",
         "For the school it is not yet clear when the work is to begin, but the head of it said that she was glad to "
         "have the word of the council, and that the children would be told of it when they are back from the lakes."]


def page(inner, before="", after=""):
    menu = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
    return f"<html><body>{before}<nav>{menu}</nav>{inner}<footer>Copyright 2024 The Town Paper</footer>{after}</body></html>"


def paragraphs(texts):
    return "".join(f"<p>{t}</p>" for t in texts)


def test_page_inside_a_form():
    whole = page(f"<form id=aspnetForm><div class=content>{paragraphs(STORY)}</div><label>Search</label></form>")
    assert ht.main_text(whole).split("\n")[:3] == STORY
    one = f"<html><body><form><div><p>{STORY[0]}</p></div></form></body></html>"
    assert ht.main_text(one) == STORY[0]
    beside = page(f"<article>{paragraphs(STORY)}</article><form><p>{STORY[1]}</p><input></form>")
    assert ht.main_text(beside) == "\n".join(STORY)


def test_copyright_is_a_notice_only_if_short():
    text = "Copyright law is not what the council had in mind, the members said, as it was for the court to say. " * 2
    told = page(f"<div>{paragraphs([STORY[0], text.strip(), STORY[1]])}</div>", after="<p>Copyright (c) 2023 Paper</p>")
    assert ht.main_text(told) == "\n".join([STORY[0], text.strip(), STORY[1]])
    short = page(f"<div>{paragraphs([STORY[0], 'Copyright matters here.', STORY[1], '© 2024 Someone'])}</div>")
    assert ht.main_text(short) == "\n".join([STORY[0], "Copyright matters here.", STORY[1]])


def test_linked_paragraphs():
    short = "See <a href=/map>the map</a> first, then read."
    told = page(f"<div>{paragraphs([STORY[0], short, STORY[1]])}</div>")
    assert ht.main_text(told) == "\n".join([STORY[0], "See the map first, then read.", STORY[1]])
    linked = f"<p><a href=/more>{STORY[1]}</a></p>"
    told = page(f"<article>{paragraphs(STORY[:1])}{linked}{paragraphs(STORY[2:])}</article>")
    assert ht.main_text(told) == "\n".join(STORY)


def test_deeply_nested_names():
    for depth in (1, 31, 40, 200):
        inner = "<div class=widget>" * depth + paragraphs(STORY) + "</div>" * depth
        assert ht.main_text(page(inner)) == "\n".join(STORY), depth
