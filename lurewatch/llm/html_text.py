"""Main text of web pages by two passes over their blocks.

A forward-only reader cuts a page into blocks at block elements and gives each block its text, its
link characters, whether it is a heading, and the kind of container it stands in. Pass one labels a
block by its own features: containers that never hold the article (menus, footers, sidebars, forms,
adverts, notices, comments) and blocks of links are bad; long blocks with many stop words are good;
the rest is short or near good. Pass two gives the undecided blocks the label of their nearest decided
neighbours: between two good ones good, between two bad ones bad, else that of the nearer side.
Marked articles, or else ``main``, are a prior: if the marked part holds most of what is good by its own
features, its blocks are judged one class milder, and undecided blocks only look at their own side of the
mark. Otherwise marks count for nothing, so teasers in ``article`` do not displace a story outside. Long
blocks that are good by their own features stay on either side. Where no block is good, the near ones are.

Stop words count in the language that knows most of a block's words. A page that no listed language knows
is judged by length and links alone, and a block with few stop words is undecided, not bad: text of other
languages, tables and code go with what stands around them. A class or id names a bad container by its
words, unless it only states what the element has or is filed under (``has-sidebar``, ``tag-social``); a
container that holds nearly all good text of the page is not bad by name.

Every piece of the page is looked at once, so unclosed quotes, comments, scripts and tags cost no more
than others. Defined cases: a null page is empty and has no text; an empty table gives an empty result;
rows are independent of each other, and extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurewatch.llm.common import text_slices

LENGTH_LOW, LENGTH_HIGH = 70, 200
STOP_LOW, STOP_HIGH, LINKS_HIGH = 0.15, 0.25, 0.4

# Frequent function words of some European languages, a line each; density only, so they may be short.
STOP_WORDS = [frozenset(line.split()) for line in """
the of and to in is that for it as was with be by on not he his this are or at from which you an we a
der die und das ist von den mit sich des auf für nicht ein eine als auch es im dem zu werden sie wir in
le la les et est des un une du dans que qui pour pas sur au par ce il en plus avec ne se sont de a
el los las y que en un una por con no para su es al lo como más del se pero sus o este la de a
il di che e la per un una in non con del da sono si dei gli a i
de het een van en dat die in te is op met voor niet aan er om ook als bij
o a os as do da em um uma para com não por mais no na dos de que e se
""".strip().split("\n")]
_LANGUAGES = {word: [k for k, known in enumerate(STOP_WORDS) if word in known]
              for word in frozenset().union(*STOP_WORDS)}

BLOCKS = frozenset("""
address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
main menu nav noframes noscript ol optgroup option p pre section select summary table tbody td
template textarea tfoot th thead title tr ul button
""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("""
script style head title noscript template svg math object iframe canvas audio video noembed noframes
select option textarea button xmp map datalist
""".split())
# Elements that close an open <p>.
CLOSES_P = BLOCKS - {"body", "html", "head", "caption", "col", "colgroup", "td", "th", "tr", "tbody",
                     "thead", "tfoot", "option", "optgroup", "legend", "button", "title", "template"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}}
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))

BAD_TAGS = frozenset("nav aside footer menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu "
                      "menubar toolbar".split())
# Bad unless they hold nearly all good text: pages of some frameworks stand in a form as a whole.
FORM_TAGS = frozenset("form fieldset".split())
BAD_WORDS = frozenset("""
ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment
comments commentlist consent cookie cookies copyright disqus disclaimer dropdown feedback foot footer
footnav gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay
pager pagination paywall popup promo promoted promotion recommended related replies reply respond
responses reviews search share sharing sidebar sidenav signup skip social sponsor sponsored subscribe
subscription tagcloud tags teaser toolbar topbar trending widget widgets discussion cta toc
""".split())
SOFT_WORDS = frozenset("article articlebody content entry main post story".split())
TOP_WORDS = frozenset("header head top hero".split())
# A class that begins so tells what an element has or is filed under, not what it is.
STATE_PARTS = frozenset("has no not with without is hide show tag tags category categories cat term topic "
                        "post page postid pageid single format type status layout js wp".split())
# Names of what readers add: more text than the article's is usual there.
READERS = frozenset("comment comments commentlist disqus discussion feedback replies reply respond "
                    "responses reviews".split())
# So many good blocks, with so many times the characters of the page's other text, override a name.
MANY, NEARLY_ALL = 3, 4
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())

_NEXT = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")
_RIGHTS = re.compile(r"\u00a9|\(c\) |Copyright\W+(?:\u00a9|\(c\)|\d{4}\b)", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")


class _Page:
    """Position in the page; remembers what no longer occurs behind it."""

    def __init__(self, html: str):
        self.html, self.gone, self.lower = html, set(), None

    def find(self, mark: str, at: int) -> int:
        if mark in self.gone:
            return -1
        found = self.html.find(mark, at)
        if found < 0:
            self.gone.add(mark)
        return found

    def find_end_tag(self, name: str, at: int) -> int:
        if name in self.gone:
            return -1
        if self.lower is None:
            # Lower case that keeps every character's place.
            self.lower = self.html.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        found = self.lower.find(f"</{name}", at)
        if found < 0:
            self.gone.add(name)
        return found

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag; quoted values may hold others."""
        html, n = self.html, len(self.html)
        while True:
            close = self.find(">", at)
            if close < 0:
                return n
            quote = _QUOTE.search(html, at, close)
            if not quote:
                return close
            sign = html[quote.end() - 1]
            end = self.find(sign, quote.end())
            if end < 0:
                # The quote is never closed: the first > ends the tag.
                return close
            at = end + 1


_QUOTE = re.compile(r"=\s*[\"']")


def _container(tag: str, attributes: dict[str, str], inside_article: bool) -> tuple[str, str]:
    """What an element is: 'bad', 'good' (article), 'main', 'soft' (named like an article) or '';
    and how its class or id names it: 'readers', 'bad', 'form' (also a form without a name) or ''."""
    role = attributes.get("role", "").lower()
    if tag in BAD_TAGS or role in BAD_ROLES or "hidden" in attributes \
            or attributes.get("aria-hidden", "").lower() == "true" \
            or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "bad", ""
    if not inside_article and tag == "header":
        return "bad", ""
    words = set()
    for name in ("class", "id"):
        for one in attributes.get(name, "").split():
            parts = _PART.findall(_CAMEL.sub(" ", one).lower())
            if len(parts) < 2 or parts[0] not in STATE_PARTS:
                words.update(parts)
    named = ""
    if tag not in ("html", "body", "main"):
        named = "readers" if words & READERS else "bad" if words & BAD_WORDS else ""
        if not named and not inside_article and tag == "div" and words & TOP_WORDS:
            named = "bad"
    if tag in FORM_TAGS or role == "form":
        named = named or "form"
    if tag == "article" or role == "article":
        return "good", named
    if tag == "main" or role == "main":
        return "main", named
    return "soft" if words & SOFT_WORDS and tag in ("div", "section", "td") else "", named


def blocks(html: str) -> list[dict]:
    """The page's text blocks in order: text, link characters, heading, container, article number, and the
    chain of elements with a bad name around it."""
    page, out = _Page(html), []
    # Open elements with their kind; of inline elements only links and those with a kind.
    stack: list[tuple[str, str, tuple | None]] = []
    kinds = dict.fromkeys(("bad", "good", "main", "soft", "skip", ""), 0)
    opened: dict[str, int] = {}
    parts, links, breaks, articles = [], 0, 0, 0
    # The innermost open element with a bad name: its number, how it is named, and the one around it.
    names, n_names = None, 0

    def flush():
        nonlocal parts, links
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            kind = next((k for k in ("bad", "good", "main", "soft") if kinds[k]), "")
            out.append({"text": text, "links": links, "kind": kind, "article": articles if kinds["good"] else 0,
                        "names": names,
                        "heading": any(opened.get(h) for h in HEADINGS)})
        parts, links = [], 0

    def push(tag, kind, named):
        nonlocal articles, names, n_names
        articles += kind == "good"
        stack.append((tag, kind, names))
        if named:
            n_names += 1
            names = (n_names, named, names)
        opened[tag] = opened.get(tag, 0) + 1
        kinds[kind] += 1

    def pop():
        nonlocal names
        tag, kind, names = stack.pop()
        opened[tag] -= 1
        kinds[kind] -= 1

    def close(tag):
        """Close the nearest open ``tag`` and all inside it; one that isn't open is ignored.

        An inline element is not sought behind a block.
        """
        if opened.get(tag):
            if tag not in BLOCKS:
                k = len(stack) - 1
                while stack[k][0] != tag and stack[k][0] not in BLOCKS:
                    k -= 1
                if stack[k][0] != tag:
                    return
            while True:
                last = stack[-1][0]
                pop()
                if last == tag:
                    return

    def put(text):
        nonlocal links, breaks
        if text and not kinds["skip"]:
            if text.strip():
                breaks = 0
            parts.append(text)
            if opened.get("a"):
                links += len(_SPACE.sub(" ", text).strip())

    at, n = 0, len(html)
    while at < n:
        m = _NEXT.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at:m.start()])
        if m[1]:
            if html.startswith((">", "->"), m.end()):
                at = html.index(">", m.end()) + 1
                continue
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m[4]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        tag, end = m[3].lower(), page.tag_end(m.end())
        at = min(end + 1, n)
        if m[2]:
            if tag in BLOCKS:
                flush()
            elif tag == "br":
                put(" ")
            close(tag)
            continue
        if tag == "br":
            breaks += 1
            put(" ")
            if breaks == 2:
                flush()
            continue
        if opened.get("head") and tag not in IN_HEAD:
            close("head")
        if tag in BLOCKS:
            flush()
            if opened.get("p") and tag in CLOSES_P:
                close("p")
            same = SAME.get(tag, ())
            while stack and stack[-1][0] not in STOPS.get(tag, ()) and any(
                    opened.get(s) for s in same) and (stack[-1][0] in same or stack[-1][0] not in BLOCKS):
                last = stack[-1][0]
                pop()
                if last in same:
                    break
        if tag in VOID:
            continue
        attributes = {k.lower(): unescape(a or b or c or "")
                      for k, a, b, c in _ATTR.findall(html, m.end(), end)} \
            if end > m.end() else {}
        if tag == "a" and opened.get("a"):
            close("a")
        inside = kinds["good"] or kinds["main"]
        kind, named = ("skip", "") if tag in SKIPPED else _container(tag, attributes, bool(inside))
        if kind == "good" and kinds["good"]:
            # An article inside an article is a reader's comment.
            kind, named = "", "readers"
        if kind or named or tag == "a" or tag in BLOCKS or tag in RAW:
            push(tag, kind, named)
        if tag in RAW:
            end = page.find_end_tag(tag, at)
            if end < 0:
                break
            at = end
    flush()
    return out


def _stop_density(text: str) -> tuple[float, int]:
    """Share of function words, in the language that knows most of them, and the number of words."""
    words = _WORD.findall(text.lower())
    hits = [0] * len(STOP_WORDS)
    for word, n in Counter(filter(_LANGUAGES.__contains__, words)).items():
        for k in _LANGUAGES[word]:
            hits[k] += n
    return (max(hits) / len(words) if words else 0.0), len(words)


def _own_labels(page: list[dict], stops: list[tuple[float, int]]) -> list[str]:
    """Labels of blocks by their own features: bad, good, near, low (few stop words) or short."""
    links = [b["links"] > LINKS_HIGH * len(b["text"]) for b in page]
    # The page's prose decides whether its language is known, not its menus.
    prose = [(d * n, n) for b, linked, (d, n) in zip(page, links, stops)
             if not linked and b["kind"] != "bad" and len(b["text"]) >= LENGTH_LOW]
    density_of_page = sum(x for x, _ in prose) / max(1, sum(n for _, n in prose))
    known = density_of_page >= STOP_LOW / 2
    high, low = min(STOP_HIGH, density_of_page * 0.8), min(STOP_LOW, density_of_page * 0.5)
    labels = []
    for block, linked, (density, _) in zip(page, links, stops):
        length, kind, text = len(block["text"]), block["kind"], block["text"]
        if linked and kind in ("good", "main", "soft") and length >= LENGTH_LOW and density >= high:
            # A paragraph of an article that is one link goes with what stands around it.
            labels.append("low")
        elif kind == "bad" or linked or length <= LENGTH_HIGH and _RIGHTS.match(text):
            labels.append("bad")
        elif length < LENGTH_LOW:
            labels.append("short")
        elif kind == "soft" or not known or density >= high:
            labels.append("good" if kind == "soft" or length > LENGTH_HIGH else "near")
        else:
            labels.append("near" if density >= low else "low")
    return labels


def _drop_named(page: list[dict], labels: list[str]) -> list[dict]:
    """The blocks, of kind 'bad' inside of badly named containers, but for containers that hold nearly
    all good text of the page. Those of readers' words give way only to a page without good text; a form
    that holds all of it needs one good block. Every look at the blocks frees one container, until none is
    to be freed."""
    freed: set[int] = set()
    while True:
        outer: dict[int, tuple[int, str] | None] = {}

        def outermost(names):
            """The outermost container in the chain that has not been freed."""
            chain = []
            while names and names[0] not in outer:
                chain.append(names)
                names = names[2]
            found = outer[names[0]] if names else None
            for one in reversed(chain):
                found = found or (None if one[0] in freed else one[:2])
                outer[one[0]] = found
            return found

        tops = [outermost(b["names"]) for b in page]
        free = free_good = 0
        held: dict[tuple[int, str], list[int]] = {}
        for block, label, top in zip(page, labels, tops):
            size = len(block["text"])
            if top is None:
                free += size if label in ("good", "near") else 0
                free_good += size if label == "good" else 0
            elif label == "good":
                n = held.setdefault(top, [0, 0])
                n[0], n[1] = n[0] + 1, n[1] + size
        best = max(((size, -number, kind) for (number, kind), (n, size) in held.items()
                    if n >= (1 if kind == "form" and not free_good else MANY) and size > NEARLY_ALL * free and (kind != "readers" or not free_good)), default=None)
        if best is None:
            break
        freed.add(-best[1])
    return [block | {"kind": "bad"} if top else block for block, top in zip(page, tops)]


def _winner(page: list[dict], labels: list[str]) -> str | None:
    """'good' (articles) or 'main' if that mark holds most of the good blocks' characters.

    Articles count by the largest of them, so many teasers do not outweigh a story. Where nothing is
    good by its own features, the near blocks are compared, and where nothing is near, any mark wins.
    """
    for wanted in (("good",), ("near",)):
        sizes: dict[tuple, int] = {}
        for block, label in zip(page, labels):
            if label in wanted:
                group = block["kind"] if block["kind"] in ("good", "main") else "", block["article"]
                sizes[group] = sizes.get(group, 0) + len(block["text"])
        if sizes:
            best = max((v for (kind, _), v in sizes.items() if kind == "good"), default=0)
            main, rest = sizes.get(("main", 0), 0), sizes.get(("", 0), 0)
            if best and best >= main + rest:
                return "good"
            return "main" if main and main >= rest else None
    # Only short blocks and blocks with few stop words are left.
    left = {b["kind"] for b, x in zip(page, labels) if x != "bad"}
    return next((k for k in ("good", "main") if k in left), None)


def classify(page: list[dict]) -> list[bool]:
    """Whether each block belongs to the main text."""
    stops = [_stop_density(b["text"]) for b in page]
    page = _drop_named(page, _own_labels(page, stops))
    labels = _own_labels(page, stops)
    named = _winner(page, labels)
    decided: list[str | None] = []
    for block, label in zip(page, labels):
        if named and block["kind"] == named:
            label = {"near": "good", "low": "near"}.get(label, label)
        decided.append({"good": "good", "bad": "bad"}.get(label))
    # Articles that are not the marked part are parts of their own; others share the text around.
    sides = [b["kind"] if named and b["kind"] == named else b["article"] if b["kind"] == "good" else 0
             for b in page]
    if "good" not in decided:
        if named:
            # No block of the mark is decided: all of it that may be good is.
            decided = ["good" if side == named and label != "bad" else mark
                       for side, label, mark in zip(sides, labels, decided)]
        else:
            decided = ["good" if label == "near" else mark for label, mark in zip(labels, decided)]
    out = _inherit(decided, sides)
    # Headings above a good block belong to it.
    for k in range(len(out) - 1):
        if page[k]["heading"] and labels[k] == "short":
            out[k] = out[k + 1] if out[k + 1] == "good" else out[k]
    return [x == "good" for x in out]


def _inherit(decided: list[str | None], sides: list) -> list[str]:
    """Undecided blocks take the label of the nearest decided one of their side; ties go to good."""
    n = len(decided)

    def sweep(order):
        last, out = {}, [None] * n
        for k in order:
            if decided[k]:
                last[sides[k]] = k
            out[k] = last.get(sides[k])
        return out

    before, after = sweep(range(n)), sweep(range(n - 1, -1, -1))
    out = []
    for k in range(n):
        if decided[k]:
            out.append(decided[k])
            continue
        near = sorted((abs(k - j), decided[j] != "good") for j in (before[k], after[k])
                      if j is not None)
        out.append("bad" if not near or near[0][1] else "good")
    return out


def main_text(html: str | None) -> str:
    page = blocks(html or "")
    return "\n".join(b["text"] for b, keep in zip(page, classify(page)) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """page_id, url, text (main text, blocks joined by a line end), n_chars."""
    def run(batches):
        for part in (p for batch in batches for p in text_slices(batch, 2)):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                        F.col(html).cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
