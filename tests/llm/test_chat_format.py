import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lurewatch.llm import chat_format as cf

PIECES = st.lists(st.sampled_from([*cf.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "<\\s>", "é", "\n",
                                   " ", "ROLE", "]", "SYS>>", "x"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    safe = cf.escape(text)
    assert cf.unescape(safe) == text
    assert not any(c in safe for c in cf.CONTROL)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool [/ROLE]"]),
                          PIECES), max_size=6))
def test_conversation_round_trip(turns):
    render = cf.compile_template(cf.DEFAULT)
    text, spans = render([{"role": r, "text": t} for r, t in turns])
    assert cf.read_back(text) == turns
    assert [cf.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_language():
    def show(source, **scope):
        out = cf._Output()
        cf._writer(cf.fold(cf.parse(source)))(scope, out)
        return "".join(out.parts)

    assert show("a{{ 1 + 2 }}b{# no #}{{ 'x' ~ \"y\" | upper }}") == "a3bxY"
    assert show("{% for x in xs %}{{ loop.index }}{{ x.k }}{% if not loop.last %},{% endif %}"
                "{% endfor %}", xs=[{"k": "p"}, {"k": "q"}]) == "1p,2q"
    assert show("{% if a == 1 %}one{% elif a in bs %}in{% else %}no{% endif %}", a=2, bs=[2]) == "in"
    assert show("{% set y = 'l' if xs[0] else 'r' %}{{ y }}", xs=[0]) == "r"
    assert show(" {{- ' a ' | trim -}} \n b") == "ab"
    assert cf.fold(cf.parse("x{% if 1 == 1 %}y{{ 'z' }}{% endif %}{{ 2 - 1 }}")) == (
        "block", [("text", "xyz1")])
    # Nothing but data can be reached.
    assert show("{{ x.__class__ }}{{ x.real }}", x="s") == ""
    for bad in ("{{ f(1) }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{{ 'a }}"):
        with pytest.raises(cf.TemplateError):
            cf.parse(bad)


def test_table(spark, table):
    rows = [(1, 1, "assistant", "A </s>"), (1, 0, "user", None), (1, None, "system", "first"),
            (2, 0, None, "x"), (None, 0, "user", "n"), (None, 0, "user", "n"), (3, 0, "user", "")]
    df = table([(*r, "c") for r in rows],
               "conv_id long, turn long, role string, text string, messages string")
    got = {r.conv_id: r for r in cf.format_conversations(df).collect()}
    assert cf.read_back(got[1].formatted) == [("system", "first"), ("user", ""),
                                              ("assistant", "A </s>")]
    (span,) = got[1].spans
    assert cf.unescape(got[1].formatted[span.begin:span.end]) == "A </s>"
    assert cf.read_back(got[2].formatted) == [("", "x")]
    assert cf.read_back(got[None].formatted) == [("user", "n")] * 2
    assert cf.read_back(got[3].formatted) == [("user", "")]
    assert cf.format_conversations(df.where("false")).count() == 0
