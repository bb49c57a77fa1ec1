"""Chat formatting: a small sandboxed template language, compiled to Python closures.

A template is text with ``{{ expression }}``, ``{% for x in list %}``, ``{% if %} / {% elif %} /
{% else %}``, ``{% set x = expression %}``, ``{% generation %} ... {% endgeneration %}`` and
``{# comment #}``; a ``-`` inside a tag trims the white space next to it. Expressions have literals,
names, ``a.b`` and ``a[b]`` (lookups in dictionaries and lists only), ``~``, ``+``, ``-``, comparisons,
``in``, ``and``, ``or``, ``not``, ``x if c else y`` and the filters of FILTERS. There are no calls and
no attributes of Python objects, and loops run over given lists only, so a template can't reach
anything but its data and always ends.

``compile_template`` parses the text into a tree of tuples, folds constant parts, joins neighbouring
text and turns every node into a closure. A rendered conversation is its text and the spans, in code
points, of what stood between generation markers.

Control strings inside texts are escaped reversibly: a backslash is put behind the first character of
every control string, also of one that already holds backslashes there; ``unescape`` takes one away.

Defined cases: a null text or role is empty; turns of a conversation are ordered by turn (null first),
role and text; repeated rows are turns of their own; rows with a null conversation id form one
conversation; an empty table gives an empty result. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"]
_BODY = "|".join(rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in CONTROL)
_ESCAPE = re.compile(f"(?s)(?={_BODY}).")
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\(?=\\*{re.escape(c[1:])})" for c in CONTROL))

DEFAULT = """
{%- for m in messages -%}
{%- if m.role == 'assistant' -%}
<s>{% generation %}{{ m.text | escape_control }}{% endgeneration %}</s>
{%- elif m.role == 'user' -%}
[INST]{{ m.text | escape_control }}[/INST]
{%- elif m.role == 'system' -%}
<<SYS>>{{ m.text | escape_control }}<</SYS>>
{%- else -%}
[ROLE]{{ m.role | escape_control }}[/ROLE]{{ m.text | escape_control }}</s>
{%- endif -%}
{%- endfor -%}
"""


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


FILTERS = {
    "escape_control": escape, "trim": lambda x: _text(x).strip(), "lower": lambda x: _text(x).lower(),
    "upper": lambda x: _text(x).upper(), "length": len,
    "first": lambda x: x[0] if x else None, "last": lambda x: x[-1] if x else None,
}


class TemplateError(ValueError):
    pass


def _text(value) -> str:
    if value is None:
        return ""
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


# --- text to tree -----------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?)(.*?)(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|"
                    r"(==|!=|<=|>=|[<>~+\-|().\[\],]))")
_BACK = {"n": "\n", "t": "\t"}


def _pieces(source: str):
    """('text' | 'out' | 'tag', content), white space trimmed where a tag asks for it."""
    out, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        left = next(g for g in (m[1], m[4], m[7]) if g is not None)
        right = next(g for g in (m[3], m[6], m[9]) if g is not None)
        text = source[at:m.start()]
        text = text.lstrip() if trim else text
        out.append(("text", text.rstrip() if left else text))
        if m[2] is not None:
            out.append(("out", m[2].strip()))
        elif m[5] is not None:
            out.append(("tag", m[5].strip()))
        at, trim = m.end(), bool(right)
    tail = source[at:]
    out.append(("text", tail.lstrip() if trim else tail))
    return [p for p in out if p != ("text", "")]


class _Expression:
    """Recursive descent over one expression; makes tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"bad expression: {source!r}")
            kind = ("number", "string", "name", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "name") \
            and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is expected")

    def whole(self) -> tuple:
        node = self.choice()
        if self.at != len(self.tokens):
            raise TemplateError("text behind the expression")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("choice", test, node, self.choice())
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negation()
        while self.take("and"):
            node = ("and", node, self.negation())
        return node

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self) -> tuple:
        node = self.sum()
        while sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = ("compare", sign, node, self.sum())
        return node

    def sum(self) -> tuple:
        node = self.filtered()
        while sign := self.take("~", "+", "-"):
            node = ("math", sign, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.value()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def value(self) -> tuple:
        if self.take("("):
            node = self.choice()
            self.need(")")
        elif self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        else:
            kind, word = self.tokens[self.at]
            self.at += 1
            if kind == "number":
                node = ("const", int(word))
            elif kind == "string":
                node = ("const", re.sub(r"(?s)\\(.)", lambda m: _BACK.get(m[1], m[1]), word[1:-1]))
            elif kind == "name":
                fixed = {"true": True, "false": False, "none": None}
                node = ("const", fixed[word]) if word in fixed else ("name", word)
            else:
                raise TemplateError(f"unexpected {word!r}")
        while True:
            if self.take("."):
                node = ("item", node, ("const", self.name()))
            elif self.take("["):
                node = ("item", node, self.choice())
                self.need("]")
            else:
                return node


def parse(source: str) -> tuple:
    """The template as a tree of tuples."""
    pieces, at = _pieces(source), 0

    def block(*ends: str) -> tuple[list, str]:
        nonlocal at
        body = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                body.append(("text", content))
                continue
            if kind == "out":
                body.append(("out", _Expression(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return body, content
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"bad loop: {content!r}")
                inner, _ = block("endfor")
                body.append(("for", m[1], _Expression(m[2]).whole(), ("block", inner)))
            elif word == "if":
                arms, last = [], rest
                while True:
                    inner, end = block("elif", "else", "endif")
                    arms.append((_Expression(last).whole(), ("block", inner)))
                    if not end.startswith("elif"):
                        break
                    last = end.partition(" ")[2]
                other = block("endif")[0] if end.startswith("else") else []
                body.append(("if", arms, ("block", other)))
            elif word == "set":
                name, _, value = rest.partition("=")
                body.append(("set", name.strip(), _Expression(value).whole()))
            elif word == "generation":
                inner, _ = block("endgeneration")
                body.append(("generation", ("block", inner)))
            else:
                raise TemplateError(f"unexpected tag {content!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return body, ""

    return ("block", block()[0])


# --- folding ----------------------------------------------------------------------------------

def fold(node: tuple) -> tuple:
    """Compute constant parts, drop dead branches, join neighbouring text."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "out":
        inner = fold(node[1])
        return ("text", _text(inner[1])) if inner[0] == "const" else ("out", inner)
    if kind == "block":
        body = []
        for part in map(fold, node[1]):
            for one in part[1] if part[0] == "block" else [part]:
                if one[0] == "text" and body and body[-1][0] == "text":
                    body[-1] = ("text", body[-1][1] + one[1])
                elif one != ("text", ""):
                    body.append(one)
        return ("block", body)
    if kind == "if":
        arms, other = [], fold(node[2])
        for test, body in node[1]:
            test, body = fold(test), fold(body)
            if test[0] == "const" and not test[1]:
                continue
            if test[0] == "const":
                other = body
                break
            arms.append((test, body))
        return ("if", arms, other) if arms else other
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    parts = tuple(fold(p) if isinstance(p, tuple) else p for p in node)
    inner = [p for p in parts if isinstance(p, tuple)]
    if all(p[0] == "const" for p in inner):
        return ("const", _closure(parts)({}))
    return parts


# --- tree to closures -------------------------------------------------------------------------

_COMPARE = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}


def _lookup(holder, key):
    if isinstance(holder, dict):
        return holder.get(key)
    if isinstance(holder, list) and isinstance(key, int) and -len(holder) <= key < len(holder):
        return holder[key]
    return None


def _closure(node: tuple):
    """A function of the names in scope that gives the expression's value."""
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, n=node[1]: scope.get(n)
    parts = [_closure(p) for p in node[1:] if isinstance(p, tuple)]
    if kind == "item":
        holder, key = parts
        return lambda scope: _lookup(holder(scope), key(scope))
    if kind == "filter":
        return lambda scope, f=FILTERS[node[1]], x=parts[0]: f(x(scope))
    if kind == "not":
        return lambda scope, x=parts[0]: not x(scope)
    if kind == "choice":
        test, yes, no = parts
        return lambda scope: yes(scope) if test(scope) else no(scope)
    a, b = parts
    if kind == "and":
        return lambda scope: a(scope) and b(scope)
    if kind == "or":
        return lambda scope: a(scope) or b(scope)
    if kind == "compare":
        return lambda scope, f=_COMPARE[node[1]]: f(a(scope), b(scope))
    if node[1] == "~":
        return lambda scope: _text(a(scope)) + _text(b(scope))
    if node[1] == "+":
        return lambda scope: a(scope) + b(scope)
    return lambda scope: a(scope) - b(scope)


class _Output:
    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _writer(node: tuple):
    """A function (scope, output) that renders the node."""
    kind = node[0]
    if kind == "text":
        return lambda scope, out, t=node[1]: out.add(t)
    if kind == "out":
        return lambda scope, out, f=_closure(node[1]): out.add(_text(f(scope)))
    if kind == "set":
        return lambda scope, out, n=node[1], f=_closure(node[2]): scope.__setitem__(n, f(scope))
    if kind == "block":
        steps = [_writer(p) for p in node[1]]
        if len(steps) == 1:
            return steps[0]

        def block(scope, out):
            for step in steps:
                step(scope, out)
        return block
    if kind == "for":
        name, items, body = node[1], _closure(node[2]), _writer(node[3])

        def loop(scope, out):
            values = items(scope)
            values = values if isinstance(values, list) else []
            for k, value in enumerate(values):
                inner = dict(scope)
                inner[name] = value
                inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0,
                                 "last": k == len(values) - 1}
                body(inner, out)
        return loop
    if kind == "if":
        arms, other = [(_closure(t), _writer(b)) for t, b in node[1]], _writer(node[2])

        def branch(scope, out):
            for test, body in arms:
                if test(scope):
                    return body(scope, out)
            return other(scope, out)
        return branch
    body = _writer(node[1])

    def generation(scope, out):
        begin = out.size
        body(scope, out)
        out.spans.append((begin, out.size))
    return generation


@lru_cache(maxsize=16)
def compile_template(source: str):
    """A function of a list of messages that gives the text and the generation spans."""
    write = _writer(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


# --- reading back -----------------------------------------------------------------------------

_MARK = re.compile(r"(?s)<s>(?P<assistant>.*?)</s>|\[INST\](?P<user>.*?)\[/INST\]|"
                   r"<<SYS>>(?P<system>.*?)<</SYS>>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)</s>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a conversation that DEFAULT has formatted."""
    turns, at = [], 0
    while at < len(formatted):
        m = _MARK.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        if m["role"] is not None:
            turns.append((unescape(m["role"]), unescape(m["text"])))
        else:
            role = m.lastgroup
            turns.append((role, unescape(m[role])))
        at = m.end()
    return turns


def format_conversations(turns: DataFrame, template: str = DEFAULT) -> DataFrame:
    """conv_id, formatted, spans (begin, end in code points of the loss mask).

    One conversation is one text, so its turns meet in one row.
    """
    compile_template(template)
    rows = turns.select(F.col("conv_id").cast("long"), F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("m"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("messages"))

    def run(batches):
        render = compile_template(template)
        for batch in batches:
            made = [render(messages) for messages in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in made], pa.string()),
                 pa.array([[{"begin": a, "end": b} for a, b in s] for _, s in made],
                          pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))],
                names=["conv_id", "formatted", "spans"])

    return whole.mapInArrow(
        run, "conv_id long, formatted string, spans array<struct<begin: int, end: int>>")
