"""Chat formatting: a template is compiled to Python closures, which render conversations turn by turn with loss spans.

``Template`` parses a small sandboxed template language into a syntax tree, folds constant subtrees and generates closures:

    {{ expression }}   {% for x in y %} {% endfor %}   {% if a %} {% elif b %} {% else %} {% endif %}   {% set x = y %}
    {% generation %} {% endgeneration %}   {# comment #}   -%} and {%- strip white space

Expressions: strings, integers, true, false, none, names, ``x.y`` and ``x['y']`` (of mappings, sequences and ``loop`` only),
``not and or``, comparisons, ``in``, ``+ - * ~``, ``a if b else c``, filters (``|trim upper lower length default escape``).
There are no calls, no attributes of Python objects and no loops but over given values, so a template can't reach beyond its
input. What stands between the generation markers is under the loss mask.

``format_conversations`` deals rows by conversation, lets Spark sort them (with spilling) and renders them as a stream: a
template that reads ``messages`` only by one outermost ``for`` needs one turn at a time, so a conversation of any length takes
one turn's memory; the output is a row for each piece, in order. Other templates see a whole conversation as a list.

Defined results: null roles, texts and turns are allowed (empty; a null turn comes first; equal turns go by role, then text).
Rows without a conversation are one conversation. Rows that repeat are turns that repeat. Columns of other names are ignored;
only the conversation's column and piece, text, loss are returned. An empty table gives no rows. A template that doesn't parse
is an error with its place.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.runtime import bound_batches

# -- escapes ------------------------------------------------------------------------------------------------------------------

#: Strings by which the template marks turns: an opening bracket, a name, a closing bracket.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
_NAMES = "(?:/?s>|/?INST\\]|/?ROLE\\])"
_TO_ESCAPE, _ESCAPED = re.compile(rf"([<\[])(?=\\*{_NAMES})"), re.compile(rf"([<\[])\\(?=\\*{_NAMES})")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    """A backslash more behind the bracket of each control string, so that none is left. A bracket starts every control string and another
    ends it, so none arises where texts and marks meet either."""
    return _TO_ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


# -- the syntax tree ------------------------------------------------------------------------------------------------------------


class Node(NamedTuple):
    """kind, and what the kind has: other nodes, lists of nodes, names, values."""

    kind: str
    parts: tuple = ()


class TemplateError(ValueError):
    pass


_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*~<>|.\[\](),]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_RESERVED = {"and", "or", "not", "in", "if", "else"}


class _Expression:
    """A recursive-descent parser of one expression; the weakest operators come first."""

    LEVELS = [("or",), ("and",), ("not",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-"), ("~",), ("*",)]

    def __init__(self, text: str) -> None:
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            found = _TOKEN.match(text, at)
            if not found:
                raise TemplateError(f"Unexpected {text[at:].strip()[:20]!r} in {text.strip()!r}")
            self.tokens.append((found.lastindex, found[found.lastindex]))
            at = found.end()
        self.tokens.append((0, ""))

    def take(self, *wanted: str) -> str | None:
        if self.tokens[0][1] in wanted and self.tokens[0][0] in (3, 4):
            return self.tokens.pop(0)[1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing in {self.text.strip()!r}")

    def name(self) -> str:
        kind, word = self.tokens.pop(0)
        if kind != 3 or word in _RESERVED or word in _WORDS:
            raise TemplateError(f"A name is missing in {self.text.strip()!r}")
        return word

    def whole(self) -> Node:
        out = self.choice()
        if self.tokens[0][0]:
            raise TemplateError(f"Unexpected {self.tokens[0][1]!r} in {self.text.strip()!r}")
        return out

    def choice(self) -> Node:
        value = self.level(0)
        if self.take("if"):
            test = self.level(0)
            self.need("else")
            return Node("choice", (test, value, self.choice()))
        return value

    def level(self, k: int) -> Node:
        if k == len(self.LEVELS):
            return self.filtered()
        if self.LEVELS[k] == ("not",):
            return Node("not", (self.level(k),)) if self.take("not") else self.level(k + 1)
        left = self.level(k + 1)
        while op := self.take(*self.LEVELS[k]) or ("not in" if "in" in self.LEVELS[k] and self.tokens[0][1] == "not" and self.take("not") else None):
            if op == "not in":
                self.need("in")
            left = Node("binary", (op, left, self.level(k + 1)))
        return left

    def filtered(self) -> Node:
        value = self.primary()
        while op := self.take("|", ".", "["):
            if op == "[":
                value = Node("item", (value, self.choice()))
                self.need("]")
            elif op == ".":
                value = Node("item", (value, Node("constant", (self.name(),))))
            else:
                name, given = self.name(), []
                if self.take("("):
                    while not self.take(")"):
                        given.append(self.choice())
                        self.take(",")
                if name not in FILTERS:
                    raise TemplateError(f"There is no filter {name}")
                value = Node("filter", (name, value, *given))
        return value

    def primary(self) -> Node:
        if self.take("("):
            value = self.choice()
            self.need(")")
            return value
        if self.take("-"):
            return Node("binary", ("-", Node("constant", (0,)), self.primary()))
        kind, word = self.tokens[0]
        if kind == 1:
            self.tokens.pop(0)
            return Node("constant", (int(word),))
        if kind == 2:
            self.tokens.pop(0)
            return Node("constant", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S),))
        if word in _WORDS:
            self.tokens.pop(0)
            return Node("constant", (_WORDS[word],))
        return Node("name", (self.name(),))


def parse(source: str) -> list[Node]:
    """Statements of a whole template."""
    stack: list[tuple[str, list, list[Node]]] = [("", [], [])]  # open blocks: keyword, its parts so far, its body
    at, strip = 0, False

    def text(upto: str, cut: bool) -> None:
        piece = upto.lstrip() if strip else upto
        piece = piece.rstrip() if cut else piece
        if piece:
            stack[-1][2].append(Node("text", (piece,)))

    for tag in _TAG.finditer(source):
        text(source[at : tag.start()], bool(tag[1] or tag[4] or tag[7]))
        at, strip = tag.end(), bool(tag[3] or tag[6] or tag[8])
        if tag[2] is not None:
            stack[-1][2].append(Node("print", (_Expression(tag[2]).whole(),)))
        elif tag[5] is not None:
            try:
                _statement(tag[5].strip(), stack)
            except TemplateError as wrong:
                raise TemplateError(f"{wrong}, at character {tag.start()}") from None
    text(source[at:], False)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return stack[0][2]


def _statement(text: str, stack: list) -> None:
    word, _, rest = text.partition(" ")
    if word == "for":
        left, mark, right = rest.partition(" in ")
        if not mark:
            raise TemplateError("for needs 'in'")
        stack.append(("for", [_Expression(left).name(), _Expression(right).whole()], []))
    elif word == "if":
        stack.append(("if", [[_Expression(rest).whole()], []], []))  # tests, bodies
    elif word in ("elif", "else") and stack[-1][0] == "if":
        _, (tests, bodies), body = stack.pop()
        if len(tests) == len(bodies):
            raise TemplateError(f"{word} after else")
        tests = [*tests, _Expression(rest).whole()] if word == "elif" else tests
        stack.append(("if", [tests, [*bodies, body]], []))
    elif word == "set":
        name, _, value = rest.partition("=")
        stack[-1][2].append(Node("set", (_Expression(name).name(), _Expression(value).whole())))
    elif word == "generation":
        stack.append(("generation", [], []))
    elif word[:3] == "end" and len(stack) > 1 and stack[-1][0] == word[3:]:
        kind, parts, body = stack.pop()
        if kind == "if":
            tests, bodies = parts
            parts, body = [tuple(tests), tuple(map(tuple, [*bodies, body]))], None
        stack[-1][2].append(Node(kind, (*parts, tuple(body)) if body is not None else tuple(parts)))
    else:
        raise TemplateError(f"Unexpected {text!r}")


# -- constants and closures -------------------------------------------------------------------------------------------------------


def _text(x: Any) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(x or ""),
    "default": lambda x, y="": y if x is None else x, "escape": lambda x: escape(_text(x)),
}
BINARY: dict[str, Callable] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
}
#: Characters that a template's own constants may grow to when they are folded or multiplied.
MOST_CHARS = 1 << 20


def _item(x: Any, key: Any) -> Any:
    """Of mappings and sequences only; what isn't there is none."""
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, tuple, str)) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    return None


def _times(op: str, a: Any, b: Any) -> Any:
    if op == "*" and not (isinstance(a, int) and isinstance(b, int)) and len(a if isinstance(a, str) else b) * (b if isinstance(b, int) else a) > MOST_CHARS:
        raise TemplateError("A product is too long")
    return BINARY[op](a, b)


def fold(node: Node) -> Node:
    """The expression with its constant parts computed."""
    if node.kind in ("constant", "name"):
        return node
    node = Node(node.kind, tuple(fold(p) if isinstance(p, Node) else p for p in node.parts))
    inner = [p for p in node.parts if isinstance(p, Node)]
    if node.kind == "choice" and inner[0].kind == "constant":
        return inner[1] if inner[0].parts[0] else inner[2]
    if node.kind == "binary" and node.parts[0] in ("and", "or") and inner[0].kind == "constant":
        return inner[1] if bool(inner[0].parts[0]) == (node.parts[0] == "and") else inner[0]
    if inner and all(p.kind == "constant" for p in inner):
        try:
            return Node("constant", (_value(node)({}),))
        except (TypeError, ValueError):
            return node  # fails when it is rendered, if it ever is
    return node


def fold_body(body: Iterable[Node]) -> list[Node]:
    """Statements with folded expressions: printed constants become text, texts that meet are joined, tests that are known choose."""
    out: list[Node] = []
    for node in (n for given in body for n in _folded(given)):
        if node.kind == "text" and out and out[-1].kind == "text":
            node = Node("text", (out.pop().parts[0] + node.parts[0],))
        if node != Node("text", ("",)):
            out.append(node)
    return out


def _folded(node: Node) -> list[Node]:
    if node.kind == "print":
        value = fold(node.parts[0])
        return [Node("text", (_text(value.parts[0]),)) if value.kind == "constant" else Node("print", (value,))]
    if node.kind == "if":
        tests, bodies, kept = [fold(t) for t in node.parts[0]], [fold_body(b) for b in node.parts[1]], []
        last = bodies[len(tests)] if len(bodies) > len(tests) else []
        for test, inner in zip(tests, bodies, strict=False):
            if test.kind == "constant" and test.parts[0]:
                last = inner
                break
            if test.kind != "constant":
                kept.append((test, inner))
        return [Node("if", (tuple(t for t, _ in kept), (*(tuple(b) for _, b in kept), tuple(last))))] if kept else last
    if node.kind in ("for", "set"):
        return [Node(node.kind, (node.parts[0], fold(node.parts[1]), *(tuple(fold_body(b)) for b in node.parts[2:])))]
    if node.kind == "generation":
        return [Node("generation", (tuple(fold_body(node.parts[0])),))]
    return [node]


def _value(node: Node) -> Callable[[dict], Any]:
    """A closure of the names in scope."""
    p = node.parts
    if node.kind == "constant":
        return lambda names, value=p[0]: value
    if node.kind == "name":
        return lambda names, name=p[0]: names.get(name)
    if node.kind == "item":
        of, key = _value(p[0]), _value(p[1])
        return lambda names: _item(of(names), key(names))
    if node.kind == "not":
        of = _value(p[0])
        return lambda names: not of(names)
    if node.kind == "choice":
        test, yes, no = map(_value, p)
        return lambda names: yes(names) if test(names) else no(names)
    if node.kind == "filter":
        function, given = FILTERS[p[0]], [_value(x) for x in p[1:]]
        return lambda names: function(*(g(names) for g in given))
    op, left, right = p[0], _value(p[1]), _value(p[2])
    if op == "and":
        return lambda names: left(names) and right(names)
    if op == "or":
        return lambda names: left(names) or right(names)
    return lambda names: _times(op, left(names), right(names))


class Piece(NamedTuple):
    text: str
    loss: bool


def _body(nodes: Iterable[Node], loss: bool = False) -> Callable[[dict], Iterator[Piece | None]]:
    """A closure that yields pieces; None ends what belongs to one turn of an outermost loop."""
    parts = [_part(n, loss) for n in nodes]

    def run(names: dict) -> Iterator[Piece | None]:
        for part in parts:
            yield from part(names)

    return run


def _part(node: Node, loss: bool) -> Callable[[dict], Iterator[Piece | None]]:
    p = node.parts
    if node.kind == "text":
        fixed = (Piece(p[0], loss),)
        return lambda names: iter(fixed)
    if node.kind == "print":
        value = _value(p[0])
        return lambda names: iter((Piece(_text(value(names)), loss),))
    if node.kind == "generation":
        return _body(p[0], True)
    if node.kind == "set":
        value = _value(p[1])

        def put(names: dict) -> Iterator[Piece | None]:
            names[p[0]] = value(names)
            return iter(())

        return put
    if node.kind == "if":
        tests, bodies = [_value(t) for t in p[0]], [_body(b, loss) for b in p[1]]

        def choose(names: dict) -> Iterator[Piece | None]:
            for test, body in zip(tests, bodies, strict=False):
                if test(names):
                    return body(names)
            return bodies[-1](names) if len(bodies) > len(tests) else iter(())

        return choose
    values, body = _value(p[1]), _body(p[2], loss)

    def loop(names: dict) -> Iterator[Piece | None]:
        rest, i = iter(values(names) or ()), 0
        now = next(rest, rest)
        while now is not rest:
            after = next(rest, rest)
            inner = names | {p[0]: now, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is rest}}
            yield from body(inner)
            yield None
            now, i = after, i + 1

    return loop


class Template:
    def __init__(self, source: str) -> None:
        self.source = source
        self.tree = fold_body(parse(source))
        self._run = _body(self.tree)
        #: Whether one turn at a time is enough.
        self.streams = sum(_uses(self.tree, "messages")) == 1 and any(n.kind == "for" and n.parts[1] == Node("name", ("messages",)) for n in self.tree)

    def pieces(self, messages: Iterable[dict], **names: Any) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, spans under the loss mask) piece by piece: a turn of an outermost loop at a time."""
        text, spans, at = [], [], 0
        for piece in self._run({**names, "messages": messages if self.streams else list(messages)}):
            if piece is None:
                if text:
                    yield "".join(text), spans
                text, spans, at = [], [], 0
                continue
            if piece.loss:
                spans.append((at, at + len(piece.text)))
            text.append(piece.text)
            at += len(piece.text)
        if text:
            yield "".join(text), spans

    def render(self, messages: Iterable[dict], **names: Any) -> str:
        return "".join(text for text, _ in self.pieces(messages, **names))


def _uses(tree: Iterable, name: str) -> Iterator[int]:
    for x in tree:
        if isinstance(x, Node):
            yield int(x == Node("name", (name,)))
            yield from _uses(x.parts, name)
        elif isinstance(x, tuple):
            yield from _uses(x, name)


# -- conversations --------------------------------------------------------------------------------------------------------------

#: User and assistant turns have marks of their own; any other role is written out, so that it can be read back.
TEMPLATE = Template(
    """\
{{- '<s>' -}}
{%- for m in messages -%}
{%- if m.role == 'user' -%} {{- '[INST] ' ~ m.text|escape ~ ' [/INST]' -}}
{%- elif m.role == 'assistant' -%} {{- ' ' -}} {%- generation -%} {{- m.text|escape -}} {%- endgeneration -%} {{- '</s>' -}}
{%- else -%} {{- '[ROLE]' ~ m.role|escape ~ '[/ROLE]' ~ m.text|escape ~ '</s>' -}}
{%- endif -%}
{%- endfor -%}"""
)
PIECES = "piece long, text string, loss array<struct<start: int, end: int>>"


def format_conversations(rows: DataFrame, template: Template = TEMPLATE, conversation: str = "conv_id") -> DataFrame:
    """rows: a conversation's column, turn, role, text. (conversation, piece, text, loss): the pieces of a conversation in order are its
    formatted text; loss has the spans (of code points) within a piece that the loss mask covers. A conversation's rows are together, in
    one partition and in order."""
    bound_batches(rows.sparkSession)
    dealt = rows.select(F.col(conversation), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition(F.col(conversation))
    dealt = dealt.sortWithinPartitions(F.col(conversation).asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    source = template.source

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, kinds = Template(source), []

        def turns() -> Iterator[tuple]:
            for b in batches:
                kinds[:] = [b.schema.field(0).type]
                for c, t, r, x in zip(*(column.to_pylist() for column in b.columns), strict=True):
                    yield c, {"turn": t, "role": r, "text": x}

        found = ((c, i, text, spans) for c, own in groupby(turns(), key=lambda x: x[0]) for i, (text, spans) in enumerate(compiled.pieces(m for _, m in own)))
        for held in _held(found):
            ids, numbers, texts, spans = zip(*held, strict=True)
            loss = pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([pa.array(ids, kinds[0]), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), loss], [conversation, "piece", "text", "loss"])

    return dealt.mapInArrow(render, f"`{conversation}` {rows.schema[conversation].dataType.simpleString()}, {PIECES}")


#: Characters and rows of a batch at most.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 4096


def _held(found: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, chars = [], 0
    for row in found:
        held.append(row)
        chars += len(row[2])
        if chars >= BATCH_CHARS or len(held) >= BATCH_ROWS:
            yield held
            held, chars = [], 0
    if held:
        yield held


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in one piece of TEMPLATE's output, or in a whole one."""
    marks = [m for m in _CONTROL.finditer(text) if m[0] != "<s>"]
    out, at = [], 3 if text.startswith("<s>") else 0
    i = 0
    while i < len(marks):
        if marks[i][0] == "[INST]":
            out.append(("user", text[marks[i].end() + 1 : marks[i + 1].start() - 1]))
            i += 2
        elif marks[i][0] == "[ROLE]":
            out.append((text[marks[i].end() : marks[i + 1].start()], text[marks[i + 1].end() : marks[i + 2].start()]))
            i += 3
        else:
            out.append(("assistant", text[at + 1 : marks[i].start()]))
            i += 1
        at = marks[i - 1].end()
    return [(unescape(role), unescape(words)) for role, words in out]
