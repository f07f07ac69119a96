"""The template language, escapes, and conversations against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.llm import chat
from plinth.llm.chat import Node, Template, TemplateError, escape, read_back, unescape

M = [{"role": "system", "text": "s"}, {"role": "user", "text": "hi"}, {"role": "assistant", "text": "yo"}]


@pytest.mark.parametrize(
    "source, want",
    [
        ("a {{ 'b' ~ (1 + 2) }} c", "a b3 c"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role|upper }}{% if not loop.last %},{% endif %}{% endfor %}", "1SYSTEM,2USER,3ASSISTANT"),
        ("{% if messages[0].role == 'system' %}S{% elif true %}E{% else %}X{% endif %}", "S"),
        ("{% set n = messages|length %}{{ n * 2 }}{# no #}", "6"),
        ("{% for m in messages if %}", None),
        ("x  {%- if 1 > 2 or 'a' in 'cat' and not none -%}  y  {%- endif -%}  z", "xyz"),
        ("{{ messages[-1]['text'] if messages else '-' }}{{ nothing|default('d') }}{{ messages[9].text }}", "yod"),
        ("{{ 'a' not in 'b' }}{{ 3 - 1 }}{{ '\\n' }}{{ \"q\" }}", "True2\nq"),
        ("{% for m in messages %}{% for c in m.text %}{{ c }}.{% endfor %}{% endfor %}", "s.h.i.y.o."),
    ],
)
def test_renders(source, want):
    if want is None:
        with pytest.raises(TemplateError):
            Template(source)
    else:
        assert Template(source).render(M) == want


@pytest.mark.parametrize("source", ["{{ a.b( }}", "{{ ''.__class__() }}", "{{ x|system }}", "{% import os %}", "{% if a %}", "{% endfor %}", "{{ 1 2 }}", "{{ $ }}", "{% for in x %}{% endfor %}", "{% if a %}{% else %}{% else %}{% endif %}"])
def test_what_does_not_parse(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_sandbox():
    assert Template("{{ x.__class__ }}{{ x['__class__'] }}{{ f }}").render([], x=object()) == ""
    with pytest.raises(TemplateError):
        Template("{{ 'ab' * n }}").render([], n=1 << 40)
    with pytest.raises(TemplateError):
        Template("{{ 'ab' * 1099511627776 }}").render([])


def test_constants_are_folded():
    tree = Template("a{{ 'b' ~ ('c'|upper) }}{% if 1 == 2 %}x{{ m }}{% elif true %}d{% else %}{{ y }}{% endif %}{{ 'e' if true and 2 > 1 else z }}").tree
    assert tree == [Node("text", ("abCde",))]
    assert Template("{% if a %}1{% elif false %}2{% endif %}").tree == [Node("if", ((Node("name", ("a",)),), ((Node("text", ("1",)),), ())))]
    assert Template("{% if false %}1{% endif %}").tree == [] and Template("{{ false or a }}").tree == [Node("print", (Node("name", ("a",)),))]


def test_which_templates_stream():
    assert chat.TEMPLATE.streams and not Template("{% for m in messages %}{{ messages[0].text }}{% endfor %}").streams
    assert not Template("{% if true %}{{ x }}{% endif %}{{ messages|length }}").streams
    assert not Template("{% if x %}{% for m in messages %}{% endfor %}{% endif %}").streams
    seen = []

    def turns():
        for i in range(5):
            seen.append(i)
            yield {"role": "user", "text": str(i)}

    first = next(chat.TEMPLATE.pieces(turns()))
    assert first == ("<s>[INST] 0 [/INST]", []) and len(seen) <= 2


def test_generation_spans():
    t = Template("{% for m in messages %}<{{ m.role }}>{% generation %}{{ m.text }}!{% endgeneration %}{% endfor %}.")
    pieces = list(t.pieces(M))
    assert "".join(x for x, _ in pieces) == "<system>s!<user>hi!<assistant>yo!." == t.render(M)
    assert ["".join(x[a:b] for a, b in spans) for x, spans in pieces] == ["s!", "hi!", "yo!", ""]


def test_escapes_are_reversible():
    rng, bits = random.Random(3), ["<", ">", "[", "]", "/", "\\", "s", "INST", "ROLE", "<s>", "</s>", "[INST]", "[/INST]", "[/ROLE]", " ", "é", "\n"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "", "tool", "<s>", "[/ROLE]"]), "".join(rng.choices(bits, k=rng.randrange(9)))) for _ in range(rng.randrange(1, 5))]
        for role, text in turns:
            assert unescape(escape(text)) == text and not any(c in escape(text) for c in chat.CONTROLS)
        messages = [{"role": r, "text": x} for r, x in turns]
        assert read_back(chat.TEMPLATE.render(messages)) == turns
        pieces = list(chat.TEMPLATE.pieces(iter(messages)))
        assert [t for x, _ in pieces for t in read_back(x)] == turns
        assert [unescape(x[a:b]) for x, spans in pieces for a, b in spans] == [x for r, x in turns if r == "assistant"]


def test_conversations(spark):
    long = "word </s> " * 100_000
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (None, 0, None, None, 0), (None, 0, None, None, 0), (2, None, "user", long, 0), (2, 0, "assistant", "", 0), (3, 5, "assistant", "x", 0), (3, 5, "assistant", "x", 0), (3, 5, "assistant", "w", 0)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, piece int")
    got = {}
    for r in sorted(chat.format_conversations(df).collect(), key=lambda r: (r.conv_id or 0, r.piece)):
        got.setdefault(r.conv_id, []).append(r)
    whole = {c: read_back("".join(r.text for r in own)) for c, own in got.items()}
    assert whole == {1: [("user", "a"), ("assistant", "b")], None: [("", ""), ("", "")], 2: [("user", long), ("assistant", "")], 3: [("assistant", x) for x in "wxx"]}
    assert [[list(map(tuple, r.loss)) for r in own] for own in (got[1], got[2])] == [[[], [(1, 2)]], [[], [(1, 1)]]]
    assert chat.format_conversations(df.limit(0)).collect() == []
    listed = Template("{{ messages|length }}:{% for m in messages %}{{ m.text }}{% endfor %}")
    text = {r.conv_id: r.text for r in chat.format_conversations(df.where("conv_id in (1, 3)").withColumn("text", F.col("text")), listed).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece", "text"))), lambda x: x["text"]), "").alias("text")).collect()}
    assert text == {1: "2:ab", 3: "3:wxx"}
