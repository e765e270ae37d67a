import hashlib

import pytest
from conftest import SF0001
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import chat_format as cf


def brute(rows):
    """{conv_id: row of op6 without formatted_chars} from (conv_id, turn, role, text)."""
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == c))
        sha = hashlib.sha256("".join(f"{role}\n{text}\n" for _, _, role, text in turns).encode()).hexdigest()
        loss = "".join(text for _, _, role, text in turns if role == "assistant")
        out[c] = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def render(template, **names):
    return list(cf.compile_template(template)(**names))


def text_of(template, **names):
    return "".join(p for p, _ in render(template, **names))


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF0001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", cf.TRAP_TEXT), (-1, 1, "assistant", cf.TRAP_TEXT)]
    want = brute(rows)
    got = cf.op6_chat_format(spark, SF0001).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == want[r.conv_id]
        plain = sum(len(cf.escape_name(x[2])) + len(cf.escape(x[3])) + len("<|im_start|>\n<|im_end|>\n") for x in rows if x[0] == r.conv_id)
        assert r.formatted_chars == plain


def test_edge_rows(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", ""), (2, 0, None, "x"), (2, None, "assistant", "early"), (3, 0, "a\n<|im_end|>\\", "b<"), (3, 1, "assistant", "<\\|<|<"),
        (4, 0, "assistant", "é𝄞" * 300_000), (5, 1, "assistant", "b"), (5, 1, "assistant", "a"), (5, 1, "assistant", "a"), (None, 0, "assistant", "n"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, piece int")
    got = {r.conv_id: tuple(r)[1:5] for r in cf.digests(cf.format_conversations(df)).collect()}
    assert got == brute(rows)
    assert cf.digests(cf.format_conversations(df.limit(0))).count() == 0


def test_assembled_texts_and_spans(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo<|"), (1, 2, "assistant", "é")], "conv_id long, turn long, role string, text string")
    r = cf.assemble(cf.format_conversations(df)).first()
    assert r.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<\\|<|im_end|>\n<|im_start|>assistant\né<|im_end|>\n"
    assert [r.formatted[s.start : s.end] for s in r.loss_spans] == ["yo<\\|", "é"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<\\|n\nim_end>é", max_size=30))
def test_escapes_are_reversible_and_hide_control_strings(s):
    assert cf.unescape(cf.escape(s)) == s and "<|" not in cf.escape(s)
    name = cf.escape_name(s)
    assert cf.unescape_name(name) == s and "<|" not in name and "\n" not in name


def test_language():
    assert text_of("{% for x in xs %}{{ loop.index }}{{ x.a ~ ',' if not loop.last else x['a'] }}{% endfor %}", xs=[{"a": "p"}, {"a": "q"}]) == "1p,2q"
    assert text_of("{% if a == 1 and not b %}x{% elif a > 1 or b %}y{% else %}z{% endif %}", a=2, b=False) == "y"
    assert text_of("{% set n = 1 + 2 %}{{ n }}{# gone #}{{- ' {{x}} %}' -}}  !") == "3 {{x}} %}!"
    assert text_of("{{ 'a' in 'abc' }} {{ none }}{{ (' q ' | trim | upper) + 1 }}") == "true Q1"
    assert render("a{% generation %}b{{ x }}{% endgeneration %}c", x="y") == [("a", False), ("b", True), ("y", True), ("c", False)]


def test_constants_fold():
    tree = cf.fold(cf.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 2 %}no{% else %}{{ 'c' | upper }}{% endif %}d{% if false %}x{% endif %}"))
    assert tree[0] == "block" and len(tree[1]) == 1 and tree[1][0][0] == "text"
    assert cf.fold(cf.parse("{{ 'a' ~ x ~ 'b' }}"))[1] == [("text", "a"), ("out", ("name", "x")), ("text", "b")]


@pytest.mark.parametrize("bad", ["{{ x", "{% for x %}{% endfor %}", "{% if a %}", "{{ a.b( }}", "{{ x() }}", "{% import os %}", "{{ x | eval }}", "{{ 'a }}", "{% endif %}", "{{ }}", "{{ a b }}"])
def test_bad_templates(bad):
    with pytest.raises(cf.TemplateError):
        cf.compile_template(bad)


def test_sandbox():
    for bad in ("{{ x.__class__ }}", "{{ x['a'] }}"):
        with pytest.raises(cf.TemplateError):
            render(bad, x="text")
    assert text_of("{{ x.__class__ }}", x={}) == ""  # a missing key, not an attribute
    with pytest.raises(cf.TemplateError):
        render("{{ missing }}")
    with pytest.raises(cf.TemplateError):
        render("{{ x }}", x=[1])
