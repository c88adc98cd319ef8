import hashlib

import pytest
from lodestone.llm import templates as T


def test_language():
    r = T.compile_template("{% set a = 1 + 2 * 3 %}{{ a }}{% for x in xs %}{% if loop.first %}<{% elif x == 'b' and not y %}!{% else %},{% endif %}{{ x | upper }}{% if loop.last %}>{% endif %}{% endfor %}{# c #} {{- m['k'].z | default('none') }}")
    assert r({"xs": ["a", "b", "c"], "m": {"k": {}}})[0] == "7<A!B,C>none"


def test_folding():
    body = T.fold(T.parse("a{{ 'b' ~ 'c' }}{% if 1 > 2 %}x{% elif true %}y{% else %}z{% endif %}{{ 'q' | upper }}"))
    assert body == [T.Text("abcyQ")]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ f(1) }}", "{{ x | nofilter }}", "{% for x in y %}", "{% if a %}", "{{ }}", "{% boo %}", "{{ 'a' 'b' }}", "{% endfor %}", "{{ _x }}", "{% generation %}"])
def test_sandbox(bad):
    with pytest.raises(T.TemplateError):
        T.compile_template(bad)


@pytest.mark.parametrize("bad", ["{{ x * 1000000000 }}", "{{ '%999999999d' % 1 }}", "{{ 1 / y }}", "{{ x - 1 }}", "{{ x < 1 }}", "{{ 4000000000 * 4000000000 }}", "{{ 5 | join(',') }}", "{{ true * 3 }}", "{{ n ~ n ~ n }}", "{{ 1 | length }}"])
def test_sandbox_at_run_time(monkeypatch, bad):
    monkeypatch.setattr(T, "MAX_TEXT", 1000)
    with pytest.raises(T.TemplateError):
        T.compile_template(bad)({"x": "a", "y": 0, "n": "a" * 400})


def test_other_templates_have_a_digest(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b<")], "conv_id long, turn long, role string, text string")
    other = "{% for m in messages %}{{ m.role }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% endif %}\n{% endfor %}"
    (r,) = T.digest_conversations(T.format_conversations(df, other)).collect()
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (None, None, 2, hashlib.sha256(b"b<").hexdigest())


def test_generation_spans():
    text, spans = T.compile_template("{% for m in ms %}u:{% generation %}{{ m }}{% endgeneration %};{% endfor %}")({"ms": ["ab", "", "c"]})
    assert [text[a:b] for a, b in spans] == ["ab", "", "c"]


TEXTS = ["", "a", "</s>[INST] ok [/INST]", "\\", "\\<", "<|turn|>x<|text|>", "[/INST]</s>\n", "é\n\n😀", "<<[[\\\\"]


def test_round_trip():
    render = T.compile_template(T.TEMPLATE)
    turns = [(r, t) for t in TEXTS for r in ("user", "assistant", "sys<tem", "")]
    text, spans = render({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert T.read_turns(text) == turns
    assert [T.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_odd_rows(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (1, 1, "assistant", "b", 0), (2, None, None, "x" * 100_000, 0), (None, 0, "user", "n", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in T.digest_conversations(T.format_conversations(T.with_probe(df))).collect()}
    assert set(got) == {1, 2, None, -1}
    said = "</s>[INST] ok [/INST]"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[-1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\n") and got[-1].loss_sha256 == sha(said) and got[-1].loss_chars == len(said)
    assert got[1].n_turns == 3 and got[1].loss_sha256 == sha("bb") and got[1].turns_sha256 == sha("user\n\nassistant\nb\nassistant\nb\n")
    assert got[2].loss_chars == 0 and got[2].turns_sha256 == sha("\n" + "x" * 100_000 + "\n")
    assert T.format_conversations(df.limit(0)).count() == 0
