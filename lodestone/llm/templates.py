"""Chat formatting by a template compiler.

A sandboxed template language is lexed and parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures. Rendering gives the formatted text and the spans (code points) inside generation markers, the loss mask.

Language: text, `{{ expr }}`, `{% for x in expr %}`, `{% if %}/{% elif %}/{% else %}`, `{% set x = expr %}`, `{% generation %}`
with their `end` tags, and `{# comments #}`. A `-` inside a tag's braces strips the white space beside it. Expressions: names,
strings, numbers, true/false/none, `a.b` and `a['b']` on mappings, `loop.index/index0/first/last`, `not and or`,
`== != < <= > >= in`, `+ - * / % ~` (`- * / %` on numbers only), parentheses, and the filters of FILTERS as `x | f` or `x | f(arg)`. There are no calls, no
attributes of Python objects and no imports, so a template reaches nothing but its variables; values are bounded
(MAX_TEXT, MAX_INT), and whatever goes wrong is a TemplateError.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import ship

#: Control strings all begin with `<` or `[`; texts have these and the backslash escaped by a backslash.
ESCAPED = re.compile(r"([\\<\[])")
UNESCAPE = re.compile(r"\\([\\<\[])")

#: The default template. Only an assistant's text is trained on.
TEMPLATE = """
{%- for m in messages -%}
<|turn|>{{ m.role | escape }}<|text|>
{%- if m.role == 'assistant' -%}
[INST]{% generation %}{{ m.text | escape }}{% endgeneration %}[/INST]
{%- else -%}
{{ m.text | escape }}
{%- endif -%}
</s>{{ '\\n' }}
{%- endfor -%}
"""

#: A formatted turn, as TEMPLATE writes it.
TURN = re.compile(r"<\|turn\|>((?:[^\\<\[]|\\.)*)<\|text\|>(?:\[INST\])?((?:[^\\<\[]|\\.)*)(?:\[/INST\])?</s>\n", re.S)


def escape(text: str) -> str:
    return ESCAPED.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable] = {
    "escape": escape,
    "trim": str.strip,
    "upper": str.upper,
    "lower": str.lower,
    "length": len,
    "string": str,
    "default": lambda v, d="": d if v is None else v,
    "join": lambda v, by="": by.join(map(str, v)),
}

class TemplateError(ValueError):
    """The template is not in the language, or does what the language forbids."""


#: Code points that a value may have at most, and integers: a template cannot fill a worker's memory.
MAX_TEXT, MAX_INT = 1 << 28, 1 << 63


def bounded(value: object) -> object:
    """The value, or TemplateError if it is too large."""
    if isinstance(value, str) and len(value) > MAX_TEXT or isinstance(value, int) and abs(value) >= MAX_INT:
        raise TemplateError("a value is too large")
    return value


def on_numbers(f: Callable) -> Callable:
    """f of two numbers; anything else, and division by zero, is a TemplateError."""

    def run(a: object, b: object) -> object:
        if not all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)):
            raise TemplateError(f"not numbers: {a!r:.40}, {b!r:.40}")
        try:
            return bounded(f(a, b))
        except ArithmeticError as e:
            raise TemplateError(str(e)) from e

    return run


def on_values(f: Callable) -> Callable:
    """f of values; what it cannot do is a TemplateError."""

    def run(*args: object) -> object:
        try:
            return bounded(f(*args))
        except (TypeError, AttributeError) as e:
            raise TemplateError(str(e)) from e

    return run


def plus(a: object, b: object) -> object:
    """The sum of numbers, or two texts joined."""
    return a + b if isinstance(a, str) and isinstance(b, str) else on_numbers(operator.add)(a, b)


def show(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


OPERATORS = {
    "==": operator.eq, "!=": operator.ne, "<": on_values(operator.lt), "<=": on_values(operator.le), ">": on_values(operator.gt),
    ">=": on_values(operator.ge), "+": on_values(lambda a, b: plus(a, b)), "-": on_numbers(operator.sub), "*": on_numbers(operator.mul),
    "/": on_numbers(operator.truediv), "%": on_numbers(operator.mod), "~": on_values(lambda a, b: show(a) + show(b)),
    "in": on_values(lambda a, b: a in b),
}
LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">=", "in"), ("+", "-", "~"), ("*", "/", "%"))


# --- syntax tree ---------------------------------------------------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: object
    key: object


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Apply:
    name: str
    args: list


@dataclass
class Text:
    text: str


@dataclass
class Print:
    value: object


@dataclass
class Set:
    name: str
    value: object


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class If:
    arms: list  # of (condition, body); a last condition Const(True) is the else arm


@dataclass
class Generation:
    body: list


# --- parser --------------------------------------------------------------------------------------------------------

TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
TOKEN = re.compile(r"\s*(?:(\d+\.\d+|\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/%~<>|().,\[\]=]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def lex(template: str) -> Iterator[tuple[str, str]]:
    """('text' | 'print' | 'tag', content) in order."""
    at, strip = 0, False
    for m in TAG.finditer(template):
        before, after = (m[1] or m[4] or m[7], m[3] or m[6] or m[8])
        text = template[at : m.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if before else text
        if m[2] is not None:
            yield "print", m[2]
        elif m[5] is not None:
            yield "tag", m[5].strip()
        at, strip = m.end(), bool(after)
    yield "text", template[at:].lstrip() if strip else template[at:]


@dataclass
class Tokens:
    source: str
    items: list = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        pos, end = 0, len(self.source.rstrip())
        while pos < end:
            m = TOKEN.match(self.source, pos)
            if not m:
                raise TemplateError(f"cannot read {self.source[pos:]!r}")
            kind = next(i for i in range(1, 5) if m[i] is not None)
            self.items.append((kind, m[kind]))
            pos = m.end()

    def peek(self) -> str | None:
        return self.items[self.at][1] if self.at < len(self.items) and self.items[self.at][0] >= 3 else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected in {self.source!r}")

    def done(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r} in {self.source!r}")

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != 3 or self.items[self.at][1].startswith("_"):
            raise TemplateError(f"name expected in {self.source!r}")
        self.at += 1
        return self.items[self.at - 1][1]


def expression(t: Tokens, level: int = 0) -> object:
    if level == len(LEVELS):
        return unary(t)
    left = expression(t, level + 1)
    while op := t.take(*LEVELS[level]):
        left = Op(op, [left, expression(t, level + 1)])
    return left


def unary(t: Tokens) -> object:
    if t.take("not"):
        return Op("not", [expression(t, 2)])
    if t.take("-"):
        return Op("-", [Const(0), unary(t)])
    value = atom(t)
    while sign := t.take(".", "[", "|"):
        if sign == ".":
            value = Item(value, Const(t.name()))
        elif sign == "[":
            value = Item(value, expression(t))
            t.need("]")
        else:
            name = t.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            args = [value]
            if t.take("("):
                while not t.take(")"):
                    args.append(expression(t))
                    t.take(",")
            value = Apply(name, args)
    return value


def atom(t: Tokens) -> object:
    if t.at >= len(t.items):
        raise TemplateError(f"expression ends early: {t.source!r}")
    kind, word = t.items[t.at]
    if kind == 1:
        t.at += 1
        return Const(float(word) if "." in word else int(word))
    if kind == 2:
        t.at += 1
        return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
    if t.take("("):
        value = expression(t)
        t.need(")")
        return value
    if word in ("true", "false", "none"):
        t.at += 1
        return Const({"true": True, "false": False, "none": None}[word])
    return Name(t.name())


def parse(template: str) -> list:
    parts = list(lex(template))
    body, at = block(parts, 0, ())
    if at < len(parts):
        raise TemplateError(f"unexpected tag {parts[at][1]!r}")
    return body


def block(parts: list, at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    """Nodes up to a tag whose first word is in ends; the index of that tag."""
    out: list = []
    while at < len(parts):
        kind, content = parts[at]
        if kind == "text":
            out.append(Text(content))
        elif kind == "print":
            t = Tokens(content)
            out.append(Print(expression(t)))
            t.done()
        else:
            word = content.split(None, 1)[0] if content else ""
            if word in ends:
                return out, at
            t = Tokens(content)
            t.at = 1
            if word == "for":
                name = t.name()
                t.need("in")
                over = expression(t)
                body, at = block(parts, at + 1, ("endfor",))
                out.append(For(name, over, body))
            elif word == "generation":
                body, at = block(parts, at + 1, ("endgeneration",))
                out.append(Generation(body))
            elif word == "set":
                name = t.name()
                t.need("=")
                out.append(Set(name, expression(t)))
            elif word == "if":
                arms, condition = [], expression(t)
                while True:
                    t.done()
                    body, at = block(parts, at + 1, ("elif", "else", "endif"))
                    arms.append((condition, body))
                    if at >= len(parts) or parts[at][1] == "endif":
                        break
                    t = Tokens(parts[at][1])
                    t.at = 1
                    condition = expression(t) if parts[at][1].startswith("elif") else Const(True)
                out.append(If(arms))
            else:
                raise TemplateError(f"unknown tag {content!r}")
            t.done()
            if at >= len(parts):
                raise TemplateError(f"{word!r} is not closed")
        at += 1
    if ends:
        return out, at
    return out, at


# --- constant folding ----------------------------------------------------------------------------------------------


def fold_expr(e: object) -> object:
    if isinstance(e, Item):
        return Item(fold_expr(e.of), fold_expr(e.key))
    if isinstance(e, (Op, Apply)):
        args = [fold_expr(a) for a in e.args]
        folded = type(e)(e.op if isinstance(e, Op) else e.name, args)
        if all(isinstance(a, Const) for a in args):
            return Const(compile_expr(folded)({}))
        return folded
    return e


def fold(body: list) -> list:
    """Constant expressions become values, constant conditions disappear, neighbouring texts merge."""
    out: list = []
    for node in body:
        nodes = [node]
        if isinstance(node, Print):
            value = fold_expr(node.value)
            nodes = [Text(show(value.value))] if isinstance(value, Const) else [Print(value)]
        elif isinstance(node, Set):
            nodes = [Set(node.name, fold_expr(node.value))]
        elif isinstance(node, For):
            nodes = [For(node.name, fold_expr(node.over), fold(node.body))]
        elif isinstance(node, Generation):
            nodes = [Generation(fold(node.body))]
        elif isinstance(node, If):
            arms = []
            for condition, inner in node.arms:
                condition = fold_expr(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                arms.append((condition, fold(inner)))
                if isinstance(condition, Const):
                    break
            nodes = arms[0][1] if arms and isinstance(arms[0][0], Const) else [If(arms)] if arms else []
        for n in nodes:
            if isinstance(n, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].text + n.text)
            elif not isinstance(n, Text) or n.text:
                out.append(n)
    return out


# --- closures ------------------------------------------------------------------------------------------------------


def compile_expr(e: object) -> Callable[[dict], object]:
    if isinstance(e, Const):
        value = e.value
        return lambda env: value
    if isinstance(e, Name):
        name = e.name
        return lambda env: env.get(name)
    if isinstance(e, Item):
        of, key = compile_expr(e.of), compile_expr(e.key)

        def item(env: dict) -> object:
            held, k = of(env), key(env)
            if isinstance(held, dict):
                return held.get(k)
            if isinstance(held, (list, str)) and isinstance(k, int):
                return held[k] if -len(held) <= k < len(held) else None
            return None

        return item
    args = [compile_expr(a) for a in e.args]
    if isinstance(e, Apply):
        f, first, more = on_values(FILTERS[e.name]), args[0], args[1:]
        if not more and e.name in ("escape", "trim", "upper", "lower"):
            return lambda env: f(show(first(env)))
        return lambda env: f(first(env), *[a(env) for a in more])
    if e.op == "not":
        return lambda env: not args[0](env)
    a, b = args
    if e.op == "and":
        return lambda env: a(env) and b(env)
    if e.op == "or":
        return lambda env: a(env) or b(env)
    f = OPERATORS[e.op]
    return lambda env: f(a(env), b(env))


class Output:
    """What a rendering has written: pieces, their length so far, and the spans of generation blocks."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def compile_body(body: list) -> Callable[[dict, Output], None]:
    steps = [compile_node(n) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def compile_node(node: object) -> Callable[[dict, Output], None]:
    if isinstance(node, Text):
        text = node.text
        return lambda env, out: out.write(text)
    if isinstance(node, Print):
        value = compile_expr(node.value)
        return lambda env, out: out.write(show(value(env)))
    if isinstance(node, Set):
        name, value = node.name, compile_expr(node.value)
        return lambda env, out: env.__setitem__(name, value(env))
    if isinstance(node, Generation):
        body = compile_body(node.body)

        def generation(env: dict, out: Output) -> None:
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return generation
    if isinstance(node, For):
        name, over, body = node.name, compile_expr(node.over), compile_body(node.body)

        def loop(env: dict, out: Output) -> None:
            items = list(over(env) or [])
            for i, x in enumerate(items):
                body(env | {name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1}}, out)

        return loop
    arms = [(compile_expr(c), compile_body(b)) for c, b in node.arms]

    def choose(env: dict, out: Output) -> None:
        for condition, body in arms:
            if condition(env):
                return body(env, out)
        return None

    return choose


def compile_template(template: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from variables to (formatted text, generation spans)."""
    body = compile_body(fold(parse(template)))

    def render(variables: dict) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        body(dict(variables), out)
        return "".join(out.pieces), out.spans

    return render


# --- operator ------------------------------------------------------------------------------------------------------

FORMATTED = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
BATCH = 512


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (array of start, end in code points: the loss mask).

    turns: conv_id, turn, role, text; other columns are ignored. Turns go by turn (null first), ties by role and text;
    repeated rows are turns of their own. Null role and text: empty. Rows with a null conv_id form one conversation. An
    empty table gives no rows. Conversations are dealt by conv_id, sorted within partitions and rendered as they stream
    by, so a task holds one conversation at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, held, messages, out = compile_template(template), None, [], []
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if messages and conv_id != held:
                    out.append((held, *render({"messages": messages})))
                    messages = []
                    if len(out) >= BATCH:
                        yield _formatted(out)
                        out = []
                held = conv_id
                messages.append({"role": role or "", "text": text or ""})
        if messages:
            out.append((held, *render({"messages": messages})))
        yield _formatted(out)

    ship(turns.sparkSession)
    dealt = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, formatted string, spans array<struct<start: long, end: long>>")


def _formatted(rows: list[tuple]) -> pa.RecordBatch:
    ids, texts, spans = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], FORMATTED.field(2).type)], schema=FORMATTED)


def read_turns(formatted: str) -> list[tuple[str, str]] | None:
    """The (role, text) turns of a text that TEMPLATE formatted; None if another template did."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            return None
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Counts and digests of the turns and the masked texts, read back from the formatted text and its spans.

    n_turns and turns_sha256 are null where the text is not in TEMPLATE's form; the masked texts are read from any template
    that escapes them. Null texts count as empty, null spans as none. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns = read_turns(text := text or "")
                whole = None if turns is None else _sha("".join(f"{r}\n{t}\n" for r, t in turns))
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans or ())
                rows.append((conv_id, None if turns is None else len(turns), whole, len(loss), _sha(loss), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in DIGEST.split(", ")])

    ship(formatted.sparkSession)
    return formatted.mapInArrow(run, DIGEST)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -1, whose texts hold control strings. Turns that the table itself has in conversation -1
    stay: they and the two new ones are one conversation, in the usual order."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
