"""A small sandboxed template language for chats, compiled to closures that render a conversation piece by piece.

    {{ expression }}                        put out, null as nothing
    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in e %} {% endfor %}        with loop.index0, loop.first and loop.last inside
    {% generation %} {% endgeneration %}    what a model learns to write
    {# a note #}

Expressions: strings, whole numbers, true, false, none, names, ``a.b`` and ``a['b']``, ``a | filter``, ``~`` (joins text),
``==``, ``!=``, ``in``, ``not``, ``and``, ``or`` and brackets. A template reaches the names it is given, the fields of
mappings and the filters it is compiled with, and nothing else: there are no calls, no attributes of Python objects and
no imports.

``compiled`` parses a template into a syntax tree, folds constants in it (a constant output becomes text, neighbouring
texts one, a branch that is never taken goes) and turns each node into a closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any


#: What a rendering yields after each message: the place where it may be cut.
BREAK = ("", None)


class TemplateError(ValueError):
    """A template that does not follow the language, or asks for what it may not have."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operation by name on expressions: field, filter or operator."""

    what: str
    parts: tuple
    name: str = ""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    """Branches (condition, nodes), the first true one of which is taken."""

    branches: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>==|!=|[~|.()\[\]]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_RESERVED = {"and", "or", "not", "in"}


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def peek(self, *signs: str) -> bool:
        return bool(self.tokens) and self.tokens[0][0] != "string" and self.tokens[0][1] in signs

    def take(self, kind: str | None = None, value: str | None = None) -> str:
        if not self.tokens or (kind and self.tokens[0][0] != kind) or (value and self.tokens[0][1] != value):
            raise TemplateError(f"expected {value or kind}, found {self.tokens[0][1] if self.tokens else 'the end'}")
        return self.tokens.pop(0)[1]

    def whole(self):
        e = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return e

    def either(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return Apply("not", (self.negated(),))
        return self._chain(self.joined, "==", "!=", "in")

    def joined(self):
        return self._chain(self.filtered, "~")

    def _chain(self, inner: Callable, *signs: str):
        e = inner()
        while self.peek(*signs):
            e = Apply(self.take(), (e, inner()))
        return e

    def filtered(self):
        e = self.atom()
        while self.peek("|", ".", "["):
            sign = self.take()
            if sign == "|":
                e = Apply("filter", (e,), self.take("word"))
            elif sign == ".":
                e = Apply("field", (e,), self.take("word"))
            else:
                e = Apply("field", (e,), self._string(self.take("string")))
                self.take("sign", "]")
        return e

    def atom(self):
        kind = self.tokens[0][0] if self.tokens else "end"
        if self.peek("("):
            self.take()
            e = self.either()
            self.take("sign", ")")
            return e
        if kind == "string":
            return Const(self._string(self.take()))
        if kind == "number":
            return Const(int(self.take()))
        word = self.take("word")
        if word in _RESERVED:
            raise TemplateError(f"unexpected {word!r}")
        return Const(_WORDS[word]) if word in _WORDS else Name(word)

    @staticmethod
    def _string(quoted: str) -> str:
        return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), quoted[1:-1], flags=re.S)


class Parser:
    """Nodes of a template; a block ends at one of the words it is told."""

    def __init__(self, source: str):
        self.parts = [p for p in _PARTS.split(source) if p]

    def nodes(self, *ends: str) -> tuple[tuple, str]:
        out = []
        while self.parts:
            part = self.parts.pop(0)
            if part.startswith("{#"):
                continue
            if part.startswith("{{"):
                out.append(Output(Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                words = part[2:-2].strip()
                word = words.split(None, 1)[0] if words else ""
                if word in ends:
                    return tuple(out), words
                out.append(self.statement(word, words[len(word) :]))
            else:
                out.append(Text(part))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(out), ""

    def statement(self, word: str, rest: str):
        if word == "for":
            m = re.fullmatch(r"\s+([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m or m[1] in ("loop", *_RESERVED, *_WORDS):
                raise TemplateError(f"for cannot be {rest!r}")
            return For(m[1], Expression(m[2]).whole(), self.nodes("endfor")[0])
        if word == "generation":
            return Generation(self.nodes("endgeneration")[0])
        if word != "if":
            raise TemplateError(f"unknown statement {word!r}")
        branches, test = [], Expression(rest).whole()
        while True:
            body, end = self.nodes("elif", "else", "endif")
            branches.append((test, body))
            if end == "endif":
                return If(tuple(branches))
            test = Const(True) if end == "else" else Expression(end[len("elif") :]).whole()


def shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def field(value: Any, name: str) -> Any:
    if not isinstance(value, Mapping):
        raise TemplateError(f"no field {name!r} of {type(value).__name__}")
    return value.get(name)


_OPERATORS: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b, "~": lambda a, b: shown(a) + shown(b), "not": lambda a: not a}


class Compiler:
    def __init__(self, filters: Mapping[str, Callable[[str], str]]):
        self.filters = dict(filters)

    def _filter(self, name: str) -> Callable[[str], str]:
        if name not in self.filters:
            raise TemplateError(f"unknown filter {name!r}")
        return self.filters[name]

    # Folding

    def folded(self, e):
        """An expression with its constant parts worked out."""
        if not isinstance(e, Apply):
            return e
        parts = tuple(map(self.folded, e.parts))
        if e.what in ("and", "or") and isinstance(parts[0], Const):
            return parts[1] if bool(parts[0].value) == (e.what == "and") else parts[0]
        out = Apply(e.what, parts, e.name)
        if e.what == "filter":
            self._filter(e.name)
        return Const(self.value(out)({})) if all(isinstance(p, Const) for p in parts) else out

    def tidy(self, nodes: Iterable) -> tuple:
        """Nodes with folded expressions, without what cannot show, neighbouring texts joined."""
        out: list = []
        for node in nodes:
            for n in self._tidied(node):
                if isinstance(n, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].value + n.value)
                elif not (isinstance(n, Text) and not n.value):
                    out.append(n)
        return tuple(out)

    def _tidied(self, node) -> tuple:
        if isinstance(node, Output):
            e = self.folded(node.value)
            return (Text(shown(e.value)),) if isinstance(e, Const) else (Output(e),)
        if isinstance(node, For):
            return (For(node.name, self.folded(node.over), self.tidy(node.body)),)
        if isinstance(node, Generation):
            body = self.tidy(node.body)
            return (Generation(body),) if body else ()
        if isinstance(node, If):
            kept = []
            for test, body in node.branches:
                test = self.folded(test)
                if isinstance(test, Const) and not test.value:
                    continue
                kept.append((test, self.tidy(body)))
                if isinstance(test, Const):
                    break
            if kept and isinstance(kept[0][0], Const):
                return kept[0][1]
            return (If(tuple(kept)),) if kept else ()
        return (node,)

    # Closures

    def value(self, e) -> Callable[[Mapping], Any]:
        if isinstance(e, Const):
            return lambda names, v=e.value: v
        if isinstance(e, Name):
            return lambda names, n=e.name: names[n] if n in names else None
        first, *rest = map(self.value, e.parts)
        if e.what == "field":
            return lambda names, n=e.name: field(first(names), n)
        if e.what == "filter":
            f = self._filter(e.name)
            return lambda names: f(shown(first(names)))
        if e.what == "and":
            return lambda names: first(names) and rest[0](names)
        if e.what == "or":
            return lambda names: first(names) or rest[0](names)
        f = _OPERATORS[e.what]
        return (lambda names: f(first(names), rest[0](names))) if rest else (lambda names: f(first(names)))

    def block(self, nodes: tuple) -> Callable[[dict, bool], Iterator[tuple[str, bool | None]]]:
        """Renders nodes as pieces (text, generated); messages are taken one at a time, so they may be a stream."""
        steps = [self.node(n) for n in nodes]

        def run(names: dict, generated: bool) -> Iterator[tuple[str, bool | None]]:
            for step in steps:
                yield from step(names, generated)

        return steps[0] if len(steps) == 1 else run

    def node(self, n) -> Callable[[dict, bool], Iterator[tuple[str, bool | None]]]:
        if isinstance(n, Text):
            return lambda names, generated, t=n.value: iter(((t, generated),))
        if isinstance(n, Output):
            f = self.value(n.value)
            return lambda names, generated: iter(((shown(f(names)), generated),))
        if isinstance(n, Generation):
            body = self.block(n.body)
            return lambda names, generated: body(names, True)
        if isinstance(n, If):
            branches = [(self.value(test), self.block(body)) for test, body in n.branches]

            def choose(names: dict, generated: bool) -> Iterator[tuple[str, bool | None]]:
                for test, body in branches:
                    if test(names):
                        return body(names, generated)
                return iter(())

            return choose
        over, body, breaks = self.value(n.over), self.block(n.body), (BREAK,) if n.over == Name("messages") else ()

        def loop(names: dict, generated: bool) -> Iterator[tuple[str, bool | None]]:
            items, k = iter(over(names) or ()), 0
            end = object()
            item = next(items, end)
            while item is not end:
                after = next(items, end)
                yield from body({**names, n.name: item, "loop": {"index0": k, "first": k == 0, "last": after is end}}, generated)
                yield from breaks
                item, k = after, k + 1

        return loop


def names_in(tree) -> set[str]:
    """Names that nodes or an expression read."""
    if isinstance(tree, Name):
        return {tree.name}
    if isinstance(tree, tuple):
        return set().union(*map(names_in, tree))
    inner = {Apply: ("parts",), Output: ("value",), If: ("branches",), For: ("over", "body"), Generation: ("body",)}.get(type(tree), ())
    return set().union(*(names_in(getattr(tree, f)) for f in inner))


@dataclass(frozen=True)
class Template:
    """A compiled template. each_alone: it is one loop over the messages that looks at nothing but the message at hand, so a
    conversation may be rendered in stretches and put together afterwards."""

    tree: tuple
    each_alone: bool
    render: Callable[[Iterable[Mapping]], Iterator[tuple[str, bool | None]]]


def compiled(source: str, filters: Mapping[str, Callable[[str], str]]) -> Template:
    """The template as a function from messages to pieces (text, generated), with BREAK after each message."""
    c = Compiler(filters)
    tree = c.tidy(Parser(source).nodes()[0])
    run = c.block(tree)
    alone = len(tree) == 1 and isinstance(tree[0], For) and tree[0].over == Name("messages") and names_in(tree[0].body) <= {tree[0].name}
    return Template(tree, alone, lambda messages: run({"messages": messages}, False))
