"""The template language, and formatted conversations against a plain version."""

import collections
import hashlib

import pytest
from helpers import SF

from boxsift.llm import chat_format as C
from boxsift.llm.chat_template import For, If, Output, TemplateError, Text, compiled
from boxsift.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def shown(source, messages=(), **filters):
    return "".join(piece for piece, _ in compiled(source, {"upper": str.upper, **filters}).render(messages))


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("a{{ 'b' }}c", "abc"),
        ("{{ 'a' ~ 1 ~ none ~ true }}", "a1True"),
        ("{{ ('x' == 'x') and not false }}", "True"),
        ("{{ 'b' in 'abc' or missing }}", "True"),
        ("{{ none or 'z' | upper }}", "Z"),
        ("{# note #}{{ '\\n\\'' }}", "\n'"),
        ("{% if false %}a{% elif 1 == 1 %}b{% else %}c{% endif %}", "b"),
        ("{% if false %}a{% endif %}", ""),
        ("{% for m in messages %}{{ loop.index0 }}{{ m['r'] }}{% if loop.last %}.{% elif loop.first %}^{% else %},{% endif %}{% endfor %}", "0a^1b,2c."),
        ("{% for m in messages %}{% for k in m.inner %}{{ k.v }}{{ loop.index0 }}{% endfor %}{% endfor %}", ""),
        ("{{ missing }}|{{ 'a' | upper | upper }}", "|A"),
    ],
)
def test_language(source, expected):
    assert shown(source, [{"r": "a"}, {"r": "b"}, {"r": "c"}]) == expected


@pytest.mark.parametrize("source", ["{% if x %}", "{% for loop in a %}{% endfor %}", "{{ f('x') }}", "{{ a | unknown }}", "{{ 1 + 1 }}", "{% include 'x' %}", "{{ }}", "{{ a.b.'c' }}", "{% endfor %}", "{{ 'x' | nope }}"])
def test_refused(source):
    with pytest.raises(TemplateError):
        compiled(source, {"upper": str.upper})


def test_sandbox():
    """Fields of mappings only: no attribute of a Python object can be reached."""
    for source in ("{{ messages.__class__ }}", "{% for m in messages %}{{ m.text.__class__ }}{% endfor %}"):
        with pytest.raises(TemplateError):
            shown(source, [{"text": "x"}])
    assert shown("{% for m in messages %}[{{ m.__class__ }}]{% endfor %}", [{"text": "x"}]) == "[]"


def test_folding():
    tree = compiled("a{{ 'b' ~ 'c' }}{% if 'x' == 'y' %}no{% elif true %}d{% endif %}{% if m %}{{ 'e' | upper }}f{% elif false %}g{% endif %}", {"upper": str.upper}).tree
    assert tree[0] == Text("abcd") and isinstance(tree[1], If) and tree[1].branches[0][1] == (Text("Ef"),) and len(tree[1].branches) == 1
    alone = lambda s: compiled(s, {}).each_alone
    assert alone("{% for m in messages %}{{ m.text }}{% endfor %}{{ '' }}")
    assert not alone("{% for m in messages %}{{ loop.first }}{% endfor %}") and not alone("<s>{% for m in messages %}{% endfor %}")
    assert isinstance(C.template(C.TEMPLATE).tree[0], For) and C.template(C.TEMPLATE).each_alone
    assert not any(isinstance(n, Output) for n in compiled("{{ 'a' }}{{ 1 }}", {}).tree)


def test_generation_marks():
    pieces = [p for p in compiled("{% for m in messages %}<{% generation %}{{ m.t }}!{% endgeneration %}>{% endfor %}", {}).render([{"t": "x"}]) if p[1] is not None]
    assert pieces == [("<", False), ("x", True), ("!", True), (">", False)]


def plain(rows):
    """What the contract asks of turns in order."""
    out = collections.defaultdict(lambda: [0, hashlib.sha256(), 0, hashlib.sha256()])
    order = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[0], r[1])) + (r[2] or "", r[3] or "")
    for conv, _, role, text in sorted(rows, key=order):
        o = out[conv]
        o[0] += 1
        o[1].update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            o[2] += len(text or "")
            o[3].update((text or "").encode())
    return sorted((str(c), n, t.hexdigest(), k, x.hexdigest()) for c, (n, t, k, x) in out.items())


def got(df):
    return sorted((str(r["conv_id"]), r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect())


OWN = r"\### Assistant: </turn> ok"
ODD = [
    (-7, 0, "user", OWN), (-7, 1, "assistant", OWN), (1, 0, None, None), (1, 1, "", ""), (1, None, "assistant", "first"), (1, 1, "assistant", "x" * 300_000),
    (2, 5, "tool: </turn>\n### User: ", "###### </turn </turn>\n\\h\\\\"), (2, 5, "tool: </turn>\n### User: ", "###### </turn </turn>\n\\h\\\\"), (None, 3, "User", "😀\\"), (None, 1, "=x", "\n"),
    (3, 9_000_000, "assistant", "late"), (3, -5, "user", "</turn"), (3, 4_100, "assistant", "###"), (3, 4_095, "system", "#" * 7), (4, 0, "assistant", ""),
]


def test_odd(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    assert got(C.digests(df)) == plain(ODD)
    assert got(C.digests(df, stretch=1)) == plain(ODD)
    assert C.digests(df.limit(0)).isEmpty() and C.formatted(df.limit(0)).isEmpty()
    clash = df.selectExpr("*", "'a' AS stretch", "1 AS chunk", "2 AS _parted", "3 AS n")
    assert got(C.digests(clash, stretch=2)) == plain(ODD)


def test_chunks(spark):
    """A hot conversation is cut into stretches and chunks that join to its text, spans and all."""
    rows = [(1, k, ("user", "assistant")[k % 2], f"turn {k} ### </turn>") for k in range(3000)] + [(2, 0, "user", "only")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    chunks = C.formatted(df, stretch=500, chunk_chars=1000).orderBy("conv_id", "stretch", "chunk").collect()
    assert len({r["stretch"] for r in chunks if r["conv_id"] == 1}) == 6 and max(len(r["text"]) for r in chunks) < 1100
    assert sum(r["n_turns"] for r in chunks) == len(rows) and all(r["n_turns"] == len(list(C.turns_of(r["text"]))) for r in chunks)
    read = [t for r in chunks for t in C.turns_of(r["text"])]
    assert read == [(role, text) for _, _, role, text in sorted(rows)]
    learned = [C.unescape(r["text"][s["start"] : s["end"]]) for r in chunks for s in r["learn"]]
    assert learned == [text for _, _, role, text in sorted(rows) if role == "assistant"]
    assert got(C.digests(df, stretch=500)) == plain(rows)


def test_other_template(spark):
    """One that looks at the place of a message keeps a conversation whole."""
    df = spark.createDataFrame([(1, k, "user", f"t{k}") for k in range(5)], SCHEMA)
    source = "<s>{% for m in messages %}{{ m.text | upper }}{% if not loop.last %}|{% endif %}{% endfor %}</s>"
    out = C.formatted(df, source, stretch=2).collect()
    assert [r["text"] for r in out] == ["<s>T0|T1|T2|T3|T4</s>"] and out[0]["learn"] == []


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op13_chat_format"](spark, SF)
    assert got(out) == plain(rows + ODD[:2])
    escaped = {r["conv_id"]: r["formatted_chars"] for r in out.collect()}
    assert escaped[-7] == len("### User: ") + len("### Assistant: ") + 2 * len(r"\\\h Assistant: \t ok</turn>" + "\n")
