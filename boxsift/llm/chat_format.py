"""Chat formatting: conversations rendered by a compiled template, with the spans that a model learns from, and read back.

Turns are dealt by conversation and stretch of turns, sorted, and rendered as a stream: a task holds one turn and the
chunk it writes, never a conversation. A template that looks at one message at a time (``Template.each_alone``; the one
given here does) is rendered in stretches of ``STRETCH`` turn numbers, so that a conversation with a third of all turns is
spread over the tasks; for another one a conversation is one stream. Each row of the result is a chunk of about
``CHUNK_CHARS`` characters; a conversation's text is its chunks in order of (stretch, chunk).

The template given here marks turns by ``### Role: `` and ``</turn>``. The filter ``escape`` writes these strings and the
backslash inside texts as a backslash and a letter, so a reader that splits at the marks gets each role and text back.

Defined results: turns are taken in order of turn, then role, then text, a null turn first; repeated rows are all
formatted; a null text is empty, a null role is the empty role; rows with a null conv_id make one conversation; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxsift.llm.chat_template import Template, compiled
from boxsift.llm.common import map_batches, written

STRETCH = 4096
CHUNK_CHARS = 1 << 20
#: Conversations of several stretches that may be broadcast; more are joined by a shuffle.
FEW_IDS = 100_000
END = "</turn>"
ROLES = {"assistant": "Assistant", "user": "User", "system": "System"}
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'assistant' %}### Assistant: {% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% elif m.role == 'user' %}### User: {{ m.text | escape }}"
    "{% elif m.role == 'system' %}### System: {{ m.text | escape }}"
    "{# any other role by its own name #}{% else %}### ={{ m.role | escape_name }}: {{ m.text | escape }}{% endif %}"
    "{{ '</turn>' ~ '\\n' }}{% endfor %}"
)
_CONTROL = {"\\": "\\\\", "###": "\\h", END: "\\t"}
_NAMED = _CONTROL | {":": "\\c"}
_BACK = {v[1]: k for k, v in _NAMED.items()}
_HEAD = re.compile(r"### (=?)([^:]*): ", re.S)


def _escaper(table: dict[str, str]):
    found = re.compile("|".join(map(re.escape, table)))
    return lambda text: found.sub(lambda m: table[m[0]], text)


FILTERS = {"escape": _escaper(_CONTROL), "escape_name": _escaper(_NAMED), "trim": str.strip, "upper": str.upper, "lower": str.lower}


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


@lru_cache(8)
def template(source: str) -> Template:
    """Compiled once in each worker."""
    return compiled(source, FILTERS)


OUTPUT = "conv_id long, stretch long, chunk int, n_turns long, text string, learn array<struct<start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Chunks:
    """Rows of OUTPUT on their way into record batches."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.size += len(row[4]) + 64

    def batch(self) -> pa.RecordBatch:
        conv, stretch, chunk, turns, text, spans = zip(*self.rows)
        flat = np.array([x for s in spans for x in s], "i4").reshape(-1, 2)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype("i4")
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
        learn = pa.ListArray.from_arrays(pa.array(offsets), pairs).cast(_SPAN)
        self.rows, self.size = [], 0
        columns = [pa.array(conv, pa.int64()), pa.array(stretch, pa.int64()), pa.array(chunk, pa.int32()), pa.array(turns, pa.int64()), pa.array(text, pa.string()), learn]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "stretch", "chunk", "n_turns", "text", "learn"])


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "stretch", "role", "text")))


def _rendered(source: str, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = template(source).render, Chunks()
        for (conv, stretch), turns in itertools.groupby(_turns(batches), key=lambda r: r[:2]):
            pieces, spans, at, chunk, n = [], [], 0, 0, 0
            for piece, generated in render({"role": role, "text": text} for _, _, role, text in turns):
                if generated is None:
                    n += 1
                    if at > chunk_chars:
                        out.add(conv, stretch, chunk, n, "".join(pieces), spans)
                        pieces, spans, at, chunk, n = [], [], 0, chunk + 1, 0
                elif generated:
                    spans.append((at, at + len(piece)))
                pieces.append(piece)
                at += len(piece)
                if out.size > chunk_chars:
                    yield out.batch()
            if pieces or not chunk:
                out.add(conv, stretch, chunk, n, "".join(pieces), spans)
            if out.size > chunk_chars:
                yield out.batch()
        if out.rows:
            yield out.batch()

    return run


def formatted(turns: DataFrame, source: str = TEMPLATE, stretch: int | None = STRETCH, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """turns (conv_id, turn, role, text) as chunks: conv_id, stretch, chunk, n_turns, text, learn (spans of code points in
    text). A chunk ends with a turn. stretch None keeps each conversation one stream."""
    whole = stretch is None or not template(source).each_alone
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        (F.lit(0) if whole else F.coalesce(F.floor(F.col("turn") / F.lit(stretch)), F.lit(-(2**62)))).cast("long").alias("stretch"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "turn", "role", "text")
    return map_batches(dealt, _rendered(source, chunk_chars), OUTPUT)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a chunk of the template given here."""
    known = {v: k for k, v in ROLES.items()}
    for part in text.split(f"{END}\n")[:-1]:
        head = _HEAD.match(part)
        yield unescape(head[2]) if head[1] else known[head[2]], unescape(part[head.end() :])


class Digest:
    """What the chunks of a conversation say, taken in as they come; the hashes are all that is kept."""

    def __init__(self):
        self.turns, self.learned, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def take(self, text: str, spans: list[tuple[int, int]]) -> None:
        for role, said in turns_of(text):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for start, end in spans:
            learned = unescape(text[start:end])
            self.learned.update(learned.encode())
            self.loss_chars += len(learned)
        self.chars += len(text)


DIGESTS = "conv_id long, stretch long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, done = None, None, []

    def row() -> tuple:
        return (*key, state.n_turns, state.turns.hexdigest(), state.loss_chars, state.learned.hexdigest(), state.chars)

    def made() -> pa.RecordBatch:
        schema = pa.schema([(c, pa.string() if k == "string" else pa.int64()) for c, k in (x.split() for x in DIGESTS.split(", "))])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    for b in batches:
        spans = b.column("learn")
        starts, ends = (spans.values.field(k).to_numpy().tolist() for k in (0, 1))
        offsets = spans.offsets.to_numpy().tolist()
        for k, (conv, stretch, text) in enumerate(zip(*(b.column(c).to_pylist() for c in ("conv_id", "stretch", "text")))):
            if state is None or (conv, stretch) != key:
                if state is not None:
                    done.append(row())
                key, state = (conv, stretch), Digest()
            a, z = offsets[k], offsets[k + 1]
            state.take(text, list(zip(starts[a:z], ends[a:z])))
        if done:
            yield made()
            done.clear()
    if state is not None:
        done.append(row())
        yield made()


def read_back(chunks: DataFrame) -> DataFrame:
    """DIGESTS of each conversation and stretch, from the rows of ``formatted`` as they come from it."""
    return map_batches(chunks, _digested, DIGESTS)


def digests(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """One row of DIGESTS, less the stretch, for each conversation.

    A digest runs over a conversation's turns in order and has no parallel form: conversations that were formatted in
    several stretches are read once more as one stream each, in the memory of one chunk.
    """
    pieces = written(read_back(formatted(turns, stretch=stretch)), "chat-digests")
    parted = pieces.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("_parted"))
    n = parted.count()
    if n == 0:
        return pieces.drop("stretch")
    parted = F.broadcast(parted) if n <= FEW_IDS else parted
    same = F.col("conv_id").eqNullSafe(F.col("_parted"))
    one = pieces.join(parted, same, "left_anti")
    many = read_back(formatted(turns.select("conv_id", "turn", "role", "text").join(parted, same, "left_semi"), stretch=None))
    return one.unionByName(many).drop("stretch")
