"""Secret scans: three fixed patterns, and a token-efficiency test for random strings.

Prose takes few tokens for its length; a random key breaks into short pieces. A candidate is a longest run of key
characters that mixes letters and digits; it is reported when its characters per token under a byte-pair vocabulary
fall to a threshold. Known digests (hexadecimal runs of a digest's length) and identifiers (UUIDs, dotted or
underscored names, numbers, versions, paths of words) are left out first.

Each text is scanned whole where it is read: one Arrow pass, no shuffle. Offsets count code points, end exclusive.

Defined results: a null or empty text has no span; equal texts have equal spans; overlapping kinds are all reported; an
empty table gives no rows; the columns named in ``keep`` pass through, except one called spans, whose name the output takes;
no other column is read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import free_name, map_batches

KINDS = ("assign", "access", "hex", "random")
#: The first three in the order of the contract: pattern, group whose length counts, least length.
ASSIGN = re.compile(r"""(?a:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # shorter runs fail and hold no longer one
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST_CHARS = (32, 40, 56, 64, 96, 128)
IDENTIFIER = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+/_=-]+"  # a number, a date, a rule of dashes
    r"|(?:[A-Za-z]+|[0-9]{1,4})(?:[/_=+-]+(?:[A-Za-z]+|[0-9]{1,4}))*[/_=+-]*"  # words and short numbers
    r"|[A-Z]?[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,4}"  # camel case
)
MAX_CHARS_PER_TOKEN = 2.0
WORD_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary(path: str):
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=WORD_SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, kind as a place in KINDS."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_known(run: str) -> bool:
    """A digest or an identifier."""
    if len(run) in DIGEST_CHARS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    return bool(IDENTIFIER.fullmatch(run))


def random_spans(text: str, encode, most: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs that take a token for every ``most`` characters or fewer."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
        if mixed and not is_known(run) and len(run) <= most * len(encode(run)):
            out.append((m.start(), 3, m.end()))
    return out


def _scanned(path: str, most: float, keep: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode_ordinary
        for b in batches:
            made = []
            for t in b.column(text).to_pylist():
                spans = sorted(base_spans(t) + random_spans(t, encode, most)) if t else []
                made.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            spans = pa.array(made, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), spans], [*keep, "spans"])

    return run


def scan(df: DataFrame, ranks: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), most: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The columns of keep, and spans: an array of (kind, start, end) sorted by start, then kind.

    ranks is the path of a tiktoken vocabulary file, which every executor can read.
    """
    keep = [c for c in keep if c != "spans"]
    own = free_name(keep, "text_")
    rows = df.select(*keep, F.col(text).alias(own))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_batches(rows, _scanned(ranks, most, keep, own), f"{kinds}spans array<struct<kind string, start bigint, end bigint>>")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans as text."""
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scanned.withColumns(
        {
            "n_assign": of("assign"),
            "n_access": of("access"),
            "n_hex": of("hex"),
            "n_random": of("random"),
            "base_sha256": F.sha2(joined(base).cast("binary"), 256),
            "spans": joined(F.col("spans")),
        }
    )
