"""Fill-in-the-middle against a plain version, on whole tables and odd texts."""

import hashlib
import re

from helpers import SF
from pyspark.sql import functions as F

from boxsift.llm import fill_middle as M

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    t, h = text or "", hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = UNIT.findall(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def held(df):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = df.select("doc_id", "text").collect()
    expected = sorted((str(r["doc_id"]), *map(str, plain(r["doc_id"], r["text"])[:4]), sha(plain(r["doc_id"], r["text"])[4]), sha(r["text"] or "")) for r in rows)
    got = M.digest(M.rearrange(df)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    assert sorted(tuple(map(str, r)) for r in got) == expected


def test_whole_table(spark):
    held(spark.read.parquet(f"{SF}/documents.parquet"))


def test_odd(spark, odd_docs, no_docs):
    held(odd_docs)
    assert M.rearrange(no_docs).isEmpty()
    texts = ["  a  b \n", "\n", " ", "a", "😀 😀\t😀", "é x y z", "<P", "a <S> b", "<<S", "x<\nS>", "$1 \\E \\Q a|b", "a\x0bb\x0cc\rd", "<M>"]
    held(spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string"))


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "keep", "form?", 7)], "doc_id long, text string, _text string, form string, n long")
    got = M.rearrange(df).first()
    assert got["_text"] == "keep" and got["form"] in ("plain", "psm", "spm") and got["n"] == 3


def test_filters_above(spark):
    """A filter on what the operator returns keeps the rows it should, and a long text ends soon."""
    df = spark.createDataFrame([(i, "word " * 20_000) for i in range(20)], "doc_id long, text string")
    out = M.digest(M.rearrange(df))
    assert out.where("form != 'plain' AND prefix_chars >= 0").count() == out.where("restored_sha256 IS NOT NULL AND form != 'plain'").count()


def test_grammars(spark):
    cases = {
        M.WORDS: ("  a  b ", ["  a", "  b", " "]),
        M.LINES: ("a\n\nb", ["a\n", "\n", "b"]),
        M.CODE: ("if x1==2:\n  y", ["if", " ", "x", "1", "=", "=", "2", ":", "\n  ", "y"]),
        M.CHARACTERS: ("a😀\n", ["a", "😀", "\n"]),
    }
    for grammar, (text, expected) in cases.items():
        df = spark.createDataFrame([(text,), ("",)], "text string")
        assert [r[0] for r in df.select(M.units(F.col("text"), grammar)).collect()] == [expected, []]
