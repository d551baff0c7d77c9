"""Token alignment against a plain version that works on byte offsets of whole texts."""

import collections
import hashlib

import numpy as np
import pytest
from helpers import SF

from boxsift.llm import token_align as L
from boxsift.llm.common import token_file

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain(rows):
    """Rows as the contract states them, from (doc_id, text)."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(token_file(A)), SentencePieceProcessor(model_file=token_file(B))
    ta.encode_special_tokens = True
    of = L.byte_level()
    spelled_b = lambda i: bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = ([], []) if not text else (ta.encode(f" {text}", add_special_tokens=False).ids, tb.encode(text))
        x, y = [bytes(of[c] for c in ta.id_to_token(i)) for i in a], [spelled_b(i) for i in b]
        if not text or b"".join(x) != f" {text}".encode() or b"".join(y) != f" {text}".encode():
            a, b, x, y = [], [], [], []
        ea, eb = np.cumsum([0, *map(len, x)]).tolist(), np.cumsum([0, *map(len, y)]).tolist()
        both = sorted(set(ea[1:]) & set(eb[1:]))
        ia, ib, groups, links = 0, 0, [], []
        for end in both:
            ja, jb = ea.index(end, ia + 1), eb.index(end, ib + 1)
            groups.append(f"{','.join(map(str, a[ia:ja]))}|{','.join(map(str, b[ib:jb]))}")
            links += [(a[p], b[q]) for p in range(ia, ja) for q in range(ib, jb) if ea[p] < eb[q + 1] and eb[q] < ea[p + 1]]
            ia, ib = ja, jb
        counts.update(set(links))
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    out = [(i, na, nb, g, len(ls), sum(counts[p] == best[p[0]] for p in ls), sum(counts[p] for p in ls), sha) for i, na, nb, g, ls, sha in docs]
    return sorted(tuple(map(str, r)) for r in out)


def got(df):
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted(tuple(str(r[c]) for c in columns) for r in df.collect())


ODD = [
    "a", " a", "a ", "a  b", "a\nb", "\na", "a\n\nb c", "a \nb", "a\n b", "tab\there", "cr\r\nlf", "nbsp x", "▁x", "x ▁y", "ﬁ é é", "😀 a😀b", "<|endoftext|> <s> </s> <0x41>",
    "it's we'll I'M 12345 a1b2 !!! ...", "ideographic　space 中文 字", "   ", "\x00\x01 \x1c x", "antidisestablishmentarianism " * 3, "x" * 5000, "foo" + " " * 30 + "bar", "'s 's", "\x85  y",
]


@pytest.mark.parametrize("heavy", [L.HEAVY, 40, 0])
def test_odd(spark, odd_docs, no_docs, heavy):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "a  b"), (None, "a b"), (None, None), (900, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS row", "1 AS pairs", "2 AS n", "3 AS class")
    assert got(L.align(df, token_file(A), token_file(B), heavy=heavy)) == plain(rows)
    if heavy == L.HEAVY:
        assert got(L.align(odd_docs, token_file(A), token_file(B))) == plain([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
        assert L.align(no_docs, token_file(A), token_file(B)).isEmpty()


def test_whole_table(spark):
    from boxsift.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op12_token_align"](spark, SF)) == plain(rows)


def test_transducer(monkeypatch):
    """Random cuts of one text on both sides; a fresh automaton gives the same."""
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 100, 400).tolist())
    parts = sorted({text[k : k + n] for k in range(400) for n in range(1, 5)})
    at = {p: i for i, p in enumerate(parts)}

    def cut():
        out, k = [], 0
        while k < len(text):
            n = int(rng.integers(1, 5))
            out.append(at[text[k : k + n]])
            k += n
        return out

    machine = L.Transducer(parts, parts)
    for _ in range(20):
        a, b = cut(), cut()
        ends, links = machine.align(a, b)
        assert len(links) == len(a) + len(b) - len(ends) and ends[-1] == (len(a), len(b))
        monkeypatch.setattr(L, "STEPS", 0)
        assert machine.align(a, b) == (ends, links)
        monkeypatch.setattr(L, "STEPS", 1_000_000)
        assert machine.align(a, b[:-1]) is None and machine.align(a[:-1], b) is None and machine.align(a, [*b, 0]) is None
    assert machine.align([], []) == ([], [])


def test_pairs_side_by_side(monkeypatch):
    """Many pairs in one go give what each gives alone: short ones, one over the bound, empty ones, and such as spell other bytes."""
    rng = np.random.default_rng(4)
    parts = [bytes(p) for n in range(1, 4) for p in rng.integers(97, 99, (12, n)).tolist()] + [b""]
    at = {p: i for i, p in enumerate(parts)}

    def cut(text):
        out, k = [], 0
        while k < len(text):
            n = next(n for n in rng.permutation([1, 2, 3]).tolist() + [1] if text[k : k + n] in at)
            out.append(at[text[k : k + n]])
            k += n
        return out

    texts = [bytes(rng.integers(97, 99, n).tolist()) for n in [0, 1, 2, 400, *rng.integers(1, 30, 300).tolist()]]
    pairs = [(cut(t), cut(t)) for t in texts]
    pairs += [([*a, at[b"a"]], b) for a, b in pairs[:40]] + [(a, [*b, at[b"a"]]) for a, b in pairs[:40]] + [(a[::-1], b) for a, b in pairs[:40]] + [([len(parts) - 1, *a], b) for a, b in pairs[:4]]
    alone = L.Transducer(parts, parts)
    want = [alone.align(a, b) for a, b in pairs]
    cuts = [np.cumsum([0, *(len(p[side]) for p in pairs)]) for side in (0, 1)]
    flat = [np.array([i for p in pairs for i in p[side]]) for side in (0, 1)]
    machine = L.Transducer(parts, parts)
    for steps in (1_000_000, 1_000_000, 0):
        monkeypatch.setattr(L, "STEPS", steps)
        end_a, end_b, links, bad = machine.align_many(*flat, *cuts)
        assert bad.tolist() == [w is None for w in want] and bad.any()
        for k, w in enumerate(want):
            if w is not None:
                (i, n), (j, m) = cuts[0][k : k + 2].tolist(), cuts[1][k : k + 2].tolist()
                ends = zip((np.flatnonzero(end_a[i:n]) + 1).tolist(), (np.flatnonzero(end_b[j:m]) + 1).tolist(), strict=True)
                assert (list(ends), links[i + j : i + j + len(w[1])].tolist()) == w


def test_units_do_not_walk_alone(monkeypatch):
    """Units of ordinary length cost no walk of their own, whether new or kept; the store's halves give the same alignments."""
    monkeypatch.setattr(L.Transducer, "align", None)
    monkeypatch.setattr(L, "UNIT_STORE", 4)
    worker = L.Aligner(token_file(A), token_file(B))
    units = ["stone", "bridge", "\nunquietly", "x" * 60, "123", "don't"]
    first = [r for t, k in [worker.look_up(units)] for r in t.take(k).to_pylist()]
    assert not any(r["bad"] for r in first) and first[0]["text"].endswith(b";") and "x" * 60 not in worker.rows
    for some in (units[:3], ["new", *units[2:]], units, units[::-1]):
        table, rows = worker.look_up(some)
        assert [r for u, r in zip(some, table.take(rows).to_pylist()) if u != "new"] == [first[units.index(u)] for u in some if u != "new"]
