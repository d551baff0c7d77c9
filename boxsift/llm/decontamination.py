"""Benchmark decontamination by latent semantic retrieval, then subsequence and answer checks.

1. Passages that have a hashed word are counted over all documents (one pass). A word's weight falls with their number,
   but no word weighs nothing: where an item is in most of the documents, its words still tell it from other passages.
2. A randomised SVD of the TF-IDF matrix of all passages: each task adds a^T (a Omega) over its passages a, the sums meet
   in a tree, and a Nystroem step on the driver turns A^T A Omega, of fixed size, into singular vectors (one pass). The
   first vector, the mean direction, is dropped; the others are scaled to unit variance.
3. Every passage of every document is compared with the passages of the benchmark by cosine in that space; those close
   enough, that also have a share of the rarer half of the item passage's words, are candidates. So is each place where
   ``GRAM`` words of an item, one of the rarer half among them, stand word for word, or all words of a shorter item;
   these are looked up by hash. A candidate is checked on its words, in the same task: the longest common subsequence
   with the item must cover ``SURE`` of it; or ``LIKELY`` of it, ``FEWEST`` words at least, while the item's answer is
   there too, or words with ``HEAVY`` of the item's weight, as in a paraphrase that replaces words or moves parts. Words
   weigh as in TF-IDF, so common words that agree by chance count little (one pass).

The answer is the column ``answer`` of the benchmark, where there is one and it is filled, else the item's last sentence.
Nothing is shuffled but the sums. The benchmark is a query set that meets all rows, in blocks of ``ITEM_WORDS`` words,
with a pass over the documents for each block. An item of more than ``PART`` words is sought in parts of so many, and
the part that is found best speaks for it, so that the check of a place never grows with the square of an item.

Defined results: a null or empty text has no leak; an item without a word is never leaked; an item of fewer than
``SHORT_ITEM`` words must be there word for word; repeated rows are judged alike, each on its own; an item listed twice
is reported twice; the cosine is null where a pair was found by its words alone; an empty table of documents or of items
gives no rows; other columns are not read, and ``clean`` returns the columns of its input as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import columns_of, free_name, map_batches, word_count, written
from boxsift.llm.shingles import _FACTORS, PUNCTUATION, text_chunks, word_hashes
from boxsift.llm.sums import summed

TERMS = 1 << 14
RANK, OVERSAMPLE = 48, 8
#: Passages are made of blocks of words: long ones of four, that start at every second block, and short ones of two, that
#: start at every block. Items of up to SHORT_PASSAGE_ITEM words are sought among the short ones.
BLOCK, LONG, SHORT = 8, 4, 2
SHORT_PASSAGE_ITEM = 24
#: Words of an item that stand together and make a place a candidate.
GRAM = 3
#: Bits of the table that screens hashes of words that stand together, and matches that are taken up at a time.
SCREEN, MATCHES = 22, 1 << 20
COSINE, SURE, LIKELY, ANSWER, HEAVY = 0.3, 0.8, 0.45, 0.8, 0.45
FEWEST = 7
#: Share of the rarer half of an item passage's words that a candidate passage must have.
SHARED = 0.35
SHORT_ITEM = 8
#: Words of an item that are sought at once; words of the items of a block; pairs of passages that are compared at a time.
PART, ITEM_WORDS, PAIRS = 512, 1 << 20, 1 << 21
#: Words whose vectors are summed at a time.
STRETCH = 16_384


def terms_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, their terms, and the texts that have them."""
    h, owner = word_hashes(raw, PUNCTUATION)
    return h, (h >> np.uint64(50)).astype("i4"), owner


def _blocks(owner: np.ndarray, n: int, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words' texts: the place of each word in its text, the first word of each block, and the block's text."""
    first = np.searchsorted(owner, np.arange(n))
    place = np.arange(len(owner)) - first[owner]
    start = np.flatnonzero(place % size == 0)
    return place, start, owner[start]


@dataclass
class LatentSpace:
    idf: np.ndarray
    basis: np.ndarray  # terms x rank, each row times the term's idf

    def weights(self, h: np.ndarray) -> np.ndarray:
        """Of words by their hashes."""
        return self.idf[(h >> np.uint64(50)).astype("i4")]

    def blocks_of(self, h: np.ndarray, owner: np.ndarray, n: int, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums, word sets, first words and texts of all blocks of n texts, given as hashes and texts of their words.

        A word set is 256 bits, one for each word by its hash; of the words that some marks, if given.
        """
        term = (h >> np.uint64(50)).astype("i4")
        _, start, of = _blocks(owner, n)
        used = np.arange(len(h)) if some is None else np.flatnonzero(some)
        sets = np.zeros((len(start), 4), "u8")
        if len(used):
            bits = np.zeros((len(used), 4), "u8")
            bits[np.arange(len(used)), (h[used] & np.uint64(3)).astype("i8")] = np.uint64(1) << ((h[used] >> np.uint64(2)) & np.uint64(63))
            block = np.searchsorted(start, used, side="right") - 1
            cut = np.flatnonzero(np.diff(block, prepend=-1))
            sets[block[cut]] = np.bitwise_or.reduceat(bits, cut)
        return _block_sums(self.basis, np.arange(len(h)), term, start), sets, start, of


def passages(sums: np.ndarray, sets: np.ndarray, of: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors, word sets and first blocks of the passages of so many blocks; a text's last ones may be shorter."""
    if not len(of):
        return sums, sets, np.empty(0, "i8")
    first = np.searchsorted(of, of)  # first block of the block's text
    at = np.flatnonzero((np.arange(len(of)) - first) % stride == 0)
    # A passage that only repeats the end of the one before it is left out.
    size = np.bincount(of)[of[at]]
    place = at - first[at]
    at = at[(place == 0) | (place + length - stride < size)]
    v, bits = sums[at].copy(), sets[at].copy()
    for k in range(1, length):
        ok = np.flatnonzero(at + k < len(of))
        ok = ok[of[at[ok] + k] == of[at[ok]]]
        v[ok] += sums[at[ok] + k]
        bits[ok] |= sets[at[ok] + k]
    norm = np.linalg.norm(v, axis=1)
    some = norm > 1e-9
    return v[some] / norm[some, None], bits[some], at[some]


def _block_sums(rows: np.ndarray, used: np.ndarray, term: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of the rows of each block's terms, over the places in used; taken in stretches that stay in a cache."""
    out = np.zeros((len(start), rows.shape[1]), "f4")
    block = np.searchsorted(start, used, side="right") - 1
    for k in range(0, len(used), STRETCH):
        part = block[k : k + STRETCH]
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        out[part[cut]] += np.add.reduceat(rows[term[used[k : k + STRETCH]]], cut)
    return out


def passage_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Passages that have each term, and their number."""

    def task(chunks: Iterator[tuple[pa.RecordBatch, list[bytes]]]) -> np.ndarray | None:
        total = None
        for _, raw in chunks:
            _, term, owner = terms_of(raw)
            total = np.zeros(TERMS + 1, "i8") if total is None else total
            _, start, _ = _blocks(owner, len(raw), LONG * BLOCK)
            passage = np.repeat(np.arange(len(start)), np.diff(start, append=len(term)))
            step = (1 << 32) // TERMS  # passages whose pairs with terms fit 32 bits
            for k in range(0, len(start), step):
                a, b = start[k], start[k + step] if k + step < len(start) else len(term)
                pairs = np.sort((passage[a:b] - k).astype("u4") * np.uint32(TERMS) + term[a:b].astype("u4"))
                once = pairs[np.flatnonzero(np.diff(pairs, prepend=pairs[0] + np.uint32(1)))]
                total[:-1] += np.bincount(once % np.uint32(TERMS), minlength=TERMS)
            total[-1] += len(start)
        return total

    got = summed(docs.select("text"), task, "i8", 1, lower=True)
    return (got[:-1], int(got[-1])) if len(got) else (np.zeros(TERMS, "i8"), 0)


def fit_space(docs: DataFrame, rank: int = RANK, seed: int = 11) -> LatentSpace:
    """Randomised SVD over the passages of all documents."""
    df, n = passage_frequency(docs)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype("f4")  # 1 at least
    width = rank + OVERSAMPLE
    omega = np.random.default_rng(seed).standard_normal((TERMS, width)).astype("f4")
    weighted = omega * idf[:, None]

    def task(chunks: Iterator[tuple[pa.RecordBatch, list[bytes]]]) -> np.ndarray | None:
        total = None
        for _, raw in chunks:
            total = np.zeros((TERMS, width), "f4") if total is None else total
            _, term, owner = terms_of(raw)
            if not len(term):
                continue
            _, start, _ = _blocks(owner, len(raw), LONG * BLOCK)
            used = np.flatnonzero(idf[term])
            y = _block_sums(weighted, used, term, start)
            block = np.searchsorted(start, used, side="right") - 1
            square = np.bincount(block, idf[term[used]] ** 2, len(start))
            y /= np.maximum(square, 1e-9)[:, None].astype("f4")  # rows of unit length, on both sides
            order = np.argsort(term[used].astype("u2"), kind="stable")
            sorted_terms, sorted_blocks = term[used][order], block[order]
            for k in range(0, len(used), STRETCH):
                terms = sorted_terms[k : k + STRETCH]
                cut = np.flatnonzero(np.diff(terms, prepend=-1))
                total[terms[cut]] += np.add.reduceat(y[sorted_blocks[k : k + STRETCH]], cut)
        if total is not None:
            total *= idf[:, None]  # a term's weight is the same at each of its places
        return total

    z = summed(docs.select("text"), task, "f4", 16, lower=True)
    if not len(z):
        return LatentSpace(idf, weighted[:, 1 : rank + 1])
    z = z.reshape(TERMS, width).astype("f8")
    values, vectors = np.linalg.eigh((omega.T @ z + z.T @ omega) / 2)
    good = values > max(values.max(), 0) * 1e-9
    if not good.any():
        return LatentSpace(idf, weighted[:, 1 : rank + 1])
    u, s, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    keep = slice(1, rank + 1) if len(s) > 1 else slice(0, 1)
    return LatentSpace(idf, (u[:, keep] / np.maximum(s[keep], s[0] * 1e-6) * idf[:, None]).astype("f4"))


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; masks has the places of each word of one side, as bits."""
    full = (1 << size) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


@dataclass
class Item:
    """An item, or a part of a long one; row tells the rows of the benchmark apart."""

    row: int
    item_id: int
    words: list[int]
    masks: dict[int, int]
    answer: list[int]
    answer_masks: dict[int, int]
    weight: dict[int, float]  # a word's share of the weight of the item's distinct words
    rare: set[int]  # the rarer half of them


def _hashes(text: str) -> list[int]:
    return word_hashes([text.lower().encode()], PUNCTUATION)[0].tolist()


def make_items(row: int, item_id: int, text: str | None, answer: str | None, space: LatentSpace) -> list[Item]:
    """The item, in parts if it is long: each with the words of the whole answer, or the last sentence, that it has."""
    words = _hashes(text or "")
    sentences = [x for x in (text or "").replace("\n", ". ").split(". ") if any(c.isalnum() for c in x)]
    told = _hashes(answer or "") or (_hashes(sentences[-1]) if sentences else [])
    told = told[-PART:]
    out = []
    for k in range(0, len(words), PART):
        part = words[max(0, min(k, len(words) - PART)) : k + PART]
        distinct = np.array([*dict.fromkeys(part)], "u8")
        w = space.weights(distinct).astype("f8")
        rare = distinct[w >= np.median(w)]
        out.append(Item(row, item_id, part, _masks(part), told, _masks(told), dict(zip(distinct.tolist(), (w / w.sum()).tolist())), set(rare.tolist())))
    return out


def _masks(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def compare(item: Item, region: list[int]) -> tuple[float, float] | None:
    """Shares of the item and of its answer that the region has in order; None if that is no leak."""
    n, there = len(item.words), set(region)
    if len(item.rare & there) < LIKELY / 2 * len(item.rare):
        return None
    whole = common_subsequence(item.masks, n, region) / n
    answer = common_subsequence(item.answer_masks, len(item.answer), region) / len(item.answer) if item.answer else 0.0
    if n < SHORT_ITEM:
        verbatim = any(region[k : k + n] == item.words for k in range(len(region) - n + 1))
        return (whole, answer) if verbatim else None
    if whole >= SURE:
        return whole, answer
    if whole < LIKELY or whole * n < FEWEST:
        return None
    return (whole, answer) if answer >= ANSWER or sum(w for x, w in item.weight.items() if x in there) >= HEAVY else None


@dataclass
class Grams:
    """Hashes of n words that stand together in items, in order, and the items of each: of[at[k] : at[k + 1]]."""

    n: int
    hashes: np.ndarray
    at: np.ndarray
    of: np.ndarray
    screen: np.ndarray

    def matches(self, h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First words, among all words of some texts, and items of the places where such words stand."""
        s = gram_hashes(h, self.n)
        at = np.flatnonzero(self.screen[s >> np.uint64(64 - SCREEN)])
        at = at[owner[at] == owner[at + self.n - 1]]
        k = np.searchsorted(self.hashes, s[at])
        same = self.hashes[np.minimum(k, len(self.hashes) - 1)] == s[at]
        at, k = at[same], k[same]
        size = self.at[k + 1] - self.at[k]
        ends = np.cumsum(size)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + MATCHES, side="right")))
            some = size[first:last]
            place = np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some)
            yield np.repeat(at[first:last], some), self.of[np.repeat(self.at[k[first:last]], some) + place]
            first = last


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n words in sequence, of words' hashes."""
    if len(h) < n:
        return np.empty(0, "u8")
    s = h[: len(h) - n + 1] * _FACTORS[0]
    for k in range(1, n):
        s += h[k : len(h) - n + 1 + k] * _FACTORS[k]
    return s


def _telling_grams(item: Item, n: int) -> np.ndarray:
    """Of an item, those with a word of its rarer half; each item has some."""
    rare = np.array([w in item.rare for w in item.words])
    telling = np.lib.stride_tricks.sliding_window_view(rare, n).any(1)
    return gram_hashes(np.array(item.words, "u8"), n)[telling]


def item_grams(items: list[Item]) -> list[Grams]:
    out = []
    for n in range(1, GRAM + 1):
        pairs = [(_telling_grams(i, n), k) for k, i in enumerate(items) if min(len(i.words), GRAM) == n]
        if pairs:
            hashes, of = np.concatenate([s for s, _ in pairs]), np.concatenate([np.full(len(s), k) for s, k in pairs])
            order = np.lexsort((of, hashes))
            hashes, of = hashes[order], of[order]
            once = np.concatenate([[True], (np.diff(hashes) != 0) | (np.diff(of) != 0)])
            hashes, of = hashes[once], of[once]
            distinct, at = np.unique(hashes, return_index=True)
            screen = np.zeros(1 << SCREEN, bool)
            screen[distinct >> np.uint64(64 - SCREEN)] = True
            out.append(Grams(n, distinct, np.append(at, len(of)), of, screen))
    return out


def _searched(space: LatentSpace, items: list[Item], cosine: float):
    sought = item_passages(space, items)
    sizes = np.array([len(i.words) for i in items], "i8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = item_grams(items)
        for b, raw in text_chunks(batches, most=1 << 20, lower=True):
            h, word_of = word_hashes(raw, PUNCTUATION)
            sums, sets, start, of = space.blocks_of(h, word_of, len(raw))
            edges = np.searchsorted(word_of, np.arange(len(raw) + 1))
            found: dict[tuple[int, int], tuple[float | None, float, float]] = {}
            for length, stride, vectors, item_sets, owner in sought:
                v, bits, at = passages(sums, sets, of, length, stride)
                least = SHARED * np.bitwise_count(item_sets).sum(1)
                step = max(16, PAIRS // max(1, len(vectors)))
                for k in range(0, len(v) if len(vectors) else 0, step):
                    near = v[k : k + step] @ vectors.T
                    p, q = np.divmod(np.flatnonzero(near >= cosine), len(vectors))
                    alike = np.bitwise_count(bits[k + p] & item_sets[q]).sum(1) >= least[q]
                    for p, q in zip(p[alike].tolist(), q[alike].tolist()):
                        item, block = int(owner[q]), int(at[k + p])
                        text, size = int(of[block]), len(items[item].words)
                        if found.get((text, item), (0, 0, 0))[1] >= 1:
                            continue
                        a = max(edges[text], start[block] - size)
                        got = compare(items[item], h[a : min(edges[text + 1], start[block] + length * BLOCK + size)].tolist())
                        if got and got > found.get((text, item), (0, 0, 0))[1:]:
                            found[text, item] = (float(near[p, q]), *got)
            for g in grams:
                for at, item in g.matches(h, word_of):
                    # Places are cells as long as the item, so that a passage is checked once for all its matches.
                    text = word_of[at]
                    cell = (at - edges[text]) // sizes[item]
                    order = np.lexsort((cell, item, text))
                    text, item, cell = text[order], item[order], cell[order]
                    once = (np.diff(text, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0)
                    for t, i, c in zip(text[once].tolist(), item[once].tolist(), cell[once].tolist()):
                        had = found.get((t, i), (None, 0, 0))
                        if had[1] >= 1:
                            continue
                        size, first = len(items[i].words), int(edges[t])
                        got = compare(items[i], h[max(first, first + (c - 1) * size) : min(edges[t + 1], first + (c + 2) * size + GRAM)].tolist())
                        if got and got > had[1:]:
                            found[t, i] = (had[0], *got)
            best: dict[tuple[int, int], tuple] = {}
            for (t, i), told in found.items():
                key = (t, items[i].row)
                if key not in best or told[1:] > best[key][1:]:
                    best[key] = (items[i].item_id, *told)
            keys = sorted(best)
            ids = b.column("doc_id").take(pa.array([t for t, _ in keys], pa.int64()))
            columns = [ids, pa.array([best[x][0] for x in keys], pa.int64()), *(pa.array([best[x][j] for x in keys], pa.float64()) for j in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "cosine", "lcs_share", "answer_share"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, space: LatentSpace | None = None, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share) of each document row that has an item of benchmark (item_id, text,
    and answer if it has that)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", answer.alias("answer"), word_count(F.col("text")).alias("size"))
    items = written(items, "benchmark-items")
    space = space or fit_space(rows)
    blocks = max(1, math.ceil((items.agg(F.sum("size")).first()[0] or 0) / ITEM_WORDS))
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        listed = block.orderBy("item_id", "text").collect()  # ITEM_WORDS words, about
        made = [x for row, r in enumerate(listed) for x in make_items(row, r["item_id"], r["text"], r["answer"], space)]
        found = map_batches(rows, _searched(space, made, cosine), "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
        out = found if out is None else out.union(found)
    return out


def item_passages(space: LatentSpace, items: list[Item]) -> list[tuple]:
    """Passage length and stride in blocks; vectors, word sets and items of the item passages; for long and short items."""
    h = np.array([w for i in items for w in i.words], "u8")
    owner = np.repeat(np.arange(len(items)), [len(i.words) for i in items])
    rare = np.array([w in i.rare for i in items for w in i.words], bool)
    sums, sets, _, of = space.blocks_of(h, owner, len(items), rare)
    short = np.array([len(i.words) <= SHORT_PASSAGE_ITEM for i in items], bool)
    out = []
    for length, stride, some in ((LONG, LONG // 2, ~short), (SHORT, 1, short)):
        v, bits, at = passages(sums, sets, of, length, stride)
        mine = some[of[at]] if len(at) else np.empty(0, bool)
        out.append((length, stride, v[mine], bits[mine], of[at][mine]))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a leak, with all their columns; rows that share a doc_id go together, those without one stay."""
    own = free_name(docs.columns, "leaked_")
    leaks = written(find_leaks(docs, benchmark).select(F.col("doc_id").alias(f"{own}id")).distinct(), "leaked")
    return docs.join(leaks, F.col("doc_id").cast("long") == F.col(f"{own}id"), "left_anti").select(*columns_of(docs))
