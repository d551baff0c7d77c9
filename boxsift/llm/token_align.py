"""Cross-tokenizer alignment: tokens of two tokenizers over the same bytes, cut into groups and linked, with the counts of
their id pairs over the whole corpus.

A transducer walks both token sequences of a text. Its state is the side that leads and the leader's dangling suffix, the
bytes that the other side has not matched; the lagging side's next token shortens the suffix or takes the lead. When
nothing dangles, both sides end at one byte and a group closes. A step depends on suffix and token alone, so the states
form an automaton that is built as it is met. Each step with something dangling is a link: a token meets the one token
whose suffix dangles. Short pairs of sequences walk through the automaton side by side, one step of all of them at a time. Tokens that do not spell the text have no step, and the text has no tokens.

White space begins a new token in both vocabularies wherever it follows another character (``Pieces`` checks that of the
vocabulary, and falls back on whole texts), so a text is aligned as the units between such places and a distinct unit is
encoded once a batch. Other texts are encoded whole.

``aligned`` is written once, with a row for each document that lists its distinct id pairs. Pairs are counted from there;
the most frequent ones, ``HEAVY`` at most, are broadcast to be met with the documents' lists, all others by a shuffle,
where none of them is hot.

Defined results: a null or empty text, and one whose tokens spell other bytes, has zeros and an empty digest; repeated rows
and rows that share an id or have none are counted and returned each on its own; an empty table gives no rows; other
columns are not read. Ids link by bytes, so ties in count are all best.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import map_batches, written
from boxsift.llm.shingles import release

#: Units a worker remembers, in a new half and an old one, and the longest of them.
UNIT_STORE, UNIT_CHARS = 300_000, 48
#: States and steps the automaton keeps before it starts afresh.
STEPS = 1_000_000
#: New units encoded in one go.
RUN = 256
#: Most tokens of two sequences that walk beside others; longer ones walk alone.
SIDE_BY_SIDE = 64
#: Id pairs that are broadcast; about 50 bytes each.
HEAVY = 1 << 19
_SPACE = r"\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2581}"
#: Texts with other white space than single blanks and line breaks inside; those that are encoded whole.
MIXED, WHOLE = r"[ \n]{2}", rf"[{_SPACE}]|^[ \n]|[ \n]$| \n"
_UNIT = re.compile(r"(?<=\S)(?=[ \n])")


def byte_level() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable bytes stand for themselves, others follow 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteLevel:
    """Side A: a byte-level vocabulary of the tokenizers library; special tokens are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary, of = self.tokenizer.get_vocab(), byte_level()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            if all(c in of for c in token):
                self.bytes[i] = bytes(of[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """ids of texts that begin with a blank."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece vocabulary with byte fallback, which puts the blank before a text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        for i in range(len(pieces)):
            if self.model.is_control(i) or self.model.is_unknown(i):
                self.bytes[i] = b""
        #: No piece goes on past a blank or a line break that follows another character.
        self.by_unit = not any(("▁" in p[1:] and p.strip("▁")) or "\n" in p for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Transducer:
    """States are (leader, suffix, steps, number): leader 0 for nobody, 1 for side A, 2 for side B; steps by the next token's
    id. Numbers are 0 for nobody, odd where side A leads and even where side B does."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b, self.size_b, self.width = a, b, len(b), max(len(a), len(b))
        self.forget()

    def forget(self) -> None:
        self.root, self.states, self.made = (0, b"", {}, 0), {}, 0
        self.numbered, self.fresh = {0: self.root}, {}
        #: Steps as arrays: number * width + token, in order, and the number of the state after it, -1 for none.
        self.keys, self.nexts = np.array([-1]), np.array([-1])

    def step(self, state: tuple, token: int) -> tuple | None:
        """The state after the lagging side's token; None if it spells other bytes."""
        leader, suffix, steps, _ = state
        new = self.b[token] if leader == 1 else self.a[token]
        if not new:
            return None
        if suffix.startswith(new):
            after = (leader, suffix[len(new) :])
        elif new.startswith(suffix):
            after = (2 if leader == 1 else 1, new[len(suffix) :])
        else:
            return None
        out = self.root if not after[1] else self.states.get(after)
        if out is None:
            number = 2 * len(self.numbered) + (after[0] == 1)
            out = self.states[after] = self.numbered[number] = (*after, {}, number)
        steps[token] = out
        self.made += 1
        return out

    def _after(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """Numbers of the states after one step each, -1 for none."""
        keys = states * self.width + tokens
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        out, lacking = self.nexts[at], np.flatnonzero(self.keys[at] != keys)
        if len(lacking):
            new, where = np.unique(keys[lacking], return_inverse=True)
            for k in new.tolist():
                if k not in self.fresh:
                    state, token = self.numbered[k // self.width], k % self.width
                    after = state[2].get(token) or self.step(state, token)
                    self.fresh[k] = -1 if after is None else after[3]
            out[lacking] = np.array([self.fresh[k] for k in new.tolist()])[where]
        return out

    def align_many(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``align`` of the pairs a[cut_a[k]:cut_a[k + 1]] and b likewise: which tokens of a and of b end a group, links (those of
        a pair from cut_a[k] + cut_b[k] on), and pairs that do not spell the same."""
        if self.made > STEPS:
            self.forget()
        end_a, end_b, links = np.zeros(len(a), bool), np.zeros(len(b), bool), np.empty(len(a) + len(b), "i8")
        i, j, n, m = cut_a[:-1], cut_b[:-1], cut_a[1:], cut_b[1:]
        bad, slot = np.zeros(len(i), bool), i + j
        long = n - i + m - j > SIDE_BY_SIDE
        for k in np.flatnonzero(long).tolist():
            found = self.align(a[i[k] : n[k]].tolist(), b[j[k] : m[k]].tolist())
            if found is None:
                bad[k] = True
            else:
                x, y = np.array(found[0], "i8").reshape(-1, 2).T
                end_a[i[k] + x - 1] = end_b[j[k] + y - 1] = True
                links[slot[k] : slot[k] + len(found[1])] = found[1]
        # One row for each pair under way: pair, state, token that leads, i, j, their ends, place of the next link.
        live = np.flatnonzero(~long)
        rows = np.stack([live, np.zeros_like(live), np.zeros_like(live), *(x[live] for x in (i, j, n, m, slot))])
        while True:
            k, state, lead, i, j, n, m, slot = rows
            of_b = state & 1 == 1  # side A leads
            out = np.where(of_b, j == m, i == n)
            if out.any():
                bad[k[out & ((state > 0) | (j < m))]] = True
                rows, of_b = rows[:, ~out], of_b[~out]
                k, state, lead, i, j, n, m, slot = rows
            if not rows.shape[1]:
                break
            token = np.where(of_b, b.take(j, mode="clip"), a.take(i, mode="clip"))
            linked = state > 0
            links[slot[linked]] = np.where(of_b, lead * self.size_b + token, token * self.size_b + lead)[linked]
            slot += linked
            i += ~of_b
            j += of_b
            after = self._after(state, token)
            closed = after == 0
            end_a[i[closed] - 1] = end_b[j[closed] - 1] = True
            turned = (after > 0) & ((state == 0) | ((after ^ state) & 1 == 1))
            lead[turned] = token[turned]
            state[:] = after
            if (after < 0).any():
                bad[k[after < 0]] = True
                rows = rows[:, after >= 0]
        if self.fresh:
            keys, nexts = np.append(self.keys, list(self.fresh)), np.append(self.nexts, list(self.fresh.values()))
            order = np.argsort(keys)
            self.keys, self.nexts, self.fresh = keys[order], nexts[order], {}
        return end_a, end_b, links, bad

    def align(self, a: list[int], b: list[int]) -> tuple[list[tuple[int, int]], list[int]] | None:
        """Ends (in a, in b) of the groups and the links as numbers a * size_b + b; None if both do not spell the same."""
        if self.made > STEPS:
            self.forget()
        root, step, size = self.root, self.step, self.size_b
        state, i, j, lead, ends, links = root, 0, 0, 0, [], []
        n, m = len(a), len(b)
        while i < n or state is not root:
            if state[0] == 1:  # side A leads
                if j == m:
                    return None
                token = b[j]
                j += 1
                links.append(lead * size + token)
                after = state[2].get(token) or step(state, token)
            else:
                if i == n:
                    return None
                token = a[i]
                i += 1
                if state is not root:
                    links.append(token * size + lead)
                after = state[2].get(token) or step(state, token)
            if after is None:
                return None
            if after is root:
                ends.append((i, j))
            elif after[0] != state[0]:
                lead = token
            state = after
        return (ends, links) if j == m else None


#: Alignments of units or texts, a row each: tokens of A and of B, groups, whether it has none by itself, the groups as text (each
#: with a semicolon behind it), links as bytes of int64.
ALIGNMENTS = pa.schema([("n_a", "i8"), ("n_b", "i8"), ("n_groups", "i8"), ("bad", "bool"), ("text", pa.large_binary()), ("links", pa.large_binary())])


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def spread(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a binary column."""
    edges = np.frombuffer(column.buffers()[1], "i8")[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, "i8")
    return edges, memoryview(column.buffers()[2] or b"")


def binary(edges: np.ndarray, data) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, "i8")), pa.py_buffer(data)])


def stacked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([p.column(k) for p in parts]) for k in range(len(ALIGNMENTS))], schema=ALIGNMENTS)


NO_ALIGNMENTS = pa.RecordBatch.from_pylist([], schema=ALIGNMENTS)


class Aligner:
    def __init__(self, byte_file: str, piece_file: str):
        self.a, self.b = ByteLevel(byte_file), Pieces(piece_file)
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.spelled = [pa.array(side.bytes, pa.large_binary()) for side in (self.a, self.b)]
        #: Ids as text with what follows them: inside and at the end of a group, of A and then of B.
        self.names = pa.array([f"{i}{c}".encode() for side, cs in ((self.a, ",|"), (self.b, ",;")) for i in range(len(side.bytes)) for c in cs], pa.large_binary())
        #: Rows of units in the tables beside them; the older half.
        self.rows, self.table = {}, NO_ALIGNMENTS
        self.older: tuple[dict[str, int], pa.RecordBatch] = ({}, NO_ALIGNMENTS)

    def _alignments(self, a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> pa.RecordBatch:
        """ALIGNMENTS of the pairs a[cut_a[k]:cut_a[k + 1]] and b likewise."""
        end_a, end_b, links, bad = self.transducer.align_many(a, b, cut_a, cut_b)
        n_a, n_b = np.diff(cut_a), np.diff(cut_b)
        if bad.any():
            held = np.repeat(~bad, n_a), np.repeat(~bad, n_b), np.repeat(~bad, n_a + n_b)
            a, end_a, b, end_b, links = a[held[0]], end_a[held[0]], b[held[1]], end_b[held[1]], links[held[2]]
            n_a, n_b = n_a * ~bad, n_b * ~bad
        after_a, after_b = (np.concatenate([[0], np.flatnonzero(end) + 1]) for end in (end_a, end_b))  # tokens up to each group
        # A group's tokens of A stand behind the tokens of B of the groups before it, those of B behind its own tokens of A.
        names = np.empty(len(a) + len(b), "i8")
        names[np.arange(len(a)) + after_b[np.cumsum(end_a) - end_a]] = 2 * a + end_a
        names[np.arange(len(b)) + after_a[np.cumsum(end_b) - end_b + 1]] = 2 * (b + len(self.a.bytes)) + end_b
        edges, text = spread(self.names.take(pa.array(names)))
        n_groups = np.diff(np.searchsorted(after_a[1:], np.concatenate([[0], np.cumsum(n_a)]), "right"))
        n, n_links = n_a + n_b, n_a + n_b - n_groups
        first = np.cumsum(n) - n
        links = links[np.arange(n.sum()) - np.repeat(first, n) < np.repeat(n_links, n)]
        columns = [n_a, n_b, n_groups, bad, binary(edges[np.append(first, n.sum())], text), binary(np.concatenate([[0], np.cumsum(n_links)]) * 8, links)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], schema=ALIGNMENTS)

    def _encoded(self, texts: list[str]) -> Iterator[tuple[bytes, list[tuple[np.ndarray, np.ndarray]] | None]]:
        """Of each text its bytes and, of both sides, ids and where they end; None if one spells other bytes."""
        for text, *ids in zip(texts, self.a.encode(texts), self.b.encode(texts)):
            spelled, sides = text.encode(), []
            for x, known in zip(ids, self.spelled):
                x = np.array(x, "i8")
                edges, data = spread(known.take(pa.array(x)))
                if edges[-1] != len(spelled) or bytes(data[: len(spelled)]) != spelled:
                    break
                sides.append((x, edges[1:]))
            yield spelled, sides if len(sides) == 2 else None

    def text(self, text: str) -> pa.RecordBatch:
        """A text encoded whole."""
        _, sides = next(self._encoded([f" {text}"]))
        if sides is None:
            return NO_ALIGNMENTS
        (a, _), (b, _) = sides
        found = self._alignments(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
        return NO_ALIGNMENTS if found.column("bad")[0].as_py() else found

    def _units(self, units: list[str], run: int = RUN) -> pa.RecordBatch:
        """Alignments of units (a line break or the blank left out, then no place to part) by runs of them; bad where a unit
        has none by itself."""
        # A run begins with a unit of its own, so that each of the others stands behind one.
        whole = [u if u[:1] == "\n" else f" {u}" for u in units]
        sizes = np.array([len(u.encode()) for u in whole], "i8")
        starts = range(0, len(whole), run)
        ids, cuts, left, n = ([], []), ([], []), np.zeros(len(units), bool), [0, 0]
        for k, (_, sides) in zip(starts, self._encoded([" x" + "".join(whole[k : k + run]) for k in starts])):
            part = slice(k, k + run)
            ends = 2 + np.concatenate([[0], np.cumsum(sizes[part])])
            at = [np.searchsorted(edges, ends) for _, edges in sides or ()]
            if not at or any((edges[cut] != ends).any() for (_, edges), cut in zip(sides, at)):
                left[part] = True
                continue
            for side, ((x, _), cut) in enumerate(zip(sides, at)):
                ids[side].append(x[cut[0] + 1 : cut[-1] + 1])
                cuts[side].append(cut[:-1] - cut[0] + n[side])
                n[side] += cut[-1] - cut[0]
        a, b = (np.concatenate([np.empty(0, "i8"), *x]) for x in ids)
        out = self._alignments(a, b, *(np.concatenate([*x, [all_]]) for x, all_ in zip(cuts, n)))
        if not left.any():
            return out
        again = np.flatnonzero(left)
        if run > 1:
            rest = self._units([units[k] for k in again.tolist()], 1)
        else:
            none = pa.RecordBatch.from_pylist([{"n_a": 0, "n_b": 0, "n_groups": 0, "bad": True, "text": b"", "links": b""}], schema=ALIGNMENTS)
            rest = none.take(pa.array(np.zeros(len(again), "i8")))
        place = np.empty(len(units), "i8")
        place[np.concatenate([np.flatnonzero(~left), again])] = np.arange(len(units))
        return stacked([out, rest]).take(pa.array(place))

    def look_up(self, units: list[str]) -> tuple[pa.RecordBatch, np.ndarray]:
        """Alignments and the rows in them of distinct units, from the store where it has them."""
        if len(self.rows) > UNIT_STORE // 2:
            self.older, self.rows, self.table = (self.rows, self.table), {}, NO_ALIGNMENTS
        known, aged = self.rows.get, self.older[0].get
        found = list(map(known, units))
        lacking = [u for u, r in zip(units, found) if r is None]
        if not lacking:
            return self.table, np.array(found, "i8")
        old = [u for u in lacking if aged(u) is not None]
        new = sorted((u for u in lacking if aged(u) is None), key=lambda u: len(u) > UNIT_CHARS)
        table = stacked([self.table, self.older[1].take(pa.array([aged(u) for u in old], pa.int64())), self._units(new)])
        rows = dict(zip(old + new, range(len(self.table), len(table))))
        found = np.array([rows[u] if r is None else r for u, r in zip(units, found)], "i8")
        # Long units are not kept.
        while new and len(new[-1]) > UNIT_CHARS:
            del rows[new.pop()]
        self.rows.update(rows)
        self.table = table.slice(0, len(self.rows))
        return table, found


@lru_cache(1)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    """One for each Python worker, so that its store and automaton serve all tasks that the worker runs."""
    return Aligner(byte_file, piece_file)


class Rows:
    """The alignments of a batch of texts, filled in by parts."""

    def __init__(self, n: int):
        self.n = np.zeros((3, n), "i8")  # tokens of A, of B, groups
        self.sha = [""] * n
        self.keys: list[np.ndarray] = [np.empty(0, "i8")]  # place of the text
        self.codes: list[np.ndarray] = [np.empty(0, "i8")]  # links

    def one(self, k: int, x: pa.RecordBatch) -> None:
        """A text by its own alignment; without a row it has no tokens."""
        self.n[:, k], self.sha[k] = 0, ""
        if len(x):
            self.n[:, k] = [x.column(c)[0].as_py() for c in range(3)]
            self.sha[k] = hashlib.sha256(x.column("text")[0].as_py()[:-1]).hexdigest()
            self.codes.append(np.frombuffer(x.column("links")[0].as_py(), "i8"))
            self.keys.append(np.full(len(self.codes[-1]), k))

    def many(self, places: np.ndarray, units: pa.ListArray, look_up) -> list[int]:
        """Texts given as lists of units; returns the places of those that have a unit without alignment."""
        words = units.flatten().dictionary_encode()
        found, rows = look_up(words.dictionary.to_pylist())
        index = rows[words.indices.to_numpy()]
        edges = units.offsets.to_numpy() - units.offsets[0].as_py()
        bad = numbers(found.column("bad"))[index]
        left = places[np.add.reduceat(bad, edges[:-1]) > 0].tolist() if bad.any() else []
        for c in range(3):
            self.n[c, places] = np.add.reduceat(numbers(found.column(c))[index], edges[:-1])
        index = pa.array(index)
        at, text = spread(found.column("text").take(index))
        for k, a, z in zip(places.tolist(), at[edges].tolist(), at[edges[1:]].tolist()):
            self.sha[k] = hashlib.sha256(text[a : max(a, z - 1)]).hexdigest()
        at, links = spread(found.column("links").take(index))
        key = np.repeat(places, np.diff(at[edges]) // 8)
        keep = ~np.isin(key, left) if left else slice(None)
        self.codes.append(np.frombuffer(links, "i8", int(at[-1]) // 8)[keep])
        self.keys.append(key[keep])
        return left

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        keys, codes = np.concatenate(self.keys), np.concatenate(self.codes)
        order = np.lexsort((codes, keys)) if len(codes) and int(codes.max()) >= 1 << 40 else np.argsort(keys << 40 | codes)
        keys, codes = keys[order], codes[order]
        new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])])) if len(codes) else np.empty(0, "i8")
        times = np.diff(np.append(new, len(codes)))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys[new], minlength=len(ids)))]).astype("i4"))
        links = np.bincount(keys, minlength=len(ids))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(codes[new])), pa.ListArray.from_arrays(offsets, pa.array(times.astype("i4")))]
        columns = [ids, *(pa.array(x) for x in self.n), pa.array(links.astype("i8")), pa.array(self.sha), *lists]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])


def _aligned(byte_file: str, piece_file: str, rows: int = 1024):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = aligner(byte_file, piece_file)
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                texts = b.column("text").fill_null("")
                out = Rows(len(texts))
                filled = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
                odd = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False) | (not worker.b.by_unit)
                mixed = pc.match_substring_regex(texts, MIXED).to_numpy(zero_copy_only=False) & ~odd
                alone = np.flatnonzero(filled & odd).tolist()
                even = np.flatnonzero(filled & ~odd & ~mixed)
                if len(even):
                    units = pc.split_pattern(pc.replace_substring(texts.take(pa.array(even)), "\n", " \n"), " ")
                    alone += out.many(even, units, worker.look_up)
                if mixed.any():
                    cut = [[u[1:] if u[0] == " " else u for u in _UNIT.split(f" {t}")] for t in texts.filter(pa.array(mixed)).to_pylist()]
                    alone += out.many(np.flatnonzero(mixed), pa.array(cut, pa.list_(pa.string())), worker.look_up)
                for j in alone:
                    out.one(j, worker.text(texts[j].as_py()))
                yield out.batch(b.column("doc_id"))
        release()

    return run


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")


def aligned(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text") -> DataFrame:
    """ALIGNED of each row of docs; pairs are the distinct links as numbers a * pair_base + b, times how often each occurs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_batches(rows, _aligned(byte_file, piece_file), ALIGNED)


def pair_base(piece_file: str) -> int:
    """Ids of side B, by which pairs are numbered."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_file).get_piece_size()


def pair_counts(rows: DataFrame, base: int) -> DataFrame:
    """(pair, n, best) of rows of ``aligned``: documents that hold the pair linked, and whether no pair of its A id has more.
    The best counts are one row for each id of side A at most, so they may be broadcast."""
    counts = written(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    best = counts.groupBy(F.expr(f"pair div {base}").alias("a")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(best), F.expr(f"pair div {base}") == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """COLUMNS of rows, with n_best and count_sum. rows must read the same each time: a written table with a column row."""
    classed = written(counts.withColumn("class", F.floor(F.log2(F.col("n").cast("double")) * 16)), "pair-classes")
    taken, least = 0, None
    classes = classed.groupBy("class").agg(F.count("*").alias("rows")).collect()  # some hundreds
    for r in sorted(classes, key=lambda r: -r["class"]):
        if taken + r["rows"] > heavy:
            break
        taken, least = taken + r["rows"], r["class"]
    sums = (F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    frequent = F.broadcast(classed.where(F.lit(False) if least is None else F.col("class") >= least).select("pair", "n", "best"))
    found = links.join(frequent, "pair").groupBy("row").agg(*sums)
    if taken < sum(r["rows"] for r in classes):
        rest = links.join(frequent.select("pair"), "pair", "left_anti")
        rare = rest.join(classed.where(F.lit(True) if least is None else F.col("class") < least).select("pair", "n", "best"), "pair").groupBy("row").agg(*sums)
        found = found.unionByName(rare).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.select("row", *COLUMNS).join(found, "row", "left")
    filled = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select(*COLUMNS[:5], *filled, "groups_sha256")


def align(docs: DataFrame, byte_file: str, piece_file: str, text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs."""
    rows = written(aligned(docs, byte_file, piece_file, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    return scored(rows, pair_counts(rows, pair_base(piece_file)), heavy)
