"""Token-id output: Parquet list columns in ascending document order, for selective reads of tokens and of metadata.

``write_tokens`` deals documents by range of doc_id, encodes each whole text where it lands, and lets Spark's Parquet
writer store one row for each document:

    tokens/  part, doc_id, local_start, n_tokens, tokens      (ids as list<int>, the end id included)
    parts/   part, base, n_tokens, n_docs                     (one row for each range; base = ids before it)

The ids are dictionary encoded (16 bits or fewer an id for usual vocabularies), the counters delta encoded; row groups
and pages are bounded and carry page indexes, so a read of a doc_id range skips other pages and a read of the counters
never touches the ids. A document starts at base + local_start.

Defined results: a null or empty text is one row that holds the end id only; repeated doc_ids are stored each on its own,
in order of the first ``TEXT_KEY`` characters of their texts; a null doc_id comes first; an empty table gives empty tables; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxsift.llm.common import map_batches
from boxsift.llm.shingles import release

ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 1000
#: Characters of a text that put rows of one doc_id in order.
TEXT_KEY = 64
#: Words a worker keeps the ids of: a new half, and the half before it, whose words move over as they are met.
WORD_STORE = 800_000
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, tokens array<int>"
PARTS = "part int, base long, n_tokens long, n_docs long"


class Encoder:
    """ids of whole texts, with the end id appended.

    by_word is for vocabularies that drop white space: no token spans it, so the ids of a text are those of its words
    in turn, and a word is encoded once. A last full stop or comma after a letter is a token of its own there.
    """

    def __init__(self, path: str, end_id: int, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.by_word = end_id, by_word
        self.store: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab() if by_word else {}
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[bytes], run: int = 500) -> list[bytes]:
        """ids of each word. Words of letters end in one token that marks a word's end, so a run of them is encoded at once."""
        texts = [w.decode() for w in words]
        out: dict[int, bytes] = {}
        plain = [k for k, t in enumerate(texts) if t.isalpha()]
        runs = [plain[a : a + run] for a in range(0, len(plain), run)]
        for places, raw in zip(runs, self._ids([" ".join([texts[k] for k in places]) for places in runs])):
            ends = np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1
            if len(ends) == len(places):
                out.update({k: raw[4 * a : 4 * b] for k, a, b in zip(places, [0, *ends[:-1].tolist()], ends.tolist())})
        rest = [k for k in range(len(words)) if k not in out]
        out.update(zip(rest, self._ids([texts[k] for k in rest])))
        return [out[k] for k in range(len(words))]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in one stretch, the end ids included, and the number of ids of each text; null is empty."""
        texts = texts.fill_null("")
        if not self.by_word:
            ids = self._ids(texts.to_pylist())
            raw, n = np.frombuffer(b"".join(ids), "<i4"), np.array([len(x) // 4 for x in ids], "i8")
        else:
            raw, n = self._by_word(texts)
        out = np.full(len(raw) + len(n), self.end, "<i4")
        out[np.arange(len(raw)) + np.repeat(np.arange(len(n)), n)] = raw
        return out, n + 1

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words are looked up once for all texts, and the ids of a text gathered from them."""
        # ASCII letters in lower case; the strings of special tokens stay as they are.
        lower = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
        split = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids = self._look_up(words.dictionary.cast(pa.binary()).to_pylist())
        size = np.array([len(x) // 4 for x in ids], "i8")
        values, first = np.frombuffer(b"".join(ids), "<i4"), np.cumsum(size) - size
        place = words.indices.to_numpy()
        n = size[place]
        source = np.repeat(first[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        edges = np.concatenate([[0], np.cumsum(n)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return values[source], np.diff(edges)

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        """ids of distinct words, from the store where it has them."""
        if len(self.store) > WORD_STORE // 2:
            self.store, self.older = {}, self.store
        store = self.store
        new = [w for w in words if w not in store]
        store.update({w: ids for w in new if (ids := self.older.get(w)) is not None})
        new = [w for w in new if w not in store]
        cut = {w: w[:-1] for w in new if w[-1:] in (b".", b",") and w[-2:-1].isalpha()}
        whole = [*{*(w for w in new if w not in cut), *(w for w in cut.values() if w not in store), b".", b","}]
        store.update(zip(whole, self._ids_of_words(whole)))
        store.update({w: store[stem] + store[w[-1:]] for w, stem in cut.items()})
        return [store[w] for w in words]


@lru_cache(1)
def encoder(path: str, end_id: int, by_word: bool) -> Encoder:
    """One for each Python worker, so that its store serves all tasks that the worker runs."""
    return Encoder(path, end_id, by_word)


def _encoded(path: str, end_id: int, by_word: bool, rows: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = encoder(path, end_id, by_word), TaskContext.get().partitionId(), 0
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                values, n = encode(b.column("text"))
                offsets = np.concatenate([[0], np.cumsum(n)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
                columns = [pa.array(np.full(len(n), part, "i4")), b.column("doc_id"), pa.array(at + offsets[:-1]), pa.array(n), lists]
                yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "local_start", "n_tokens", "tokens"])
                at += int(offsets[-1])
        release()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    text: str = "text",
    by_word: bool = False,
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Encode docs (doc_id, text) and write them under path in ascending doc_id order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    # The start of the text and a running number split the rows of an id that very many rows share.
    dealt = rows.repartitionByRange("doc_id", F.substring("text", 1, TEXT_KEY), F.monotonically_increasing_id()).sortWithinPartitions("doc_id", "text")
    encoded = map_batches(dealt, _encoded(tokenizer, end_id, by_word), SCHEMA)
    writer = encoded.write.option("compression", "zstd").option("parquet.writer.version", "v2")
    writer = writer.option("parquet.block.size", row_group_bytes).option("parquet.page.row.count.limit", page_rows)
    for c in ("part", "doc_id", "local_start", "n_tokens"):
        writer = writer.option(f"parquet.enable.dictionary#{c}", "false")
    writer.parquet(f"{path}/tokens")
    spark = docs.sparkSession
    parts = read_counters(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each range
    parts = parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"), "n_tokens", "n_docs")
    parts.coalesce(1).write.parquet(f"{path}/parts")


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, local_start, n_tokens), without reading an id."""
    return spark.read.schema(SCHEMA).parquet(f"{path}/tokens").drop("tokens")


def read_tokens(spark: SparkSession, path: str, first_doc: int | None = None, last_doc: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens), of the doc_ids from first_doc to last_doc; the bounds reach the page indexes."""
    rows = spark.read.schema(SCHEMA).parquet(f"{path}/tokens")
    rows = rows.where(F.col("doc_id") >= first_doc) if first_doc is not None else rows
    rows = rows.where(F.col("doc_id") <= last_doc) if last_doc is not None else rows
    parts = spark.read.schema(PARTS).parquet(f"{path}/parts").select("part", "base")
    return rows.join(parts, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("tokens")
        ids, offsets = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4"), lists.offsets.to_numpy()
        raw = memoryview(ids).cast("B")
        crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens returns."""
    return map_batches(tokens, _crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
