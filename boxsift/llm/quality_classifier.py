"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

The text view knows the words and byte trigrams of a text, hashed (log counts, unit length); the metadata view knows what
the table says of a page beside its text: source, language and length, alone and in pairs. Both are naive Bayes, so a view
is a sum over documents and all documents can teach it. In each round one pass over the whole table scores every document
that is not in the labelled sample with both views; the documents that one view is most sure of, the ``CONFIDENT_SHARE`` of
either end as the held labelled texts lie and all at ``CONFIDENT`` beyond, go with that label into the other view's sums, in
the tasks, so each view teaches the other however weak it is. A view is then fitted anew, its labelled and its passed-on documents with
half of the say each. In the end each view is calibrated by a logistic fit on labelled texts that it did not train on, and
a third logistic fit on the same texts combines the two calibrated views into one score.

Labels are taken from at most ``LABELLED`` documents, chosen by hash, half of either class; the rest of the table serves
without its labels, all of it. Tasks send sums of fixed size, and three numbers for each document of the sample.
Every document is scored whole, where it is read, in one Arrow pass without a shuffle.

Defined results: a null or empty text, or one without a word, scores 0 and is not kept, and teaches nothing; labels of
documents that are not there, and null labels, are ignored; a document with two labels is used with each; of rows that
share a doc_id in the sample the one with the smallest text teaches; without labels of both classes every text with words
scores 0.5; equal rows score alike; null metadata is a value of its own; a table without n_chars counts as one of nulls
there; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxsift.llm.common import map_batches, written
from boxsift.llm.shingles import text_chunks, word_hashes
from boxsift.llm.sums import summed

LABELLED = 6000
#: A view passes on what it is sure of to this degree, and this share of either class however sure it is.
ROUNDS, CONFIDENT, CONFIDENT_SHARE = 2, 0.9, 0.1
WORD_DIMS = TRIGRAM_DIMS = 1 << 13
TEXT_DIMS, META_DIMS = WORD_DIMS + TRIGRAM_DIMS, 1 << 12
#: What each dimension's sum is raised by, as naive Bayes needs.
TEXT_FLOOR, META_FLOOR = 0.01, 0.5
#: Only what is bad with nine chances in ten is dropped.
THRESHOLD = 0.1
META = ("source", "lang", "n_chars")


def text_features(raw: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(dimensions, values) of each text, and its number of words."""
    h, owner = word_hashes(raw)
    words = np.bincount(owner, minlength=len(raw))
    word_dims = (h >> np.uint64(51)).astype("i8")
    data = np.frombuffer(b"".join(raw), "u1").astype("u4")
    ends = np.cumsum([len(r) for r in raw])
    t = (data[:-2] * np.uint32(0x9E3779B1) ^ data[1:-1] * np.uint32(0x85EBCA77) ^ data[2:] * np.uint32(0xC2B2AE3D)) if len(data) > 2 else np.empty(0, "u4")
    tri_dims = ((t * np.uint32(0x27D4EB2F)) >> np.uint32(19)).astype("i8")
    at = np.searchsorted(owner, np.arange(len(raw) + 1))
    out = []
    for k, r in enumerate(raw):
        a = ends[k] - len(r)
        counts = np.concatenate(
            [np.bincount(word_dims[at[k] : at[k + 1]], minlength=WORD_DIMS), np.bincount(tri_dims[a : max(a, ends[k] - 2)], minlength=TRIGRAM_DIMS)]
        )
        dims = np.flatnonzero(counts)
        values = np.log1p(counts[dims])
        out.append((dims, (values / max(np.linalg.norm(values), 1e-9)).astype("f4")))
    return out, words


def meta_features(b: pa.RecordBatch) -> np.ndarray:
    """Dimensions of each row's metadata: source, language, length in half doublings, and the pairs of language with both."""
    out = []
    for s, g, n in zip(*(b.column(c).to_pylist() for c in META)):
        size = None if n is None or n < 0 else int(2 * np.log2(n + 1))
        out.append([zlib.crc32(x.encode()) % META_DIMS for x in (f"s={s}", f"l={g}", f"n={size}", f"l={g},s={s}", f"l={g},n={size}")])
    return np.array(out, "i8").reshape(-1, 5)


def _logistic(x, y: np.ndarray, dims: int, rounds: int = 300, rate: float = 0.5, l2: float = 1e-5) -> np.ndarray:
    """Weights, the bias last, by full-batch gradient steps with momentum scaling (Adam); both classes weigh alike."""
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for k in range(1, rounds + 1):
        g = weight * (sigmoid(_dot(x, w)) - y)
        grad = _dot_t(x, g, dims) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8) * (0.1 + 0.9 * (1 - k / rounds))
    return w


@dataclass
class Sparse:
    """Rows of features in one stretch."""

    dims: np.ndarray
    values: np.ndarray
    row: np.ndarray
    n: int

    @staticmethod
    def of(rows: list[tuple[np.ndarray, np.ndarray]]) -> Sparse:
        none = (np.empty(0, "i4"), np.empty(0, "f4"))
        dims, values = zip(*(rows or [none]))
        return Sparse(np.concatenate(dims), np.concatenate(values), np.repeat(np.arange(len(rows), dtype="i4"), [len(d) for d, _ in rows]), len(rows))


def _dot(x, w: np.ndarray) -> np.ndarray:
    if isinstance(x, Sparse):
        return np.bincount(x.row, x.values * w[x.dims], x.n) + w[-1]
    return x @ w[:-1] + w[-1]


def _dot_t(x, g: np.ndarray, dims: int) -> np.ndarray:
    inner = np.bincount(x.dims, x.values * g[x.row], dims) if isinstance(x, Sparse) else x.T @ g
    return np.append(inner, g.sum())


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _view(labelled: np.ndarray, passed: np.ndarray, floor: float) -> np.ndarray:
    """Log odds of each dimension, of two rows of sums: of bad and of good documents."""

    def share(sums: np.ndarray) -> np.ndarray:
        return (sums + floor) / (sums.sum() + floor * len(sums))

    both = [(share(a) + share(p)) / 2 if p.any() else share(a) for a, p in zip(labelled, passed)]
    return np.log(both[1]) - np.log(both[0])


@dataclass
class QualityModel:
    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))  # slope and intercept of the calibration
    meta_scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))
    sure: np.ndarray = field(default_factory=lambda: np.array([[-np.inf, np.inf]] * 2))  # of each view, logits at and beyond which it passes labels on
    join: np.ndarray = field(default_factory=lambda: np.zeros(3))  # weights of the two calibrated logits, and a bias
    passed: list[dict[str, int]] = field(default_factory=list)  # of each round: documents that a view passed to the other

    def views(self, rows: list[tuple[np.ndarray, np.ndarray]], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = Sparse.of(rows)
        return np.bincount(x.row, x.values * self.text[x.dims], x.n), self.meta[meta].sum(1)

    def calibrated(self, rows: list[tuple[np.ndarray, np.ndarray]], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.views(rows, meta)
        return self.text_scale[0] * a + self.text_scale[1], self.meta_scale[0] * b + self.meta_scale[1]

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated scores of the text view and of the metadata view, and the combined one."""
        a, b = self.calibrated(rows, meta)
        return sigmoid(a), sigmoid(b), sigmoid(np.stack([a, b], 1).clip(-12, 12) @ self.join[:2] + self.join[2])


#: Sums of a pass: of either class the text's and the metadata's dimensions, then the documents that make them up.
_SIZES = (2 * TEXT_DIMS, 2 * META_DIMS, 2, 2)


def _add(total: np.ndarray, rows: list, meta: np.ndarray, of_text: np.ndarray, of_meta: np.ndarray) -> None:
    """Adds documents to the sums of the view that of_text and of_meta name a class for: 0, 1, or -1 for none."""
    text, page, n_text, n_meta = np.split(total, np.cumsum(_SIZES)[:-1])
    x = Sparse.of(rows)
    for c in (0, 1):
        text[c * TEXT_DIMS : (c + 1) * TEXT_DIMS] += np.bincount(x.dims, x.values * (of_text == c)[x.row], TEXT_DIMS)
        page[c * META_DIMS : (c + 1) * META_DIMS] += np.bincount(meta[of_meta == c].reshape(-1), minlength=META_DIMS)
        n_text[c] += (of_text == c).sum()
        n_meta[c] += (of_meta == c).sum()


def _labelled_sums(chunks: Iterator[tuple[pa.RecordBatch, list[bytes]]]) -> np.ndarray:
    total = np.zeros(sum(_SIZES))
    for b, raw in chunks:
        rows, words = text_features(raw)
        label = np.where(words > 0, b.column("quality").to_numpy(), -1)
        _add(total, rows, meta_features(b), label, label)
    return total


def _passed_sums(model: QualityModel, known: np.ndarray):
    """known: sorted ids of the labelled sample."""

    def run(chunks: Iterator[tuple[pa.RecordBatch, list[bytes]]]) -> np.ndarray:
        total = np.zeros(sum(_SIZES))
        for b, raw in chunks:
            rows, words = text_features(raw)
            meta = meta_features(b)
            ids = b.column("doc_id")
            free = (words > 0) & (ids.is_null().to_numpy(zero_copy_only=False) | ~np.isin(ids.fill_null(0).to_numpy(), known))
            sure = [np.where(free & (z >= high), 1, np.where(free & (z <= low), 0, -1)) for z, (low, high) in zip(model.calibrated(rows, meta), model.sure)]
            _add(total, rows, meta, sure[1], sure[0])
        return total

    return run


def _views_of(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in text_chunks(batches):
            rows, words = text_features(raw)
            a, z = model.views(rows, meta_features(b))
            some = pa.array(words > 0)
            yield pa.RecordBatch.from_arrays([b.column("quality"), pa.array(a), pa.array(z)], ["quality", "a", "b"]).filter(some)

    return run


def _calibrate(model: QualityModel, held: DataFrame) -> None:
    got = map_batches(held, _views_of(model), "quality int, a double, b double").orderBy("quality", "a", "b").toPandas()
    y, z = got["quality"].to_numpy("f8"), got[["a", "b"]].to_numpy("f8")
    if len(set(y.tolist())) < 2:
        return
    spread = np.maximum(z.std(0), 1e-9)
    model.text_scale, model.meta_scale = (_logistic(z[:, k : k + 1] / spread[k], y, 1, 300, 0.2, 1e-3) / np.array([spread[k], 1]) for k in (0, 1))
    both = np.stack([s[0] * z[:, k] + s[1] for k, s in enumerate((model.text_scale, model.meta_scale))], 1)
    ends = np.quantile(both, [CONFIDENT_SHARE, 1 - CONFIDENT_SHARE], axis=0).T
    at = np.log(CONFIDENT / (1 - CONFIDENT))
    ends = np.stack([np.maximum(ends[:, 0], -at), np.minimum(ends[:, 1], at)], 1)
    model.sure = np.where(ends[:, :1] < ends[:, 1:], ends, [-np.inf, np.inf])  # a view that says one thing of all passes nothing
    both = both.clip(-12, 12)
    model.join = _logistic(both, y, 2, 300, 0.2, 1e-3)


def _rows_of(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), n.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> QualityModel:
    """Fit on a bounded sample of labels (doc_id, quality) and all of docs (doc_id, text, source, lang, n_chars)."""
    docs = _rows_of(docs)
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality"), F.xxhash64(F.lit("labelled"), "doc_id").alias("h")).distinct()
    halves = [marked.where(F.col("quality") == q).orderBy("h", "doc_id").limit(labelled // 2) for q in (1, 0)]
    chosen = written(halves[0].union(halves[1]).select("doc_id", "quality"), "labelled", labelled)
    sample = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", *META)).alias("r"))
    sample = written(sample.select("doc_id", "quality", "r.*", (F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0).alias("held")), "sample")
    classes = {(r["held"], r["quality"]) for r in sample.select("held", "quality").distinct().collect()}
    if {q for _, q in classes} != {0, 1}:
        return QualityModel(np.zeros(TEXT_DIMS), np.zeros(META_DIMS))
    apart = len(classes) == 4  # else the few labels serve for both
    rows, held = (sample.where("NOT held"), sample.where("held")) if apart else (sample, sample)
    edges = np.cumsum(_SIZES)[:-1]
    views = lambda sums: (sums[: edges[0]].reshape(2, -1), sums[edges[0] : edges[1]].reshape(2, -1))
    text, meta = views(summed(rows, _labelled_sums, "f8", 4))
    model = QualityModel(_view(text, np.zeros_like(text), TEXT_FLOOR), _view(meta, np.zeros_like(meta), META_FLOOR))
    _calibrate(model, held)
    known = np.sort(np.array([r["doc_id"] for r in chosen.select("doc_id").distinct().collect()], "i8"))
    for _ in range(rounds):
        got = summed(docs, _passed_sums(model, known), "f8", 4)
        more_text, more_meta = views(got)
        counts = got[edges[1] :].astype("i8").tolist()
        passed = {"meta_to_text": sum(counts[:2]), "text_to_meta": sum(counts[2:])}
        model = QualityModel(_view(text, more_text, TEXT_FLOOR), _view(meta, more_meta, META_FLOOR), passed=[*model.passed, passed])
        _calibrate(model, held)
    return model


def _scored(model: QualityModel, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, raw in text_chunks(batches):
            rows, words = text_features(raw)
            some = words > 0
            text, page, both = (np.where(some, s, 0.0) for s in model.score(rows, meta_features(b)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, (text, page, both, both >= threshold))], ["doc_id", "text_score", "meta_score", "score", "kept"])

    return run


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_score, meta_score, score, kept) of each row; scores are probabilities of good quality."""
    return map_batches(_rows_of(docs), _scored(model, threshold), "doc_id long, text_score double, meta_score double, score double, kept boolean")
