"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent.

A text is lower-cased, every stretch without letters becomes one gap, and the letter groups of two to four characters
(gaps included, so they mark word ends) are hashed into buckets. A bucket has an embedding; the mean embedding of all
groups of the whole text goes through a linear softmax. Training runs in numpy on the driver, on at most
``SAMPLE_PER_LANGUAGE`` labelled texts of each language, chosen by hash so that reruns agree. All languages are learned:
with so many that ``SAMPLE`` texts or, all together, ``SAMPLE_CHARS`` characters would be passed, each one's share is smaller,
one text at least.

A fifth of the sample is not trained on: it sets the softmax temperature (least log loss) and the rejection bound, the
score that all but ``REJECTED_SHARE`` of its right predictions reach. A prediction below the bound is marked rejected.

To predict, embedding and softmax matrices are multiplied once, so a text's logits are the mean of its buckets' logits:
the same numbers, a few floats a group. Texts are scored whole, where they are read: one Arrow pass, no shuffle.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; with no labelled text at all,
everything is ``und``; equal texts are predicted alike; rows with a null language are not trained on; an empty table
gives no rows; the columns named in ``keep`` pass through, unless an output takes their name, and no other column is read
for a prediction; rows with the same key and language count once in the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxsift.llm.common import free_name, map_batches, written

SAMPLE_PER_LANGUAGE, SAMPLE, SAMPLE_CHARS = 600, 60_000, 64_000_000
BUCKETS = 1 << 16
DIMENSIONS = 16
EPOCHS, RATE, BATCH = 30, 20.0, 32
#: Few texts are gone over more often, up to so many steps.
LEAST_STEPS = 1500
REJECTED_SHARE = 0.01
UNKNOWN = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every letter group of the texts, and for each group the place of its text. Vectorised over all texts."""
    # A text of its own gap on either side; texts without a letter have no group.
    points = [np.frombuffer(("\n" + (t or "").lower() + "\n").encode("utf-32-le", "replace"), "<u4") for t in texts]
    flat = np.concatenate(points) if points else np.empty(0, "<u4")
    owner = np.repeat(np.arange(len(points)), [len(p) for p in points])
    letter = is_letter[flat]
    flat = np.where(letter, flat, 0)
    keep = letter.copy()
    keep[1:] |= ~letter[1:] & letter[:-1]  # the first of each gap
    keep[:1] = True
    keep[1:] |= owner[1:] != owner[:-1]
    flat, owner, letter = flat[keep].astype("u4"), owner[keep].astype("i4"), letter[keep]
    ids, owners = [], []
    for n in (2, 3, 4):
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h, some = np.full(m, 2166136261 + n, "u4"), np.zeros(m, bool)
        for k in range(n):
            h = (h ^ flat[k : k + m]) * np.uint32(16777619)
            some |= letter[k : k + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        h ^= h >> np.uint32(13)
        ok = some & (owner[:m] == owner[n - 1 :])
        ids.append((h[ok] % np.uint32(BUCKETS)).astype("i4"))
        owners.append(owner[:m][ok])
    return (np.concatenate(ids), np.concatenate(owners)) if ids else (np.empty(0, "i4"), np.empty(0, "i4"))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0

    def logits(self, texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logits of each text, and whether it has a letter."""
        ids, owner = subwords(texts, is_letter)
        count = np.bincount(owner, minlength=len(texts))
        sums = np.stack([np.bincount(owner, self.table[ids, k], len(texts)) for k in range(len(self.languages))], 1)
        return sums / np.maximum(count, 1)[:, None] + self.bias, count > 0

    def predict(self, texts: list[str | None], is_letter: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated score and rejection of each text."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        z, known = self.logits(texts, is_letter)
        p = softmax(z / self.temperature)
        best, score = p.argmax(1), np.where(known, p.max(1), 0.0)
        return [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)], score, (score < self.least_score) | ~known


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 3) -> LanguageModel:
    """Train on texts and labels, all of them in memory; see the module for how many there can be."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng, is_letter = np.random.default_rng(seed), letter_table()
    y = np.array([languages.index(x) for x in labels])
    # Each text as distinct buckets and their shares of its groups; some texts at a time, to keep the driver small.
    bags = []
    for k in range(0, len(texts), 100):
        part = texts[k : k + 100]
        ids, owner = subwords(part, is_letter)
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(len(part) + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            u, c = np.unique(ids[order[a:b]], return_counts=True)
            bags.append((u, (c / max(1, b - a)).astype("f4")))
    used = np.array([len(u) > 0 for u, _ in bags])
    shuffled = rng.permutation(np.flatnonzero(used))
    n_held = len(shuffled) // 5
    held, train = shuffled[:n_held], shuffled[n_held:]
    share = np.bincount(y[train], minlength=len(languages)).astype("f4")
    weight = (share.sum() / np.maximum(share, 1) / len(languages)).clip(0, 20)
    E = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype("f4")
    W, bias = np.zeros((DIMENSIONS, len(languages)), "f4"), np.zeros(len(languages), "f4")
    epochs = max(EPOCHS, LEAST_STEPS * BATCH // max(len(train), 1)) if len(train) else 0
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(train), BATCH):
            rows = train[at : at + BATCH]
            x = np.stack([bags[r][1] @ E[bags[r][0]] for r in rows])
            g = softmax(x @ W + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g *= weight[y[rows], None] / len(rows)
            back = g @ W.T
            W -= 0.05 * rate * (x.T @ g)
            bias -= 0.005 * rate * g.sum(0)
            for r, d in zip(rows, back):
                E[bags[r][0]] -= rate * bags[r][1][:, None] * d
    model = LanguageModel(languages, E @ W, bias)
    if n_held:
        z = np.concatenate([model.logits([texts[k] for k in held[a : a + 100]], is_letter)[0] for a in range(0, n_held, 100)])
        model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: -np.log(softmax(z / t)[np.arange(n_held), y[held]] + 1e-12).mean())
        p = softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == y[held]]
        model.least_score = float(np.quantile(right, REJECTED_SHARE)) if len(right) else 0.0
    return model


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on a bounded sample of labelled: per_language rows of each language at most, those whose keys hash lowest.

    Languages are counted, and the share of a language's rows that is wanted gives a bound on the hash, so that only few
    rows more than wanted are ranked, within their own language, and only the chosen rows' texts are sent to the driver.
    """
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).alias("l"), F.xxhash64(F.lit("lid"), F.col(key).cast("string")).alias("h"), F.col(text).alias("t"))
    counts = written(rows.groupBy("l").agg(F.count("*").alias("n")), "languages")
    wanted = max(1, min(per_language, SAMPLE // max(1, counts.count())))
    share = counts.select("l", (F.lit(1.25 * wanted) / F.col("n")).alias("share"))  # a row for each language
    near = rows.join(share, "l").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("share"))
    once = near.groupBy("l", "h").agg(F.min("t").alias("t"))
    in_turn = Window.partitionBy("l").orderBy("h")
    chars = F.sum(F.length(F.coalesce("t", F.lit("")))).over(in_turn)
    fits = (F.col("place") == 1) | ((F.col("place") <= wanted) & (F.col("chars") <= SAMPLE_CHARS // max(1, counts.count())))
    chosen = once.withColumns({"place": F.row_number().over(in_turn), "chars": chars}).where(fits).orderBy("l", "h").select("l", "t").collect()
    return fit([r["t"] or "" for r in chosen], [r["l"] for r in chosen])


def _predicted(model: LanguageModel, keep: list[str], text: str, rows: int = 128):
    model = LanguageModel(model.languages, model.table.astype("f4"), model.bias, model.temperature, model.least_score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letter_table()
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                language, score, rejected = model.predict(b.column(text).to_pylist(), is_letter)
                columns = [*(b.column(c) for c in keep), pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score", "rejected"])

    return run


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, lang_pred, score and rejected of each row."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    own = free_name(keep, "text_")
    rows = df.select(*keep, F.col(text).alias(own))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_batches(rows, _predicted(model, keep, own), f"{kinds}lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The fold that the registered query never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
