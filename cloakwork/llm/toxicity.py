"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct lower-case words and their beginnings of four to
six letters, hashed into buckets.  Buckets that toxic documents of the sample
hold clearly more or less often (chi-square), and buckets of pairs that tell
more together than each alone, are the machine's features.  Besides a
weight each feature has a short vector; the dot product of two vectors is the
weight of the pair, so that an insult beside a mention of a group counts more
than the two alone.  Trained in numpy with Adam on a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import Recent
from .common import bounded_sample, crc_bucket, fresh, lean, sub_batches, text_view

#: Labelled documents of each class that training takes at most, those with the smallest hashes of their ids.
SAMPLE_PER_CLASS = 4000
BUCKETS = 1 << 20
FEATURES = 8192
FACTORS = 8
#: Chi-square that a feature reaches at least, over samples of any size, and that the interaction of a pair does.
LEAST_CHI2 = 15.0
LEAST_PAIR_CHI2 = 40.0
#: Most frequent buckets of which pairs are looked at, and rows that each of a pair's four cells holds at least.
PAIR_TERMS = 1024
PAIR_ROWS = 8
EPOCHS = 12
#: Words whose features a task keeps, twice; some 450 bytes each.
KEPT_WORDS = 50_000
_TRIM = b".,;:!?\"'()[]{}<>*#$%&|-_=+~/\\"
_STEMS = (4, 5, 6)


@dataclass
class Model:
    """Weights of the chosen buckets; ``buckets`` is sorted."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logit(self, features: list[int]) -> float:
        if not features:
            return self.bias
        v = self.vectors[features]
        s = v.sum(axis=0)
        return self.bias + float(self.weights[features].sum()) + 0.5 * float(s @ s - (v * v).sum())


def word_buckets(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Hash buckets of a lower-case word and of its beginnings."""
    word = word.strip(_TRIM)
    if not word:
        return []
    text = word.decode("utf-8", errors="ignore")
    return [zlib.crc32(word) % buckets] + [zlib.crc32(b"^" + text[:n].encode()) % buckets for n in _STEMS if len(text) >= n]


def text_terms(text: str | None) -> list[int]:
    words = set((text or "").lower().encode().split())
    return sorted({b for w in words for b in word_buckets(w)})


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> list[tuple[np.ndarray, int]]:
    """Term buckets and label of a bounded sample, both classes alike; one row of each id; null labels are left out."""
    thin = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = bounded_sample(thin, "doc_id", per_class, "toxic")
    found = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # 2 x per_class ids at most
    rows = found.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("nth = 1")  # of rows with one id, one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole):
                terms = [np.array(text_terms(t), np.int32) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "toxic": batch.column("toxic"), "terms": pa.array(terms, pa.list_(pa.int32()))})

    table = rows.select("doc_id", "toxic", "text").mapInArrow(lean(run), "doc_id long, toxic int, terms array<int>").toArrow().sort_by("doc_id")
    offsets = [c.offsets.to_numpy() for c in table.column("terms").chunks]
    flat = [c.values.to_numpy() for c in table.column("terms").chunks]
    lists = [f[i:j] for f, o in zip(flat, offsets, strict=True) for i, j in zip(o, o[1:], strict=False)]
    return list(zip(lists, table.column("toxic").to_pylist(), strict=True))


def paired(sample: list[tuple[np.ndarray, int]], seen: np.ndarray) -> np.ndarray:
    """Evidence of each bucket's best pair: how far the share of toxic rows with both is from what each alone adds, as a chi-square."""
    often = np.argsort(-seen, kind="stable")[:PAIR_TERMS]
    often = often[(seen[often] >= 2 * PAIR_ROWS) & (seen[often] < len(sample))]
    place = np.full(len(seen), -1)
    place[often] = np.arange(len(often))
    held = np.zeros((len(sample), len(often)), np.float32)
    for row, (terms, _) in zip(held, sample, strict=True):
        row[(p := place[terms])[p >= 0]] = 1
    y = np.array([label for _, label in sample], np.float32)
    gain, spread, there = 0.0, 0.0, True
    for rows, toxic, sign in zip(_cells(held, None), _cells(held, y), (1, -1, -1, 1), strict=True):
        share = (toxic + 0.5) / (rows + 1)
        gain, spread, there = gain + sign * share, spread + share * (1 - share) / (rows + 1), there & (rows >= PAIR_ROWS)
    out = np.zeros(len(seen))
    if len(often):
        out[often] = np.where(there, gain * gain / spread, 0.0).max(axis=1)
    return out


def _cells(held: np.ndarray, y: np.ndarray | None) -> list[np.ndarray]:
    """For each pair of columns, rows with both, the first, the second and neither; of rows where ``y`` is 1 if given."""
    part = held if y is None else held[y > 0]
    both, one = part.T @ part, part.sum(axis=0)
    return [both, one[:, None] - both, one[None, :] - both, len(part) - one[:, None] - one[None, :] + both]


def train(sample: list[tuple[np.ndarray, int]], *, buckets: int = BUCKETS, features: int = FEATURES, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit the machine; without rows of both classes it knows the share of toxic rows alone."""
    y = np.array([label for _, label in sample], np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    empty = Model(np.zeros(0, np.int64), float(np.log((n1 + 0.5) / (n0 + 0.5))), np.zeros(0), np.zeros((0, factors)))
    if not n1 or not n0:
        return empty
    c1, c0 = np.zeros(buckets), np.zeros(buckets)
    for terms, label in sample:
        (c1 if label else c0)[terms] += 1
    seen = c1 + c0
    n = n1 + n0
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (c1 * (n0 - c0) - c0 * (n1 - c1)) ** 2 / (seen * (n - seen) * n1 * n0)
    chi2 = np.where((seen > 0) & (seen < n), np.nan_to_num(chi2), 0.0)
    worth = np.maximum(chi2 / LEAST_CHI2, paired(sample, seen) / LEAST_PAIR_CHI2)
    chosen = np.sort(np.argsort(-worth, kind="stable")[:features])
    chosen = chosen[worth[chosen] >= 1]
    if not len(chosen):
        return empty
    place = np.full(buckets, -1)
    place[chosen] = np.arange(len(chosen))
    rows = [(p := place[terms])[p >= 0] for terms, _ in sample]
    rng = np.random.default_rng(seed)
    k = len(chosen)
    params = [np.zeros(1), np.zeros(k), rng.normal(0, 0.02, (k, factors))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, rate, decay = 0, 0.05, (0.0, 1e-4, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 256):
            part = order[at : at + 256]
            sizes = np.array([len(rows[i]) for i in part])
            owner = np.repeat(np.arange(len(part)), sizes)
            idx = np.concatenate([rows[i] for i in part]).astype(np.int64)
            b, w, v = params
            lin = np.bincount(owner, w[idx], len(part))
            s, q = np.zeros((len(part), factors)), np.zeros(len(part))
            np.add.at(s, owner, v[idx])
            np.add.at(q, owner, (v[idx] ** 2).sum(axis=1))
            logit = np.clip(b[0] + lin + 0.5 * ((s * s).sum(axis=1) - q), -30, 30)
            g = (1 / (1 + np.exp(-logit)) - y[part]) / len(part)
            gw = np.bincount(idx, g[owner], k)
            gv = np.zeros_like(v)
            np.add.at(gv, idx, g[owner, None] * (s[owner] - v[idx]))
            step += 1
            for p, grad, m1, m2, l2 in zip(params, (np.array([g.sum()]), gw, gv), first, second, decay, strict=True):
                grad = grad + l2 * p
                m1 += 0.1 * (grad - m1)
                m2 += 0.001 * (grad * grad - m2)
                p -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Model(chosen.astype(np.int64), float(params[0][0]), params[1], params[2])


def score_column(docs: DataFrame, model: Model, text_col: str = "text"):
    """A column with the score (0 to 1) of every whole text; empty and null texts have the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows at most

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from lean(scored)(batches)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        place = {int(b): i for i, b in enumerate(model.buckets)}
        recent = Recent(KEPT_WORDS)
        for texts in batches:
            logits = []
            for at in range(0, len(texts), 500):
                words = [set((t or "").lower().encode().split()) for t in texts[at : at + 500]]
                known, new = recent.part(set().union(*words))
                made = {w: tuple(place[b] for b in word_buckets(w) if b in place) for w in new}
                recent.add(made)
                known.update(made)
                logits += [model.logit(sorted({f for x in map(known.__getitem__, w) if x for f in x})) for w in words]
            yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(logits, np.float64), -30, 30))))

    return score(F.col(text_col).cast("string"))


def fit(docs: DataFrame, labels: DataFrame, *, hold_out: int = 5, per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Learn from labelled rows whose crc32 of the id, modulo ``hold_out``, is not 0."""
    learnable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(crc_bucket("doc_id", hold_out) != 0)
    return train(labelled_sample(text_view(docs), learnable, per_class))


def toxicity(docs: DataFrame, labels: DataFrame, *, hold_out: int = 5, threshold: float = 0.5, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """Score every row; learn from labelled rows whose crc32 of the id, modulo ``hold_out``, is not 0.

    Returns doc_id, held_out, score and predicted.  Null and empty texts are
    scored without features; a null id is scored and not held out; repeated
    rows score alike; with empty labels every score is 0.5; an empty table
    gives no rows; other columns are ignored.
    """
    model = fit(docs, labels, hold_out=hold_out, per_class=per_class)
    scored = text_view(docs).select("doc_id", score_column(docs, model).alias("score"))
    return scored.select("doc_id", F.coalesce(crc_bucket("doc_id", hold_out) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, hold_out: int = 5, keep_unlearned: bool = False) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``; no row moves.

    Where nothing was learned (no rows of both classes, or no telling term) every
    score is the share of toxic labels, 0.5 without any, so that all rows may
    go; with ``keep_unlearned`` such a model removes nothing.
    """
    model = fit(docs, labels, hold_out=hold_out)
    if keep_unlearned and not len(model.buckets):
        return docs
    score = fresh(docs, "score")
    return docs.withColumn(score, score_column(docs, model)).where(F.col(score) < threshold).drop(score)
