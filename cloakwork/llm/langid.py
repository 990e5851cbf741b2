"""Language identification by averaged hashed subword embeddings.

Pairs and triples of characters are hashed into buckets; a text's vector is
the mean of its buckets' embeddings, and a linear softmax gives the language.
Both are trained together by stochastic gradient descent in numpy on a bounded
sample.  A temperature, fitted on a part of the sample that training does not
see, calibrates the score; texts under a calibrated score are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, crc_bucket, lean, sub_batches

#: Rows of each language that training takes at most, those with the smallest hashes of their ids.
SAMPLE_ROWS = 1000
BUCKETS = 1 << 15
DIMENSIONS = 16
EPOCHS = 5
#: Steps that training takes at least, over however many rows.
LEAST_STEPS = 300
#: A rare language's rows are taken so often at most, to come up to the most frequent one.
MOST_REPEATS = 50
#: Rows of a language from which on every fifth is kept for calibration.
CALIBRATED_ROWS = 25
#: Accuracy that texts which are not rejected reach on the calibration part.
ACCEPTED_ACCURACY = 0.995
_BLOCK = 1 << 19

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def code_points(text: str) -> np.ndarray:
    """Lower-case letters of a text, everything else as blanks, with a blank before and two behind."""
    raw = np.frombuffer(f" {text.lower()}  ".encode("utf-32-le", errors="replace"), np.uint32)
    return np.where(_letters()[raw], raw, 32).astype(np.uint32)


def subwords(points: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pairs and triples that begin at each character but the last two."""
    a, b, c = points[:-2], points[1:-1], points[2:]
    pair = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))
    triple = (pair * np.uint32(0xC2B2AE3D)) ^ (c * np.uint32(0x27D4EB2F))
    spread = lambda h: ((h ^ (h >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.int32)
    return spread(pair), spread(triple)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # of each bucket: its embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """Calibrated, a row for each text; whole texts, in blocks of bounded size."""
        sums = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            points = code_points(text)
            for at in range(0, len(points) - 2, _BLOCK):
                for h in subwords(points[at : at + _BLOCK + 2], len(self.table)):
                    sums[i] += self.table[h].sum(axis=0, dtype=np.float64)
            sums[i] /= 2 * (len(points) - 2)
        return _softmax((sums + self.bias) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bag(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text, in order, and how often each occurs; in blocks of bounded size."""
    points = code_points(text)
    counts = np.zeros(buckets, np.int64)
    for at in range(0, len(points) - 2, _BLOCK):
        for h in subwords(points[at : at + _BLOCK + 2], buckets):
            counts += np.bincount(h, minlength=buckets)
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32), counts[ids]


def train(texts: list[str], langs: list[str], *, buckets: int = BUCKETS, **options) -> Model | None:
    """Fit on texts that have a letter; None without any."""
    return train_bags([bag(t, buckets) for t in texts], langs, buckets=buckets, **options)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], langs: list[str], *, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 11, rate: float = 2.0) -> Model | None:
    """Fit on the bags of texts that have a letter; None without any."""
    languages = sorted(set(langs))
    if not languages:
        return None
    y = np.array([languages.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    k = len(languages)
    emb = rng.normal(0, 0.1, (buckets, dimensions))
    weights = rng.normal(0, 0.3, (dimensions, k))
    bias = np.zeros(k)
    order = rng.permutation(len(bags))
    each = [order[y[order] == i] for i in range(k)]
    held = np.concatenate([rows[: len(rows) // 5 if len(rows) >= CALIBRATED_ROWS else 0] for rows in each])
    fits = [rows[len(rows) // 5 if len(rows) >= CALIBRATED_ROWS else 0 :] for rows in each]
    most = max(map(len, fits))
    fit = np.concatenate([np.tile(rows, min(MOST_REPEATS, most // len(rows))) for rows in fits])

    def means(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = np.concatenate([bags[i][0] for i in part])
        share = np.concatenate([bags[i][1] / bags[i][1].sum() for i in part])
        owner = np.repeat(np.arange(len(part)), [len(bags[i][0]) for i in part])
        starts = np.cumsum([0, *(len(bags[i][0]) for i in part[:-1])])
        return ids, share, owner, np.add.reduceat(emb[ids] * share[:, None], starts)

    each = -(-len(fit) // 64)
    steps = max(epochs * each, LEAST_STEPS)
    step = 0
    for _ in range(-(-steps // each)):
        mixed = rng.permutation(fit)
        for at in range(0, len(fit), 64):
            part = mixed[at : at + 64]
            ids, share, owner, mean = means(part)
            g = _softmax(mean @ weights + bias)
            g[np.arange(len(part)), y[part]] -= 1
            now = rate * (1 - step / steps)
            step += 1
            back = g @ weights.T
            weights -= now / len(part) * (mean.T @ g)
            bias -= now / len(part) * g.sum(axis=0)
            np.subtract.at(emb, ids, now * share[:, None] * back[owner])
    temperature, threshold = 1.0, 0.0
    if len(held):
        logits = np.concatenate([means(held[i : i + 64])[3] for i in range(0, len(held), 64)]) @ weights + bias
        truth = y[held]
        grid = np.geomspace(0.05, 5, 60)
        temperature = float(min(grid, key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(held)), truth] + 1e-12).mean()))
        p = _softmax(logits / temperature)
        right, top = p.argmax(axis=1) == truth, p.max(axis=1)
        by = np.argsort(-top, kind="stable")
        sound = np.flatnonzero(np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= ACCEPTED_ACCURACY)
        threshold = float(top[by[sound[-1]]]) if len(sound) else 1.0
    return Model(languages, (emb @ weights).astype(np.float32), bias, temperature, threshold)


def identify(docs: DataFrame, *, hold_out: int = 4, held_remainder: int = 2, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Predict the language of every whole text.

    Learns from text and lang of at most ``sample_rows`` rows of each lang, one
    of each id, whose lang is not null and whose crc32 of the id, modulo
    ``hold_out``, is not ``held_remainder``, whole texts, of which tasks send
    bags of buckets to the driver, a bucket at most once for each row.  So
    every lang that has such a row with a letter is learned.  Returns doc_id,
    held_out, lang_pred, score (calibrated probability) and rejected (score
    under the calibrated threshold).

    A null text, or one without a letter, or any where nothing was learned, is
    'und' with score 0 and rejected.  Null ids are not held out, and not learned
    from; repeated rows are predicted alike; an empty table gives no rows;
    other columns are ignored.  Equal probabilities go to the first language in
    alphabetical order.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    bucket = crc_bucket("doc_id", hold_out)
    usable = rows.where(F.col("lang").isNotNull() & (bucket != held_remainder) & F.col("text").rlike(r"\p{L}"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole):
                bags = [bag(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "ids": pa.array([i.astype(np.int32) for i, _ in bags], pa.list_(pa.int32())), "times": pa.array([n.astype(np.int32) for _, n in bags], pa.list_(pa.int32()))})

    bags = bounded_sample(usable, "doc_id", sample_rows, "lang").select("doc_id", "lang", "text").mapInArrow(lean(hashed), "doc_id long, lang string, ids array<int>, times array<int>")
    sample = bags.toArrow().sort_by("doc_id")
    model = train_bags([(i.values.to_numpy(), n.values.to_numpy()) for i, n in zip(sample.column("ids"), sample.column("times"), strict=True)], sample.column("lang").to_pylist())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in sub_batches(whole):
                texts = batch.column("text").to_pylist()
                spoken = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if spoken:
                    p = model.probabilities([texts[i] for i in spoken])
                    for i, k, s in zip(spoken, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                        lang[i], score[i] = model.languages[k], min(1.0, s)
                rejected = [not model or s < model.threshold or x == "und" for s, x in zip(score, lang, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    made = rows.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double, rejected boolean")
    return made.select("doc_id", F.coalesce(bucket == held_remainder, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
