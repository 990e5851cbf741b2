"""Quality rules with thresholds that follow the data.

Word and line counts of whole texts give four rates a document.  For each
language and source, mergeable KLL quantile sketches of the rates replace
fixed cutoffs: a document is out when a rate lies beyond the group's upper
(or, for word length, lower) fence.  Most documents hold no symbol and no
repeat, so that quartiles of those rates are equal; a second set of sketches,
over the documents inside the first fences, gives them a fence that is a high
quantile.  Sketches are built in the map tasks and merged, so a source that
holds a third of all rows costs no more than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, sub_batches

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"

#: Accuracy of the sketches: with 200, a rank is off by about 1.7 % of a group's rows; groups under 200 rows are exact.
SKETCH_K = 200
#: The same for the high quantile: a rank is off by about 0.2 %; groups under 2000 rows are exact.
TAIL_K = 2000
#: Quantile that is the fence of a rate without a lower fence, over the documents that no quartile fence rules out.
TAIL = 0.99
#: Such a fence is at least this share of the rate's least spread, so that a trace in a group without any is no outlier.
TAIL_LEAST = 0.25
#: A fence lies so many spreads (upper less lower quartile, or the floor below) beyond the quartile.
FENCE = 4.0
#: Groups with fewer sound rows than this take the thresholds of their language; where that is small too, the base rules alone decide.
MIN_ROWS = 30
#: rate: (expression, least spread, has a lower fence); a rate of a text without words is null
RATES = {
    "word_length": ("word_chars / nullif(n_words, 0)", 0.02, True),
    "symbol_rate": ("n_symbols / nullif(word_chars, 0)", 0.02, False),
    "dup_line_rate": ("n_dup_lines / nullif(n_lines, 0)", 0.1, False),
    "repeat_rate": ("n_repeat_words / nullif(n_words, 0)", 0.05, False),
}
#: Up to so many groups, their fences (some 100 bytes each) go to every task, so that a large group is not dealt by its name.
LISTED_GROUPS = 100_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense numbers of the pairs (a, b), equal for equal pairs only; values stay under 2**32."""
    return np.unique(a << 32 | b, return_inverse=True)[1].astype(np.int64)


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of five which the text holds twice or more, first finds included."""
    n = len(words)
    if n <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    bits = max(1, (len(numbers) - 1).bit_length())
    if bits * window <= 62:  # the window itself fits in one number
        keys = ids[: n - window + 1].copy()
        for k in range(1, window):
            keys <<= bits
            keys |= ids[k : n - window + 1 + k]
    else:
        keys, span = ids, 1
        while span < window:
            step = min(span, window - span)
            keys = _rank(keys[: len(keys) - step], keys[step:])
            span += step
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s) + 1, bool)
    twice[1:-1] = same
    starts = order[twice[1:] | twice[:-1]]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word."""
    if not text:
        return (0,) * len(_COUNTS)
    raw = text.encode()
    words = raw.split()  # bytes split at exactly these six blanks
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text) - (len(raw) - len(raw.translate(None, BLANKS))),
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
    )


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every whole text with its lang and source; null text counts nothing."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sub_batches(whole):
                counts = np.array([text_counts(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, len(_COUNTS))
                yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("doc_id", "lang", "source")} | {c: pa.array(counts[:, k]) for k, c in enumerate(_COUNTS)})

    return rows.mapInArrow(lean(run), "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS))


def base_failed(least_words: int = 10, most_repeated: int = 20):
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def thresholds(counts: DataFrame, keys: list[str], k: int = SKETCH_K, fence: float = FENCE) -> DataFrame:
    """Per group of ``keys``, the fences of each rate over documents that pass the base rules, from its quartiles."""
    sound = counts.where(~F.col("base_failed"))
    sketched = sound.groupBy(*keys).agg(F.count("*").alias("n"), *(F.expr(f"kll_sketch_agg_double(cast({rate} as double), {k})").alias(f"s_{name}") for name, (rate, _, _) in RATES.items()))
    out = [F.col("n")]
    for name, (_, floor, lower) in RATES.items():
        q1, q3 = (F.expr(f"kll_sketch_get_quantile_double(s_{name}, {q}D)") for q in (0.25, 0.75))
        spread = F.greatest(q3 - q1, F.lit(floor)) * fence
        out += [(q3 + spread).alias(f"hi_{name}")] + [(q1 - spread).alias(f"lo_{name}")] * lower
    return sketched.select(*keys, *out)


def tails(counts: DataFrame, keys: list[str], k: int = TAIL_K, tail: float = TAIL) -> DataFrame:
    """Per group of ``keys``, the ``tail`` quantile of each rate without a lower fence, over documents that are still ``kept``."""
    names = [n for n in RATES if not RATES[n][2]]
    sketched = counts.where("kept").groupBy(*keys).agg(F.count("*").alias("n"), *(F.expr(f"kll_sketch_agg_double(cast({RATES[n][0]} as double), {k})").alias(f"s_{n}") for n in names))
    return sketched.select(*keys, "n", *(F.greatest(F.expr(f"kll_sketch_get_quantile_double(s_{n}, {tail}D)"), F.lit(TAIL_LEAST * RATES[n][1])).alias(f"hi_{n}") for n in names))


def inside(rows: DataFrame, own: DataFrame, wide: DataFrame, min_rows: int) -> DataFrame:
    """``rows`` with ``kept``: no rate lies beyond the fences of its group, or of its language where the group is small."""
    fences = [c for c in own.columns if c not in ("lang", "source", "n")]
    both = own.join(wide.withColumnsRenamed({f: f"w_{f}" for f in ["n", *fences]}), "lang")  # groups alone; one that is missing has no row to keep
    bounds = both.select("lang", "source", *(F.when(F.col("n") >= min_rows, F.col(f)).when(F.col("w_n") >= min_rows, F.col(f"w_{f}")).alias(f) for f in fences))
    bounds = cut(bounds)  # one row for each group
    few = bounds.limit(LISTED_GROUPS + 1).count() <= LISTED_GROUPS
    joined = rows.join(F.broadcast(bounds) if few else bounds, ["lang", "source"], "left")
    kept = F.col("kept")
    for f in fences:
        rate = F.expr(RATES[f[3:]][0])
        kept &= F.coalesce(rate <= F.col(f) if f.startswith("hi_") else rate >= F.col(f), F.lit(True))
    return joined.select(*(c for c in rows.columns if c != "kept"), kept.alias("kept"))


def quality_verdicts(docs: DataFrame, *, sketch_k: int = SKETCH_K, fence: float = FENCE, min_rows: int = MIN_ROWS, **columns: str) -> DataFrame:
    """Counts, base verdict and final verdict of every row.

    Returns doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, the four rates and kept.  A null or empty text
    has no words and fails the base rules; a null lang or source is a group of
    its own (written ''); repeated rows are judged row by row; an empty table
    gives no rows; other columns of ``docs`` are ignored.  A rate equal to its
    fence is kept.
    """
    counts = cut(count_words(docs, **columns)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed"))
    first = cut(inside(counts, thresholds(counts, ["lang", "source"], sketch_k, fence), thresholds(counts, ["lang"], sketch_k, fence), min_rows))
    last = inside(first, tails(first, ["lang", "source"]), tails(first, ["lang"]), min_rows)
    return last.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *(F.expr(rate).alias(n) for n, (rate, _, _) in RATES.items()), "kept")
