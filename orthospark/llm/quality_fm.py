"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a document: its distinct words, hashed to ``WORD_CELLS`` cells and weighted by one over the
root of their number; statistics of its structure (lengths, symbols, capitals, repeated lines,
words and word pairs), each both as a number and as one of ``STEPS`` steps; and its n_chars column as
metadata where there is one. Pairs interact through rank-``RANK`` vectors; scoring is linear in the number of
features by the identity  sum of pairs = (square of sum - sum of squares) / 2.

The machine is fitted by AdaGrad on at most ``MAX_LABELLED`` labelled documents (smallest hash of the
id first, a documented bound): what comes to the driver is two bytes for each of their distinct cells. The model's size is fixed, so it
can be sent to every task.

Null and empty texts have structure features only, and are scored. Labels that are null or name no
document are ignored; of repeated labels the largest counts. Without labels of both kinds
every score is the share of ones (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._tables import fold
from .toxicity import labelled_ids

MAX_LABELLED = 20_000
WORD_CELLS = 1 << 14
STEPS = 16
RANK = 8
EPOCHS = 8
#: Statistic and the range its steps divide.
STATISTICS = {
    "log_words": (0, 12), "log_chars": (0, 14), "metadata_log_chars": (0, 14), "word_length": (0, 16), "symbols": (0, 0.3), "capitals": (0, 1), "digits": (0, 0.5), "end_marks": (0, 0.2), "bars": (0, 0.2),
    "exclamations": (0, 0.2), "distinct_words": (0, 1), "distinct_pairs": (0, 1), "distinct_lines": (0, 1), "words_a_line": (0, 60), "high_bytes": (0, 0.5), "short_words": (0, 1),
}
N_STATS = len(STATISTICS)
N_FEATURES = WORD_CELLS + N_STATS * (STEPS + 1)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray


def _classes() -> np.ndarray:
    kinds = np.zeros((256, 7), np.float64)
    for i, chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".?!", b"|", b"!", bytes(range(128, 256)))):
        kinds[list(chars), i] = 1
    return kinds


_KINDS = _classes()


def _distinct_share(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Distinct over all values of each text; 1 where there are none."""
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    total = np.bincount(t, minlength=n)
    return np.where(total, np.bincount(t[new], minlength=n) / np.maximum(total, 1), 1.0)


def _features(buf: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word cells of consecutive texts, where each text's begin, and a row of statistics a text."""
    n = len(offsets) - 1
    words = _text.find_words(buf, offsets, _text.SPACE)
    h = words.hashes()
    cells = np.unique(words.text * WORD_CELLS + (h >> np.uint64(50)).astype(np.int64))
    first = np.searchsorted(cells, np.arange(n + 1) * WORD_CELLS)
    count, size = np.diff(words.first).astype(float), np.diff(offsets).astype(float)
    lengths = (words.end - words.start).astype(float)
    kinds = np.zeros((n, 7))
    for i in range(7):
        kinds[:, i] = _text.group_sums(_KINDS[buf, i], offsets)
    kinds /= np.maximum(size, 1)[:, None]
    pair = np.flatnonzero(words.text[1:] == words.text[:-1])
    pairs = _text.mix(h[pair] * np.uint64(31) + h[pair + 1])
    marked = buf.copy()
    marked[buf != 10] = 0x61  # lines are the words of a text whose only space is its line ends
    lines = _text.find_words(marked, offsets, _text.SPACE, lower=False)
    line_hash = _text.span_hash(_text.prefix_sums(buf), lines.start, lines.end)
    stats = np.stack([
        np.log1p(count), np.log1p(size), np.log1p(n_chars), _text.group_sums(lengths, words.first) / np.maximum(count, 1), *kinds.T[:6],
        _distinct_share(h, words.text, n), _distinct_share(pairs, words.text[pair], n), _distinct_share(line_hash, lines.text, n), count / np.maximum(np.diff(lines.first), 1),
        kinds[:, 6], _text.group_sums((lengths <= 3).astype(float), words.first) / np.maximum(count, 1),
    ], 1)
    return cells % WORD_CELLS, first, stats


def _rows(cells: np.ndarray, first: np.ndarray, stats: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All features of the texts, as (feature, value, where each text's begin)."""
    n, sizes = len(first) - 1, np.diff(first)
    low, high = np.array(list(STATISTICS.values())).T
    step = np.clip((stats - low) / (high - low) * STEPS, 0, STEPS - 1).astype(np.int64)
    own = np.concatenate([WORD_CELLS + np.arange(N_STATS) * STEPS + step, np.broadcast_to(WORD_CELLS + N_STATS * STEPS + np.arange(N_STATS), (n, N_STATS))], 1)
    value = np.concatenate([np.ones((n, N_STATS)) * 0.5, np.clip((stats - mean) / spread, -3, 3) * 0.3], 1)
    starts = np.concatenate([[0], np.cumsum(sizes + 2 * N_STATS)])
    feature, values = np.empty(starts[-1], np.int64), np.empty(starts[-1])
    text = np.repeat(np.arange(n), sizes)
    at = np.arange(len(cells)) + text * 2 * N_STATS
    feature[at], values[at] = cells, 1 / np.sqrt(np.maximum(sizes, 1))[text]
    tail = (starts[1:, None] - 2 * N_STATS + np.arange(2 * N_STATS)).ravel()
    feature[tail], values[tail] = own.ravel(), value.ravel()
    return feature, values, starts


def _raw(m: Machine, feature: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores before the sigmoid, and the sums of the vectors; every text has features."""
    x = m.vectors[feature] * value[:, None]
    sums = np.add.reduceat(x, starts[:-1])
    squares = np.add.reduceat((x * x).sum(1), starts[:-1])
    return m.bias + np.add.reduceat(m.weights[feature] * value, starts[:-1]) + 0.5 * ((sums * sums).sum(1) - squares), sums


def train(cells: np.ndarray, first: np.ndarray, stats: np.ndarray, y: np.ndarray, seed: int = 1) -> Machine:
    rng = np.random.default_rng(seed)
    m = Machine(float(np.log(y.mean() / (1 - y.mean()))), np.zeros(N_FEATURES), rng.normal(0, 0.02, (N_FEATURES, RANK)), stats.mean(0), np.maximum(stats.std(0), 1e-6))
    g_w, g_v, g_b = np.full(N_FEATURES, 1e-2), np.full((N_FEATURES, RANK), 1e-2), 1.0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            some = order[lo : lo + 64]
            part = (np.concatenate([cells[first[i] : first[i + 1]] for i in some]) if len(cells) else cells).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(first[some + 1] - first[some])])
            f, x, starts = _rows(part, bounds, stats[some], m.mean, m.spread)
            raw, sums = _raw(m, f, x, starts)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[some]) / len(some)
            each = np.repeat(np.arange(len(some)), np.diff(starts))
            used, where = np.unique(f, return_inverse=True)
            gx = slope[each] * x
            dw = np.bincount(where, gx) + 1e-5 * m.weights[used]
            dv = np.stack([np.bincount(where, gx * (sums[each, k] - m.vectors[f, k] * x)) for k in range(RANK)], 1) + 1e-4 * m.vectors[used]
            g_w[used] += dw * dw
            g_v[used] += dv * dv
            g_b += slope.sum() ** 2
            m.weights[used] -= 0.1 * dw / np.sqrt(g_w[used])
            m.vectors[used] -= 0.05 * dv / np.sqrt(g_v[used])
            m.bias -= 0.1 * slope.sum() / np.sqrt(g_b)
    return m


def _described(docs: DataFrame) -> DataFrame:
    n_chars = F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if "n_chars" in docs.columns else F.lit(0.0)
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.greatest(n_chars, F.lit(0.0)).alias("meta"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offsets in _text.text_slices(batch):
            cells, first, stats = _features(buf, offsets, part.column("meta").to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, N_STATS, dtype=np.int32)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("label"), _text.by_text(cells.astype(np.int16), first), lists], ["label", "cells", "stats"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> Machine | float:
    """A machine, or the score all get where the labels aren't of both kinds."""
    sample = labelled_ids(labels, label, max_labelled).withColumnRenamed(label, "label")
    rows = _described(docs).join(F.broadcast(sample), "doc_id").mapInArrow(_extract, "label int, cells array<short>, stats array<double>").toArrow().combine_chunks()
    y = rows["label"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    lists = rows["cells"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return train(lists.flatten().to_numpy(), first, rows["stats"].combine_chunks().flatten().to_numpy().reshape(-1, N_STATS), y)


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                cells, first, stats = _features(buf, offsets, part.column("meta").to_numpy())
                raw, _ = _raw(m, *_rows(cells, first, stats, m.mean, m.spread))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(raw, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: doc_id, held_out, score (probability that quality is 1), predicted (score >= threshold)."""
    m = fit(docs, labels, "quality", max_labelled)
    read = _described(docs)
    if isinstance(m, float):
        scored = read.select("doc_id", F.lit(m).alias("score"))
    else:
        scored = read.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(m)), "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
