"""Toxic passages as maximum-scoring segments of token log-odds.

A token's score is the log-odds of toxicity against the base rate, with Dirichlet (here Beta)
priors handed down from the base rate to the token's 4-byte prefix, its 6-byte prefix and
the token itself, less a drift that makes ordinary text score below zero. A linear-time scan
(Ruzzo and Tompa) finds every maximal-scoring segment. Segment scores become -log expected
counts by extreme-value calibration: lambda solves the Karlin equation on ordinary tokens,
K is fitted on ordinary documents. A document's evidence is the logarithm of their sum over its
significant segments; a logistic fit turns it into a probability.

The model is fitted on at most ``MAX_LABELLED`` labelled documents (smallest hash of the id first, a
documented bound); a quarter of them calibrates and isn't counted. Counts live in 2**20 hashed
cells, which is the size of what the tasks are sent.

Null and empty texts have no tokens and no evidence. Labels that are null or name no document are
ignored; of repeated labels the largest counts. Without any usable labels every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._tables import apart, fold, identified

MAX_LABELLED = 50_000
CELLS = 1 << 20
PREFIXES = (4, 5, 6)
#: Pseudo-counts with which a level is drawn to the one above it.
STRENGTH = 10.0
DRIFT = 0.3
#: Words within which a word counts once.
REACH = 200
#: A segment is significant from this -log expected count (0.1 by chance in a text of its length).
SIGNIFICANT = 2.3


@dataclass
class Model:
    toxic: np.ndarray  # documents with a cell's feature
    other: np.ndarray
    base: float
    lam: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    shift: float = 0.0


def _cells(words: _text.Words) -> np.ndarray:
    """Cell of each word's prefixes and of the word, a row a level."""
    sums = _text.prefix_sums(words.buf)
    levels = [_text.span_hash(sums, words.start, np.minimum(words.end, words.start + n)) for n in PREFIXES]
    levels.append(_text.span_hash(sums, words.start, words.end))
    return np.stack([(_text.mix(h + np.uint64(i)) >> np.uint64(44)).astype(np.int64) for i, h in enumerate(levels)])


def _scores(words: _text.Words, m: Model) -> np.ndarray:
    """A word that came within the last ``REACH`` words has no positive score of its own, so a passage isn't toxic by one word said over and
    over; farther on it counts anew, so a second passage of the same words is found as well."""
    cells = _cells(words)
    share = np.full(cells.shape[1], m.base)
    for level in cells:
        toxic, other = m.toxic[level], m.other[level]
        share = (toxic + STRENGTH * share) / (toxic + other + STRENGTH)
    scores = np.log(share / (1 - share)) - np.log(m.base / (1 - m.base))
    word = words.text * CELLS + cells[-1]
    order = np.argsort(word, kind="stable")
    again = np.zeros(len(scores), bool)
    again[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (np.diff(order) <= REACH)
    return np.where(again, np.minimum(scores, 0), scores) - DRIFT


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """Every maximal-scoring segment as (first, end, score), in linear time."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # first, end, total before, total after
    for i in np.flatnonzero(scores > 0).tolist():
        seg = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= seg[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= seg[3]:
                found.append([*seg, j])
                break
            seg[0], seg[2] = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, float(r - l)) for a, b, l, r, _ in found]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, CELLS), np.int64)
    documents = np.zeros(2, np.int64)
    for batch in batches:
        for part, buf, offsets in _text.text_slices(batch):
            words = _text.find_words(buf, offsets, _text.SPACE)
            cells = _cells(words)
            toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            documents += np.bincount(toxic, minlength=2)[:2]
            for level in cells:
                once = np.unique(words.text * CELLS + level)  # a document counts once for a feature
                side, cell = toxic[once // CELLS], once % CELLS
                for s in (0, 1):
                    counts[s] += np.bincount(cell[side == s], minlength=CELLS)
    used = np.flatnonzero(counts.any(axis=0))
    cell = np.concatenate([used, [-1]])
    yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(counts[0][used], documents[0])), pa.array(np.append(counts[1][used], documents[1]))], ["cell", "other", "toxic"])


_SEGMENTS = "array<struct<start:int,end:int,score:double>>"


def _segmenter(model, keep: list[str], typical: bool = False):
    """typical: also the scores of the tokens, rounded, as a histogram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                words = _text.find_words(buf, offsets, _text.SPACE)
                scores = _scores(words, m)
                out = []
                for d in range(part.num_rows):
                    a, b = words.first[d], words.first[d + 1]
                    out.append([{"start": int(words.start[a + i] - offsets[d]), "end": int(words.end[a + j - 1] - offsets[d]), "score": s} for i, j, s in maximal_segments(scores[a:b])])
                columns = [*(part.column(c) for c in keep), pa.array(np.diff(words.first).astype(np.int64)), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]
                names = [*keep, "n_tokens", "segments"]
                if typical:
                    columns.append(_text.by_text(np.round(scores, 1), words.first))
                    names.append("token_scores")
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def labelled_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, <label>)`` of at most ``most`` labelled documents outside the held-out fold: small enough to
    broadcast, whatever the size of the labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias(label))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _karlin(scores: np.ndarray, weights: np.ndarray) -> float:
    """The lambda > 0 at which the mean of exp(lambda * score) is 1."""
    p = weights / weights.sum()
    if not (scores > 0).any():
        return 1.0
    lo, hi = 1e-6, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if (p * np.exp(np.minimum(mid * scores, 500))).sum() > 1:
            hi = mid
        else:
            lo = mid
    return max(lo, 0.05)


def _evidence(scores: np.ndarray, n: int, m: Model) -> float:
    e = m.lam * scores - np.log(m.k * max(n, 1))
    return float(np.log1p(e[e > SIGNIFICANT].sum()))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-variable logistic fit, with a light ridge and smoothed labels."""
    up, down = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a = np.stack([x, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - t) + 1e-3 * w
        h = (a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model | None:
    """A model, or None where the labels don't hold both kinds."""
    spark = docs.sparkSession
    sample = identified(docs).join(F.broadcast(labelled_ids(labels, label, max_labelled)), "doc_id").withColumnRenamed(label, "toxic")
    calibrates = fold(F.col("doc_id"), 5) == 1
    rows = sample.where(~calibrates).select("text", "toxic").mapInArrow(_count, "cell long, other long, toxic long").groupBy("cell").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    rows = rows.select(F.col("cell").cast("int"), F.col("other").cast("float"), F.col("toxic").cast("float")).toArrow()
    # The last place takes the numbers of documents, cell -1.
    counts = np.zeros((2, CELLS + 1), np.float32)
    counts[0][rows["cell"].to_numpy()], counts[1][rows["cell"].to_numpy()] = rows["toxic"].to_numpy(), rows["other"].to_numpy()
    del rows
    toxic, other = counts[:, -1]
    if not toxic or not other:
        return None
    base = float(toxic / (toxic + other))
    m = Model(counts[0], counts[1], base, shift=float(np.log(base / (1 - base))))  # without documents to calibrate, no evidence means the base rate

    held = sample.where(calibrates).select("toxic", "text").mapInArrow(_segmenter(spark.sparkContext.broadcast(m), ["toxic"], True), f"toxic int, n_tokens long, segments {_SEGMENTS}, token_scores array<double>")
    held = held.select("toxic", "n_tokens", F.transform("segments", lambda s: s["score"]).alias("scores"), "token_scores")
    typical = held.where("toxic = 0").select(F.explode("token_scores").alias("s")).groupBy("s").count().toPandas()
    rows = held.select("toxic", "n_tokens", "scores").toPandas()
    if rows.empty or typical.empty:
        return m
    m.lam = _karlin(typical.s.to_numpy(), typical["count"].to_numpy(float))
    scores = [np.asarray(s, float) for s in rows.scores]
    n = np.maximum(rows.n_tokens.to_numpy(float), 1)
    top = np.array([s.max() if len(s) else 0.0 for s in scores])
    usual = rows.toxic.to_numpy() == 0
    m.k = float(usual.sum() / (n * np.exp(-m.lam * top))[usual].sum()) if usual.any() else 1.0
    x = np.array([_evidence(s, c, m) for s, c in zip(scores, n, strict=True)])
    m.slope, m.shift = logistic(x, rows.toxic.to_numpy(float))
    return m


def segments(docs: DataFrame, m: Model | None) -> DataFrame:
    """Per document: doc_id, score (probability of toxicity), n_tokens, and its significant segments with byte
    spans and -log expected counts."""
    read = identified(docs)
    if m is None:
        return read.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_tokens"), F.array().cast(_SEGMENTS).alias("segments"))
    found = read.mapInArrow(_segmenter(docs.sparkSession.sparkContext.broadcast(m), ["doc_id"]), f"doc_id long, n_tokens long, segments {_SEGMENTS}")
    level = F.log(F.lit(m.k) * F.greatest("n_tokens", F.lit(1)))
    found = found.withColumn("segments", F.filter(F.transform("segments", lambda s: s.withField("score", m.lam * s["score"] - level)), lambda s: s["score"] > SIGNIFICANT))
    evidence = F.log1p(F.aggregate("segments", F.lit(0.0), lambda a, s: a + s["score"]))
    return found.select("doc_id", (1 / (1 + F.exp(-(m.slope * evidence + m.shift)))).alias("score"), "n_tokens", "segments")


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (score >= 0.5), n_segments."""
    scored = segments(docs, fit(docs, labels, "toxic", max_labelled))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))


def reject(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the documents scored at ``threshold`` or more; rows with a null id stay."""
    name = apart(docs, "gone")
    toxic = segments(docs, fit(docs, labels, "toxic", max_labelled)).where(F.col("score") >= threshold).select(F.col("doc_id").alias(name))
    return docs.join(toxic, F.col("doc_id") == F.col(name), "left_anti")
