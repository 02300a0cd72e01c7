"""Document likelihood by a subword lattice over an existing vocabulary.

A token is a word or a text's end. The lattice probability of a word sums over every way to cut
it (with its leading space) into pieces of the vocabulary, by a forward recursion in log space; single bytes
are pieces too, so every word has one. ``lattice_score`` is a text's marginal probability under the vocabulary's own scores (those of a
BPE vocabulary are negative ranks, read as Zipf's law) and nothing else.

``score`` learns from the corpus as well. Piece weights are re-estimated by expectation-maximisation over all
distinct training words (each once: the pieces are there for words not seen before), with the vocabulary's scores as the
prior. Whole words seen in training are further arcs of the lattice, weighted by their discounted
counts; the mass that the discount frees goes to the pieces. A document is of one of
``TOPICS`` kinds (in practice its language), which weigh the ``COMMON`` commonest words each in its own way, within the mass that
they and all others have; its probability sums over them. Topics start from which common words occur together. Which less
common words there are is drawn from an urn (Dirichlet-multinomial), so one that has come is likelier to come again.
The probabilities of all texts of one length in words add up to that length's, or less by what no text spells.

Texts are tokenised twice, to count words and, once these have weights, to look them up. Word counts come from all training
documents and stay distributed. The ``FREQUENT`` most frequent words are sent to the tasks; the others meet the counts in one
join. Nothing that grows with the corpus comes to the driver. Words of over ``LONG`` bytes are summed as a stream, so memory doesn't follow
their length; for the re-estimation they are cut into stretches of that length.

Null and empty texts are their end token alone. Repeated rows are counted and scored as often as they
occur, two texts under one id each for itself; rows with a null id are left out. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._tables import fold, identified, written

FREQUENT = 1 << 16
DISCOUNT = 0.5
#: Topics, the words that found them, the words whose weight depends on them, and passes that refine them.
TOPICS, SEEDS, COMMON, PASSES = 8, 256, 4096, 2
ROUNDS = 1
#: Longest word whose lattice is held whole.
LONG = 1024
SLICE_BYTES = 8 << 20
#: Tokens that the whole corpus weighs in a document's urn of less common words.
URN = 1000.0
_CELL_BYTES = 1 << 19
_STRETCH = 1 << 16


class Pieces:
    """A vocabulary as byte strings, looked up by hash, and the natural logarithm of each one's weight."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        buf = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        hashes = _text.span_hash(_text.prefix_sums(buf), ends - [len(p) for p in pieces], ends)
        order = np.argsort(hashes)
        self.hashes, self.most = hashes[order], max(len(p) for p in pieces)
        self.set(np.asarray(weights, float)[order])

    def set(self, weights: np.ndarray) -> None:
        self.weights = weights
        self.log = np.log(weights)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


def load(path: str) -> Pieces:
    """Pieces of a sentencepiece model that lie within a word; its scores are read as ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or "▁" in piece[1:] or piece == "":
            continue
        weights[piece.replace("▁", " ").encode()] = 1 / (2.7 - min(0.0, model.get_score(i))) if model.get_score(i) > -1e8 else 1e-6
    total = sum(weights.values())
    return Pieces(list(weights), np.array(list(weights.values())) / total)


_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)
_HALF_LOG_2PI = 0.9189385332046727


def _log_gamma(x, log):
    """Logarithm of the gamma function for x > 0, of arrays or columns alike: Stirling's series, eight steps up."""
    down = log(x * (x + 1) * (x + 2) * (x + 3)) + log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    series = (_STIRLING[0] + (_STIRLING[1] + (_STIRLING[2] + _STIRLING[3] / (y * y)) / (y * y)) / (y * y)) / y
    return (y - 0.5) * log(y) - y + _HALF_LOG_2PI + series - down


def _drawn(weight, times, log):
    """Logarithm of drawing a word ``times`` times where the urn holds ``weight`` of it."""
    return _log_gamma(weight + times, log) - _log_gamma(weight, log)


@dataclass
class Topics:
    """Kinds of documents: how much likelier each makes a common word, and any other word, than the whole corpus does."""

    hashes: np.ndarray  # of the common words, sorted
    ratios: np.ndarray  # logarithms, a row a common word and one for all others
    share: np.ndarray  # logarithms

    def places(self, h: np.ndarray) -> np.ndarray:
        """Row of each word."""
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        return np.where(self.hashes[at] == h, at, len(self.hashes)) if len(self.hashes) else np.zeros(len(h), np.int64)

    def evidence(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log odds of each topic for consecutive texts whose words have these places, a row a text."""
        sums = np.concatenate([np.zeros((1, len(self.share))), np.cumsum(self.ratios[places], 0)])
        return self.share + sums[first[1:]] - sums[first[:-1]]

    def balance(self, common: np.ndarray, other: float) -> None:
        """Make each topic share the mass of the common words (in the order of their hashes) and of all others in its own way, without adding to it."""
        mass = np.append(common, other)
        self.ratios = self.ratios - np.log((mass[:, None] * np.exp(self.ratios)).sum(0) / mass.sum())


def _equal_lengths(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words with a leading space, as byte matrices of words of one length, and which words they are."""
    if not words:
        return
    sizes = np.array([len(w) for w in words]) + 1
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        size = int(sizes[group[0]])
        step = max(1, _CELL_BYTES // size)
        for lo in range(0, len(group), step):
            some = group[lo : lo + step]
            yield np.frombuffer(b"".join(b" " + words[i] for i in some), np.uint8).reshape(len(some), size), some


def _lattice(cells: np.ndarray, p: Pieces, *others: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Pieces and their log weights by length and start, and the forward log sums under these and under other log weights."""
    n, size = cells.shape
    sums = _text.prefix_sums(cells.ravel())
    found = []
    starts = np.arange(n)[:, None] * size + np.arange(size)
    for length in range(1, min(size, p.most) + 1):
        at = starts[:, : size - length + 1]
        found.append(p.find(_text.span_hash(sums, at, at + length)))
    forwards = [np.full((n, size + 1), -np.inf) for _ in (p.log, *others)]
    for forward in forwards:
        forward[:, 0] = 0
    for j in range(1, size + 1):
        for length in range(1, min(j, len(found)) + 1):
            piece = found[length - 1][:, j - length]
            there = np.flatnonzero(piece >= 0)
            if len(there):
                for forward, log in zip(forwards, (p.log, *others), strict=True):
                    forward[there, j] = np.logaddexp(forward[there, j], forward[there, j - length] + log[piece[there]])
    return found, [np.where(piece >= 0, p.log[piece], -np.inf) for piece in found], forwards


def _streamed(word: bytes, p: Pieces, logs: tuple[np.ndarray, ...]) -> list[float]:
    """The last forward sums of one long word: a stretch at a time, with the sums of one piece's length carried on."""
    cell = b" " + word
    carried = [[-math.inf] * p.most + [0.0] for _ in logs]  # forward sums up to the stretch
    for lo in range(0, len(cell), _STRETCH):
        buf = np.frombuffer(cell[max(0, lo - p.most) : lo + _STRETCH], np.uint8)
        base, sums = lo - max(0, lo - p.most), _text.prefix_sums(buf)
        ends = np.arange(base + 1, len(buf) + 1)
        into: list[list[tuple[int, int]]] = [[] for _ in ends]
        for length in range(1, p.most + 1):
            some = np.flatnonzero(ends >= length)
            piece = p.find(_text.span_hash(sums, ends[some] - length, ends[some]))
            for at, which in zip(some[piece >= 0].tolist(), piece[piece >= 0].tolist(), strict=True):
                into[at].append((length, which))
        for f, log in zip(carried, logs, strict=True):
            for arcs in into:
                terms = [f[-length] + log[which] for length, which in arcs]
                top = max(terms)
                f.append(top + math.log(sum(math.exp(t - top) for t in terms)) if top > -math.inf else top)
            del f[: -p.most - 1]
    return [f[-1] for f in carried]


def log_weights(words: list[bytes], p: Pieces, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    """Natural logarithm of each word's marginal weight over all segmentations, and the same under other log weights of the pieces."""
    out = tuple(np.zeros(len(words)) for _ in (p.log, *others))
    for i, w in enumerate(words):
        if len(w) > LONG:
            for o, v in zip(out, _streamed(w, p, (p.log, *others)), strict=True):
                o[i] = v
    short = np.array([i for i, w in enumerate(words) if len(w) <= LONG], np.int64)
    for cells, which in _equal_lengths([words[i] for i in short]):
        for o, forward in zip(out, _lattice(cells, p, *others)[2], strict=True):
            o[short[which]] = forward[:, -1]
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, p: Pieces) -> np.ndarray:
    """How often each piece is used in the words, in expectation over segmentations."""
    out = np.zeros(len(p.weights))
    parts = [(w[a : a + LONG], c) for w, c in zip(words, counts, strict=True) for a in range(0, max(len(w), 1), LONG)]
    words, counts = [w for w, _ in parts], np.array([c for _, c in parts], float)
    for cells, which in _equal_lengths(words):
        found, logs, (forward,) = _lattice(cells, p)
        size = cells.shape[1]
        backward = np.full((len(cells), size + 1), -np.inf)
        backward[:, size] = 0
        for i in range(size - 1, -1, -1):
            for length in range(1, min(size - i, len(logs)) + 1):
                backward[:, i] = np.logaddexp(backward[:, i], backward[:, i + length] + logs[length - 1][:, i])
        times = np.log(counts[which])[:, None] - forward[:, -1:]
        for length, (piece, log) in enumerate(zip(found, logs, strict=True), 1):
            used = np.exp(forward[:, : size - length + 1] + log + backward[:, length:] + times)
            there = piece >= 0
            out += np.bincount(piece[there], used[there], minlength=len(out))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, buf, offsets in _text.text_slices(batch, most=SLICE_BYTES):
            words = _text.find_words(buf, offsets, _text.SPACE)
            if not len(words.start):
                continue
            _, lead, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
            train = ~part.column("held_out").to_numpy(zero_copy_only=False)
            raw = words.buf.tobytes()
            spelled = [raw[a:b] for a, b in zip(words.start[lead].tolist(), words.end[lead].tolist(), strict=True)]
            seen = np.bincount(inverse, train[words.text]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spelled, pa.binary()), pa.array(np.bincount(inverse)), pa.array(seen)], ["word", "n", "c"])


def _expecter(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        total = np.zeros(len(p.weights))
        for batch in batches:
            if batch.num_rows:
                total += expected_counts(batch.column("word").to_pylist(), np.ones(batch.num_rows), p)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["piece", "n"])

    return run


def _weigher(pieces, own, discount: float, tokens: int, distinct: int, none: float):
    """Words with their hash, and what one occurrence adds to the base, to the model's and to the plain lattice's score.
    own: the vocabulary's own log weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces.value
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").to_numpy().astype(float)
            if not words:
                continue
            h = _word_hashes(words)
            # The end is one of the kinds of token that share what the discount frees.
            free = (discount * distinct / tokens if tokens else 1.0) * distinct / (distinct + 1) if distinct else 1.0
            seen = np.maximum(c - discount, 0) / max(tokens, 1)
            learned, plain = log_weights(words, p, own.value)
            model = np.logaddexp(np.log(np.maximum(seen, 1e-300)), np.log(free) + learned)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), batch.column("n"), pa.array(c > 0), pa.array(np.log10(c + 0.1) - none), pa.array(model / np.log(10)), pa.array(plain / np.log(10))], ["h", "n", "known", "base", "model", "plain"]
            )

    return run


def _word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(w) for w in words])
    return _text.span_hash(_text.prefix_sums(np.frombuffer(b"".join(words), np.uint8)), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


_OWN = "struct<n_tokens:long,n_known:long,base:double,model:double,plain:double,common:array<short>>"


def _occurrences(frequent):
    """A row a document with the sums over its frequent words and the places of its common ones; of others a row for each document and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, base, model, plain, topics, urn, other = frequent.value
        place = topics.places(hashes)  # of each frequent word among the common ones
        common = place < len(topics.hashes)
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch, most=SLICE_BYTES // 2):
                words = _text.find_words(buf, offsets, _text.SPACE)
                h = words.hashes()
                at = np.minimum(np.searchsorted(hashes, h), max(len(hashes) - 1, 0))
                often = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
                n = part.num_rows
                # Counts of nothing are whole numbers whatever the weights are.
                each = [np.bincount(words.text[often], v[at[often]], minlength=n).astype(float) for v in (known, base, plain)]
                usual = often.copy()
                usual[often] = common[at[often]]
                log = np.bincount(words.text[usual], model[at[usual]], minlength=n) * np.log(10)
                places = np.where(usual, place[at], len(topics.hashes)).astype(np.int16) if len(hashes) else np.zeros(len(h), np.int16)
                # Of the others first how many, then which.
                others = np.diff(words.first) - np.bincount(words.text[usual], minlength=n)
                log += others * np.log(other) - _drawn(urn, others, np.log)
                pairs, drawn = np.unique(words.text[often & ~usual] * max(len(hashes), 1) + at[often & ~usual], return_counts=True)
                log += np.bincount(pairs // max(len(hashes), 1), _drawn(urn / other * 10 ** model[pairs % max(len(hashes), 1)], drawn, np.log), minlength=n)
                rare, text = h[~often], words.text[~often]
                order = np.lexsort((rare, text))
                rare, text = rare[order], text[order]
                new = np.ones(len(rare), bool)
                new[1:] = (rare[1:] != rare[:-1]) | (text[1:] != text[:-1])
                lead = np.flatnonzero(new)
                times = np.diff(np.append(lead, len(rare)))
                ids, keys = (part.column(c).to_numpy() for c in ("doc_id", "key"))
                own = [pa.array(np.diff(words.first).astype(np.int64)), pa.array(each[0].astype(np.int64)), pa.array(each[1]), pa.array(log / np.log(10)), pa.array(each[2]), _text.by_text(places, words.first)]
                own = pa.StructArray.from_arrays(own, ["n_tokens", "n_known", "base", "model", "plain", "common"])
                yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), part.column("doc_id"), part.column("key"), pa.nulls(n, pa.int32()), own], ["h", "doc_id", "key", "times", "own"])
                yield pa.RecordBatch.from_arrays([pa.array(rare[lead].view(np.int64)), pa.array(ids[text[lead]]), pa.array(keys[text[lead]]), pa.array(times.astype(np.int32)), pa.nulls(len(lead), own.type)], ["h", "doc_id", "key", "times", "own"])

    return run


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Places of consecutive texts' words, and where each text's begin."""
    lists = batch.column("common")
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return lists.flatten().to_numpy().astype(np.int64), offsets - offsets[0]


def _together(seeds: np.ndarray):
    """In how many documents each two of the seed words, given by their places, occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(seeds),) * 2)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                places, first = _places(part)
                at = np.minimum(np.searchsorted(seeds, places), len(seeds) - 1)
                mine = seeds[at] == places
                seen = np.zeros((part.num_rows, len(seeds)), np.float32)
                seen[np.repeat(np.arange(part.num_rows), np.diff(first))[mine], at[mine]] = 1
                total += seen.T @ seen
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * len(total) + j), pa.array(total[i, j])], ["cell", "n"])

    return run


def _evidences(topics: Topics, batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch, of bounded numbers of words, with the places of their words and the log odds of each topic."""
    sizes = np.cumsum(np.diff(np.asarray(batch.column("common").offsets)))
    # The first part begins with the first text, which may have no words.
    cuts = np.unique([0, *np.searchsorted(sizes, np.arange(1 << 19, sizes[-1] + 1, 1 << 19), "right")]) if len(sizes) else []
    for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=False):
        part = batch.slice(int(a), int(b - a))
        places, first = _places(part)
        yield part, places, first, topics.evidence(places, first)


def _topic_counts(sent):
    """Common words, all others, and documents of each topic, every document being of its likeliest one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = sent.value
        k = len(topics.share)
        counts = np.zeros((len(topics.hashes) + 2) * k)
        for batch in batches:
            for _, places, first, odds in _evidences(topics, batch):
                topic = odds.argmax(1)
                counts += np.bincount(places * k + np.repeat(topic, np.diff(first)), minlength=len(counts))
                counts[-k:] += np.bincount(topic, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["cell", "n"])

    return run


def _with_topics(sent):
    """What the topics add to each document's model score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        topics = sent.value
        for batch in batches:
            for part, _, _, odds in _evidences(topics, batch):
                model = part.column("model").to_numpy() + np.logaddexp.reduce(odds, axis=1) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "n_tokens", "n_known", "base")), pa.array(model), part.column("plain")], ["doc_id", "key", "n_tokens", "n_known", "base", "model", "plain"])

    return run


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Cells of all tasks added up; ``size`` bounds what comes to the driver."""
    sums = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[sums.cell] = sums.n
    return out


def _groups(together: np.ndarray, k: int) -> np.ndarray:
    """Words that occur together, by k-means from the farthest first."""
    own = np.sqrt(np.maximum(np.diag(together), 1))
    rows = together / own[:, None] / own
    centres = rows[[0]]
    while len(centres) < k:
        far = ((rows[:, None] - centres) ** 2).sum(2).min(1).argmax()
        centres = np.concatenate([centres, rows[[far]]])
    for _ in range(30):
        group = ((rows[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([rows[group == g].mean(0) if (group == g).any() else centres[g] for g in range(k)])
    return group


def _no_topics(hashes: np.ndarray) -> Topics:
    return Topics(hashes, np.zeros((len(hashes) + 1, 1)), np.zeros(1))


def find_topics(train: DataFrame, hashes: np.ndarray, seeds: np.ndarray, common: np.ndarray, other: float, k: int = TOPICS) -> Topics:
    """From ``train(common)``, the places of training texts' words among the common ones (sorted ``hashes``); seeds: places of the commonest.
    common, other: the probabilities of the common words and of all others together."""
    sent = train.sparkSession.sparkContext.broadcast
    if len(hashes) < k:
        return _no_topics(hashes)
    together = _summed(train.mapInArrow(_together(seeds), "cell long, n double"), len(seeds) ** 2).reshape((len(seeds),) * 2)
    topics = Topics(hashes, np.zeros((len(hashes) + 1, k)), np.full(k, -np.log(k)))
    topics.ratios[seeds, _groups(together, k)] = 1.0
    for _ in range(PASSES):
        counts = _summed(train.mapInArrow(_topic_counts(sent(topics)), "cell long, n double"), (len(hashes) + 2) * k).reshape(-1, k)
        documents, counts = counts[-1], counts[:-1]
        overall = (counts.sum(1) + 0.5) / (counts.sum() + 0.5 * len(counts))
        topics = Topics(hashes, np.log((counts + 100 * overall[:, None]) / (counts.sum(0) + 100)) - np.log(overall)[:, None], np.log((documents + 1) / (documents.sum() + k)))
    topics.balance(common, other)
    return topics


def score(docs: DataFrame, pieces: Pieces, held_out=None, discount: float = DISCOUNT, rounds: int = ROUNDS, urn: float = URN, topics: int = TOPICS) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigram words), score
    (the model) and lattice_score (the vocabulary's scores alone), log10 probabilities. ``held_out``: Column; by default crc32 of the id modulo 10 is 0."""
    spark = docs.sparkSession
    held = fold(F.col("doc_id"), 10) == 0 if held_out is None else held_out
    read = identified(docs).withColumn("held_out", held)
    words = written(read.select("text", "held_out").mapInArrow(_count, "word binary, n long, c long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    ends = read.where(~F.col("held_out")).count()
    seen, distinct = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    tokens, distinct = seen + ends, distinct + (ends > 0)

    # The end is one more kind of token: pieces leave it its share.
    own_weights = pieces.weights / (pieces.weights.sum() + 1 / max(len(pieces.weights), 1))
    learned = Pieces.__new__(Pieces)
    learned.hashes, learned.most = pieces.hashes, pieces.most
    learned.set(pieces.weights / pieces.weights.sum())
    for _ in range(rounds if seen else 0):
        sent = spark.sparkContext.broadcast(learned)
        used = words.where("c > 0").select("word").mapInArrow(_expecter(sent), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()  # a row a piece
        n = pieces.weights / pieces.weights.sum() * len(pieces.weights)  # the prior: one use a piece, shared as the vocabulary's scores say
        n[used.piece] += used.n
        learned.set(n / n.sum())

    none = float(np.log10(tokens + 0.1 * (distinct + 1)))
    broadcast = spark.sparkContext.broadcast
    weigher = _weigher(broadcast(learned), broadcast(np.log(own_weights)), discount, tokens, distinct, none)
    weighed = written(words.mapInArrow(weigher, "h long, n long, known boolean, base double, model double, plain double"), "weights")
    top = weighed.orderBy(F.desc("n"), "h").limit(FREQUENT).toPandas()
    order = np.argsort(top.h.to_numpy().view(np.uint64))
    hashes = top.h.to_numpy().view(np.uint64)[order]
    known, base, model, plain = (top[c].to_numpy(float)[order] for c in ("known", "base", "model", "plain"))
    # The common words are the known ones that come first; they are frequent by that.
    first = np.flatnonzero(top.known.to_numpy(bool))[:COMMON]
    common = np.sort(top.h.to_numpy().view(np.uint64)[first])
    seeds = np.sort(np.searchsorted(common, top.h.to_numpy().view(np.uint64)[first[:SEEDS]]))
    end_share = max(ends - discount, 0) / max(tokens, 1) + (discount * distinct / tokens if tokens else 1.0) / (distinct + 1)
    masses = 10 ** model[np.searchsorted(hashes, common)]
    other = max(1 - end_share - float(masses.sum()), 1e-9)
    frequent = [hashes, known, base, model, plain, _no_topics(common), urn, other]
    rows = written(read.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_occurrences(broadcast(frequent)), f"h long, doc_id long, key long, times int, own {_OWN}"), "occurrences")
    own = rows.where("own is not null").select("doc_id", "key", "own.*")
    train = own.withColumn("held_out", held).where(~F.col("held_out")).select("common")
    found = find_topics(train, common, seeds, masses, other, topics)
    of_documents = own.select("doc_id", "key", "n_tokens", "n_known", "base", "model", "plain", "common").mapInArrow(_with_topics(broadcast(found)), "doc_id long, key long, n_tokens long, n_known long, base double, model double, plain double")
    times = F.col("times")
    drawn = _drawn(urn / other * F.pow(F.lit(10.0), "model"), times, F.log) / float(np.log(10))
    of_words = rows.where("h is not null").select("h", "doc_id", "key", "times").join(weighed.select("h", "known", "base", "model", "plain"), "h").select(
        "doc_id", "key", F.lit(None).cast("long").alias("n_tokens"), (times * F.col("known").cast("int")).cast("long").alias("n_known"), (times * F.col("base")).alias("base"), drawn.alias("model"), (times * F.col("plain")).alias("plain")
    )
    sums = of_documents.unionByName(of_words).groupBy("doc_id", "key").agg(F.count("n_tokens").alias("copies"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "model", "plain")])
    one = lambda c: F.col(c) / F.col("copies")  # noqa: E731  repeated documents have equal sums
    end_base, end_model, end_plain = float(np.log10(ends + 0.1)) - none, float(np.log10(end_share)), float(np.log10(1 - own_weights.sum()))
    out = sums.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id", held.alias("held_out"), (one("n_tokens") + 1).cast("long").alias("n_tokens"), (one("n_known") + (1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"), (one("base") + end_base).alias("base_score"), (one("model") + end_model).alias("score"), (one("plain") + end_plain).alias("lattice_score"),
    )
