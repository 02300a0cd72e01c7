"""Removing repeated substrings with an enhanced suffix array and its common-prefix intervals.

Every ``LENGTH``-byte window picks an anchor in it, the ``GRAM``-byte string of least hash (leftmost of equals).
Equal windows pick the same anchor, so only anchors that occur twice can lie in a repeat, and
all windows that can equal each other share an anchor's hash. Consecutive windows with one anchor are a
segment. Per anchor, equal segments are settled at once; of those that differ, a suffix array of the
starts is built by prefix doubling, with its longest common prefixes. A stack scan gives the
common-prefix intervals; an interval whose occurrences are preceded by different bytes (or begin their
segment) is a maximal repeat, and all its occurrences but the first lose their bytes.

Rows are settled within a task before they are sent where they can be (a common passage is sent
once a slice). An anchor whose segments could pass ``BLOCK_BYTES`` together is hot: a short phrase with
ever different text around it. Its segments are sent window by window, each under its own hash in place of the
anchor's, so that only equal windows meet and no group holds more than one of them. Equality of segments,
and of windows of hot anchors within a slice, is that of 64-bit hashes; across slices those windows are
compared by 128-bit digests as well, all other windows by bytes.

Texts are UTF-8 bytes; null and empty ones have none, and shorter ones than ``LENGTH`` lose nothing. Repeated
rows of a document are the same document and lose the same; an id with several texts is an error. Rows with a null id are left out. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._tables import identified, written

LENGTH = 100
GRAM = 24
BLOCK_BYTES = 2 << 20
BLOCK_SPANS = 1 << 16
PLACE_BITS = 22


def _sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Least of v[i : i + w] for every i up to len(v) - w."""
    step = 1
    while step * 2 <= w:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    return v if step == w else np.minimum(v[: len(v) - (w - step)], v[w - step :])


def _anchors(hashes: np.ndarray, w: int) -> np.ndarray:
    """For every i, the place of the least of hashes[i : i + w], the leftmost of equals. All but the last ``PLACE_BITS`` bits of
    a hash count, whatever the size of the slice: longer ones are gone through in stretches."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    step = (1 << PLACE_BITS) - w
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(hashes) - w + 1, step):
        h = hashes[lo : lo + step + w - 1]
        out.append((_sliding_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), w) & mask).astype(np.int64) + lo)
    return np.concatenate(out)


def _segments(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of consecutive texts: text, first window's start (in buf), number of windows, anchor hash, hash of all bytes."""
    none = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    sizes = np.diff(offsets)
    if len(buf) < length or not (sizes >= length).any():
        return none
    sums = _text.prefix_sums(buf)
    at = np.arange(len(buf) - gram + 1)
    hashes = _text.span_hash(sums, at, at + gram)
    anchor = _anchors(hashes, length - gram + 1)
    # Windows that lie within one text.
    windows = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(sizes)), windows)
    start = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + offsets[:-1][text]
    picked = anchor[start]
    lead = np.ones(len(start), bool)
    lead[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(lead)
    n = np.diff(np.append(first, len(start)))
    lo = start[first]
    return text[first], lo, n, hashes[picked[first]], _text.span_hash(sums, lo, lo + n + length - 1)


_FIRST, _LATER, _SAME = 0, 1, 2


def _standing(ids: np.ndarray, lo: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of the rows with one key: the first, by (id, lo), later ones, and those at the first's own place (of a repeated row of its document)."""
    order = np.lexsort((lo, ids, key))
    key, ids, lo = key[order], ids[order], lo[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = np.empty(len(key), np.int8)
    out[order] = np.where(new, _FIRST, np.where((ids == ids[first]) & (lo == lo[first]), _SAME, _LATER))
    return out


def _marker(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                text, lo, n, anchor, whole = _segments(buf, offsets, length, gram)
                ids, lo = part.column("doc_id").to_numpy()[text], lo - offsets[text]
                standing = _standing(ids, lo, whole)
                some = standing != _SAME
                anchor, ids, lo, n, repeats = anchor[some], ids[some], lo[some], n[some], standing[some] == _LATER
                # Repeats are settled; where they go is of no account, so they are dealt evenly.
                anchor = np.where(repeats, ids + lo, anchor.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(ids), pa.array(lo << 9 | n << 1 | repeats)], ["anchor", "doc_id", "mark"])

    return run


_CUT = "anchor long, doc_id long, lo long, n int, before int, bytes binary"
#: In place of the byte before: the row's windows are all repeats.
_SETTLED = -2


def _cut_rows(anchor: np.ndarray, ids: np.ndarray, lo: np.ndarray, n: np.ndarray, before: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor), pa.array(ids), pa.array(lo), pa.array(n.astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(pieces, pa.binary())], ["anchor", "doc_id", "lo", "n", "before", "bytes"]
    )


def _windows(buf: np.ndarray, begin: np.ndarray, ids: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """Segments window by window: runs of those that repeat an earlier one of the slice, settled, and the first of each
    with its hash as the anchor and a digest as its bytes."""
    segment = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(segment)) - np.repeat(np.cumsum(n) - n, n)
    at, ids, start = lo[segment] + step, ids[segment], begin[segment] + step
    key = _text.span_hash(_text.prefix_sums(buf), start, start + length)
    standing = _standing(ids, at, key)
    later = np.flatnonzero(standing == _LATER)
    lead = np.ones(len(later), bool)
    lead[1:] = (np.diff(later) != 1) | (np.diff(segment[later]) != 0)
    head = later[lead]
    runs = np.diff(np.append(np.flatnonzero(lead), len(later)))
    yield _cut_rows(ids[head] + at[head], ids[head], at[head], runs, np.full(len(head), _SETTLED), [b""] * len(head))
    raw, open_ = buf.tobytes(), np.flatnonzero(standing == _FIRST)
    digests = [hashlib.blake2b(raw[a : a + length], digest_size=16).digest() for a in start[open_].tolist()]
    yield _cut_rows(key[open_].view(np.int64), ids[open_], at[open_], np.ones(len(open_)), np.full(len(open_), -1), digests)


def _cutter(length: int):
    """The bytes of each marked segment, and the byte before it (-1 at a text's start); of hot anchors, the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                marks = part.column("marks")
                counts = np.diff(np.asarray(marks.offsets))
                flat = marks.flatten()
                mark, text = flat.field("mark").to_numpy(), np.repeat(np.arange(part.num_rows), counts)
                anchor, hot = flat.field("anchor").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
                lo, n, ids = mark >> 9, (mark >> 1) & 255, part.column("doc_id").to_numpy()[text]
                begin = offsets[text] + lo
                if hot.any():
                    yield from _windows(buf, begin[hot], ids[hot], lo[hot], n[hot], length)
                    anchor, ids, lo, n, begin = anchor[~hot], ids[~hot], lo[~hot], n[~hot], begin[~hot]
                raw = buf.tobytes()
                pieces = [raw[a:b] for a, b in zip(begin.tolist(), (begin + n + length - 1).tolist(), strict=True)]
                before = np.where(lo > 0, buf[np.maximum(begin - 1, 0)] if len(buf) else 0, -1)
                yield _cut_rows(anchor, ids, lo, n, before, pieces)

    return run


def _window_ranks(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Equal ranks for equal windows, in byte order, by prefix doubling."""
    rank, have = buf.astype(np.uint64), 1
    while have * 2 <= length:
        pair = rank[:-have] << np.uint64(32) | rank[have:]
        if have <= 2:  # up to four bytes are their own rank
            rank = rank[:-have] << np.uint64(8 * have) | rank[have:]
        else:
            rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
        have *= 2
    return np.unique(rank[starts] << np.uint64(32) | rank[starts + length - have], return_inverse=True)[1]


def maximal_repeats(texts: list[bytes], before: list[int], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of at least ``least`` bytes in short texts: (length, occurrences as (text, start)).

    before: the byte before each text. An occurrence at a text's start counts as preceded by a byte of
    its own unless all of them are; repeats that reach a text's end are cut there. Equal texts aren't expected."""
    sizes = np.array([len(t) for t in texts])
    buf = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes)])
    windows = np.maximum(sizes - least + 1, 0)
    text = np.repeat(np.arange(len(texts)), windows)
    own = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    starts = first[text] + own
    if len(starts) < 2:
        return []
    rank = _window_ranks(buf, starts, least)
    # Only windows that repeat, and of those only groups with different bytes before them, can begin a maximal repeat.
    previous = np.where(own > 0, buf[np.maximum(starts - 1, 0)].astype(np.int64), 256 + text)
    low, high = np.full(rank.max() + 1, 1 << 40), np.full(rank.max() + 1, -1)
    np.minimum.at(low, rank, previous)
    np.maximum.at(high, rank, previous)
    some = np.flatnonzero(low[rank] < high[rank])
    if not len(some):
        return []
    # The enhanced suffix array of these starts: order, common prefixes, bytes before.
    most = int(sizes.max())
    left = first[text[some] + 1] - starts[some]
    cells = buf[np.minimum(starts[some][:, None] + np.arange(most), len(buf) - 1)].astype(">u2") + 1
    cells[np.arange(most) >= left[:, None]] = 0
    order = np.argsort(np.ascontiguousarray(cells.astype(">u2")).view(f"V{2 * most}").ravel(), kind="stable")
    cells, suffix = cells[order], some[order]
    differ = (cells[1:] != cells[:-1]) | (cells[1:] == 0)
    common = np.where(differ.any(1), differ.argmax(1), most)
    return _scan(common.tolist(), previous[suffix].tolist(), list(zip(text[suffix].tolist(), own[suffix].tolist(), strict=True)), least)


def _scan(common: list[int], previous: list[int], places: list[tuple[int, int]], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Stack scan of the common prefixes of neighbours: intervals with different bytes before, the longest first of nested ones."""
    found = []
    stack: list[list] = []  # common prefix, left end, the one byte before (None: several)
    for i, depth in enumerate([*common, 0]):
        left, kind = i, previous[i]
        while stack and stack[-1][0] > depth:
            d, l, k = stack.pop()
            kind = k if k == kind else None
            left = l
            if kind is None:
                found.append((d, places[l : i + 1]))
        if depth >= least:
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == kind else None
            else:
                stack.append([depth, left, kind])
    return found


def _settle(rows: list[tuple], length: int, out: list[tuple[int, int, int]]) -> list[tuple]:
    """Rows (anchor, id, lo, n, before, bytes) of whole or begun anchors, in order: spans to remove go to out; returned are
    the rows with windows not seen before."""
    distinct: dict[tuple, tuple] = {}
    for r in rows:
        kept = distinct.setdefault((r[0], r[5]), r)
        if kept is not r and (kept[1], kept[2]) != (r[1], r[2]):
            out.append((r[1], r[2], r[2] + r[3] + length - 1))
    per_anchor: dict[int, int] = {}
    for anchor, _ in distinct:
        per_anchor[anchor] = per_anchor.get(anchor, 0) + 1
    differing = [r for r in distinct.values() if per_anchor[r[0]] > 1]
    if differing:
        settled: set[tuple[int, int]] = set()
        for size, places in maximal_repeats([r[5] for r in differing], [r[4] for r in differing], length):
            begin = [(differing[t][1], differing[t][2] + o, t, o) for t, o in places]
            least = min(begin)
            for b in begin:
                if b != least and (b[2], b[3]) not in settled and b[:2] != least[:2]:
                    settled.add((b[2], b[3]))
                    out.append((b[0], b[1], b[1] + size))
    return list(distinct.values())


def _repeats(length: int):
    """Spans to remove; rows come sorted by (anchor, doc_id, lo)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        out: list[tuple[int, int, int]] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "end"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "lo", "n", "before", "bytes")), strict=True):
                if row[4] == _SETTLED:
                    out.append((row[1], row[2], row[2] + row[3] + length - 1))
                    if len(out) >= BLOCK_SPANS:
                        yield flush()
                    continue
                if size >= BLOCK_BYTES:
                    left = _settle(held, length, out)
                    # What is new of an anchor that goes on stays.
                    held = [r for r in left if r[0] == row[0]]
                    size = sum(r[3] + length - 1 for r in held) // 2
                    yield flush()
                held.append(row)
                size += row[3] + length - 1
        _settle(held, length, out)
        yield flush()

    return run


def _one_text_each(read: DataFrame) -> None:
    """Places are told apart by doc_id, so an id can't stand for two texts."""
    key = F.xxhash64("text")
    twice = read.groupBy("doc_id").agg(F.min(key).alias("a"), F.max(key).alias("b")).where("a != b").select("doc_id").limit(5).collect()
    if twice:
        raise ValueError(f"one doc_id has several texts, such as {sorted(r.doc_id for r in twice)}")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(doc_id, start, end)``: bytes that are in a ``length``-byte string with an earlier occurrence; spans overlap."""
    if not 0 <= length - gram < 255:
        raise ValueError("a window may hold 1 to 255 anchors")
    read = identified(docs)
    _one_text_each(read)
    marks = read.mapInArrow(_marker(length, gram), "anchor long, doc_id long, mark long")
    open_ = F.col("mark").bitwiseAND(F.lit(1)) == 0
    # One shuffle of numbers; repeats that are settled lie apart from the anchors.
    several = marks.withColumn("n", F.count(F.when(open_, 1)).over(Window.partitionBy("anchor")))
    most = BLOCK_BYTES // (2 * length - gram)  # segments of the greatest size in a block
    marked = written(several.where((F.col("n") > 1) | ~open_).withColumn("hot", F.col("n") > most).drop("n"), "marks")
    lists = marked.where(open_).groupBy("doc_id").agg(F.array_distinct(F.collect_list(F.struct("anchor", "mark", "hot"))).alias("marks"))
    cut = read.join(lists, "doc_id").mapInArrow(_cutter(length), _CUT)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "lo").mapInArrow(_repeats(length), "doc_id long, start long, end long")
    lo, n = F.shiftrightunsigned("mark", 9), F.shiftrightunsigned("mark", 1).bitwiseAND(F.lit(255))
    sent = marked.where(~open_).select("doc_id", lo.alias("start"), (lo + n + (length - 1)).alias("end"))
    return found.unionByName(sent)


def _merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _remover(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, gone, parts, at = text.encode(), _merged(spans), [], 0
                for a, b in gone:
                    parts.append(raw[at:a])
                    at = b
                left = b"".join([*parts, raw[at:]])
                rows.append((key, len(raw), sum(b - a for a, b in gone), len(gone), hashlib.sha256(left).hexdigest(), *([left] if keep_text else [])))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = list(zip(*rows, strict=True)) or [()] * (5 + keep_text)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; ``kept``, the bytes left, if asked for."""
    spans = written(repeated_spans(docs, length, gram), "spans")
    lists = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return identified(docs).join(lists, "doc_id", "left").mapInArrow(_remover(keep_text), schema)
