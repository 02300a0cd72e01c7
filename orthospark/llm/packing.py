"""Packing documents into token sequences by minimum bin slack.

Documents become token ids and then pieces of at most ``capacity`` tokens. Only the number of
pieces of each length (at most ``capacity`` numbers) comes to the driver, which plans bins: the longest
piece left, and with it the fullest combination of available lengths, found by a bitset subset-sum
dynamic program; the combination is taken out as often as the counts allow. The plan, some slots a
length, is broadcast, and every piece takes the slot its rank within its length falls into. Ranks
are made in parts of about ``PART_ROWS`` pieces, ``BUCKETS`` at least, so one common length is never one task's work.

Null and empty texts are one piece that holds the end token alone. Repeated documents are packed as
often as they occur. Rows with a null id are left out. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._tables import identified, written

CAPACITY = 1024
END = 2
BUCKETS, PART_ROWS = 256, 1 << 20
SLICE_BYTES = 1 << 20
#: Bytes of a text for the tokenizer, and texts that it is given at once: what it returns takes many times the ids.
RUN_BYTES, RUNS = 1 << 12, 64
#: A worker keeps ids of chunks of at most so many bytes each; beyond so many together, those that were met again since the last time.
KEPT_LENGTH, KEPT_BYTES = 64, 1 << 22

_loaded: dict[str, tuple] = {}


def _bytes_of(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all chunks, and where each begins, with the end."""
    begin = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
    return np.frombuffer(chunks.buffers()[2] or b"", np.uint8)[begin[0] : begin[-1]], begin - begin[0]


class _Kept:
    """Distinct chunks and their ids, kept from slice to slice. Chunks meet on a hash; whether they are equal is told by their bytes."""

    def __init__(self) -> None:
        self.chunks, self.ids = pa.array([], pa.large_binary()), pa.array([], pa.large_list(pa.uint32()))
        self.hashes, self.rows, self.again = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.n_bytes = 0

    def find(self, chunks: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The row of each chunk, -1 where there is none."""
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        inside = at < len(self.hashes)
        order, at = order[inside], at[inside]
        met = self.hashes[at] == hashes[order]
        order, row = order[met], self.rows[at[met]]
        equal = pc.equal(chunks.take(pa.array(order)), self.chunks.take(pa.array(row))).to_numpy(zero_copy_only=False)
        found = np.full(len(chunks), -1, np.int64)
        found[order[equal]] = row[equal]
        self.again[row[equal]] = True
        return found

    def add(self, chunks: pa.Array, hashes: np.ndarray, ids: pa.Array) -> None:
        rows = np.concatenate([self.rows, np.arange(len(self.chunks), len(self.chunks) + len(chunks))])
        both = np.concatenate([self.hashes, hashes])
        order = np.argsort(both, kind="stable")
        self.hashes, self.rows, self.again = both[order], rows[order], np.append(self.again, np.zeros(len(chunks), bool))
        self.chunks, self.ids = pa.concat_arrays([self.chunks, chunks]), pa.concat_arrays([self.ids, ids])
        self.n_bytes += int(_bytes_of(chunks)[1][-1])

    def thin(self) -> None:
        """Leaves out what wasn't met again since the last time."""
        old, stay = self.again, np.flatnonzero(self.again)
        self.hashes, self.rows = self.hashes[old[self.rows]], (np.cumsum(old) - 1)[self.rows[old[self.rows]]]
        self.chunks, self.ids, self.again = self.chunks.take(pa.array(stay)), self.ids.take(pa.array(stay)), np.zeros(len(stay), bool)
        self.n_bytes = int(_bytes_of(self.chunks)[1][-1])


def _load(vocabulary: str):
    """The tokenizer, how many bytes each id stands for, and the chunks kept; once a worker."""
    if vocabulary not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are what runs side by side
        from tokenizers import Tokenizer

        reader = Tokenizer.from_file(vocabulary)
        sizes = np.zeros(reader.get_vocab_size(), np.int64)
        for token, i in reader.get_vocab().items():
            sizes[i] = len(token)  # a byte-level vocabulary spells each byte as one character
        for i, token in reader.get_added_tokens_decoder().items():
            sizes[i] = len(token.content.encode())
        _loaded[vocabulary] = reader, sizes, _Kept()
    return _loaded[vocabulary]


def _chunk_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts can be cut without changing their tokens: before a space or line end that follows a letter or sign.

    No pre-token has a space after something else, so one always ends there. Bytes that may end
    a non-ASCII space aren't cut after."""
    cut = np.zeros(len(buf), bool)
    before = buf[:-1]
    plain = (before > 0x20) & (before < 0x7F)
    plain[1:] |= (before[1:] >= 0x80) & (buf[:-2] >= 0xC3) & (buf[:-2] < 0xE0)
    cut[1:] = plain & ((buf[1:] == 0x20) | (buf[1:] == 0x0A))
    cut[offsets[:-1][offsets[:-1] < len(buf)]] = True
    return np.flatnonzero(cut)


def _encode(chunks: pa.Array, reader, sizes: np.ndarray) -> pa.Array:
    """Ids of each chunk, as lists."""
    buf, bounds = _bytes_of(chunks)
    begin, stop, raw = bounds[:-1], bounds[1:], buf.tobytes()
    # A chunk that starts with a space and doesn't end with one keeps its tokens when such chunks are joined.
    joins = ((buf[begin] == 0x20) | (buf[begin] == 0x0A)) & (buf[stop - 1] > 0x20) & (buf[stop - 1] < 0x7F)
    order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
    length = (stop - begin)[order]
    n_joined = int(joins.sum())
    run = np.cumsum(length[:n_joined]) // RUN_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), *range(n_joined, len(order) + 1)] if n_joined else list(range(len(order) + 1))
    found: list[np.ndarray] = []
    for at in range(0, len(cuts) - 1, RUNS):
        spans = zip(cuts[at : at + RUNS], cuts[at + 1 : at + RUNS + 1], strict=False)
        texts = [b"".join([raw[a:b] for a, b in zip(begin[order[lo:hi]].tolist(), stop[order[lo:hi]].tolist(), strict=True)]).decode() for lo, hi in spans]
        found += [np.array(e.ids, np.uint32) for e in reader.encode_batch_fast(texts, add_special_tokens=False)]
    tokens = np.concatenate(found) if found else np.zeros(0, np.uint32)
    # Where the chunks' bytes end, their tokens do.
    last = np.searchsorted(np.cumsum(sizes[tokens]), np.cumsum(length), "left") + 1
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], last]), pa.int64()), pa.array(tokens))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return lists.take(pa.array(place))


def token_ids(buf: np.ndarray, offsets: np.ndarray, vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of consecutive texts and where each text's begin. A distinct chunk is encoded once, and not again while the worker keeps it."""
    reader, sizes, kept = _load(vocabulary)
    if kept.n_bytes >= KEPT_BYTES:
        kept.thin()
    start = _chunk_starts(buf, offsets)
    spans = [None, pa.py_buffer(np.append(start, len(buf)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), spans).dictionary_encode()
    chunks, inverse = coded.dictionary, coded.indices.to_numpy()
    data, bounds = _bytes_of(chunks)
    hashes = _text.span_hash(_text.prefix_sums(data), bounds[:-1], bounds[1:])

    row = kept.find(chunks, hashes)
    known, new = np.flatnonzero(row >= 0), np.flatnonzero(row < 0)
    encoded = _encode(chunks.take(pa.array(new)), reader, sizes)
    place = np.empty(len(chunks), np.int64)
    place[np.concatenate([known, new])] = np.arange(len(chunks))
    lists = pa.concat_arrays([kept.ids.take(pa.array(row[known])), encoded]).take(pa.array(place[inverse]))
    short = np.flatnonzero(np.diff(bounds)[new] <= KEPT_LENGTH)
    kept.add(chunks.take(pa.array(new[short])), hashes[new[short]], encoded.take(pa.array(short)))
    return lists.values.to_numpy(), lists.offsets.to_numpy()[np.searchsorted(start, offsets)]


def _pieces(vocabulary: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch, most=SLICE_BYTES):
                ids, first = token_ids(buf, offsets, vocabulary)
                ids = ids.astype("<u4")
                rows: list[tuple] = []
                for key, a, b in zip(part.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    own = np.append(ids[a:b], np.uint32(END)).astype("<u4")
                    at, size = 0, (len(own) - 1) % capacity + 1
                    for piece in range(-(-len(own) // capacity)):
                        data = own[at : at + size].tobytes()
                        rows.append((key, piece, at, size, zlib.crc32(data), *([own[at : at + size].astype(np.int32)] if keep_ids else [])))
                        at, size = at + size, capacity
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(rows[0])])

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (how often each length, how many such bins), the fullest first for the longest length left."""
    left = {n: c for n, c in sorted(counts.items(), reverse=True) if c > 0}
    bins = []
    while left:
        longest = next(iter(left))
        room = capacity - longest
        mask, reach = (1 << (room + 1)) - 1, 1
        layers: list[tuple[int, int, int]] = []  # sums reachable before, length, how many at once
        for n, c in left.items():
            if n > room:
                continue
            many, step = min(c - (n == longest), room // n), 1
            while many > 0 and not reach >> room & 1:
                step = min(step, many)
                layers.append((reach, n, step))
                reach |= reach << (n * step) & mask
                many, step = many - step, step * 2
            if reach >> room & 1:
                break
        total, chosen = reach.bit_length() - 1, {longest: 1}
        for before, n, step in reversed(layers):
            if not before >> total & 1:  # not reachable without this layer
                total -= n * step
                chosen[n] = chosen.get(n, 0) + step
        times = min(left[n] // k for n, k in chosen.items())
        bins.append((chosen, times))
        for n, k in chosen.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return bins


def _slots(bins: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces a sequence, offset of the first)."""
    rank: dict[int, int] = {}
    slots, sequence = [], 0
    for chosen, times in bins:
        offset = 0
        for n, k in chosen.items():
            at = rank.get(n, 0)
            slots.append((n, at, at + k * times, sequence, k, offset))
            rank[n] = at + k * times
            offset += n * k
        sequence += times
    return slots


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; ids as well if ``keep_ids``.

    vocabulary: path of a byte-level BPE vocabulary whose pre-tokens hold a space only before other characters."""
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = written(identified(docs).mapInArrow(_pieces(vocabulary, capacity, keep_ids), schema), "pieces")
    parts = max(BUCKETS, pieces.count() // PART_ROWS)
    pieces = pieces.withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = written(pieces.groupBy("length", "__part").agg(F.count("*").alias("__n")), "lengths")
    lengths = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}  # at most ``capacity`` rows
    slots = spark.createDataFrame(_slots(plan(lengths, capacity)), "__length long, __from long, __to long, __sequence long, __each long, __offset long")
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__n")
    ranked = pieces.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__part").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(counts.withColumn("__before", before).drop("__n"), ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    # The plan has some slots for each of at most ``capacity`` lengths.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    nth = F.col("__rank") - F.col("__from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("__sequence") + F.floor(nth / F.col("__each"))).cast("long").alias("sequence_id"), (F.col("__offset") + nth % F.col("__each") * F.col("length")).cast("long").alias("offset"), *(["ids"] if keep_ids else []),
    )
