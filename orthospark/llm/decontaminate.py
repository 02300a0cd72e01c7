"""Benchmark decontamination with a generalised suffix automaton over words.

The benchmark items, as word sequences, make one automaton. Each document's words stream
through it; the state tells the longest stretch that ends here and occurs in some item.
A stretch of ``window`` words (or a whole shorter item) is a hit.

The benchmark is the broadcast side. Its items are dealt by hash over blocks of about ``BLOCK_WORDS`` words (a longer item
is cut into stretches that share a window less one word); one block at a time comes to the driver and goes to the tasks as an automaton, so
what driver and tasks hold is bounded however long the benchmark is. Every block meets every document (a stated
query set against all rows, in blocks); a benchmark of k blocks reads the documents k times.

Null and empty texts have no words, are never hit and never match; items without words are
ignored; repeated items count each under its own id; repeated documents each get a row, whatever the number of blocks;
documents with a null id are left out of :func:`match`. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._tables import apart, identified, written

WINDOW = 10
BLOCK_WORDS = 100_000

_MATCHED = "doc_id long, key long, n_words long, spans array<struct<start:int,end:int>>, bytes array<struct<start:int,end:int>>, longest int, items array<string>"


class Automaton:
    """Suffix automaton of word sequences; ``found`` lists what ends at a position."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[str]] = {}
        whole: dict[int, dict[int, set[str]]] = {}
        for key, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
                if len(words) >= window:
                    ends.setdefault(last, set()).add(key)
            if len(words) < window:
                whole.setdefault(last, {}).setdefault(len(words), set()).add(key)
        # What a state's words are part of: handed down the suffix links, longest first.
        self.items: list[frozenset[str]] = [frozenset()] * len(self.next)
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        gathered = [ends.get(s, set()) for s in range(len(self.next))]
        for s in order:
            if self.length[s] >= window:
                gathered[self.link[s]] = gathered[self.link[s]] | gathered[s]
        for s in order:
            if self.length[s] >= window > self.length[self.link[s]]:
                self.items[s] = frozenset(gathered[s])
        # Whole short items that end wherever a state's words end.
        self.short: list[tuple[tuple[int, frozenset[str]], ...]] = [()] * len(self.next)
        for s in reversed(order):
            own = tuple((n, frozenset(k)) for n, k in whole.get(s, {}).items())
            self.short[s] = own + self.short[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, w, q)
        cur = self._state({}, -1, length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q)
        return cur

    def _state(self, out: dict[int, int], link: int, length: int) -> int:
        self.next.append(out)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, int, frozenset[str]]]:
        """(last word, words hit, longest match there, items) for each position at which a window ends."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = n = 0
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state = nxt[state][w]
                n += 1
            if n >= window:
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                yield i, window, n, self.items[s]
            for size, keys in self.short[state]:
                if size <= n:
                    yield i, size, n, keys


def _item_words(window: int, most: int):
    """Items as word hashes; of items longer than ``most`` words, stretches that hold every window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                words = _text.find_words(buf, offsets, _text.NOT_ALNUM)
                hashes = words.hashes().view(np.int64)
                rows = []
                for key, a, b in zip(part.column("item").to_pylist(), words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    rows += [(key, hashes[at : min(b, at + most + window - 1)]) for at in range(a, max(a + 1, b - window + 1), most) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.list_(pa.int64()))], ["item", "words"])

    return run


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> tuple[DataFrame, int]:
    """``(item, words, block)``, and the number of blocks."""
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    items = written(rows.mapInArrow(_item_words(window, BLOCK_WORDS), "item string, words array<long>"), "items")
    total = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK_WORDS))
    return items.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))), n


def _matcher(block: list[tuple[str, np.ndarray]], window: int):
    vocab = np.unique(np.concatenate([h for _, h in block])) if block else np.zeros(0, np.uint64)
    automaton = Automaton([(k, np.searchsorted(vocab, h).tolist()) for k, h in block], window)
    least = min([window, *(len(h) for _, h in block)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                yield _match_slice(part, buf, offsets, vocab, automaton, least)

    return run


def _match_slice(part, buf, offsets, vocab, automaton, least) -> pa.RecordBatch:
    words = _text.find_words(buf, offsets, _text.NOT_ALNUM)
    hashes = words.hashes()
    at = np.searchsorted(vocab, hashes)
    known = np.zeros(len(hashes), bool)
    if len(vocab):
        known = vocab[np.minimum(at, len(vocab) - 1)] == hashes
    # Stretches of benchmark words; a match lies within one, and a shorter one holds none.
    edge = np.ones(len(hashes) + 1, bool)
    if len(hashes):
        edge[1:-1] = (known[1:] != known[:-1]) | (words.text[1:] != words.text[:-1])
    cut = np.flatnonzero(edge)
    runs = [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True) if b - a >= least and known[a]]
    n = part.num_rows
    spans, where, longest, items = [[] for _ in range(n)], [[] for _ in range(n)], [0] * n, [set() for _ in range(n)]
    for a, b in runs:
        d = int(words.text[a])
        for i, size, length, keys in automaton.stream(at[a:b].tolist()):
            lo, hi = a + i + 1 - size, a + i + 1
            longest[d] = max(longest[d], length)
            items[d] |= keys
            if spans[d] and lo <= spans[d][-1][1]:
                while len(spans[d]) > 1 and lo <= spans[d][-2][1]:
                    spans[d].pop()
                spans[d][-1] = (min(lo, spans[d][-1][0]), hi)
            else:
                spans[d].append((lo, hi))
    for d in range(n):
        where[d] = [{"start": int(words.start[a] - offsets[d]), "end": int(words.end[b - 1] - offsets[d])} for a, b in spans[d]]
        spans[d] = [{"start": a - int(words.first[d]), "end": b - int(words.first[d])} for a, b in spans[d]]
    pair = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id"), part.column("key"), pa.array(np.diff(words.first).astype(np.int64)), pa.array(spans, pair), pa.array(where, pair), pa.array(longest, pa.int32()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        ["doc_id", "key", "n_words", "spans", "bytes", "longest", "items"],
    )


def match(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document, with a hash of its text (key): its words, hit spans in words and in bytes of the text, the longest match, and the items hit."""
    read = identified(docs).withColumn("key", F.xxhash64("text"))
    items, n = _blocks(benchmark, item_id, item_text, window)

    def part(b: int) -> DataFrame:
        block = [(r["item"], np.array(r["words"], np.int64).view(np.uint64)) for r in items.where(F.col("block") == b).select("item", "words").collect()]  # about BLOCK_WORDS words
        return read.mapInArrow(_matcher(block, window), _MATCHED)

    first = part(0)
    if n == 1:
        return first
    # A row for each document from the first block, hits from the others; they meet by id and text, so repeated rows stay rows.
    first, more = written(first, "matched"), None
    for b in range(1, n):
        hits = written(part(b).where(F.size("items") > 0).dropDuplicates(["doc_id", "key"]), "matched")
        more = hits if more is None else more.unionByName(hits)
    listed = more.groupBy("doc_id", "key").agg(*[F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("spans", "bytes", "items")], F.max("longest").alias("more_longest"))
    both = first.join(listed, ["doc_id", "key"], "left")
    joined = lambda c: F.array_sort(F.concat(c, F.coalesce(f"more_{c}", F.array().cast(first.schema[c].dataType))))
    return both.select("doc_id", "key", "n_words", _merge_spans(joined("spans")).alias("spans"), _merge_spans(joined("bytes")).alias("bytes"), F.greatest("longest", "more_longest").alias("longest"), F.array_distinct(joined("items")).alias("items"))


def _merge_spans(spans):
    """Sorted spans with those that touch or overlap made one."""
    one = lambda s, e: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"))

    def add(done, s):
        last = F.element_at(done, -1)
        return F.when((F.size(done) > 0) & (s["start"] <= last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(one(last["start"], F.greatest(last["end"], s["end"]))))).otherwise(F.concat(done, F.array(one(s["start"], s["end"]))))

    return F.when(F.size(spans) > 0, F.aggregate(F.slice(spans, 2, F.size(spans)), F.slice(spans, 1, 1), add)).otherwise(spans)


def report(matched: DataFrame) -> DataFrame:
    """Counts and digests of :func:`match`."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return matched.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist(), strict=True):
            raw, parts, at = text.encode(), [], 0
            for s in spans:
                parts.append(raw[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*parts, raw[at:]]).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(kept, pa.string())], ["doc_id", "key", "kept"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = 0, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark passages: spans of more than ``max_words`` words are cut out of the text (by default every hit
    is), whole documents go where hit words are more than ``max_coverage`` of all. Columns stay; n_chars,
    where there is one, follows the text. Documents without hits, and those with a null id, pass through unchanged; of repeated
    rows each is cut, and two texts under one id are judged and cut each for itself."""
    hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["start"])
    long_ = F.filter("bytes", lambda b, i: F.element_at("spans", i + 1)["end"] - F.element_at("spans", i + 1)["start"] > max_words)
    found = match(docs, benchmark, window).where(F.size("spans") > 0)
    found = written(found.select("doc_id", "key", (hit > max_coverage * F.col("n_words")).alias("drop"), long_.alias("cut")).dropDuplicates(["doc_id", "key"]), "contaminated")
    texts = identified(docs).withColumn("key", F.xxhash64("text")).join(found.where(~F.col("drop") & (F.size("cut") > 0)), ["doc_id", "key"])
    cut = texts.select("doc_id", "key", "text", "cut").mapInArrow(_cut, "doc_id long, key long, kept string").dropDuplicates(["doc_id", "key"])
    id_, key, kept = (apart(docs, c) for c in ("of", "key", "kept"))
    same = (F.col("doc_id") == F.col(id_)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(key))
    named = lambda df, *more: df.select(F.col("doc_id").alias(id_), F.col("key").alias(key), *more)
    out = docs.join(named(found.where("drop")), same, "left_anti").join(named(cut, F.col("kept").alias(kept)), same, "left")
    changed = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changed).select(*docs.columns)


ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least({WINDOW}, len(w)) AS k FROM items WHERE len(w) > 0))),
places AS (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k),
found AS MATERIALIZED (SELECT doc_id, i, p.k, item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM places) p JOIN windows USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT at_) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS at_ FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""
