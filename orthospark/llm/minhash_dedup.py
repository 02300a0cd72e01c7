"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates.

A document is the set of its distinct word shingles. One hash splits the set over ``bands *
rows`` bins; the least value of each bin is the signature, and an empty bin takes the value
of the first filled bin in its own fixed probing order (optimal densification). Each band
of a signature is a bucket key.

Documents with equal sets are one class and go on as its smallest id. The edges are stars: the member of a
bucket that shares most buckets is its hub and is compared with every other, a pair a member. Buckets of one hub are
one group. Groups whose members are then not all in one component get further hubs, in rounds, and only pairs still in different
components are compared; members whose shingles rule out a link with anyone left are put aside. So a group of true copies costs
a pair a member, and no pair that shares a bucket stays undecided. A group of many sets that are all nearly, but not quite,
linked is the costly case: a member that stays possible is held against every further hub. Links are
confirmed on the full shingle sets (64-bit hashes of the shingles).

Null and empty texts have no shingles and are linked with nothing; a text of fewer words than a shingle
is one shingle. Repeated rows give repeated results. Rows with a null id are left out. Only doc_id and
text are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthospark.operators.graph import connected, contracted

from . import _text
from ._tables import apart, identified, written

WORDS = 5
PERCENT = 80
BANDS, ROWS = 40, 5
BINS = BANDS * ROWS
#: Parts over which the members of one group are dealt.
SALTS = 16

#: Row i: the order in which an empty bin i looks for a filled one.
_PROBES = np.argsort(np.random.default_rng(7).random((BINS, BINS)), axis=1)
_C = np.uint64(0xC2B2AE3D27D4EB4F)


def _shingles(buf: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of consecutive texts, sorted within each, and where each text's begin."""
    words = _text.find_words(buf, offsets, _text.SPACE)
    h = words.hashes()
    counts = np.diff(words.first)

    def joined(at: np.ndarray, n: int) -> np.ndarray:
        out = np.full(len(at), n, np.uint64)
        for j in range(n):
            out = _text.mix(out * _C + h[at + j])
        return out

    at = np.arange(max(0, len(h) - k + 1))
    at = at[words.text[at] == words.text[at + k - 1]]
    values, text = [joined(at, k)], [words.text[at]]
    for n in range(1, k):
        few = np.flatnonzero(counts == n)
        values.append(joined(words.first[few], n))
        text.append(few)
    values, text = np.concatenate(values), np.concatenate(text)
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(len(counts) + 1))


def _bands(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket keys, a row a text; meaningless for texts without shingles."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    bins = ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    cell = text * BINS + bins
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]  # values are sorted, so the first of a bin is its least
    signature, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    signature[cell[lead]] = values[lead]
    filled[cell[lead]] = True
    empty = np.flatnonzero(~filled)
    empty = empty[np.diff(first)[empty // BINS] > 0]
    base, own = empty // BINS * BINS, empty % BINS
    for step in range(BINS):
        if not len(empty):
            break
        source = base + _PROBES[own, step]
        found = filled[source]
        signature[empty[found]] = signature[source[found]]
        empty, base, own = empty[~found], base[~found], own[~found]
    rows = signature.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = _text.mix(key * _C + rows[:, :, r])
    return key


def _signer(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                values, first = _shingles(buf, offsets, k)
                sums = [_text.group_sums(_text.mix(values ^ np.uint64(x)), first).view(np.int64) for x in (0x1234567, 0x89ABCDEF0)]
                keys = _bands(values, first).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), lists], ["doc_id", "n", "a", "b", "bands"])

    return run


def _setter(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets in _text.text_slices(batch):
                values, first = _shingles(buf, offsets, k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _text.by_text(values.view(np.int64), first)], ["id", "shingles"])

    return run


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(hub, id, n) with the size of the hub's set, what both share, what the hub has and the other lacks, and
    what the other has of its own."""
    x = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("sx"))
    y = sets.select("id", F.col("shingles").alias("sy"))
    both = pairs.join(x.hint("merge"), "hub").join(y.hint("merge"), "id").withColumn("lacks", F.array_except("sx", "sy"))
    return both.select("hub", "id", "n", F.size("sx").alias("hub_n"), (F.size("sx") - F.size("lacks")).alias("common"), "lacks", F.array_except("sy", "sx").alias("own"))


def _linked(common: Column, n: str, m: str, percent: int) -> Column:
    return common * 100 >= percent * (F.col(n) + F.col(m) - common)


def _grouped(classes: DataFrame) -> DataFrame:
    """``(hub, id, n)``: for every bucket its hub with each other member; buckets of one hub make one group."""
    rows = classes.select(F.col("rep").alias("id"), "n", F.explode("bands").alias("bucket"))
    # All sides grow with the documents, so they are merged at every size.
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").hint("merge")
    shared = written(rows.join(sizes, "bucket"), "buckets")
    weight = shared.groupBy("id").agg(F.sum("size").alias("weight")).hint("merge")
    hubs = shared.join(weight, "id").groupBy("bucket").agg(F.min(F.struct(-F.col("weight"), F.col("id").alias("id")))["id"].alias("hub")).hint("merge")
    return written(shared.join(hubs, "bucket").where("id != hub").groupBy("hub", "id").agg(F.first("n").alias("n")), "members")


def _part() -> Column:
    """Which of the ``SALTS`` parts of its group a member is in."""
    return F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")


def _to_each_part(few: DataFrame) -> DataFrame:
    """A row a group, or a root, for each part of its members, so that a large one's members don't meet it in one task."""
    return few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _open(left: DataFrame, percent: int) -> DataFrame:
    """Of the members the ones that another member may still be linked with: those of groups that
    span several components, if shingles no other member has leave room for it."""
    by_root = left.groupBy("hub", "root").agg(F.count("*").alias("k"), F.min("n").alias("least"), F.max("reach").alias("farthest"))
    groups = by_root.groupBy("hub").agg(F.count("*").alias("roots"), (F.sum("k") - F.max("k")).alias("outside"), F.max_by("root", "k").alias("main"), F.min("least").alias("least"), F.max("farthest").alias("farthest"))
    may = (F.col("reach") >= percent * F.col("least")) & (percent * F.col("n") <= F.col("farthest"))
    return left.join(_to_each_part(groups.where("roots > 1")).hint("merge"), ["hub", "salt"]).where(may).drop("roots", "least", "farthest")


def _joined_stars(new: DataFrame) -> DataFrame:
    """``(node, to)``: a new root for the roots that ``new(root, h_root)`` joins, the least around the hubs each of them meets."""
    stars = new.groupBy("h_root").agg(F.min(F.least("root", "h_root")).alias("to"))
    each = F.explode(F.array("root", "h_root")).alias("node")
    return new.select("root", "h_root").distinct().join(stars.hint("merge"), "h_root").select(each, "to").groupBy("node").agg(F.min("to").alias("to"))


def _further_links(views: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """``links`` and those between members of a group, neither of them its hub, that join different components (as far as
    one contraction a round tells).

    Every round some members of each open group become hubs, four times as many as in the round before: all that are outside the
    group's main component once they are few, else those with the fewest shingles of their own. They are compared with
    the members of other components and then leave, since every pair of theirs is decided. What two members share follows exactly from how both
    differ from the group's hub, so no text is read again."""
    labels = written(contracted(links), "labels")
    # All sides grow with the groups, so they are merged at every size, here and in the rounds.
    rooted = views.join(labels.hint("merge"), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node").withColumn("salt", _part())
    several = rooted.groupBy("hub").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("hub")
    of_open = written(rooted.join(_to_each_part(several).hint("merge"), ["hub", "salt"], "left_semi"), "open")
    alone = of_open.select("hub", "id", F.explode("own").alias("s")).groupBy("hub", "s").agg(F.count("*").alias("k"), F.min("id").alias("id")).where("k = 1").groupBy("hub", "id").agg(F.count("*").alias("alone"))
    left = of_open.join(alone.hint("merge"), ["hub", "id"], "left").withColumn("alone", F.coalesce("alone", F.lit(0)))
    # percent * (size of the other) can't be more than this: shingles that are alone in the group aren't shared.
    left = left.withColumn("reach", 100 * F.col("n") - (100 + percent) * F.col("alone"))
    many, new = 4, None
    while True:
        if new is not None:
            joined = _to_each_part(_joined_stars(new).withColumnRenamed("node", "root"))
            left = left.join(joined.hint("merge"), ["root", "salt"], "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        left = written(_open(left, percent), "open")
        if left.isEmpty():
            return links
        few = F.col("outside") <= many
        chosen = left.where(~few | (F.col("root") != F.col("main"))).groupBy("hub", F.when(few, F.col("id")).otherwise(F.pmod(F.xxhash64("id"), F.lit(many))).alias("draw"))
        as_hub = F.struct(F.col("id").alias("h"), F.col("n").alias("hn"), F.col("reach").alias("hr"), F.col("root").alias("h_root"), F.col("lacks").alias("hl"), F.col("own").alias("ho"))
        hubs = written(chosen.agg(F.min_by(as_hub, F.struct("alone", "id")).alias("x")).select("hub", "x.*"), "hubs")
        left = left.drop("outside", "main")
        sent = _to_each_part(hubs)
        at_most = F.col("hub_n") - F.greatest(F.size("lacks"), F.size("hl")) + F.least(F.size("own"), F.size("ho"))
        shared = F.col("hub_n") - F.size(F.array_union("lacks", "hl")) + F.size(F.array_intersect("own", "ho"))
        near = (F.col("root") != F.col("h_root")) & (percent * F.col("n") <= F.col("hr")) & (percent * F.col("hn") <= F.col("reach"))
        found = left.alias("l").join(sent.hint("merge").alias("s"), (F.col("l.hub") == F.col("s.hub")) & (F.col("l.salt") == F.col("s.salt")) & near & _linked(at_most, "n", "hn", percent) & _linked(shared, "n", "hn", percent))
        new = written(found.select(F.least("id", "h").alias("u"), F.greatest("id", "h").alias("v"), "root", "h_root").distinct(), "links")
        links = links.unionByName(new.select("u", "v"))
        left = left.join(hubs.select("hub", F.col("h").alias("id")).hint("merge"), ["hub", "id"], "left_anti")
        many *= 4


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest id reachable over links of at least
    ``percent`` % similarity), kept (it is that smallest id), n_links of its class (confirmed star edges)."""
    read = identified(docs)
    marks = written(read.mapInArrow(_signer(words), "doc_id long, n long, a long, b long, bands array<long>"), "marks")
    # Documents with equal sets have equal bands: whichever comes first will do.
    classes = written(marks.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    members = _grouped(classes)
    wanted = members.select(F.explode(F.array("hub", "id")).alias("doc_id")).distinct().hint("merge")
    sets = written(read.join(wanted, "doc_id", "left_semi").mapInArrow(_setter(words), "id long, shingles array<long>").dropDuplicates(["id"]), "sets")
    views = written(_compared(members, sets), "views")
    links = written(views.where(_linked(F.col("common"), "hub_n", "n", percent)).select(F.least("hub", "id").alias("u"), F.greatest("hub", "id").alias("v")), "stars")
    links = _further_links(views.drop("common"), links, percent)
    labels = connected(links)
    degree = links.distinct().select(F.explode(F.array("u", "v")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    roots = classes.select("a", "b", "n", "rep").join(labels.hint("merge"), F.col("rep") == F.col("node"), "left").select("a", "b", "n", "rep", F.coalesce("root", "rep").alias("root")).join(degree.hint("merge"), "rep", "left")
    component = F.coalesce("root", "doc_id")
    return marks.select("doc_id", "n", "a", "b").join(roots.hint("merge"), ["a", "b", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest id.
    Documents without words are all kept; so are rows with a null id."""
    name = apart(docs, "gone")
    gone = near_duplicates(docs, words, percent).where(~F.col("kept")).select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


#: Every two documents with a shingle in common are compared; components hand their smallest id on from link to link.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(w[i] || ' ' || coalesce(w[i + 1], '')) AS s FROM (SELECT *, unnest(range(1, greatest(len(w), 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * common >= 80 * (a.n + b.n - common)),
ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, component_id) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM words UNION (
  SELECT w.v, min(r.component_id) FROM reach r JOIN ways w ON w.u = r.doc_id JOIN recurring.reach o ON o.doc_id = w.v WHERE r.component_id < o.component_id GROUP BY ALL))
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM reach LEFT JOIN sizes USING (doc_id)
"""
