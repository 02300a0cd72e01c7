"""Conversation prefix trie: how much of conversations is shared, node by node.

Conversations are ordered by turn (null first; ties by the code of role and text). A turn's code is the MD5 of its role
and text. Every conversation is rebuilt from the first turns of another one and its own later ones (:func:`rebuilt`); conversations of
the same codes become one sequence, whose members' ids are joined block by block of ids.

Sequences are dealt over shards by range and sorted, so all that starts alike stands together. A shard numbers its codes in their order and
puts its sequences into a ternary search tree, medians first, so that siblings are balanced; a node is made after its parent, so a pass over
the nodes backwards adds up members, leaves and savings. Only nodes on the paths of a shard's first and last sequence can go
on in other shards: these boundary nodes are added up by the digest of their path, and then along each path, each
counted on one of the paths it is on. All that reaches no further than its shard is final there.

A task holds one shard's nodes and one conversation's codes (16 bytes a turn), never texts. Ids of a sequence's members are
hashed as a stream, up to 4,096 a row.

Null roles and texts are empty. Rows with a null conv_id are left out; repeated rows are turns of their own. A conversation
without turns left is a member of the root. An empty table has no nodes. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._tables import written

SPACES = "[\\x20\\x09-\\x0D]+"
GROUP = 20
SHARD_TURNS = 100_000
BLOCK_BITS = 12
NO_ENDS = hashlib.sha256(b"").hexdigest()
_NODES = "shard int, path int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, words long, node binary, parent binary"
_KINDS = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in _NODES.split(", ")]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: its turns in order, as an array of (code, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    code = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("code")
    words = F.size(F.filter(F.split(text, SPACES), lambda w: w != "")).alias("words")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), code, words).alias("turn"))
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn"), _by_turn), lambda t: F.struct(t["code"].alias("code"), t["words"].alias("words"))).alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    less, more = F.lit(-1), F.lit(1)
    turn = F.when(a["turn"] < b["turn"], less).when(a["turn"] > b["turn"], more).when(a["turn"].isNull() & b["turn"].isNotNull(), less).when(a["turn"].isNotNull() & b["turn"].isNull(), more)
    return F.coalesce(turn, F.when(a["code"] < b["code"], less).when(a["code"] > b["code"], more).otherwise(0))


def rebuilt(of: DataFrame, group: int = GROUP) -> DataFrame:
    """conv_id and turns: conversation c starts with the first h turns of conversation c - c % group, h = crc32(c) % 4, and goes on with its own turns after its first h."""
    heads = of.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    own = of.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    none = F.slice("turns", 1, 0)
    joined = own.join(heads.hint("merge"), "base", "left")
    return joined.select("conv_id", F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def blocks(of: DataFrame) -> DataFrame:
    """turns, block, ids: members of each sequence, up to 4,096 ids a row, comma-joined; least and n: the smallest, and how many."""
    ids = F.array_sort(F.collect_list("conv_id"))
    joined = F.array_join(F.transform(ids, lambda i: i.cast("string")), ",")
    return of.groupBy("turns", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(joined.alias("ids"), F.min("conv_id").alias("least"), F.count("*").alias("n"))


class Trie:
    """A ternary search tree of sequences of numbers; node 0 is the root, and each node is made after its parent."""

    def __init__(self) -> None:
        self.key, self.parent, self.depth = [-1], [-1], [0]
        self.low, self.high, self.below = [0], [0], [0]  # 0: none, as no link leads to the root
        self.n, self.least, self.ends = [0], [None], [None]

    def _made(self, key: int, parent: int) -> int:
        for column, value in ((self.key, key), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.low, 0), (self.high, 0), (self.below, 0), (self.n, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return len(self.key) - 1

    def _child(self, at: int, key: int) -> int:
        links, i = self.below, at
        while node := links[i]:
            if key == self.key[node]:
                return node
            links, i = (self.low if key < self.key[node] else self.high), node
        links[i] = self._made(key, at)
        return links[i]

    def insert(self, sequence: list[int], n: int, least: int, ends: str) -> list[int]:
        """n members end here, of which the smallest is ``least``. The nodes passed, root first."""
        at, path = 0, [0]
        for key in sequence:
            at = self._child(at, key)
            path.append(at)
        for i in path:
            self.n[i] += n
            self.least[i] = least if self.least[i] is None else min(least, self.least[i])
        self.ends[at] = ends
        return path


def medians_first(n: int) -> Iterator[int]:
    """0 .. n-1: the middle, and then the middles of what is left and right of it."""
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            m = (a + b) // 2
            yield m
            todo += [(m + 1, b), (a, m)]


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[bytes, int]], int, int, str]]:
    """Each sequence of sorted blocks, with how many members end there, the smallest, and the digest of them all."""
    now = None
    for batch in batches:
        rows = zip(batch.column("turns").to_pylist(), batch.column("ids").to_pylist(), batch.column("least").to_pylist(), batch.column("n").to_pylist(), strict=True)
        for turns_, ids, least, n in rows:
            turns_ = [(t["code"], t["words"]) for t in turns_]
            if now is not None and turns_ == now:
                digest.update(b"," + ids.encode())
                total, first = total + n, min(first, least)
                continue
            if now is not None:
                yield now, total, first, digest.hexdigest()
            now, total, first, digest = turns_, n, least, hashlib.sha256(ids.encode())
    if now is not None:
        yield now, total, first, digest.hexdigest()


def shard_nodes(shard: int, sequences: list[tuple[list[tuple[bytes, int]], int, int, str]]) -> Iterator[tuple]:
    """Rows of ``_NODES``: path 0 for what is final but for its parent's id (where ``parent`` is given), 1 and 2 for nodes on the first and last path."""
    words_of = {code: w for turns_, *_ in sequences for code, w in turns_}
    codes = sorted(words_of)  # so that numbers are in the order of the sequences
    words, numbers = [words_of[c] for c in codes], {c: i for i, c in enumerate(codes)}
    coded = [[numbers[code] for code, _ in turns_] for turns_, *_ in sequences]
    trie = Trie()
    paths = {}
    for m in medians_first(len(sequences)):
        path = trie.insert(coded[m], *sequences[m][1:])
        if m in (0, len(sequences) - 1):
            paths[m] = path
    on_path = [paths[0], paths[len(sequences) - 1]]
    edge = {i for path in on_path for i in path}
    digest = {}
    for path in on_path:
        for i in path:
            digest[i] = hashlib.md5(digest[trie.parent[i]] + codes[trie.key[i]]).digest() if i else b""
    size = len(trie.key)
    kids, leaves, saved = [0] * size, [0] * size, [0] * size
    for i in range(size - 1, -1, -1):
        if i in edge:  # its own part is known when all shards are
            continue
        leaves[i] = leaves[i] or 1
        saved[i] += (trie.n[i] - 1) * words[trie.key[i]]
        p = trie.parent[i]
        kids[p], leaves[p], saved[p] = kids[p] + 1, leaves[p] + leaves[i], saved[p] + saved[i]
        on = p in edge
        yield shard, 0, trie.least[i], trie.depth[i], None if on else trie.least[p], trie.n[i], kids[i], leaves[i], saved[i], trie.ends[i] or NO_ENDS, None, None, digest[p] if on else None
    for side, path in enumerate(on_path, 1):
        for i in path:
            w = words[trie.key[i]] if i else 0
            yield shard, side, trie.least[i], trie.depth[i], None, trie.n[i], kids[i], leaves[i], saved[i], trie.ends[i], w, digest[i], digest[trie.parent[i]] if i else None


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    sequences = list(_sequences(batches))
    if not sequences:
        return
    rows = []
    for row in shard_nodes(TaskContext.get().partitionId(), sequences):
        rows.append(row)
        if len(rows) == 10_000:
            yield _batch(rows)
            rows = []
    yield _batch(rows)


def merged_boundary(edges: DataFrame) -> DataFrame:
    """One row a boundary node, its counts over all shards; ``edges``: rows of the first and last paths."""
    # A node on both paths of a shard stands there twice with the same values.
    once = edges.groupBy("shard", "node").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "words")])
    total = lambda c: F.sum(c).alias(c)
    nodes = once.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.max("ends_sha256").alias("ends_sha256"),
        total("n_convs"), total("n_children"), total("n_leaves"), total("saved_tokens"),
    )
    nodes = written(nodes, "boundary")
    kids = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("more"))
    own = nodes.join(kids.hint("merge"), "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more")
    own = own.withColumn("n_leaves", F.col("n_leaves") + F.when(F.col("n_children") == 0, 1).otherwise(0)).withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words"))
    # Each node's own part goes to all above it along one path that it is on.
    paths = edges.select("shard", "path", "node")
    owner = paths.groupBy("node").agg(F.min(F.struct("shard", "path")).alias("owner"))
    parts = paths.join(owner.join(own.select("node", "depth", "n_leaves", "saved_tokens"), "node").hint("merge"), "node")
    mine = F.struct("shard", "path") == F.col("owner")
    up = Window.partitionBy("shard", "path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    summed = parts.select("node", F.sum(F.when(mine, F.col("n_leaves")).otherwise(0)).over(up).alias("n_leaves"), F.sum(F.when(mine, F.col("saved_tokens")).otherwise(0)).over(up).alias("saved_tokens"))
    summed = summed.groupBy("node").agg(total("n_leaves"), total("saved_tokens"))
    return own.drop("n_leaves", "saved_tokens").join(summed.hint("merge"), "node")


def trie(of: DataFrame) -> DataFrame:
    """Per node of the trie over ``of(conv_id, turns)``: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    packed = written(blocks(of), "sequences")
    shards = 1 + (packed.agg(F.sum(F.size("turns") + 1)).first()[0] or 0) // SHARD_TURNS
    dealt = packed.repartitionByRange(max(shards, of.sparkSession.sparkContext.defaultParallelism), "turns").sortWithinPartitions("turns", "block")
    nodes = written(dealt.select("turns", "ids", "least", "n").mapInArrow(_shards, _NODES), "nodes")
    edges = nodes.where("path > 0")
    boundary = written(merged_boundary(edges), "merged")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    least = boundary.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    final = nodes.where("path = 0 AND parent IS NULL").select(*columns)
    # A shard's rows below one boundary node are fewer than the shard's; nodes of one parent in all shards have no bound.
    here = edges.select("shard", F.col("node").alias("parent")).distinct().join(least.hint("merge"), "parent")
    below = nodes.where("path = 0 AND parent IS NOT NULL").drop("parent_conv_id").join(here.hint("merge"), ["shard", "parent"]).select(*columns)
    on = boundary.join(least.hint("merge"), "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))).select(*columns)
    return final.unionByName(below).unionByName(on)


def shared_prefixes(conversations: DataFrame, group: int = GROUP) -> DataFrame:
    """The trie of the rebuilt conversations."""
    return trie(rebuilt(written(turns(conversations), "turns"), group))


# CRC-32 over the digits: a byte is put in, and eight steps follow.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END), 4294967295)"""

ORACLE = f"""
WITH own AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id),
drawn AS (SELECT *, ({_CRC} % 4)::INT AS h FROM own),
built AS (
  SELECT c.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN c.turns[1:0] ELSE b.turns[1:c.h] END, c.turns[c.h + 1:]) AS turns
  FROM drawn c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % {GROUP}),
paths AS (SELECT conv_id, len(turns) AS size, turns, unnest(range(0, len(turns) + 1)) AS depth FROM built),
prefixes AS (SELECT conv_id, depth, size = depth AS ends, turns[1:depth] AS node, coalesce(turns[depth].text, '') AS text FROM paths),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN len(list_filter(regexp_split_to_array(any_value(text), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ELSE 0 END AS words
  FROM prefixes GROUP BY node, depth),
kids AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
parts AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * words AS saved FROM nodes LEFT JOIN kids USING (node)),
sums AS (
  SELECT p.node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM parts v JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node)
SELECT parts.conv_id, parts.depth, parent.conv_id AS parent_conv_id, parts.n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, parts.ends_sha256
FROM parts JOIN sums USING (node) LEFT JOIN nodes parent ON parts.depth > 0 AND parent.node = parts.node[1:parts.depth - 1]
"""
