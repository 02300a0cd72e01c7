"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Five filters fail a text: A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals ``[A-Z]`` > 10 *
code points; D: it holds any of ``#$%&*|``; E: it is identical to the text of a smaller doc_id.

Only E needs other documents. Two cells of a counting Bloom sketch are counted up for every text: each task's
counts are its sketch, and adding them up cell by cell merges the sketches. A text with a cell counted
once is certainly unique. The cells counted twice or more, one bit each, are broadcast; the texts that hit two of them
are shuffled, whole, for the smallest id of each text, each task's copies as one row. The sketch has
``CELLS_PER_TEXT`` cells a text, ``MOST_CELLS`` at most (a bit each: 64 MB); with more texts it clears fewer, so more
are shuffled, and results are the same. Give ``most_cells`` what executors can hold.

Every document thus has a mask of failed filters. Counts by mask are additive: all orders are read off at most 32 rows a part.

Null texts are empty: they fail A, and all but the first E. Null and empty lang are one part. Rows with a null id are
left out. Repeated rows count as often as they occur; they don't fail E for each other, as their id isn't
smaller. Two texts under one id are two rows. A document with several labels has a flag if any of them says 1. An empty
table gives no rows. Only doc_id, text, lang and the labels' doc_id, quality and toxic are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import written

SPACES = "[\\x20\\x09-\\x0D]+"
FILTERS = "ABCDE"
CELLS_PER_TEXT = 16
MOST_CELLS = 1 << 29
_BITMAP = 1 << 15  # bits of one bitmap of bitmap_construct_agg


def _read(docs: DataFrame) -> DataFrame:
    part, text = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text")
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), part, text, F.xxhash64(text).alias("key"))


def own_failures() -> Column:
    """Bits of A, B, C and D, from words and text."""
    n = F.size("words")
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    failed = [n < 100, 100 * F.size(F.array_distinct("words")) < 80 * n, 100 * capitals.cast("long") > 10 * F.length("text"), F.col("text").rlike("[#$%&*|]")]
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failed[1:], 1)), F.when(failed[0], 1).otherwise(0))


def sketch_cells(texts: int, most_cells: int = MOST_CELLS) -> int:
    """A power of two, of one bitmap at least."""
    return min(most_cells, max(_BITMAP, 1 << (CELLS_PER_TEXT * max(texts, 1) - 1).bit_length()))


def repeated_cells(keys: DataFrame, cells: int) -> np.ndarray:
    """A bit for each cell, set where it was counted twice or more; ``cells`` / 8 bytes."""
    low, high = F.col("key").bitwiseAND(F.lit(cells - 1)), F.shiftrightunsigned("key", 32).bitwiseAND(F.lit(cells - 1))
    # A text whose two cells are one counts once in it. Spark's bitmaps number bits from 1.
    counted = keys.select(F.explode(F.array_distinct(F.array(low + 1, high + 1))).alias("bit")).groupBy("bit").agg(F.count("*").alias("n")).where("n > 1")
    maps = counted.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros((cells // _BITMAP, _BITMAP // 8), np.uint8)
    for r in maps.collect():
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def may_repeat(spark: SparkSession, keys: DataFrame, most_cells: int = MOST_CELLS) -> Callable[[Column], Column]:
    """A test of keys against the merged sketch of ``keys``: false for certainly unique ones."""
    cells = sketch_cells(keys.count(), most_cells)
    sketch = spark.sparkContext.broadcast(repeated_cells(keys, cells))

    @F.pandas_udf("boolean")
    def test(key: pd.Series) -> pd.Series:
        bits, k = sketch.value, key.to_numpy().view(np.uint64)
        low, high = k & np.uint64(cells - 1), (k >> np.uint64(32)) & np.uint64(cells - 1)
        hit = [(bits[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8)) & 1 for c in (low, high)]
        return pd.Series((hit[0] & hit[1]).astype(bool))

    return test


def flagged(docs: DataFrame, labels: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """doc_id, part, mask (bit i: fails filter i of ``FILTERS``), good and toxic (1 or 0) of every document."""
    words = _read(docs).withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    own = written(words.select("doc_id", "part", "key", own_failures().alias("own")), "failures")  # some numbers a document
    may = may_repeat(docs.sparkSession, own.select("key"), most_cells)
    possible = _read(docs).select("doc_id", "text", "key").where(may("key"))
    first = possible.groupBy("key", "text").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_set("key").alias("firsts"))
    said = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(said("quality"), said("toxic"))
    joined = own.withColumn("may", may("key")).join(written(first, "firsts").hint("merge"), "doc_id", "left").join(known.hint("merge"), "doc_id", "left")
    copy = F.col("may") & ~F.coalesce(F.array_contains("firsts", F.col("key")), F.lit(False))
    return joined.select("doc_id", "part", (F.col("own") + F.when(copy, 16).otherwise(0)).alias("mask"), F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def mask_counts(flags: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows a part."""
    return flags.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def by_order(counts: DataFrame) -> DataFrame:
    """Counts by mask, read off for each order of the filters and each of its steps."""
    orders = ["".join(p) for p in itertools.permutations(FILTERS)]
    steps = counts.withColumn("filter_order", F.explode(F.lit(orders))).withColumn("step", F.explode(F.lit(list(range(1, len(FILTERS) + 1)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    here, before = bits(F.substr("filter_order", "step", F.lit(1))), bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))
    masked = steps.withColumn("here", here).withColumn("before", before).withColumn("fails", F.col("mask").bitwiseAND(F.col("here")) > 0).withColumn("gone", F.col("mask").bitwiseAND(F.col("before")) > 0)
    total = lambda of, when: F.coalesce(F.sum(F.when(when, F.col(of))), F.lit(0)).alias
    fails, gone = F.col("fails"), F.col("gone")
    # A document is removed by each of its k failing filters in 120 / k of the orders.
    share = F.coalesce(F.sum(F.when(fails, F.col("n") * F.lit(len(orders)).cast("long") / F.bit_count("mask"))), F.lit(0.0)).cast("long")
    return masked.groupBy("part", "filter_order", "step").agg(
        total("n", ~fails & ~gone)("kept"), total("n", fails & ~gone)("removed"), total("n", fails & gone)("redundant"), total("n", F.col("mask") == F.col("here"))("unique_fails"),
        total("good", fails & ~gone)("good_lost"), total("toxic", fails & ~gone)("toxic_lost"), share.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """Per part, filter_order (120) and step (1 to 5): kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return by_order(mask_counts(flagged(docs, labels, most_cells)))


_LETTERS = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(FILTERS))

ORACLE = f"""
WITH letters(x, b) AS (VALUES {_LETTERS}),
read AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents WHERE doc_id IS NOT NULL),
flags AS (
  SELECT doc_id, part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask FROM read),
known AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
counts AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM letters a, letters b, letters c, letters d, letters e
  WHERE (a.b | b.b | c.b | d.b | e.b) = {(1 << len(FILTERS)) - 1}),
steps AS (SELECT filter_order, step, bits[step] AS here, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
seen AS (SELECT *, (mask & here) > 0 AS fails, (mask & before) > 0 AS gone FROM counts, steps),
done AS (
  SELECT part, filter_order, step, here, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = here), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost FROM seen GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, here))::BIGINT AS shapley FROM done
"""
