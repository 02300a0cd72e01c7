"""Mixing sources to target weights, as DataFrame expressions only.

Sources in order of code points (null last) weigh 1, 2, 3, 1, 2, 3, ... and share the words of all documents. A
target stops at ``MOST_EPOCHS`` times its source's size; what is over is shared anew by weight until no target is above.

Within a source documents are drawn as by Efraimidis and Spirakis: a document's key is an exponential number, made from a hash
of its id and a seed, over its quality weight; the smaller the key the earlier the document. A source gives all its documents once for
every whole epoch in its target, then documents by key until the rest of the target is spent; the one at which it is
spent gives its first words only, so a source's words are its target, rounded.

Keys are dealt over ``BUCKETS`` and more buckets a source, by their size: words are added up by bucket, the sums run over buckets, and
only within a bucket over documents. So no task orders a whole source, however large it is.

A null text has no words. Rows with a null id are left out. Null and empty sources are two sources. Repeated rows are
documents of their own, with one key; which of two equal rows is cut doesn't show. Two texts under one id have one key too, the
shorter first. A source without words has the target 0. An empty table gives no rows. Only doc_id, text and
source are read, and of the qualities doc_id and quality (the largest of several; any other value than 0 or 1, or none, is unknown).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._tables import written

SPACES = "[\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: Quality weights: good, unknown and bad documents.
GOOD, UNKNOWN, BAD = 1.0, 0.75, 0.5
SEED = 11
BUCKETS = 256
ROWS_PER_BUCKET = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words."""
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")).cast("long")
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with rank (from 0) in order of ``source``, null last: rows are numbered in each part of a sorted table, and from part to part."""
    parts = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    parts = written(parts.withColumn("at", F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)), "sources")
    # A row a part of the sort, never more than there are shuffle partitions.
    before = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return parts.join(F.broadcast(before.select("part", "before")), "part").withColumn("rank", F.col("at") + F.col("before")).drop("part", "at", "before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target: one row a source of ``sizes(source, size)``."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.lit(list(weights)), (F.col("rank") % len(weights)).cast("int") + 1)
    sources = written(ranked(sums).select("source", "source_size", weight.alias("weight")), "weights")
    # What a unit of weight gets. Sources that it would lift above their limit stop there, and the others get more: it never shrinks,
    # and is all that a round leaves to the next.
    share, stopped, cap = 0.0, -1, F.col("source_size") * most_epochs
    while True:
        full = cap < F.col("weight") * F.lit(share)
        total, words, weighing, n = sources.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if n == stopped or not weighing:
            break
        share, stopped = (total - (words or 0)) / weighing, n
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(share))
    return sources.select("source", "source_size", target.alias("target"))


def key(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """An exponential number of rate ``weight`` from 52 bits of a hash."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", doc_id, F.lit(seed))), 1, 13), 16, 10).cast("double")
    return -F.ln((drawn + 1) / F.lit(float(1 << 52))) / weight


def mix(docs: DataFrame, qualities: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_epochs: int = MOST_EPOCHS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted), source, epochs (whole)."""
    said = qualities.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    weight = F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(UNKNOWN)
    weighed = written(sized(docs).join(said.hint("merge"), "doc_id", "left").select("doc_id", "source", "size", weight.alias("weight")), "sized")
    n, mean = weighed.agg(F.count("*"), F.avg("weight")).first()
    if not n:
        mean = 1.0
    buckets += n // ROWS_PER_BUCKET
    # Among documents of the mean weight, exp(-key * weight) is even between 0 and 1. Null sources need a value to meet by.
    at = lambda df: df.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    drawn = at(weighed).withColumn("key", key(F.col("doc_id"), F.col("weight"), seed))
    drawn = drawn.withColumn("bucket", F.floor((1 - F.exp(-F.col("key") * F.lit(mean))) * buckets))
    aims = at(targets(weighed, weights, most_epochs)).drop("source")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("left", F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size"))
    sums = drawn.groupBy("name", "bucket").agg(F.sum("size").alias("words")).join(aims.hint("merge"), "name")
    earlier = F.sum("words").over(Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("earlier", F.coalesce(earlier, F.lit(0))).drop("words")
    by_key = Window.partitionBy("name", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    spent = drawn.withColumn("spent", F.coalesce(F.sum("size").over(by_key), F.lit(0))).join(sums.hint("merge"), ["name", "bucket"])
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("earlier") - F.col("spent")))
    return spent.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"), "source", "epochs")


_CASES = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))

ORACLE = f"""
WITH docs AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> ''))::BIGINT AS size FROM documents WHERE doc_id IS NOT NULL),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {_CASES} END AS weight FROM sums),
lifted AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS nth, coalesce(sum({MOST_EPOCHS} * source_size) OVER earlier, 0) AS full_words, coalesce(sum(weight) OVER earlier, 0) AS full_weight, sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM weighed WINDOW earlier AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT arg_min((words - full_words)::DOUBLE / (weights - full_weight), nth) AS share FROM lifted WHERE {MOST_EPOCHS} * source_size >= weight * ((words - full_words)::DOUBLE / (weights - full_weight))),
aims AS (
  SELECT source, source_size, target, epochs, floor(target + 0.5)::BIGINT - epochs * source_size AS rest FROM (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM (
      SELECT source, source_size, least(({MOST_EPOCHS} * source_size)::DOUBLE, weight * coalesce(share, 0)) AS target FROM weighed, share))),
said AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
keyed AS (
  SELECT docs.*, -ln((('0x' || substr(md5(doc_id || ':{SEED}'), 1, 13))::BIGINT::DOUBLE + 1) / {1 << 52}::DOUBLE) / CASE quality WHEN 1 THEN {GOOD} WHEN 0 THEN {BAD} ELSE {UNKNOWN} END AS key
  FROM docs LEFT JOIN said USING (doc_id)),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM keyed)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - spent)))::BIGINT AS taken, run.source, epochs
FROM run JOIN aims ON run.source IS NOT DISTINCT FROM aims.source
"""
