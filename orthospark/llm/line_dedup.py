"""Line dedup over content-defined chunks of lines, as DataFrame expressions only.

A text's lines are hashed (first 32 bits of MD5); a rolling hash over each line and the one
before it ends a chunk after the line where it is divisible by ``DIVISOR``. So boundaries
depend on the lines around them alone, and move along when lines are put in before. Of ends that follow each other every
second one counts, so no chunk is a single line; within ``MOST`` lines without any end (lines that go on repeating have none) one is put in.
Each of ``BASES`` gives a rolling hash and so a series of chunks of its own: a line in a chunk that runs
into the text around a passage in one series is within the passage in another. A chunk with
two or more lines that hold a word, whose bytes also make an earlier chunk (smaller doc_id, or
earlier in the text) of any series, is repeated; the lines that repeated chunks cover are removed. Of what repeats, the first
stays: its lines repeat nothing. Hashes only pick the chunks that may
repeat; those are then compared byte by byte.

Null and empty texts are one empty line and lose nothing. Repeated rows are the same document and
share its fate. Rows with a null id are kept as they are by :func:`remove` and left out of :func:`report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import apart, identified, written

DIVISOR = 2
#: Lines without an end.
MOST = 6
#: One series of chunks each.
BASES = (257, 65537, 8191)
SALTS = 8
_PRIME = 2147483647
#: In turn, on a text's ends as a string of 0 and 1: an end after MOST lines without, none after the first line, of
#: adjoining ones every second, none before the last line but one there.
_RULES = (("0" * MOST, "0" * (MOST - 1) + "1"), ("^1", "0"), ("11", "10"), ("..$", "01"))


def _chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with lines, and spans: (first line from 1, number of lines) of the chunks of all series, each once."""
    lines = docs.withColumn("lines", F.split("text", "\n", -1))
    hashed = lines.withColumn("hashes", F.transform("lines", lambda l: F.conv(F.substring(F.md5(l.cast("binary")), 1, 8), 16, 10).cast("long")))

    def spans(base: int) -> Column:
        rolling = lambda i: F.element_at("hashes", i) + F.when(i > 1, F.element_at("hashes", F.greatest(i - 1, F.lit(1)))).otherwise(0) * base
        bits = F.array_join(F.transform(F.sequence(F.lit(1), F.size("hashes")), lambda i: F.when(rolling(i) % _PRIME % DIVISOR == 0, "1").otherwise("0")), "")
        for pattern, by in _RULES:
            bits = F.regexp_replace(bits, pattern, by)
        ends = F.array_compact(F.transform(F.split(bits, ""), lambda c, i: F.when(c == "1", i + 1)))
        starts = F.concat(F.array(F.lit(0)), ends)
        return F.zip_with(F.slice(starts, 1, F.size(starts) - 1), ends, lambda a, b: F.struct((a + 1).alias("first"), (b - a).alias("n")))

    return hashed.withColumn("spans", F.array_distinct(F.flatten(F.array(*[F.filter(spans(b), lambda s: s["n"] > 1) for b in BASES]))))


def _chunks(read: DataFrame) -> DataFrame:
    """doc_id, span and text of every one of ``spans`` with at least two lines that hold a word."""
    rows = read.select("doc_id", F.explode(F.transform("spans", lambda s: F.struct(s.alias("span"), F.slice("lines", s["first"], s["n"]).alias("lines")))).alias("chunk"))
    with_word = F.size(F.filter("chunk.lines", lambda l: l.rlike("[^\\x20\\x09-\\x0D]")))
    return rows.where(with_word > 1).select("doc_id", "chunk.span", F.array_join("chunk.lines", "\n").alias("chunk"))


def _key(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)``: the chunks that repeat an earlier one, per document that has any.

    Keys are counted first; only chunks whose key occurs twice are sent with their text, and a common one's rows are dealt over ``SALTS`` parts."""
    read = identified(docs)
    keys = written(_chunks(_chunked(read)).select("doc_id", "span", _key(F.col("chunk")).alias("key")), "keys")
    twice = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # What repeats grows with the texts: merged with them at every size.
    some = written(keys.join(twice.hint("merge"), "key").groupBy("doc_id").agg(F.collect_set("span").alias("spans")), "repeating")
    may = written(_chunks(read.join(some.hint("merge"), "doc_id").withColumn("lines", F.split("text", "\n", -1))).withColumn("key", _key(F.col("chunk"))), "chunks")
    # Here bytes are compared. Where they agree throughout a key, the key alone says which rows are equal, and no text is sent again.
    groups = written(may.groupBy("key", "chunk").agg(F.min(F.struct("doc_id", "span")).alias("first")), "groups")
    of_key = written(groups.groupBy("key").agg(F.count("*").alias("n"), F.min("first").alias("first")), "firsts")
    first = of_key.where("n = 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = may.select("doc_id", "span", "key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    later = F.struct("doc_id", "span") > F.col("first")
    same = salted.join(first.hint("merge"), ["key", "salt"]).where(later).select("doc_id", "span")
    clashing = of_key.where("n > 1").select("key")
    if not clashing.isEmpty():
        same = same.unionByName(may.join(groups.join(clashing.hint("merge"), "key").hint("merge"), ["key", "chunk"]).where(later).select("doc_id", "span"))
    return written(same.groupBy("doc_id").agg(F.collect_set("span").alias("spans")), "repeated")


def _left() -> Column:
    """The lines that none of spans covers, in order."""
    gone = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["n"] - 1)))
    return F.transform(F.array_except(F.sequence(F.lit(1), F.size("lines")), gone), lambda i: F.element_at("lines", i))


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed_chunks, n_removed_lines, kept_sha256 (of the text left)."""
    joined = identified(docs).join(repeated_chunks(docs).hint("merge"), "doc_id", "left").withColumn("lines", F.split("text", "\n", -1))
    parts = joined.withColumn("left", F.when(F.col("spans").isNull(), F.col("lines")).otherwise(_left()))
    return parts.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        (F.size("lines") - F.size("left")).cast("long").alias("n_removed_lines"), F.sha2(F.array_join("left", "\n").cast("binary"), 256).alias("kept_sha256"),
    )


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines of repeated chunks; n_chars, where there is one, follows the text."""
    id_, at = apart(docs, "of"), apart(docs, "at")
    gone = repeated_chunks(docs).select(F.col("doc_id").alias(id_), F.col("spans").alias(at))
    joined = docs.join(gone.hint("merge"), F.col("doc_id") == F.col(id_), "left").select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(at).alias("spans"))
    lines = joined.withColumn("lines", F.split(F.coalesce("row.text", F.lit("")), "\n", -1))
    left = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(F.array_join(_left(), "\n"))
    out = lines.select("row", F.col("spans").isNull().alias("whole"), left.alias("left"))
    changed = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return out.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def _ruled(bits: str) -> str:
    for pattern, by in _RULES:
        bits = f"regexp_replace({bits}, '{pattern}', '{by}', 'g')"
    return bits


ORACLE = f"""
WITH lines AS MATERIALIZED (
  SELECT doc_id, i, line, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
    FROM documents WHERE doc_id IS NOT NULL)),
raw AS (
  SELECT doc_id, base, i, CASE WHEN (h + coalesce(lag(h) OVER (PARTITION BY doc_id, base ORDER BY i), 0) * base) % {_PRIME} % {DIVISOR} = 0 THEN '1' ELSE '0' END AS bit
  FROM lines, (VALUES {", ".join(f"({b})" for b in BASES)}) series(base)),
ruled AS (SELECT doc_id, base, {_ruled("string_agg(bit, '' ORDER BY i)")} AS bits FROM raw GROUP BY doc_id, base),
marked AS (SELECT doc_id, base, unnest(string_split(bits, ''))::INT AS ends, generate_subscripts(string_split(bits, ''), 1) AS i FROM ruled),
placed AS (
  SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id, base ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM marked),
spans AS (SELECT DISTINCT doc_id, first, last FROM (SELECT doc_id, min(i) AS first, max(i) AS last FROM placed GROUP BY doc_id, base, place) WHERE last > first),
chunks AS (
  SELECT doc_id, first, last, string_agg(line, chr(10) ORDER BY i) AS chunk FROM (
    SELECT s.*, l.i, l.line FROM (SELECT *, unnest(range(first, last + 1)) AS i FROM spans) s JOIN lines l USING (doc_id, i))
  GROUP BY doc_id, first, last HAVING count(*) FILTER (WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')) > 1),
gone AS MATERIALIZED (
  SELECT doc_id, first, last FROM (
    SELECT doc_id, first, last, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS nth FROM chunks) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM gone),
counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, coalesce(any_value(n), 0)::BIGINT AS n_removed_chunks, count(c.i)::BIGINT AS n_removed_lines,
  sha256(coalesce(string_agg(CASE WHEN c.i IS NULL THEN line END, chr(10) ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.i = l.i LEFT JOIN counted k ON k.doc_id = l.doc_id GROUP BY l.doc_id
"""
