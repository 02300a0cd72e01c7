"""Quality rules under weak supervision, as DataFrame expressions only.

Each rule votes to keep (1) or to drop (0) a document, or abstains (null). Several rules look at each fault, some of
them strictly. Expectation-maximisation estimates, without labels, how often each rule votes rightly for good and for bad
documents, from the counts of vote patterns (at most 3 to the number of rules of them, whatever the corpus); what is
expected beforehand weighs as much as ``PSEUDO`` documents at any size. The posterior probability of good replaces all-must-pass
filtering: a lone vote to drop is outweighed where its rule turns out to be no mark of bad documents.

Null and empty texts have no words and fail the base test. Repeated rows are counted and judged as often as
they occur; rows with a null id are left out. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import identified, written

SPACES = "[\\x20\\x09-\\x0D]+"
WINDOW = 5
ROUNDS = 100
#: What is expected before any document is seen: the share of good documents, and how often a vote is right
#: on a good and on a bad one (a bad document has one fault or another, so most rules miss it).
GOOD, RIGHT_ON_GOOD, RIGHT_ON_BAD = 0.8, 0.98, 0.4
#: Weight of that, in documents.
PSEUDO = 100.0


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and counts that rules use (n_lines, n_capitals)."""
    words = identified(docs).withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    lines = words.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda l: l.rlike("[^\\x20\\x09-\\x0D]")))
    windows = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<long>"))
    hashed = lines.withColumn("windows", windows)
    # Sorted with their places, equal windows stand side by side.
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    ordered = hashed.withColumn("sorted", F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda i, j: F.element_at("sorted", i)["h"] == F.element_at("sorted", j)["h"]
    n = F.size("sorted")
    found = F.filter(F.sequence(F.lit(1), n), lambda i: ((i > 1) & same(i, F.greatest(i - 1, F.lit(1)))) | ((i < n) & same(i, F.least(i + 1, n))))
    places = ordered.withColumn("places", F.when(n > 0, F.array_sort(F.transform(found, lambda i: F.element_at("sorted", i)["i"]))))
    covered = F.aggregate(F.sequence(F.lit(1), F.size("places")), F.lit(0), lambda a, i: a + F.when(i < F.size("places"), F.least(F.lit(WINDOW), F.element_at("places", F.least(i + 1, F.size("places"))) - F.element_at("places", i))).otherwise(WINDOW))
    kept = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    return places.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        kept("[^#*$%&|<>]+").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("places") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"), kept("[^A-Z]+").alias("n_capitals"),
    )


def _vote(drop: Column, keep: Column) -> Column:
    return F.when(drop, 0).when(keep, 1)


def rules() -> dict[str, Column]:
    n, c = F.col("n_words"), F.col
    return {
        "length": _vote(n < 10, n >= 50),
        "brief": _vote(n < 25, n >= 100),
        "symbols": _vote(100 * c("n_symbols") > 30 * n, 100 * c("n_symbols") <= 5 * n),
        "some_symbols": _vote(100 * c("n_symbols") > 5 * n, c("n_symbols") == 0),
        "repeats": _vote(100 * c("n_repeat_words") > 15 * n, c("n_repeat_words") == 0),
        "some_repeats": _vote(100 * c("n_repeat_words") > 5 * n, c("n_repeat_words") == 0),
        "lines": _vote(100 * c("n_dup_lines") > 30 * c("n_lines"), c("n_dup_lines") == 0),
        "word_length": _vote((c("word_chars") < 3 * n) | (c("word_chars") > 12 * n), (c("word_chars") >= 4 * n) & (c("word_chars") <= 10 * n)),
        "capitals": _vote(100 * c("n_capitals") > 30 * c("word_chars"), 100 * c("n_capitals") <= 10 * c("word_chars")),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def expectation_maximisation(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents, and per rule how often its votes are right on good and on bad ones."""
    n_rules = len(patterns[0][0]) if patterns else 0
    share, right = GOOD, [(RIGHT_ON_GOOD, RIGHT_ON_BAD)] * n_rules
    for _ in range(rounds if patterns else 0):
        good, total = GOOD * PSEUDO, PSEUDO
        hits = [[RIGHT_ON_GOOD * GOOD * PSEUDO, GOOD * PSEUDO, RIGHT_ON_BAD * (1 - GOOD) * PSEUDO, (1 - GOOD) * PSEUDO] for _ in range(n_rules)]
        for votes, count in patterns:
            up, down = share, 1 - share
            for v, (g, b) in zip(votes, right, strict=True):
                if v is not None:
                    up, down = up * (g if v else 1 - g), down * (1 - b if v else b)
            p = up / (up + down)
            good, total = good + p * count, total + count
            for v, h in zip(votes, hits, strict=True):
                if v is not None:
                    h[0], h[1] = h[0] + p * count * v, h[1] + p * count
                    h[2], h[3] = h[2] + (1 - p) * count * (1 - v), h[3] + (1 - p) * count
        share, right = good / total, [(a / b, c / d) for a, b, c, d in hits]
    return share, right


def judge(docs: DataFrame) -> DataFrame:
    """Per document: the measures, base_failed, kept, and quality (posterior probability of good)."""
    measured = written(measures(docs), "measures")  # some numbers a document
    voted = measured.select("*", base_failed().alias("base_failed"), *[c.alias(f"vote_{k}") for k, c in rules().items()])
    names = [f"vote_{k}" for k in rules()]
    patterns = [(tuple(r[:-1]), r[-1]) for r in voted.groupBy(*names).count().orderBy(*names).collect()]  # at most 3**9 rows
    share, right = expectation_maximisation(patterns)
    odds = F.lit(share / (1 - share))
    for name, (g, b) in zip(names, right, strict=False):
        odds = odds * F.when(F.col(name) == 1, g / (1 - b)).when(F.col(name) == 0, (1 - g) / b).otherwise(1.0)
    quality = voted.withColumn("quality", odds / (1 + odds))
    return quality.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("quality") >= 0.5)).alias("kept"), F.round("quality", 6).alias("quality"))
