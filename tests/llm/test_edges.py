"""What the operators do with batches of empty texts, clashing columns, and several texts under one id."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from orthospark.llm import _tokenizers, decontaminate, line_dedup, lm_score, minhash_dedup, suffix_dedup, toxicity

#: Names that stages use inside, or did.
CLASHING = "gone", "gone_", "of", "at", "key", "kept", "row", "left", "whole", "places", "__gone", "__id", "__bytes", "__kept", "__places", "__text", "__whole", "__row"


def clashing(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), *range(len(CLASHING))) for i, t in enumerate(texts)] + [(None, "no id", None, None, 5, *range(len(CLASHING)))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)).repartition(2)


@pytest.fixture(scope="module")
def pieces():
    return lm_score.load(_tokenizers.pieces())


def test_language_model_of_empty_batches(spark, pieces):
    """A partition of empty texts, empty texts first in their batch, and a table of nothing else."""
    for rows in ([(1, ""), (2, None)], [(i, "a b c") for i in range(8)] + [(100 + i, "") for i in range(20)], [(i, "" if i < 5 else "x y") for i in range(9)]):
        for parts in (1, 16):
            df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(parts, "doc_id")
            got = {r.doc_id: r for r in lm_score.score(df, pieces).collect()}
            assert {i: got[i].n_tokens for i in got} == {i: 1 + len((t or "").split()) for i, t in rows}
            assert all(math.isfinite(r.score) and math.isfinite(r.base_score) and r.base_score <= 0 for r in got.values())


def test_language_model_of_two_texts_under_one_id(spark, pieces):
    df = spark.createDataFrame([(3, "a b zz"), (3, "a b c d zz"), (3, "a b zz"), (4, "a b c d")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in lm_score.score(df, pieces, held_out=F.col("doc_id") == 3).collect())
    base = lambda *counts: round(sum(math.log10((c + 0.1) / (5 + 0.1 * 6)) for c in counts), 6)
    assert got == [(3, 4, 3, base(1, 1, 0, 1))] * 2 + [(3, 6, 5, base(1, 1, 1, 1, 0, 1)), (4, 5, 5, base(1, 1, 1, 1, 1))]


def test_stages_with_clashing_columns(spark):
    rng = random.Random(1)
    lines = ["\n".join(" ".join(rng.choice("abcdefgh") * 3 for _ in range(8)) for _ in range(6)) for _ in range(6)]
    item = " ".join(f"item{i}" for i in range(14))
    texts = [*lines, lines[0], "head\n" + lines[1] + "\ntail", "x " * 30 + item + " y" * 30, item, "", None]
    docs = clashing(spark, texts)
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 1)], "doc_id long, quality int, toxic int")
    for stage in (line_dedup.remove, minhash_dedup.deduplicate, lambda d: toxicity.reject(d, labels), lambda d: decontaminate.decontaminate(d, bench)):
        out = stage(docs)
        rows = out.collect()
        assert out.schema == docs.schema and rows and all(r[c] == i for r in rows for i, c in enumerate(CLASHING))
        assert any(r.text == "no id" for r in rows)
    left = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert item not in left[8].text and left[8].n_chars == len(left[8].text) and 9 not in left and left[11].text is None
    assert {r.doc_id for r in minhash_dedup.deduplicate(docs).collect()} == {*range(12), None} - {6, 7}  # 7 is text 1 with two more words


def test_decontaminate_two_texts_under_one_id(spark):
    item = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"é é é {item} " + "z " * 40), (1, "a completely different ü text"), (1, item), (2, "b " * 30 + item)]
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, item in r.text) for r in got) == [(1, False), (1, False), (2, False)]
    assert any(r.text == rows[1][1] for r in got) and any(r.text.startswith("é é é  z") for r in got)


def test_suffix_dedup_says_where_ids_stand_for_two_texts(spark):
    df = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (8, "c")], "doc_id long, text string")
    with pytest.raises(ValueError, match=r"\[7\]"):
        suffix_dedup.remove_repeats(df)
    got = suffix_dedup.remove_repeats(df.where("text != 'b'")).collect()
    assert sorted((r.doc_id, r.kept_sha256) for r in got) == [(7, hashlib.sha256(b"a").hexdigest())] + [(8, hashlib.sha256(b"c").hexdigest())] * 2


@pytest.mark.parametrize("n", [1, 300_000])
def test_very_long_texts(spark, n):
    """One text of many words, its only copy, and the passage it holds."""
    item = " ".join(f"q{i}" for i in range(30))
    text = "w " * n + item
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    docs = spark.createDataFrame([(0, text + "\n" + text), (1, "short")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_hit) for r in decontaminate.report(decontaminate.match(docs, bench)).collect()} == {0: (2 * n + 60, 60), 1: (1, 0)}
    assert {r.doc_id: (r.n_lines, r.n_removed_lines) for r in line_dedup.report(docs).collect()} == {0: (2, 0), 1: (1, 0)}
