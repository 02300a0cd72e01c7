"""The pipeline's stages on a small corpus, each against what its own input calls for."""

import random

import corpus_pipeline
import pyarrow as pa
import pyarrow.parquet as pq
import test_operators as T
from orthospark.llm import decontaminate


def test_stages(spark, tmp_path):
    texts, toxic, _ = T.labelled_texts(seed=8, n=240)
    rng = random.Random(0)
    item = " ".join(f"bench{rng.randrange(10**6)}" for _ in range(15))
    texts += [texts[0], texts[1] + " tail", texts[2] + "\n" + item + "\nmore words", *T.TEXTS[:20], ""]
    toxic += [toxic[0], toxic[1], toxic[2]]
    ids = list(range(len(texts)))
    none = [None] * len(texts)
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": pa.array(none, pa.string()), "source": pa.array(none, pa.string()), "n_chars": [len(t) for t in texts]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids[: len(toxic)], "quality": pa.array([1] * len(toxic), pa.int32()), "toxic": pa.array(toxic, pa.int32())}), tmp_path / "labels.parquet")
    pq.write_table(pa.table({"item_id": [1], "text": [item]}), tmp_path / "benchmark.parquet")

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
        if name == "line_dedup":
            order = sorted(kept["toxicity"])
            assert [kept[name][i] for i in order] == T.lines_left([kept["toxicity"][i] for i in order])
        if name == "near_dedup":
            order = sorted(kept["line_dedup"])
            roots = T.near_components([kept["line_dedup"][i] for i in order], 5)[1]
            assert sorted(kept[name]) == [i for k, i in enumerate(order) if roots[k] == k]
        if name == "decontaminate":
            assert decontaminate.report(decontaminate.match(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")))).where("contaminated").count() == 0
            assert before.count() - docs.count() <= 1
    assert sum(i in kept["toxicity"] for i, t in enumerate(toxic) if t) <= 0.1 * sum(toxic)
    assert sum(i not in kept["toxicity"] for i, t in enumerate(toxic) if not t) <= 0.1 * len(toxic)  # some 140 documents to learn from
    assert {r.doc_id for r in docs.collect()} == set(kept["decontaminate"])
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect()} == {tuple(r) for r in docs.select("doc_id", "piece", "length").collect()}
