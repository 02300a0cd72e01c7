import numpy as np
import pytest
from pyspark.sql import functions as F

from orthospark.operators import scoring, tiles, training
from orthospark.sources import npy
from orthospark.sources import tables as S
from orthospark.streaming.verdicts import verdict_counts


def test_files(spark, tmp_path):
    for site, name in (("a", "x.tif"), ("b", "x.tif"), ("b", "y.tif")):
        (tmp_path / site).mkdir(exist_ok=True)
        (tmp_path / site / name).write_bytes(b"1")
    assert S.list_inputs(spark, str(tmp_path), "x.tif").count() == 2
    folder = tmp_path / "npy" / "site" / "train" / "normal"
    folder.mkdir(parents=True)
    np.save(folder / "t.npy", np.arange(6).reshape(2, 3, 1))
    np.save(folder / "u.npy", np.arange(4))
    rows = {r.name: r for r in S.read_npy_tiles(spark, f"{tmp_path}/npy/*/*/*/*.npy").collect()}
    assert rows["t.npy"].data == list(range(6)) and (rows["u.npy"].height, rows["u.npy"].width) == (1, 4) and rows["t.npy"].orchard == "site"


def test_tables(spark, tmp_path):
    meta = spark.createDataFrame([("f", 0, "good", "s", [1.0], None, "normal", None, "train")], "filename string, label int, label_name string, clsname string, mean array<double>, std array<double>, `case` string, maskname string, split string")
    S.write_metadata(meta, str(tmp_path / "meta"))
    back = S.read_metadata(spark, str(tmp_path / "meta" / "train_metadata")).first()
    assert back.mean == [1.0] and back.std is None
    tiles = spark.createDataFrame([("o", "train", "normal", [1.0])], "orchard string, split string, `case` string, data array<double>")
    S.write_dataset(tiles, str(tmp_path / "tiles"))
    assert S.read_dataset(spark, str(tmp_path / "tiles")).first().case == "normal"
    results = spark.createDataFrame([("k", "a/b.npy", 1, 0.1), ("k", "a/b.npy", 2, 0.2)], "clsname string, filename string, at int, pred double")
    S.write_results(results, str(tmp_path / "results"), "at")
    assert [r.pred for r in S.read_results(spark, str(tmp_path / "results")).collect()] == [0.2]
    limits = spark.createDataFrame([("all_case_1", 1.0)], "clsname string, threshold double")
    S.write_thresholds(limits, str(tmp_path / "limits"))
    with pytest.raises(ValueError, match="all_case_2"):
        S.read_thresholds(spark, str(tmp_path / "limits"))
    S.write_stats(limits, str(tmp_path / "stats"))
    assert S.read_stats(spark, str(tmp_path / "stats")).count() == 1


def test_runs(spark, tmp_path):
    folder = tmp_path / "Jitter And Dropout"
    folder.mkdir()
    (folder / "m-1.csv").write_text("Epoch,Train_Loss,all_case_1_AUROC,all_case_2_AUROC\n10,1,.90,.70\n20,1,.95,.80\n30,1,.95,.78\n")
    runs = S.read_runs(spark, str(tmp_path))
    averages = training.run_average(runs)
    assert [round(r.average, 3) for r in averages.orderBy("epoch").collect()] == [0.8, 0.875, 0.865]
    assert training.best_epoch(runs, "auroc_1", "model").first().epoch == 20
    assert training.best_epoch(averages, "average", "model").first().epoch == 20
    catalogue = spark.createDataFrame([("one", "Jitter and Dropout", "m-1"), ("two", "x", "y")], "name string, experiment string, model string")
    found, missing = S.read_named_runs(runs, catalogue)
    assert found.count() == 0 and missing.count() == 2
    found, missing = S.read_named_runs(runs, catalogue, ignore_case=True)
    assert found.count() == 3 and [r.name for r in missing.collect()] == ["two"]
    limits = training.run_limits(runs, ["auroc_2"], "experiment").first()
    assert (limits.auroc_2_min, limits.auroc_2_max) == pytest.approx((0.695, 0.805))


def test_projects(spark):
    row = {"orchard": "o", "path": "p", "output_path": "q", "files": [("f", 3)], "mask": "m", "reference": "r", "chunk_size": 1.0, "chunk_overlap": 0.5, "anomaly_threshold": 0.8, "scale_ratio": 1.0}
    assert S.layers_for(S.projects(spark, [row]), ["a.tif", "b.tif"]).count() == 2
    with pytest.raises(ValueError, match="mask"):
        S.projects(spark, [row | {"mask": None}])


def test_scorers(spark):
    rng = np.random.default_rng(0)
    plane = rng.normal(size=(2, 6))
    rows = [(i, (rng.normal(size=2) @ plane + 5).tolist()) for i in range(60)] + [(99, (np.arange(6.0) * 9).tolist())]
    df = spark.createDataFrame(rows, "id long, data array<double>")
    got = {r.id: r for r in scoring.reconstruct(df, scoring.fit_reconstruction(df.where("id < 60"), 2)).collect()}
    assert max(got[i].mse for i in range(60)) < 1e-9 < got[99].mse and len(got[0].rec) == 6
    assert {r.id: r.score for r in scoring.score_tiles(df, lambda: lambda a: a.max(axis=1), "id").collect()}[99] == 45


def test_stream(spark, tmp_path):
    rows = [("a", 1.0, "2020-01-01 00:00:05"), ("a", 50.0, "2020-01-01 00:00:20"), ("a", 99.0, "2020-01-01 00:01:05"), ("b", 99.0, "2020-01-01 00:01:06")]
    spark.createDataFrame(rows, "clsname string, score double, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(tmp_path / "in"))
    limits = spark.createDataFrame([("all_case_1", 35.0), ("all_case_2", 60.0)], "clsname string, threshold double")
    stream = verdict_counts(spark.readStream.schema("clsname string, score double, at timestamp").parquet(str(tmp_path / "in")), limits, "at", "1 minute", "1 hour")
    q = stream.writeStream.format("memory").outputMode("complete").queryName("verdicts").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[1:] for r in spark.table("verdicts").collect()) == [("a", 0, 0, 1), ("a", 1, 1, 0), ("b", 0, 0, 1)]


def npy_rows(n):
    return [(f"s{i % 2}", "test" if i % 3 == 0 else "train", "normal", f"{i}.npy", 1, 2, 1, [float(i), 0.5]) for i in range(n)]


def test_npy_source_round_trip_and_pruning(spark, tmp_path):
    """What is written comes back; folders that a filter or an option leaves out aren't opened, so what lies in them needn't even be readable."""
    tiles = spark.createDataFrame(npy_rows(30), npy.SCHEMA)
    root = f"file://{tmp_path}/npy"
    npy.write_tiles(tiles.repartition(3), root)
    assert sorted(map(tuple, npy.read_tiles(spark, root).collect())) == sorted(npy_rows(30))
    npy.write_tiles(tiles, root)  # the same files again
    assert npy.read_tiles(spark, root).count() == 30
    (tmp_path / "npy" / "s1" / "train" / "normal" / "broken.npy").write_bytes(b"not an array")
    test = [r for r in npy_rows(30) if r[1] == "test"]
    assert sorted(map(tuple, npy.read_tiles(spark, root, split="test").collect())) == sorted(test)
    pushed = npy.read_tiles(spark, root).where("split = 'test' AND orchard = 's0' AND height = 1")
    assert sorted(map(tuple, pushed.collect())) == sorted(r for r in test if r[0] == "s0")
    assert npy.read_tiles(spark, root).where("split = 'test' AND split = 'train'").count() == 0
    with pytest.raises(Exception, match="npy|pickle|magic"):
        npy.read_tiles(spark, root, split="train").collect()
    parts = npy.NpyReader({"path": root, "split": "test", "files_per_partition": "4"}).partitions()
    assert [len(p.files) for p in parts] == [4, 4, 2]


def test_results_are_merged_class_by_class(spark, tmp_path):
    path = str(tmp_path / "results")
    run = lambda *rows: spark.createDataFrame([(c, f"a/{k}.npy", at, pred) for c, k, at, pred in rows], "clsname string, filename string, at int, pred double")
    files = lambda c: {p.name: p.stat().st_mtime_ns for p in (tmp_path / "results" / f"clsname={c}").glob("*.parquet")}
    S.write_results(run(("1", "x", 5, 0.1), ("1", "y", 5, 0.2), ("2", "x", 5, 0.3)), path, "at")
    before = files("2")
    # A later row of x, an older one of y, a new one; class 2 isn't named.
    S.write_results(run(("1", "x", 6, 0.4), ("1", "y", 4, 0.5), ("1", "z", 1, 0.6), ("3", "x", 1, 0.7)), path, "at")
    got = sorted((r.result_key, round(r.pred, 1)) for r in S.read_results(spark, path).collect())
    assert got == [("1_a_x", 0.4), ("1_a_y", 0.2), ("1_a_z", 0.6), ("2_a_x", 0.3), ("3_a_x", 0.7)]
    assert files("2") == before
    S.write_results(run(), path, "at")
    assert S.read_results(spark, path).count() == 5


def test_bucketed_layers_meet_without_a_shuffle(spark, tmp_path):
    cells = spark.createDataFrame([("r", y, x, y * 10 + x) for y in range(8) for x in range(8)], "raster_id string, y int, x int, v int")
    for name in ("v", "mask", "ref"):
        S.write_layer(cells.withColumnRenamed("v", name), f"layer_{name}", 4, str(tmp_path / name))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = tiles.colocate(*[spark.table(f"layer_{name}") for name in ("v", "mask", "ref")])
        plan = met._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {(r.v, r.mask, r.ref) for r in met.collect()} == {(y * 10 + x,) * 3 for y in range(8) for x in range(8)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("v", "mask", "ref"):
            spark.sql(f"DROP TABLE layer_{name}")
