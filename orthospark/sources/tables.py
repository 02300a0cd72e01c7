"""Readers and writers of tiles, metadata, results, statistics, thresholds, runs and projects."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orthospark.functions.columns import result_key, unique_id
from orthospark.schema import METADATA, PROJECT, RUN
from orthospark.sources.npy import as_tile
from orthospark.sources.scratch import written


def list_inputs(spark: SparkSession, root: str, name: str) -> DataFrame:
    """path and unique_id of every file of that name below root; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    start = F.regexp_replace(F.lit(root), "^[a-z]+:/*|/+$", "")
    bare = F.regexp_replace("path", "^[a-z]+:/*", "")
    relative = F.when(F.startswith(bare, F.ltrim(start)), F.substring(bare, F.length(start) + F.lit(2), F.length(bare))).otherwise(bare)
    return files.withColumn("unique_id", unique_id(relative))


def read_npy_tiles(spark: SparkSession, glob: str) -> DataFrame:
    """Tiles in .npy files under orchard/split/case; one-dimensional arrays become one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows.append((*path.split("/")[-4:], *as_tile(np.load(io.BytesIO(content)))))
            yield pd.DataFrame(rows, columns=["orchard", "split", "case", "name", "height", "width", "channels", "data"])

    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    return files.mapInPandas(run, "orchard string, split string, case string, name string, height int, width int, channels int, data array<double>")


def write_dataset(tiles: DataFrame, root: str) -> None:
    tiles.write.mode("overwrite").partitionBy("orchard", "split", "case").parquet(root)


def read_dataset(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)


def write_metadata(rows: DataFrame, root: str) -> None:
    """One JSON object a line, train and test apart."""
    for split in ("train", "test"):
        rows.where(F.col("split") == split).drop("split").write.mode("overwrite").json(f"{root}/{split}_metadata")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METADATA).json(path)


def latest_results(results: DataFrame, at: str) -> DataFrame:
    """One row a result key, the last written; adds result_key from clsname and filename."""
    return _latest(results.withColumn("result_key", result_key(F.col("clsname"), F.col("filename"))), at)


def _latest(keyed: DataFrame, at: str) -> DataFrame:
    w = Window.partitionBy("result_key").orderBy(F.desc(at))
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_results(results: DataFrame, path: str, at: str) -> None:
    """Merges results into those at ``path``, if there are any: of each key the row with the largest ``at`` stays, whichever run it is of.
    Only classes that the new results name are read and written again; the files of all others aren't touched."""
    spark = results.sparkSession
    new = results.withColumn("result_key", result_key(F.col("clsname"), F.col("filename")))
    try:
        # With the new rows' schema: names of classes that look like numbers stay texts.
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        new = new.unionByName(old.join(new.select("clsname").distinct(), "clsname", "left_semi"))
    # Written first, as a table can't be read and replaced at once.
    merged = written(_latest(new, at), "results")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("clsname").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_layer(cells: DataFrame, name: str, buckets: int, path: str | None = None) -> None:
    """A layer of rasters as the table ``name``, bucketed and sorted by place: layers with as many buckets meet without a shuffle."""
    place = ["raster_id", "y", "x"]
    writer = cells.repartition(buckets, *place).write.mode("overwrite").bucketBy(buckets, *place).sortBy(*place)
    (writer.option("path", path) if path else writer).saveAsTable(name)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").parquet(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.write.mode("overwrite").parquet(path)


def require_thresholds(thresholds: DataFrame, names: tuple[str, ...] = ("all_case_1", "all_case_2")) -> DataFrame:
    """The thresholds; an error names those that are missing."""
    have = {r[0] for r in thresholds.where(F.col("clsname").isin(*names)).select("clsname").distinct().collect()}
    if missing := [n for n in names if n not in have]:
        raise ValueError(f"no threshold for {', '.join(missing)}")
    return thresholds


def read_thresholds(spark: SparkSession, path: str, names: tuple[str, ...] = ("all_case_1", "all_case_2")) -> DataFrame:
    return require_thresholds(spark.read.parquet(path), names)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Every CSV log below root: the experiment is its directory, the model its stem."""
    rows = spark.read.schema(RUN).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(root)
    parts = F.split(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), "/")
    return rows.select(
        F.element_at(parts, -2).alias("experiment"), F.regexp_replace(F.element_at(parts, -1), r"\.csv$", "").alias("model"),
        F.col("Epoch").alias("epoch"), F.col("Train_Loss").alias("train_loss"), F.col("all_case_1_AUROC").alias("auroc_1"), F.col("all_case_2_AUROC").alias("auroc_2"),
    )


def read_named_runs(runs: DataFrame, catalogue: DataFrame, ignore_case: bool = False) -> tuple[DataFrame, DataFrame]:
    """Runs under their catalogue names (name, experiment, model), and the entries without a run."""
    fold = F.lower if ignore_case else (lambda c: c)
    same = (fold(runs["experiment"]) == fold(catalogue["experiment"])) & (fold(runs["model"]) == fold(catalogue["model"]))
    return runs.join(catalogue, same).select("name", *[runs[c] for c in runs.columns]), catalogue.join(runs, same, "left_anti")


def projects(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Parameters of each site; an error names the first missing one."""
    df = spark.createDataFrame([], PROJECT)
    for row in rows:
        for field in df.columns:
            if row.get(field) is None:
                raise ValueError(f"{row.get('orchard', 'a project')}: {field} is missing")
    return spark.createDataFrame(rows, PROJECT)


def layers_for(sites: DataFrame, layers: list[str]) -> DataFrame:
    """A row for each site and each of a short list of layer files."""
    return sites.withColumn("layer", F.explode(F.array(*map(F.lit, layers)))).withColumn("file", F.concat_ws("/", "path", "layer"))
