"""Scoring tiles: by a scorer the user brings, or by how badly a linear model of normal tiles rebuilds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthospark.functions.columns import anomaly_distance, mean_square


def score_tiles(tiles: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], key: str, data: str = "data") -> DataFrame:
    """``(key, score)`` by a scorer of batches of tiles; ``load`` makes it, once a task."""
    kind = tiles.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = load()
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({key: batch[key], "score": score(np.stack(list(batch[data]))).astype(float)})

    return tiles.select(key, data).mapInPandas(run, f"{key} {kind}, score double")


def mean_tile(tiles: DataFrame, data: str = "data") -> list[float]:
    """One number a cell of a tile."""
    return tiles.agg(Summarizer.mean(array_to_vector(data))).first()[0].toArray().tolist()


def fit_reconstruction(normals: DataFrame, k: int, data: str = "data") -> tuple[list[float], np.ndarray]:
    """Mean and k principal directions (a row a cell) of normal tiles; k and the tile's size bound them."""
    vectors = normals.select(array_to_vector(data).alias("v"))
    return mean_tile(normals, data), np.array(PCA(k=k, inputCol="v", outputCol="p").fit(vectors).pc.toArray())


def project(tiles: DataFrame, mean: list[float], directions, data: str = "data") -> DataFrame:
    """Adds rec, the projection of each tile on orthonormal directions through the mean, and its errors (mse, distance)."""
    table = lambda m: F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in m])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    rows, means = np.asarray(directions, float), F.array(*[F.lit(float(m)) for m in mean])
    centred = tiles.withColumn("__c", F.zip_with(F.col(data), means, lambda a, b: a - b))
    placed = centred.withColumn("__p", F.transform(table(rows.T), lambda d: dot(d, F.col("__c"))))
    rebuilt = placed.withColumn("rec", F.zip_with(means, F.transform(table(rows), lambda r: dot(r, F.col("__p"))), lambda m, v: m + v)).drop("__c", "__p")
    return rebuilt.withColumn("mse", mean_square(F.col(data), F.col("rec"))).withColumn("distance", anomaly_distance(F.col(data), F.col("rec")))


def reconstruct(tiles: DataFrame, model: tuple[list[float], np.ndarray], data: str = "data") -> DataFrame:
    return project(tiles, *model, data)
