"""Tiles in .npy files under orchard/split/case as a data source of its own: ``spark.read.format("npy_tiles")``.

Register it with ``spark.dataSource.register(NpyTiles)``. Options: path (any store that Arrow's file systems reach), and orchard, split or case to read only the folders
of that name; equalities on these columns do the same. Spark needs ``spark.sql.python.filterPushdown.enabled`` for that (:func:`read_tiles` sets it). Folders that are left out aren't listed, and
their files aren't opened. A partition holds whole files, up to ``files_per_partition`` of them.
Written, a tile is one file named by its ``name``, put there whole, so a task that runs twice leaves what one run does.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage

FOLDERS = ("orchard", "split", "case")
SCHEMA = "orchard string, split string, `case` string, name string, height int, width int, channels int, data array<double>"
FILES_PER_PARTITION = 256


def as_tile(a: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """height, width, channels and the values in order; a one-dimensional array is one row."""
    a = a.reshape(1, -1) if a.ndim == 1 else a
    return (*a.shape[:2], a.shape[2] if a.ndim > 2 else 1, a.astype(float).ravel())


@dataclass
class Files(InputPartition):
    """Files of one partition, each with its folders' names and its own."""

    files: list[tuple[str, tuple[str, ...]]]


class NpyTiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NpyWriter(self.options["path"], [f.name for f in schema.fields])


class NpyReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.only = {c: options[c] for c in FOLDERS if options.get(c) is not None}
        self.most = int(options.get("files_per_partition", FILES_PER_PARTITION))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in FOLDERS and self.only.get(f.attribute[0], f.value) == f.value:
                self.only[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[Files]:
        store, root = fs.FileSystem.from_uri(self.path)
        level: list[tuple[str, tuple[str, ...]]] = [(root, ())]
        for folder in FOLDERS:
            below = []
            for at, names in level:
                found = [i for i in store.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.Directory]
                below += [(i.path, (*names, i.base_name)) for i in found if self.only.get(folder, i.base_name) == i.base_name]
            level = below
        files = []
        for at, names in level:
            files += sorted((i.path, (*names, i.base_name)) for i in store.get_file_info(fs.FileSelector(at)) if i.base_name.endswith(".npy"))
        return [Files(files[i : i + self.most]) for i in range(0, len(files), self.most)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(self.path)
        kinds = pa.schema([*[(c, pa.string()) for c in (*FOLDERS, "name")], *[(c, pa.int32()) for c in ("height", "width", "channels")], ("data", pa.list_(pa.float64()))])
        for path, names in partition.files:
            with store.open_input_file(path) as f:
                tile = as_tile(np.load(io.BytesIO(f.read())))
            yield pa.RecordBatch.from_arrays([pa.array([v], k.type) for v, k in zip((*names, *tile), kinds, strict=True)], schema=kinds)


class NpyWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns = path, columns

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, root = fs.FileSystem.from_uri(self.path)
        for row in rows:
            row = dict(zip(self.columns, row, strict=True))
            out = io.BytesIO()
            np.save(out, np.asarray(row["data"], float).reshape(row["height"], row["width"], row["channels"]))
            folder = "/".join([root, *(row[c] for c in FOLDERS)])
            store.create_dir(folder)
            with store.open_output_stream(f"{folder}/{row['name']}") as f:
                f.write(out.getvalue())
        return WriterCommitMessage()


def read_tiles(spark, path: str, **only: str):
    """Tiles below ``path``; orchard, split and case, where given, are the only folders read. Turns filter pushdown on in the session."""
    spark.dataSource.register(NpyTiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("npy_tiles").options(path=path, **only).load()


def write_tiles(tiles, path: str) -> None:
    """tiles: the columns that :func:`read_tiles` gives."""
    tiles.sparkSession.dataSource.register(NpyTiles)
    tiles.write.format("npy_tiles").mode("append").option("path", path).save()
