"""Tensor files (npy, npz with key arr_0, legacy h5) as track tables.

A file is read by tasks in row blocks; npy files are memory-mapped, so a task touches its own rows only. Files hold
(examples, 4, length); windows are cropped around the middle while reading.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS = "example_idx bigint, position_values array<array<float>>"


class TensorBlock(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


def load_tensor(path: str, key: str = "arr_0") -> np.ndarray:
    """An npy file memory-mapped, or one member of an npz file."""
    if str(path).endswith(".npz"):
        with np.load(path) as z:
            return z[key]
    return np.load(path, mmap_mode="r")


def crop(length: int, window: int) -> tuple[int, int]:
    """The slice around the middle. Odd windows lose a column and windows over the length have no slice: both fail."""
    half = window // 2
    start, end = length // 2 - half, length // 2 + half
    if end - start != window or start < 0 or end > length:
        raise ValueError(f"a window of {window} does not fit a track of {length}: it must be even and no longer")
    return start, end


class TensorSource(DataSource):
    """spark.read.format("tensor").option("path", ...).option("window", 400).load()"""

    @classmethod
    def name(cls) -> str:
        return "tensor"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema):
        return TensorReader(self.options)


class TensorReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.key = options["path"], options.get("key", "arr_0")
        self.window, self.block = int(options.get("window", 0)), int(options.get("block", 2000))

    def partitions(self):
        n = len(load_tensor(self.path, self.key))
        block = n if self.path.endswith(".npz") else self.block  # a zip member has one reader
        return [TensorBlock(a, min(n, a + block)) for a in range(0, n, max(1, block))] or [TensorBlock(0, 0)]

    def read(self, partition):
        data = load_tensor(self.path, self.key)
        start, end = crop(data.shape[2], self.window) if self.window else (0, data.shape[2])
        for i in range(partition.first, partition.last):
            yield i, np.asarray(data[i, :, start:end], dtype=np.float32).T.tolist()


def read_tensor(spark: SparkSession, path: str, window: int = 0) -> DataFrame:
    """example_idx, position_values (a row of four per position)."""
    spark.dataSource.register(TensorSource)
    return spark.read.format("tensor").option("path", path).option("window", window).load()


def read_h5(spark: SparkSession, path: str, window: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sequences, hypothetical scores) of a legacy file in either of its two layouts; needs h5py."""
    import h5py

    with h5py.File(path, "r") as f:
        if "hyp_scores" in f:
            hyp, seq = f["hyp_scores"][:], f["input_seqs"][:]
        else:
            hyp, seq = (f[k][:].transpose(0, 2, 1) for k in ("shap/seq", "raw/seq"))
    start, end = crop(seq.shape[1], window) if window else (0, seq.shape[1])
    frames = [pd.DataFrame({"example_idx": np.arange(len(x)), "position_values": [r[start:end].astype(np.float32).tolist() for r in x]}) for x in (seq, hyp)]
    return spark.createDataFrame(frames[0], ROWS), spark.createDataFrame(frames[1], ROWS)


def tracks_from(sequences: DataFrame, hypothetical: DataFrame) -> DataFrame:
    """example_idx, letters, hyp; letters are the largest base per position, the first on ties."""
    letter = lambda r: (F.array_position(r, F.array_max(r)) - 1).cast("int")
    left = sequences.select("example_idx", F.transform("position_values", letter).alias("letters"))
    right = hypothetical.select("example_idx", F.transform("position_values", lambda r: F.transform(r, lambda x: x.cast("double"))).alias("hyp"))
    return left.join(right, "example_idx")


def padding(length: int, min_overlap: float) -> tuple[int, int]:
    """Sliding room: rounded down for neighbours, up for alignments."""
    return int(length * (1 - min_overlap)), math.ceil(length * (1 - min_overlap))
