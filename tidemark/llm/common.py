"""Shared pieces of the training-data operators: written cut points, and words and windows of Arrow text as numpy hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java character class.
SPACES = r"[\x20\x09-\x0D]+"

_GEN = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _GEN.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE, _STEP = (_GEN.integers(0, 2**64, 2, dtype=np.uint64) | np.uint64(1)).tolist()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset (tests), one of our own, but
    only if driver and tasks are one process; elsewhere a local folder would be lost, so that is an error."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN_DIR.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it again, so that a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete what cut() wrote for tables that nothing reads any more, such as those of earlier rounds of a loop."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes in `column` each (one row may have more), to bound a task's memory."""
    text = batch.column(column)
    if not len(text):
        return
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64) + 64)
    at = 0
    while at < len(text):
        done = size[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(size, done + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def spans(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, whether each stands in a word, where texts start and end, first and end byte of every word).

    A word is a run of bytes outside 0x20 and 0x09-0x0D within one text; null has none.
    """
    text = text.cast(pa.large_string())
    n = len(text)
    bounds = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    solid = ~_SPACE[data]
    if text.null_count:
        lengths = np.diff(bounds)
        solid &= np.repeat(np.asarray(text.is_valid()), lengths)
    fresh = np.zeros(len(data) + 1, bool)
    fresh[bounds] = True
    before = np.concatenate(([False], solid[:-1]))[: len(data)]
    after = np.concatenate((solid[1:], [False]))[: len(data)]
    return data, solid, bounds, np.flatnonzero(solid & (~before | fresh[:-1])), np.flatnonzero(solid & (~after | fresh[1:])) + 1


def words(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first byte, end byte) of every word of every text; null has none. Bytes count from the array's start.

    Words are those of `spans`; `lower` folds A-Z. Hashes are 64 bits, equal for equal words.
    """
    data, solid, bounds, first, end = spans(text)
    if not len(first):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty, empty
    size = end - first
    powers = np.full(int(size.max()), _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    at = np.flatnonzero(solid)
    heads = np.cumsum(size) - size
    local = np.arange(len(at)) - np.repeat(heads, size)
    hashed = np.add.reduceat((_BYTE_LOWER if lower else _BYTE)[data[at]] * powers[local], heads)
    row = np.searchsorted(bounds, first, "right") - 1
    return mix(hashed ^ (size.astype(np.uint64) * np.uint64(_STEP))), row, first, end


def windows(hashes: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every run of k words in one row."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = np.zeros(n, np.uint64)
    for j in range(k):
        acc = acc * np.uint64(_STEP) + hashes[j : j + n]
    inside = np.flatnonzero(row[:n] == row[k - 1 :])
    return mix(acc[inside]), inside


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
