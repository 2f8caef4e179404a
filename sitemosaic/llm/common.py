"""Helpers of the corpus operators: shared storage, compact blocks, table access."""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import checkpoint, new_folder, shared_dir  # noqa: F401
from ..tasks import tidy  # noqa: F401


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 16 << 20) -> None:
    """Lowers the session's bound on the bytes of an Arrow batch, for maps whose rows are whole texts: a batch stands in the executor and in its worker."""
    now = spark.conf.get(BATCH_SETTING, None)
    size = int(now.rstrip("b")) if now and now.rstrip("b").lstrip("-").isdigit() else -1
    if not 0 < size <= most:
        spark.conf.set(BATCH_SETTING, f"{most}b")


# -- integers and strings as compressed blocks -------------------------------------
def pack_ints(a: np.ndarray) -> bytes:
    """Unsigned 32-bit integers: byte planes (as many as the largest value needs), compressed."""
    import zstandard
    a = np.ascontiguousarray(a, np.uint32)
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()
    return struct.pack("<IB", len(a), width) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack_ints(b: bytes) -> np.ndarray:
    import zstandard
    n, width = struct.unpack_from("<IB", b)
    out = np.zeros((n, 4), np.uint8)
    if n:
        planes = zstandard.ZstdDecompressor().decompress(b[5:], max_output_size=n * width)
        out[:, :width] = np.frombuffer(planes, np.uint8).reshape(width, n).T
    return out.reshape(-1).view(np.uint32)


def pack_bytes(items: list[bytes]) -> bytes:
    import zstandard
    sizes = pack_ints(np.fromiter(map(len, items), np.uint32, len(items)))
    return struct.pack("<I", len(sizes)) + sizes + zstandard.ZstdCompressor(level=1).compress(b"".join(items))


def unpack_bytes(b: bytes) -> list[bytes]:
    import zstandard
    k, = struct.unpack_from("<I", b)
    ends = np.cumsum(unpack_ints(b[4:4 + k]), dtype=np.int64)
    body = zstandard.ZstdDecompressor().decompress(b[4 + k:], max_output_size=int(ends[-1]) + 1 if len(ends) else 1)
    out, at = [], 0
    for e in ends.tolist():
        out.append(body[at:e])
        at = e
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0]+sizes[0]-1, starts[1] .. and so on, in one array."""
    sizes = np.asarray(sizes, np.int64)
    out = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum()), dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - out, sizes)


def slices(batches, rows: int = 500) -> Iterator:
    """Arrow batches in slices of a few rows, so that only a slice's values are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def text_bytes(column) -> Iterator[bytes]:
    """UTF-8 of an Arrow string column, null as empty."""
    for v in column.cast("binary") if column.type != "binary" else column:
        yield v.as_py() or b""
