"""Whole texts as byte arrays, hashes of any run of bytes or words, and small Spark helpers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the splitmix64 finish)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _upto(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        n = max(n, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers


class Rolling:
    """Hashes of any runs of a value sequence, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self._down = _upto(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self._sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self._sums[stop] - self._sums[start]) * self._down[start])


class Texts:
    """Some whole texts in one byte array, a line feed after each. Text i is data[start[i]:stop[i]]."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stop = np.cumsum(lengths + 1) - 1
        self.start = self.stop - lengths
        self._rolling: Rolling | None = None

    def rolling(self) -> Rolling:
        if self._rolling is None:
            self._rolling = Rolling(_BYTE[self.data])
        return self._rolling

    def words(self) -> Words:
        return Words(self)


class Words:
    """Words between white space: byte bounds, their text's number, and where each text's words begin (one entry more)."""

    def __init__(self, texts: Texts):
        space = _SPACE[texts.data]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        edges = np.concatenate([[0], change]) if len(space) and not space[0] else change
        self.start, self.stop = edges[0::2], edges[1::2]
        self.doc = np.searchsorted(texts.stop, self.start)
        self.first = np.searchsorted(self.doc, np.arange(len(texts.stop) + 1))
        self.hash = texts.rolling().of(self.start, self.stop)


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about limit bytes; a longer text makes a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(text) + 1
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column: the values dealt out in order, counts[i] to row i."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def packed(values: np.ndarray) -> bytes:
    """An array with its type and length, compressed."""
    top = int(values.max(initial=0)) if values.min(initial=0) >= 0 else 1 << 40
    kind = "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8"
    body = pa.compress(values.astype(kind).tobytes(), codec="zstd", asbytes=True)
    return kind[1:].encode() + len(values).to_bytes(8, "little") + body


def stored(data: bytes) -> np.ndarray:
    """A packed array as narrow as it was packed."""
    kind, n = np.dtype("<" + data[:2].decode()), int.from_bytes(data[2:10], "little")
    body = pa.decompress(data[10:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(body, kind)


def unpacked(data: bytes) -> np.ndarray:
    return stored(data).astype(np.int64)


def whole_rows(docs: DataFrame) -> DataFrame:
    """Every column inside one struct, so that no further column can clash with names of the input."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))


def numbered(df: DataFrame, order: list[str], total: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Rows with their rank (_rank, from 0) in a total order, and the number of rows.

    Rows are range-partitioned and written once; one count per partition gives the offsets, so no task sees them all.
    """
    from palisade.session import materialize

    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumn("_id", F.monotonically_increasing_id())
    stored = materialize(placed, "ranked").withColumn("_part", F.shiftright("_id", 33))
    counts = sorted((r["_part"], r["n"]) for r in stored.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, before = [], 0  # one number per partition
    for part, n in counts:
        offsets.append((part, before))
        before += n
    table = spark.createDataFrame(offsets or [(0, 0)], "_part long, _before long")
    ranked = stored.join(F.broadcast(table), "_part")
    within = F.col("_id") - F.shiftleft(F.col("_part"), 33)
    return ranked.withColumn("_rank", F.col("_before") + within).drop("_part", "_before", "_id"), before
