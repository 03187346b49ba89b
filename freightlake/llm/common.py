"""Shared helpers: tables, scratch folders, and vectorised words over Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space, and tab to carriage return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 20
#: DuckDB's CRC-32 of the bytes in {0}, a list of integers.
CRC32_SQL = "xor(list_reduce([4294967295::BIGINT] || {0}, lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, zero: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
#: DuckDB's list of the bytes of the text {0}.
BYTES_SQL = "list_transform(range(octet_length(encode({0}))), lambda i: CAST('0x' || substr(hex(encode({0})), 2 * i + 1, 2) AS BIGINT))"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_SECOND_BASE = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a folder of its own, once for each context; a cluster must name one.
    """
    context = spark.sparkContext
    place = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not place:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='spark-shared-')}")
        place = context.getCheckpointDir()
    return place.rstrip("/")


def private(columns: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with none of the columns, nor, in any case of letters, with each other."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def named(*columns: str) -> list[Column]:
    """Columns by their exact names, whatever characters are in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def cut(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here and a lost executor costs nothing.

    release: have the driver collect its garbage, since Spark drops a finished plan's shuffle files only then.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    if release:
        collect_garbage(spark)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hash_bucket(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def _table_of_powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, STEP_BYTES + 1)
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 4 * STEP_BYTES:
            _powers[base] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values, so that equal sums spread evenly."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit polynomial hashes of values[start:end], from prefix sums; second: of another base."""
    n, base = len(values), _SECOND_BASE if second else _BASE
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values.astype(np.uint64) * _table_of_powers(base, n), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _table_of_powers(pow(base, -1, 1 << 64), n + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of some consecutive texts: byte spans, the text each belongs to, and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        self.n_texts = len(offsets) - 1
        inside = ~_SPACE[data]
        first = np.empty(len(data), dtype=bool)
        last = np.empty(len(data), dtype=bool)
        if len(data):
            first[0] = True
            first[1:] = ~inside[:-1]
            first[offsets[:-1][offsets[:-1] < len(data)]] = True
            last[-1] = True
            last[:-1] = ~inside[1:]
            last[offsets[1:][offsets[1:] > 0] - 1] = True
        self.starts = np.flatnonzero(inside & first)
        self.ends = np.flatnonzero(inside & last) + 1
        #: bounds[i]:bounds[i+1] are the words of text i
        self.bounds = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, second: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, second)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), np.diff(self.bounds))


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins and ends in them; a null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", step_bytes: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about step_bytes of text each, with the text column's bytes and offsets.

    When the batches end the worker gives back what memory it holds but no longer uses, since it waits for other tasks.
    """
    for batch in batches:
        data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + step_bytes, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to
        del batch, data, offsets
    give_back()


def give_back() -> None:
    """Return freed memory to the system, as far as the allocators can."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def bytes_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column with lengths[i] of the bytes in row i."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1 and so on, counts[i] of them, for each i in turn."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(int(total[-1]) if len(total) else 0)


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with counts[i] of the values in row i."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
