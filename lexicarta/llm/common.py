"""Shared helpers: staged tables in the cluster's shared folder, vectorised
word hashing over Arrow text columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexicarta.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


# ------------------------------------------------------------------ staging


class Staged:
    """Intermediate Parquet tables under the shared checkpoint folder.

    A staged table cuts lineage and survives lost executors.  ``drop``
    removes a table this object wrote once nothing reads it any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """Write what all other tables were for, and delete those."""
        out = self.write(df)
        for number in range(1, self.count):
            self.drop(number)
        return out

    def drop(self, number: int) -> None:
        """Delete the ``number``-th table written (1-based), if it is there."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{number}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def extended(schema: T.StructType, **added: T.DataType) -> T.StructType:
    """``schema`` with further columns."""
    return T.StructType([*schema.fields, *[T.StructField(k, t) for k, t in added.items()]])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def id_bucket(doc_id: Column, modulus: int = 5) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


# ------------------------------------------------------------- word hashing

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K1, _K2, _K3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x2545F4914F6CDD1D)
#: Bytes hashed at a time; temporary arrays take some fifty times as many.
PIECE = 256 << 10
_tables: dict[str, np.ndarray] = {}

#: \x20 and \x09-\x0D separate words.
SPACE_SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * _K1
    x = x ^ (x >> np.uint64(29))
    x = x * _K2
    return x ^ (x >> np.uint64(32))


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables or len(_tables["pow"]) < n:
        size = max(n, PIECE + 4096)
        _tables["pow"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _tables["inv"] = np.cumprod(np.full(size, _INV, np.uint64))
    return _tables["pow"], _tables["inv"]


def _byte_tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    key = f"bytes{lower}"
    if key not in _tables:
        sep = np.zeros(256, bool)
        sep[list(SPACE_SEPARATORS)] = True
        value = np.arange(1, 257, dtype=np.uint64)
        if lower:
            value[65:91] += np.uint64(32)
        _tables[key], _tables[key + "v"] = sep, value
    return _tables[key], _tables[key + "v"]


def _hash_piece(data: np.ndarray, breaks: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of one byte range: (start, end, hash).  ``breaks``: offsets at
    which a new document begins."""
    sep_table, value_table = _byte_tables(lower)
    sep = sep_table[data]
    begin, end = ~sep, ~sep
    begin[1:] &= sep[:-1]
    end[:-1] &= sep[1:]
    inner = breaks[(breaks > 0) & (breaks < len(data))]
    begin[inner] = ~sep[inner]
    end[inner - 1] = ~sep[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value_table[data] * power[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, mix(hashes + (ends - starts).astype(np.uint64) * _K3)


class Words:
    """The words of a run of documents, flat.

    ``per_doc[i]`` words belong to document ``first + i``; word ``j`` is
    ``data[starts[j]:ends[j]]`` with 64-bit hash ``hashes[j]``.
    """

    __slots__ = ("first", "per_doc", "starts", "ends", "hashes", "data")

    def __init__(self, first, per_doc, starts, ends, hashes, data):
        self.first, self.per_doc, self.starts, self.ends, self.hashes, self.data = first, per_doc, starts, ends, hashes, data

    @property
    def offsets(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.per_doc)])


def iter_words(texts: pa.Array, lower: bool) -> Iterator[Words]:
    """Words of a column of texts (null: none), in runs of whole documents
    of about ``PIECE`` bytes.  A longer document is hashed piece by piece,
    cut at separators, so temporary memory stays bounded by the piece."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if n == 0:
        return
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64)[texts.offset: texts.offset + n + 1]
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1)
        last = min(last, n)
        lo, hi = int(offsets[first]), int(offsets[last])
        parts = []
        at = lo
        while at < hi:
            to = min(hi, at + PIECE)
            if last - first == 1 and to < hi:  # inside one long document: cut at a separator
                to = _cut(data, at, to, hi)
            else:
                to = hi
            s, e, h = _hash_piece(data[at:to], offsets[first:last] - at, lower)
            parts.append((s + at, e + at, h))
            at = to
        if parts:
            starts, ends, hashes = (np.concatenate([p[k] for p in parts]) for k in range(3))
        else:
            starts, ends, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        per_doc = np.diff(np.searchsorted(starts, offsets[first: last + 1], "left"))
        yield Words(first, per_doc, starts, ends, hashes, data)
        first = last


def _cut(data: np.ndarray, at: int, to: int, hi: int) -> int:
    """A position near ``to`` that does not split a word."""
    sep_table, _ = _byte_tables(False)
    back = np.flatnonzero(sep_table[data[at:to]])
    if len(back):
        return at + int(back[-1]) + 1
    while to < hi:
        ahead = np.flatnonzero(sep_table[data[to: to + PIECE]])
        if len(ahead):
            return to + int(ahead[0])
        to = min(hi, to + PIECE)
    return hi


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    m = len(hashes) - k + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, k * int(_K3) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for j in range(k):
        out *= _BASE
        out += hashes[j: j + m]
    return mix(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of every ``width`` consecutive
    values (compared by their upper 40 bits), by doubling."""
    m = len(values) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    out = []
    block = 1 << 23
    for lo in range(0, m, block):
        part = values[lo: min(len(values), lo + block + width - 1)]
        low = np.uint64(0xFFFFFF)
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= width:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < width:
            step = width - size
            key = np.minimum(key[:-step], key[step:])
        out.append((key & low).astype(np.int64) + lo)
    return np.concatenate(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
