"""Helpers shared by the training-data operators: tables, shared folder, byte views."""

from __future__ import annotations

import ctypes
import ctypes.util

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from fitloom.sources.scratch import Scratch, remove, shared_dir  # noqa: F401  the operators take them from here

U64 = np.uint64
#: Bytes of text that numpy kernels take at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, docs: DataFrame) -> str:
    """A column name that docs does not use."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


#: Rows and bytes that go to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = "1500", "8m"


def small_batches(df: DataFrame) -> DataFrame:
    """df, in a session whose Arrow batches are small: texts are long, and a worker holds a few copies of a batch.

    Settings other than Spark's own are left as they are.
    """
    conf = df.sparkSession.conf
    for key, plain, ours in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), BATCH_BYTES)):
        if conf.get(key, None) in (plain, "64MB", "64m", None):
            conf.set(key, ours)
    return df


def give_back() -> None:
    """Return this process's unused memory to the system."""
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c")
    trim = getattr(ctypes.CDLL(name), "malloc_trim", None) if name else None
    if trim is not None:
        trim(0)


def released(run):
    """run, whose worker gives unused memory back when a task ends; workers live on between stages."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first, last) document ranges of at most `limit` bytes, one document at least."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


#: Fixed random value of each byte, and the odd base of the word hash.
BYTE_VALUE, BASE = stream(11, 256), U64(0x9E3779B97F4A7C55)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


#: Letters and digits, and every byte beyond ASCII; capitals fold to small letters.
WORDLIKE = np.zeros(256, bool)
WORDLIKE[48:58] = WORDLIKE[65:91] = WORDLIKE[97:123] = WORDLIKE[128:] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~SPACE, accents: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each run of `inside` bytes, A-Z lower-cased, and the row it lies in.

    By default runs are white-space words; accents lower-cases U+00C0 to U+00DE, too.
    """
    low = LOWER[raw]
    if accents and len(raw):
        low[1:][(raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)] += 32
    solid = inside[raw]
    start = solid.copy()
    start[1:] &= ~solid[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = solid[heads]
    at = np.flatnonzero(start)
    if not len(at):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    body = np.flatnonzero(solid)
    word = np.cumsum(start[body]) - 1
    pos = body - at[word]
    power = np.cumprod(np.concatenate([[U64(1)], np.full(int(pos.max()), BASE, U64)]))
    first = np.searchsorted(body, at)
    got = np.add.reduceat(BYTE_VALUE[low[body]] * power[pos], first)
    return mix(got), np.searchsorted(offsets, at, "right") - 1


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int):
    """Per row the sorted distinct 64-bit hashes of its `size`-word shingles.

    A row of fewer words has one shingle, its whole sequence; none has none.
    """
    words, row = word_hashes(raw, offsets)
    n = len(offsets) - 1
    lo, hi = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
    keys = stream(23, size) | U64(1)
    full = np.zeros(0, U64)
    if len(words) >= size:
        full = words[: len(words) - size + 1] * keys[0]
        for j in range(1, size):
            full = full + words[j : len(words) - size + 1 + j] * keys[j]
        full = mix(full)
    for i in range(n):
        a, b = lo[i], hi[i]
        if b - a >= size:
            yield np.unique(full[a : b - size + 1])
        elif b > a:
            yield mix(np.sum(words[a:b] * keys[: b - a], keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, U64)
