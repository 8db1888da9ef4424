"""Helpers that several corpus operators use: checkpoints, byte tables, word tokens and hashes in numpy."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
#: One batch of texts is worked on in slices of about this many bytes, so that memory stays level.
SLICE_BYTES = 2 << 20
#: Bytes of text, or words of it, that are hashed at once, so that a very long text takes no more than its results.
PIECE = 1 << 20

_rng = np.random.default_rng(20240117)
#: A random odd 64-bit multiplier, its inverse modulo 2**64 and a random value for each byte.
ODD = int(_rng.integers(1 << 62, 1 << 63)) | 1
ODD_INVERSE = pow(ODD, -1, 1 << 64)
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The folder that the session names in spark.checkpoint.dir; one of our own only on a single machine without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder from whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def released(work):
    """A function of batches that, when its task ends, gives back to the system the memory that its worker, which other tasks use next, does not need."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def free_name(name: str, *taken: str) -> str:
    """name, with underscores behind it until no column has it."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


def array_literal(values: list[int], kind: str = "bigint"):
    """values as a constant array column; it goes to the JVM as one string, which the optimizer folds into an array once."""
    if not values:
        return F.expr(f"cast(array() as array<{kind}>)")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def let(value, body):
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_column(text):
    """The words of a text column as an array; none for a null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES.decode()))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about limit bytes of text each; a longer text stands alone."""
    sizes = np.nan_to_num(np.asarray(pyarrow.compute.binary_length(column).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > limit:
            yield start, k
            start, total = k, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts in UTF-8; a null text has no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def powers(n: int, base: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class PowerTable:
    """Powers of ODD and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up, self.down = powers(1 << 16, ODD), powers(1 << 16, ODD_INVERSE)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            self.up, self.down = powers(size, ODD), powers(size, ODD_INVERSE)
        return self.up, self.down


POWERS = PowerTable()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, the bytes of some texts that begin at bounds[:-1]; and the first word of each text, with the number of words last."""
    blank = np.ones(len(data) + 1, bool)
    blank[:-1] = IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds[:-1]] = True
    inside = ~blank
    before = np.empty_like(blank)
    before[0], before[1:] = True, blank[:-1]
    starts = np.flatnonzero(inside & (before | edge))
    stop = blank | edge
    stop_before = np.zeros_like(blank)
    stop_before[1:] = inside[:-1]
    ends = np.flatnonzero(stop & stop_before)
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: random byte values under powers of a random multiplier, scrambled."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        to = max(k + 1, int(np.searchsorted(ends, base + PIECE, side="right")))
        if ends[to - 1] - base > PIECE:
            out[k] = _long_word(data[base : ends[k]])
        else:
            piece = data[base : ends[to - 1]]
            up, down = POWERS.get(len(piece) + 1)
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[piece] * up[: len(piece)], out=sums[1:])
            a, b = starts[k:to] - base, ends[k:to] - base
            out[k:to] = (sums[b] - sums[a]) * down[a]
        k = to
    return mix(out + (ends - starts).astype(np.uint64))


def _long_word(data: np.ndarray) -> np.uint64:
    """The same sum for one word, piece by piece."""
    total = 0
    for k in range(0, len(data), PIECE):
        piece = data[k : k + PIECE]
        total += pow(ODD, k, 1 << 64) * int((BYTE_VALUES[piece] * POWERS.get(len(piece) + 1)[0][: len(piece)]).sum(dtype=np.uint64))
    return np.uint64(total % (1 << 64))


def rolling_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every run of size words, given the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for k in range(0, n, PIECE):
        piece = words[k : k + PIECE + size - 1]
        up, down = POWERS.get(len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=sums[1:])
        m = len(piece) - size + 1
        out[k : k + m] = mix((sums[size:] - sums[:m]) * down[:m])
    return out
