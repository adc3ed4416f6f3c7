"""What the corpus operators share: tables, the shared folder, and words as NumPy arrays.

Text columns are read as the UTF-8 buffers that Arrow hands over, in blocks of bounded size, so that
a partition's texts are never all held at once and no Python object is made for each word.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that are worked on at once (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20

#: Spark's setting by which a query's shuffle files are removed once it has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

U64 = np.uint64
_M1, _M2, _GOLD = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), U64(0x9E3779B97F4A7C15)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_folders: dict[str, str] = {}
_tables: dict[int, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir, removed when the driver ends; where the setting is unset
    (tests), a local one is set once."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-"))
            folder = sc.getCheckpointDir()
        _folders[sc.applicationId] = f"{folder}/wordloom-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        atexit.register(clear, spark)
    return _folders[sc.applicationId]


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)  # PySpark has no call of its own for this
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Removes all tables that this application has written; what still reads them fails."""
    with contextlib.suppress(Exception):  # at the driver's end Spark may have ended before
        if folder := _folders.pop(spark.sparkContext.applicationId, None):
            _remove(spark, folder)


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a new plan, which sees the setting
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _tables[id(out)] = path
    weakref.finalize(out, _tables.pop, id(out), None)
    return out


def discard(*tables: DataFrame) -> None:
    """Removes what `written` gave, once nothing reads it any more."""
    for df in tables:
        if path := _tables.pop(id(df), None):
            _remove(df.sparkSession, path)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one mix of 64-bit values."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _GOLD)
_BASE = U64(0xD6E8FEB86659FD93)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, BLOCK_BYTES * 2), b, U64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run values[start:end] of 64-bit values, order and length included."""
    up, down = powers(len(values) + 1)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * _GOLD)


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


#: Bytes of words: all but space and 09-0D; and letters, digits and whatever is not ASCII.
NOT_SPACE = ~_table(b" \t\n\x0b\x0c\r")
ALNUM = _table(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(128, 256)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Block:
    """Texts lo..hi of a batch: their bytes, and where each begins; null is empty."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.n = hi - lo

    def words(self, member: np.ndarray = NOT_SPACE, lower: bool = False, hashed: bool = True) -> Words:
        return Words(self, member, lower, hashed)


class Words:
    """starts, ends (bytes), doc (row in the block), count and first (by row), hash."""

    def __init__(self, block: Block, member: np.ndarray, lower: bool, hashed: bool):
        data, offsets, n = block.data, block.offsets, block.n
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        inside = member[data]
        begins = inside & edge[:-1]
        begins[1:] |= inside[1:] & ~inside[:-1]
        closes = inside & edge[1:]
        closes[:-1] |= inside[:-1] & ~inside[1:]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=n)[:n] if n else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        if hashed:
            self.hash = runs_hash(_BYTE[LOWER[data] if lower else data], self.starts, self.ends)

    def windows(self, size: int) -> np.ndarray:
        """Where size consecutive words of one text start."""
        last = len(self.doc) - size + 1
        return np.flatnonzero(self.doc[:last] == self.doc[size - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of size words, and their hashes."""
        at = self.windows(size)
        acc = np.zeros(len(at), U64)
        for k in range(size):
            acc = mix(acc * _BASE + self.hash[at + k])
        return at, acc


def blocks(texts: pa.Array, budget: int = BLOCK_BYTES) -> Iterator[Block]:
    """The texts of an Arrow column, some at a time."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, "right")) - 1)
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


class Sorted:
    """Values by 64-bit key: sorted arrays with a directory of the keys' leading bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = U64(64 - max(1, int(len(keys)).bit_length()))
        self.first = np.searchsorted(self.keys >> self.shift, np.arange((1 << (64 - int(self.shift))) + 1, dtype=U64)).astype(np.int32)
        self.deep = int(np.diff(self.first).max(initial=0))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are there, and the value of each (0 where it is not)."""
        value, found = np.zeros(len(keys), self.values.dtype), np.zeros(len(keys), bool)
        lead = (keys >> self.shift).astype(np.int64)
        at, stop, left = self.first[lead], self.first[lead + 1], np.arange(len(keys))
        for _ in range(self.deep):
            open_ = at < stop
            at, stop, left = at[open_], stop[open_], left[open_]
            if not len(left):
                break
            hit = self.keys[at] == keys[left]
            value[left[hit]], found[left[hit]] = self.values[at[hit]], True
            at, stop, left = at[~hit] + 1, stop[~hit], left[~hit]
        return found, value


def ids_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only these two, named doc_id and text, whatever other columns are called."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
