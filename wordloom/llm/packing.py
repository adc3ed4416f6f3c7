"""Operator 3, packing by shortest-pack-first over the length histogram.

Texts are cut every `size` tokens, so only the last piece of each is shorter. The histogram of the lengths
(at most `size` numbers, whatever the corpus) is packed on the driver: lengths are placed longest first,
each into the packs with the most room, by updating the counts of packing patterns and not single packs.
Patterns meet pieces by rank: the r-th piece of a length takes the r-th slot for it. Ranks come from counts
by (written part, length), so no length is ever gathered or sorted in one task.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import documents, ids_and_text, written
from wordloom.llm.pretokens import as_letters, is_plain, pretokens

#: Words whose ids a worker keeps before it starts anew, and the length beyond which it keeps none.
MAX_WORDS, KEPT_CHARS = 700_000, 256


class WordIds(dict):
    """pre-token -> its ids as bytes (little-endian, 32 bits), as the library gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model

    def __missing__(self, word: str) -> bytes:
        if len(self) > MAX_WORDS:
            self.clear()
        ids = np.array([t.id for t in self.model.tokenize(as_letters(word))], "<u4").tobytes()
        if len(word) <= KEPT_CHARS:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if is_plain(text):
            return b"".join(map(self.__getitem__, pretokens(text)[0]))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_made: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _made:
        _made.clear()
        _made[path] = WordIds(path)
    return _made[path]


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """(how many packs, the lengths in each), every piece of the histogram in exactly one pack.

    Lengths come longest first. Each goes to the patterns with the most room; pieces that fit nowhere open
    packs, as many to a pack as it holds. Ties go to the older pattern, so the result is reproducible.
    """
    packs: list[tuple[int, list[int]]] = []
    room: list[tuple[int, int]] = []  # (-room, index into packs), largest room first

    def add(count: int, lengths: list[int]) -> None:
        packs.append((count, lengths))
        heapq.heappush(room, (sum(lengths) - size, len(packs) - 1))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not in 1..{size}")
        again = []
        while n and room and -room[0][0] >= length:
            free, k = heapq.heappop(room)
            count, lengths = packs[k]
            used = min(count, n)
            if used < count:
                packs[k] = (count - used, lengths)
                again.append((free, k))
            else:
                packs[k] = (0, [])
            add(used, [*lengths, length])
            n -= used
        for x in again:
            heapq.heappush(room, x)
        each = size // length
        if n // each:
            add(n // each, [length] * each)
        if n % each:
            add(1, [length] * (n % each))
    return [p for p in packs if p[0]]


def slots(packs: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, offset), by rank; a row reaches to the next one's rank."""
    rank: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    sequence = 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            rows.setdefault(length, []).append((rank.get(length, 0), sequence, offset))
            rank[length] = rank.get(length, 0) + count
            offset += length
        sequence += count
    return {length: np.array(r, np.int64) for length, r in rows.items()}


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, size: int, end_id: int, vocabulary: str | None, id_col: str, text_col: str) -> DataFrame:
    """The pieces of each text's ids, with the task that made them and each one's rank of its length there."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        ids_of = word_ids(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
        part, seen = TaskContext.get().partitionId(), [0] * (size + 1)
        last = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = (ids_of.of(text.as_py()) if text.is_valid else b"") + last
                for at in range(0, len(ids), 4 * size):
                    piece = ids[at : at + 4 * size]
                    n = len(piece) // 4
                    rows.append((doc_id, at // 4, n, zlib.crc32(piece), len(ids) // 4, part, seen[n]))
                    seen[n] += 1
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    return ids_and_text(docs, id_col, text_col).mapInArrow(cut, f"{PIECE}, part long, nth long")


def pack(docs: DataFrame, size: int = 4096, end_id: int = 2, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is its end id alone; repeated ids and texts are packed row by row; an empty table
    gives no rows; other columns are not read. The pieces are written to the shared folder first, as ranks
    must not change when a task runs again.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, size, end_id, vocabulary, id_col, text_col), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = by_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    place = spark.sparkContext.broadcast(slots(shortest_pack_first(histogram, size)))  # bound by the histogram

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                table = place.value[int(length[at[0]])]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    ranked = cut.join(based.drop("n"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.mapInArrow(assign, f"{PIECE}, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
