"""Seed candidates: the most frequent substrings up to a length; single characters always stay.

A substring's prefix is at least as frequent as it is and comes first among equals, so the best `limit` substrings
hold all their prefixes. Beyond the first lengths, they are therefore counted a few at a time, and only behind
prefixes that are among the best so far: what later passes broadcast is bound by the limit, and they shuffle
only what extends it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.workers import lean
from wordloom.model import TrainerConfig
from wordloom.operators.arrays import Trie, code_points, lengths_of, slices, substrings

#: Substrings that a task adds up before it hands them on, and characters that it counts at a time; lengths that the first pass counts, and each later one.
HELD, CHARS, FIRST, LENGTHS = 500_000, 1 << 19, 3, 2


def substring_counts(texts: DataFrame, max_chars: int, weight: str | None = None, min_chars: int = 1, prefixes: set[str] | None = None) -> DataFrame:
    """piece, count over the column normalized. Substrings may cross the boundary marker.

    With prefixes, all of one length below min_chars, only substrings that begin with one of them. Each task counts
    what it reads as arrays, some characters at a time, so memory is bounded and the shuffle gets sums.
    """
    names = sorted(prefixes) if prefixes is not None else None
    shared = texts.sparkSession.sparkContext.broadcast((names, Trie(names))) if names else None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        total: Counter = Counter()
        known, trie = shared.value if shared else (None, None)

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])
            total.clear()
            return rows

        for batch in batches:
            lengths = lengths_of(batch.column("normalized"))
            for a, b in slices(lengths, CHARS):
                codes = code_points(batch.column("normalized").slice(a, b - a), lengths[a:b])
                w = batch.column("w").slice(a, b - a).to_numpy()
                weights = None if (w == 1).all() else np.repeat(w, lengths[a:b] + 1)
                for pieces, counts in substrings(codes, max_chars, weights, trie, known):
                    if len(pieces[0]) >= min_chars:
                        for piece, c in zip(pieces, counts):
                            total[piece] += c
                    if len(total) > HELD:
                        yield out()
        yield out()
        batch = codes = weights = None
        lean()

    rows = texts.filter("normalized <> ''").select("normalized", (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    if names == []:
        rows = rows.limit(0)
    return rows.mapInArrow(count, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("count"))


def seed_candidates(texts: DataFrame, config: TrainerConfig, weight: str | None = None) -> DataFrame:
    """piece, count, protected, position: characters by code point, then the rest by count, up to the limit.

    The driver holds the characters and seed_candidate_limit pieces. Texts are read once a pass, and persisted for it
    unless they are already.
    """
    own = not texts.is_cached
    if own:
        texts = texts.select("normalized", *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        to = min(FIRST, config.max_piece_chars)
        counted = substring_counts(texts, to, weight).persist(StorageLevel.MEMORY_AND_DISK)
        single = sorted((r["piece"], r["count"]) for r in counted.filter(F.length("piece") == 1).collect())
        room = max(config.seed_candidate_limit - len(single), 0)
        best = _top(counted, room, config.min_candidate_freq)
        counted.unpersist()
        while room and to < config.max_piece_chars and (prefixes := {p for p, _ in best if len(p) == to}):
            least = max(config.min_candidate_freq, best[-1][1] if len(best) == room else 0)
            to = min((n := to + 1) + LENGTHS - 1, config.max_piece_chars)
            best += _top(substring_counts(texts, to, weight, n, prefixes), room, least)
            best = sorted(best, key=lambda x: (-x[1], x[0]))[:room]
    finally:
        if own:
            texts.unpersist()
    rows = [(p, c, True) for p, c in single] + [(p, c, False) for p, c in best]
    return texts.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rows)], "piece string, count long, protected boolean, position int")


def _top(counted: DataFrame, room: int, least: int) -> list[tuple[str, int]]:
    rows = counted.filter((F.length("piece") > 1) & (F.col("count") >= least)).orderBy(F.desc("count"), "piece").limit(room)
    return [(r["piece"], r["count"]) for r in rows.collect()] if room else []
