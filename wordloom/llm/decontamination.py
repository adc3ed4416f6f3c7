"""Operator 1, benchmark decontamination by a BM25 index of the test items with block-max WAND.

The items are indexed, not the corpus: a term's postings hold its BM25 impact on each item, divided by the
score that the item asks for, so that one threshold, 1, holds for all. Items are laid out in blocks, and each
term keeps its largest impact by block (block-max) and over all items (list-max). Every training passage, two
neighbouring segments of `stride` words, is a query:

* if the list-max sum of its terms stays below 1, no item is opened (the WAND bound);
* else block-max sums are formed for terms that are in few blocks, with list-max for the common rest, and
  only blocks whose sum reaches 1 are opened and scored in full; all items that reach 1 are retrieved.

Retrieved items are verified: the share of the question's and of the answer's word triples (the answer is an
item's last sentences, or its last quarter) that stand in the text near the passage.

The index is broadcast in shards of about `shard_bytes` of item text, `pass_bytes` of them for each pass over the
corpus, whose words are read once for all shards of a pass. Document frequencies and the mean length are those of the
whole benchmark, so results do not depend on the shards. An item of fewer than `least_words` different words is no
evidence of a leak (one common word would flag most texts): it is not searched for, and `weak_items` names it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import ALNUM, U64, blocks, documents, written

LEAK = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
K1, B = 1.2, 0.75
BLOCK_ITEMS, ANSWER_WORDS = 8, 6
#: The threshold, with room for the order of sums.
LEAST = 1 - 1e-9
#: Passages that are summed and scored together.
STEP = 512


def words_of(text: str) -> np.ndarray:
    return next(blocks(pa.array([text]))).words(ALNUM, lower=True).hash


def triples(words: np.ndarray) -> np.ndarray:
    """Hashes of three words in a row (the words themselves, if there are fewer)."""
    if len(words) < 3:
        return words
    return (words[:-2] * U64(31) + words[1:-1]) * U64(0x9E3779B97F4A7C15) + words[2:]


def answer_at(text: str) -> int:
    """Where the answer begins: the last sentences of six words or more, or else the last quarter of the words."""
    body = text.rstrip()
    for m in reversed(list(re.finditer(r"[.!?:]\s+", body))):
        if len(words_of(body[m.end() :])) >= ANSWER_WORDS and m.end() >= len(body) // 3:
            return m.end()
    spaces = [m.end() for m in re.finditer(r"\s+", body)]
    return spaces[len(spaces) * 3 // 4] if spaces else 0


class Index:
    """terms (sorted hashes), postings by term and by block, and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], frequency: dict[int, int], total: int, mean: float, share: float, stride: int):
        self.item_ids = [i for i, _ in items]
        words = [words_of(t) for _, t in items]
        self.question, self.answer, self.length = [], [], [len(w) for w in words]
        for (_, text), w in zip(items, words):
            n = len(words_of(text[: answer_at(text)]))
            self.question.append(np.unique(triples(w[:n])))
            self.answer.append(np.unique(triples(w[n:])))
        pairs = [np.unique(w, return_counts=True) for w in words]
        item = np.repeat(np.arange(len(items)), [len(p[0]) for p in pairs])
        term, tf = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, t) for k, t in ((0, U64), (1, np.int64)))
        self.terms, at = np.unique(term, return_inverse=True)
        df = np.array([frequency[int(t)] for t in self.terms.view(np.int64)], float)
        idf = np.log1p((total - df + 0.5) / (df + 0.5))
        size = np.array(self.length, float)[item]
        impact = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(mean, 1)))
        own = np.bincount(item, impact, minlength=len(items))  # the item as its own query
        need = share * own * np.minimum(1, stride / np.maximum(1, self.length))
        impact = impact / np.maximum(need, 1e-9)[item]
        order = np.lexsort((item, at))
        self.item, self.impact = item[order], impact[order]
        self.first = np.searchsorted(at[order], np.arange(len(self.terms) + 1))
        key = at[order] * (len(items) // BLOCK_ITEMS + 1) + self.item // BLOCK_ITEMS
        starts = np.flatnonzero(np.r_[True, np.diff(key) != 0]) if len(key) else np.zeros(0, np.int64)
        self.block = self.item[starts] // BLOCK_ITEMS
        self.block_max = np.maximum.reduceat(self.impact, starts) if len(starts) else np.zeros(0)
        self.block_first = np.searchsorted(at[order][starts], np.arange(len(self.terms) + 1))
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        self.list_max = np.maximum.reduceat(self.impact, self.first[:-1]) if len(self.terms) else np.zeros(0)
        spread = np.diff(self.block_first)
        self.common = spread > max(4, self.blocks // 8)  # bound by list-max only

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are terms, and their places."""
        at = np.minimum(np.searchsorted(self.terms, hashes), max(0, len(self.terms) - 1))
        hit = np.flatnonzero(self.terms[at] == hashes) if len(self.terms) else np.zeros(0, np.int64)
        return hit, at[hit]


def spread_out(first: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key the rows first[key]..first[key + 1]: which key, and which row."""
    n = first[keys + 1] - first[keys]
    which = np.repeat(np.arange(len(keys)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[keys], n)


def retrieve(index: Index, doc: np.ndarray, nth: np.ndarray, hashes: np.ndarray, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of the passage in these arrays, item, score), all that reach 1."""
    new = np.flatnonzero(np.r_[True, (np.diff(doc) != 0)] | (nth % stride == 0)) if len(doc) else np.zeros(0, np.int64)
    seg_of = np.cumsum(np.bincount(new, minlength=len(doc))) - 1 if len(doc) else new
    n = len(new)
    hit, term = index.find(hashes)
    seg = seg_of[hit]
    joined = np.r_[doc[new][1:] == doc[new][:-1], False] if n else np.zeros(0, bool)  # a passage: this segment and the next
    after = lambda x: x + np.where(joined.reshape(-1, *[1] * (x.ndim - 1)), np.r_[x[1:], x[:1]], 0)
    bound = np.bincount(seg, index.list_max[term], minlength=n)
    wanted = after(bound) >= LEAST
    if not wanted.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    edge = np.searchsorted(seg, np.arange(n + 2))
    starts, items, scores = [], [], []
    terms, blocks_of = len(index.terms), index.blocks
    opened = np.flatnonzero(wanted)
    for lo in range(0, len(opened), STEP):  # some passages at a time
        p = opened[lo : lo + STEP]
        size = edge[np.minimum(n, p + 1 + joined[p])] - edge[p]
        which = np.repeat(np.arange(len(p)), size)
        own = term[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(edge[p], size)]
        which, own = np.divmod(np.unique(which * terms + own), terms)  # each term of a passage counts once
        few = ~index.common[own]
        base = np.bincount(which[~few], index.list_max[own[~few]], minlength=len(p))
        at, row = spread_out(index.block_first, own[few])
        key = which[few][at] * blocks_of + index.block[row]  # only blocks that a term is in are summed
        every = np.flatnonzero(base >= LEAST)  # the common terms alone may reach 1: all blocks are open
        key, inverse = np.unique(np.r_[key, (every[:, None] * blocks_of + np.arange(blocks_of)).ravel()], return_inverse=True)
        by_block = np.bincount(inverse[: len(at)], index.block_max[row], minlength=len(key))
        key = key[by_block + base[key // blocks_of] >= LEAST]
        if not len(key):
            continue
        some = np.flatnonzero(np.isin(which, key // blocks_of))
        at, row = spread_out(index.first, own[some])
        place = which[some][at] * blocks_of + index.item[row] // BLOCK_ITEMS
        rank = np.minimum(np.searchsorted(key, place), len(key) - 1)
        inside = key[rank] == place
        slot = rank[inside] * BLOCK_ITEMS + index.item[row[inside]] % BLOCK_ITEMS
        score = np.bincount(slot, index.impact[row[inside]], minlength=len(key) * BLOCK_ITEMS).reshape(-1, BLOCK_ITEMS)
        k, nth_item = np.nonzero(score >= LEAST)
        starts.append(new[p[key[k] // blocks_of]])
        items.append(key[k] % blocks_of * BLOCK_ITEMS + nth_item)
        scores.append(score[k, nth_item])
    return (np.concatenate(starts), np.concatenate(items), np.concatenate(scores)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def overlap(asked: np.ndarray, there: np.ndarray) -> float:
    return float(np.isin(asked, there).mean()) if len(asked) else 1.0


def _leaks(index, share: float, stride: int, question: float, answer: float):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for b in blocks(batch.column("text")):
                w = b.words(ALNUM, lower=True)
                nth = np.arange(len(w.doc)) - w.first[w.doc]
                rows: list[tuple] = []
                for x in index.value:
                    start, item, score = retrieve(x, w.doc, nth, w.hash, stride)
                    best: dict[tuple, tuple] = {}
                    for s, i, v in zip(start.tolist(), item.tolist(), score.tolist()):
                        d = int(w.doc[s])
                        around = slice(max(w.first[d], s - x.length[i]), min(w.first[d + 1], s + 2 * stride + x.length[i]))
                        there = np.concatenate([triples(w.hash[around]), w.hash[around]])
                        q, a = overlap(x.question[i], there), overlap(x.answer[i], there)
                        if q >= question and a >= answer:
                            best[d, i] = max(best.get((d, i), (0.0,)), (share * v, q, a))
                    rows += [(ids[b.lo + d], x.item_ids[i], *v) for (d, i), v in best.items()]
                columns = list(zip(*rows)) if rows else [()] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return find


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's different words."""
    for batch in batches:
        for t in batch.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words_of(t)).view(np.int64))], names=["term"])


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [words_of(t or "") for t in batch.column("text").to_pylist()]
        columns = [batch.column("item_id"), batch.column("text"), pa.array([len(w) for w in words], pa.int64()), pa.array([len(np.unique(w)) for w in words], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text", "words", "kinds"])


def sized_items(items: DataFrame, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, text, words, kinds (different words)."""
    items = items.select(items[item_id_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text"))
    return items.mapInArrow(_sized, "item_id long, text string, words long, kinds long")


def weak_items(items: DataFrame, least_words: int = 8, item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, text, kinds of the items that `leaks` does not search for, null and empty ones too."""
    return sized_items(items, item_id_col, item_text_col).filter(F.col("kinds") < least_words).select("item_id", "text", "kinds")


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.6, stride: int = 64, question: float = 0.5, answer: float = 0.5, least_words: int = 8, shard_bytes: int = 8 << 20, pass_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each text and item that it leaks.

    score is the best passage's BM25 score as a share of the item's own. Null and empty texts and items leak
    nothing, nor do items of fewer than `least_words` different words (see weak_items); rows of equal text each have
    their own rows; an empty table on either side gives none; other columns are not read. Texts of any length are
    scored whole, passage by passage.
    """
    spark = docs.sparkSession
    items = sized_items(items, item_id_col, item_text_col).filter(F.col("kinds") >= least_words)
    stats = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    out = spark.createDataFrame([], LEAK)
    if not stats.n:
        return out
    shards = -(-stats.bytes // shard_bytes)
    by_term = items.mapInArrow(_terms, "term long").groupBy("term").agg(F.count("*").alias("n"))
    if shards > 1:
        by_term = written(by_term, "terms")
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards))
    each = max(1, pass_bytes // shard_bytes)
    for lo in range(0, shards, each):
        indexes = []
        for k in range(lo, min(shards, lo + each)):
            part = items.filter(shard == k)
            rows = [(r.item_id, r.text) for r in part.orderBy("item_id", "text").collect()]  # shard_bytes at most, about
            if rows:
                own = part.mapInArrow(_terms, "term long").distinct() if shards > 1 else None
                frequency = {r.term: r.n for r in (by_term.join(own, "term") if own is not None else by_term).collect()}
                indexes.append(Index(rows, frequency, stats.n, stats.words / stats.n, share, stride))
        if indexes:
            out = out.unionByName(docs.mapInArrow(_leaks(spark.sparkContext.broadcast(indexes), share, stride, question, answer), LEAK))
    return out


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
