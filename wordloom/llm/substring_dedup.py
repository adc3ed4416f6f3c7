"""Operator 4, removal of passages that stand in an earlier document.

One automaton of a whole corpus fits nowhere, so the reference is cut down to what can match at all, and sharded:

1. Each window of `window` words has an anchor, the least hash of its `gram`-word runs: equal windows have
   equal anchors. Consecutive windows with one anchor make a run, of about two thirds of a window more (at most LONG
   windows, whatever the text).
2. Only anchors of two or more documents go on. Of equal runs (copied passages), the first document keeps its own
   and the others lose theirs. What is left to compare, the distinct runs of anchors whose runs differ, is the
   reference: shards of about `shard_words` words by anchor.
3. A shard becomes a suffix automaton of its runs, documents in order, that knows the first document of each state.
   Automata are broadcast, `broadcast_words` words of reference in each of `passes` groups at most, and the documents'
   runs stream past their shard's: matching statistics against smaller documents of `window` words or more mark
   what is covered. A reference of more words than that is not broadcast: its shards are dealt to tasks, each of
   which builds one automaton at a time and streams the shard's runs past it. Results are the same.
4. An anchor of more than `anchor_words` words is dealt out, so that it need not fit: a task holds an automaton of
   shard_words + anchor_words words, about, at most. Its runs are cut into pieces of PIECE windows, counted from the
   anchor's place, so that copies have equal pieces; of equal ones, all but the first document's are covered. The
   windows of the first ones only are compared one by one (a minimum for each): the first document of a window
   has it in a piece that no smaller document has.
5. A run's spans are one row when they come back to the texts, however many they are and however often a row is
   repeated; the words that they cover go.

Every count is combined before it is shuffled; joins on anchors are ones that Spark can split.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.automaton import Compact, SuffixAutomaton, covered
from wordloom.llm.common import U64, blocks, documents, ids_and_text, runs_hash, written

RUN = "anchor long, same long, doc_id long, text_id long, first long, n long"
SNIPPET = "anchor long, same long, doc_id long, words binary, piece long, place long, parts array<long>"
FOUND = "anchor long, same long, doc_id long, s long, e long"
#: Windows of a run at most; runs that go through an automaton together.
LONG, TOGETHER = 512, 1024
#: Windows of a piece of a wide anchor's run at most.
PIECE = 8


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i : i + width], for every i that has so many."""
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _runs(window: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_ids = batch.column("doc_id").to_numpy(), batch.column("text_id").to_numpy()
            for b in blocks(batch.column("text")):
                w = b.words()
                at = w.windows(window)
                if not len(at):
                    continue
                begin = np.arange(len(w.hash) - gram + 1)
                least = sliding_min(runs_hash(w.hash, begin, begin + gram), window - gram + 1)[at]
                new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(least) != 0)])
                n = np.diff(np.r_[new, len(at)])
                cuts = -(-n // LONG)
                nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                new = np.repeat(new, cuts) + nth * LONG
                n = np.minimum(LONG, np.repeat(n, cuts) - nth * LONG)
                start = at[new]
                same = runs_hash(w.hash, start, start + n + window - 1)
                doc = w.doc[start]
                columns = least[new].view(np.int64), same.view(np.int64), ids[b.lo + doc], text_ids[b.lo + doc], start - w.first[doc], n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "same", "doc_id", "text_id", "first", "n"])

    return find


def _pieces(words: np.ndarray, anchor: int, n: int, window: int, gram: int) -> Iterator[tuple[int, int, list[int]]]:
    """(hash, first window, hashes of the windows) of each piece of a run of n windows."""
    at = np.arange(window - gram + 1)
    middle = np.flatnonzero(runs_hash(words, at, at + gram).view(np.int64) == anchor)[0]
    cuts = np.unique(np.r_[0, np.arange(middle % PIECE, n, PIECE), n])
    at = np.arange(n)
    parts = runs_hash(words, at, at + window).view(np.int64).tolist()
    whole = runs_hash(words, cuts[:-1], cuts[1:] + window - 1).view(np.int64).tolist()
    for h, s, e in zip(whole, cuts[:-1].tolist(), cuts[1:].tolist()):
        yield h, s, parts[s:e]


def _snippets(window: int, gram: int):
    """The words (as hashes) of the asked runs; of those of wide anchors, the pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for b in blocks(batch.column("text")):
                w = b.words()
                rows: list[tuple] = []
                for k in range(b.n):
                    for r in asked[b.lo + k]:
                        start = w.first[k] + r["first"]
                        words, key = w.hash[start : start + r["n"] + window - 1], (r["anchor"], r["same"], ids[b.lo + k])
                        if r["wide"]:
                            rows += [(*key, None, *piece) for piece in _pieces(words, r["anchor"], r["n"], window, gram)]
                        else:
                            rows.append((*key, words.tobytes(), None, None, None))
                columns = list(zip(*rows)) if rows else [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor", "same", "doc_id", "words", "piece", "place", "parts"])

    return cut


def automaton_of(docs: list[int], runs: list[np.ndarray]) -> Compact:
    """Of runs in their documents' order."""
    a = SuffixAutomaton()
    for d, words in zip(docs, runs):
        a.add(words.view(np.int64).tolist(), d)
    return Compact(a)


def _streamed(rows: list[tuple], automaton: Compact, window: int) -> list[tuple]:
    """(anchor, same, doc_id, s, e): what smaller documents cover of rows (anchor, same, doc_id, words)."""
    out: list[tuple] = []
    for lo in range(0, len(rows), TOGETHER):
        some = rows[lo : lo + TOGETHER]
        for (a, same, d, _), lengths in zip(some, automaton.matches([r[3] for r in some], np.array([r[2] for r in some], np.int64))):
            if lengths.max(initial=0) >= window:
                out += [(a, same, d, s, e) for s, e in covered(lengths.tolist(), window)]
    return out


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(shard, (anchor, same, doc_id, words))."""
    for shard, a, same, d, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "anchor", "same", "doc_id", "words"))):
        yield shard, (a, same, d, np.frombuffer(words, U64))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], names=["anchor", "same", "doc_id", "s", "e"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows come by (shard, doc_id, same): a shard's at a time, repeated ones once."""
    now, held = None, []
    for batch in batches:
        for shard, row in _rows(batch):
            if shard != now and held:
                yield now, held
                held = []
            now = shard
            if not held or held[-1][:3] != row[:3]:
                held.append(row)
    if held:
        yield now, held


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, rows in _by_shard(batches):
        made = pickle.dumps(automaton_of([r[2] for r in rows], [r[3] for r in rows]), 5)
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([made], pa.binary())], names=["shard", "automaton"])


def _stream(shared, window: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata: dict[int, Compact] = shared.value
        for batch in batches:
            by_shard: dict[int, list[tuple]] = {}
            for shard, row in _rows(batch):
                by_shard.setdefault(shard, []).append(row)
            yield _found([x for shard, rows in by_shard.items() for x in _streamed(rows, automata[shard], window)])

    return stream


def _build_and_stream(window: int):
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            yield _found(_streamed(rows, automaton_of([r[2] for r in rows], [r[3] for r in rows]), window))

    return both


def matched(snippets: DataFrame, words: int, window: int, shard_words: int, broadcast_words: int, passes: int) -> DataFrame:
    """FOUND of the written runs (anchor, same, doc_id, words), of so many words in all."""
    spark = snippets.sparkSession
    shards = max(1, -(-words // shard_words))
    dealt = snippets.select("anchor", "same", "doc_id", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    if words > broadcast_words * passes:
        return dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "same").mapInArrow(_build_and_stream(window), FOUND)
    out = spark.createDataFrame([], FOUND)
    step = max(1, broadcast_words // shard_words)
    for lo in range(0, shards, step):
        group = dealt.filter(F.col("shard").between(lo, lo + step - 1))
        made = group.repartition(step, "shard").sortWithinPartitions("shard", "doc_id", "same").mapInArrow(_build, "shard long, automaton binary").toArrow()
        automata = {shard: pickle.loads(x) for shard, x in zip(made.column("shard").to_pylist(), made.column("automaton").to_pylist())}  # about broadcast_words words
        out = out.unionByName(group.mapInArrow(_stream(spark.sparkContext.broadcast(automata), window), FOUND))
    return out


def compared(pieces: DataFrame, window: int) -> DataFrame:
    """FOUND of the written pieces (anchor, same, doc_id, piece, place, parts)."""
    pieces = written(pieces.join(pieces.groupBy("piece").agg(F.min("doc_id").alias("lo")), "piece"), "pieces")
    key = ["anchor", "same", "doc_id"]
    copied = pieces.filter("doc_id > lo").select(*key, F.col("place").alias("s"), (F.col("place") + F.size("parts") + window - 1).alias("e"))
    windows = pieces.filter("doc_id = lo").select(*key, "place", F.posexplode("parts").alias("nth", "part"))
    least = windows.groupBy("part").agg(F.min("doc_id").alias("lo"))
    s = F.col("place") + F.col("nth")
    return copied.unionByName(windows.join(least, "part").filter("doc_id > lo").select(*key, s.alias("s"), (s + window).alias("e")))


def _kept(with_text: bool):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digests, texts = [], [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist()):
                words = text.as_py().encode().split() if text.is_valid else []
                n.append(len(words))
                if spans:
                    stay = np.ones(len(words), bool)
                    for x in spans:
                        stay[x["s"] : x["e"]] = False
                    words = [words[k] for k in np.flatnonzero(stay)]
                gone.append(n[-1] - len(words))
                left = b" ".join(words)
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left.decode() if with_text else None)
            out = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names=names + ["kept_text"] * with_text)

    return keep


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 16, shard_words: int = 100_000, broadcast_words: int = 500_000, passes: int = 8, anchor_words: int = 300_000, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for each row.

    A word goes if a window of `window` words over it also starts in a document with a smaller id. Rows of one
    id never remove words from each other; a row without an id neither removes nor loses words. Null and empty
    texts have no words; other columns are not read; an empty table gives no rows.
    """
    docs = ids_and_text(docs, id_col, text_col).withColumn("text_id", F.xxhash64("text"))
    known = docs.filter("doc_id IS NOT NULL")
    runs = known.mapInArrow(_runs(window, gram), RUN)
    shared = runs.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("same") != F.max("same")).alias("mixed")).filter("lo < hi")
    runs = written(runs.join(shared.select("anchor", "mixed"), "anchor"), "runs")
    firsts = runs.groupBy("anchor", "same").agg(F.min(F.struct("doc_id", "text_id", "first")).alias("f"), F.max("n").alias("n"), F.max("mixed").alias("mixed"))
    later = runs.join(firsts.select("anchor", "same", F.col("f.doc_id").alias("lo")), ["anchor", "same"]).filter("doc_id > lo")
    span = lambda s, e: F.struct((F.col("first") + s).alias("s"), (F.col("first") + e).alias("e"))
    later = later.select("doc_id", "text_id", F.array(span(F.lit(0), F.col("n") + window - 1)).alias("spans"))

    mixed = firsts.filter("mixed").select("anchor", "same", "f.*", "n")
    width = mixed.groupBy("anchor").agg(F.sum(F.col("n") + window - 1).alias("words")).select("anchor", "words", (F.col("words") > anchor_words).alias("wide"))
    size = width.agg(F.coalesce(F.sum(F.when(~F.col("wide"), F.col("words"))), F.lit(0)).alias("n"), F.count_if("wide").alias("wide")).first()
    asked = mixed.join(width.select("anchor", "wide"), "anchor").groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("anchor", "same", "first", "n", "wide")).alias("asked"))
    snippets = known.join(asked, ["doc_id", "text_id"]).select("doc_id", "text", "asked").mapInArrow(_snippets(window, gram), SNIPPET)
    snippets = written(snippets, "snippets")
    found = matched(snippets.filter("words IS NOT NULL"), size["n"], window, shard_words, broadcast_words, passes)
    if size["wide"]:
        found = found.unionByName(compared(snippets.filter("parts IS NOT NULL").drop("words"), window))
    found = found.groupBy("anchor", "same", "doc_id").agg(F.collect_set(F.struct("s", "e")).alias("found"))  # a run has LONG windows at most
    own = runs.join(found, ["anchor", "same", "doc_id"]).select("doc_id", "text_id", F.transform("found", lambda x: span(x["s"], x["e"])).alias("spans"))

    spans = later.unionByName(own).groupBy("doc_id", "text_id").agg(F.flatten(F.collect_set("spans")).alias("spans"))
    left = docs.join(spans, ["doc_id", "text_id"], "left").select("doc_id", "text", "spans")
    return left.mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
