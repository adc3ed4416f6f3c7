"""Operator 6, quality rules with an n-gram perplexity band for each language.

The language model is of code points: case and scripts are kept, digits are one sign, blanks are one sign. Its
n-grams are whatever the corpus holds, so the model grows with it:

1. Each task adds up the n-grams of order 5 of its texts, some at a time; Spark sums them by language.
2. Continuation counts of the lower orders, modified Kneser-Ney discounts and back-off weights are group-bys and
   joins of these tables. No n-gram is left out.
3. N-grams and contexts become 64-bit hashes, stored as sorted arrays with their log-probabilities and weights. The
   arrays are broadcast `max_entries` at a time: several languages share a pass, and a language beyond that is
   dealt by the two signs before the predicted one into passes whose sums by text are added.
4. A text's log-perplexity is by word, as by sign a cheap filler after each word would hide what the word costs. It
   is rejected outside its language's band, `reach` interquartile ranges around the quartiles of the language's
   texts of its length class (powers of two, as short texts scatter more; a class of few texts takes the band of the
   whole language). The quartiles come from a histogram of thousandths, so they are exact and do not depend on the
   order of merging.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.llm.common import NOT_SPACE, U64, Block, Sorted, blocks, documents, mix, written

ORDER = 5
#: Distinct n-grams that a task adds up before it hands them on.
HELD = 1_500_000
REST = "other"
STEP = 1000  # a band's edges are counted in thousandths

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[np.frombuffer(b" \t\x0b\x0c\r", np.uint8)] = 32
_FOLD[np.frombuffer(b"0123456789", np.uint8)] = 48
_GOLD, _BASE = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_POINT = mix(np.arange(256, dtype=U64) * _GOLD + U64(1))

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


class Signs:
    """The code points of a block: their bytes' places, hashes of the n-grams that end at each, and each text's bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = _FOLD[data]
        lead = (data & 0xC0) != 0x80
        self.at = np.flatnonzero(lead)
        self.begin, self.end = np.searchsorted(self.at, offsets[:-1]), np.searchsorted(self.at, offsets[1:])
        first = self.data[self.at]
        self.point = _POINT[first]
        wide = np.flatnonzero(first > 127)
        if len(wide):
            at, point = self.at[wide], first[wide].astype(U64)
            padded, more = np.r_[self.data, np.zeros(3, np.uint8)], np.ones(len(wide), bool)
            for k in (1, 2, 3):  # the packed bytes stand for the code point
                byte = padded[at + k]
                more &= (byte & 0xC0) == 0x80
                point = np.where(more, (point << U64(8)) | byte, point)
            self.point[wide] = mix(point * _GOLD + U64(1))

    def grams(self) -> list[np.ndarray]:
        """By order from 1: a hash of the n-gram that ends at each place, to be mixed (without meaning where the block
        has no room for it). Signs are mixed already, so sums of their multiples tell n-grams apart."""
        out = [self.point]
        for _ in range(ORDER - 1):
            h = np.zeros(len(self.point), U64)
            np.multiply(out[-1][:-1], _BASE, out=h[1:])
            h[1:] += self.point[1:]
            out.append(h)
        return out

    def whole(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where n-grams end that lie in one text, and the text of each."""
        size = np.maximum(self.end - self.begin - n + 1, 0)
        before = np.cumsum(size) - size
        return np.arange(size.sum()) + np.repeat(self.begin + n - 1 - before, size), np.repeat(np.arange(len(size)), size)

    def text(self, ends: np.ndarray, n: int) -> pa.Array:
        """The n-grams that end there, as strings."""
        edge = np.r_[self.at, len(self.data)]
        start, stop = edge[ends - n + 1], edge[ends + 1]
        offsets = np.r_[0, np.cumsum(stop - start)]
        places = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, stop - start)
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(self.data[places].tobytes())])


@cache
def salt(model: str) -> U64:
    """What sets a model's hashes apart."""
    return mix(np.array([np.frombuffer(model.encode(), np.uint8).astype(U64) @ (_BASE ** np.arange(1, len(model.encode()) + 1, dtype=U64))], U64))[0]


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal keys together, where each run of equal ones starts in it, and one place of each. Places
    are sorted in the keys' low bits, which is faster than argsort; keys of equal high bits, which are rare, can stand
    in several runs, each of them right."""
    low = U64((1 << max(1, len(keys).bit_length())) - 1)
    order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=U64)) & low).astype(np.int64)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return order, starts, order[starts]


def _counts():
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, held = [], [], 0

        def out() -> pa.RecordBatch:
            table = pa.concat_tables(rows).combine_chunks()
            order, starts, first = distinct(np.concatenate(keys))
            n = np.add.reduceat(table.column("n").to_numpy()[order], starts) if len(starts) else np.zeros(0, np.int64)
            some = table.take(pa.array(first))
            keys.clear(), rows.clear()
            return pa.RecordBatch.from_arrays([some.column("model").combine_chunks(), some.column("gram").combine_chunks(), pa.array(n)], names=["model", "gram", "n"])

        for batch in batches:
            model = batch.column("model")
            salts = np.array([salt(x) for x in model.to_pylist()], U64)
            for b in blocks(batch.column("text")):
                s = Signs(b.data, b.offsets)
                ends, row = s.whole(ORDER)
                key = mix(s.grams()[-1][ends] ^ salts[b.lo + row])
                _, starts, first = distinct(key)
                n, key = np.diff(np.r_[starts, len(key)]), key[first]
                keys.append(key)
                rows.append(pa.table([model.take(pa.array(b.lo + row[first])), s.text(ends[first], ORDER), pa.array(n)], names=["model", "gram", "n"]))
                held += len(key)
                if held > HELD:
                    yield out()
                    held = 0
        if rows:
            yield out()

    return count


def _hashes(contexts: bool):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("gram")):
                s = Signs(b.data, b.offsets)
                grams, last, size = s.grams(), s.end - 1, s.end - s.begin
                key = np.choose(size - 1, [g[last] for g in grams])
                before = last - (0 if contexts else 1)  # the two signs before the predicted one
                deal = np.where(size >= (2 if contexts else 3), grams[1][np.maximum(before, 0)], U64(0))
                rows = batch.slice(b.lo, b.n)
                own = np.array([salt(x) for x in rows.column("model").to_pylist()], U64)
                columns = [rows.column("model"), pa.array(mix(key ^ own).view(np.int64)), pa.array(deal.view(np.int64), mask=deal == 0), rows.column("value")]
                yield pa.RecordBatch.from_arrays(columns, names=["model", "key", "deal", "value"])

    return hashed


def kneser_ney(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(model, gram, value) of seen n-grams of all orders with their log-probabilities, and of contexts with the logs of
    their back-off weights (gram "" is the empty context, its weight shared by all signs and one unseen sign)."""
    levels = [counts.select("model", "gram", F.col("n").cast("long").alias("c"))]
    for n in range(ORDER - 1, 0, -1):  # continuation counts: how many signs stand before
        levels.append(written(levels[-1].groupBy("model", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), "grams"))
    probabilities, weights, lower = [], [], None
    for n, level in enumerate(reversed(levels), 1):
        level = level.withColumn("context", F.substring("gram", 1, n - 1))
        some = level.groupBy("model").agg(*[F.count_if(F.col("c") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("kinds"))
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        known = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)
        lost = lambda k: F.when(known, F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0.0)), F.lit(0.0)), F.lit(float(k)))).otherwise(k / 2)
        some = some.select("model", *[lost(k).alias(f"d{k}") for k in (1, 2, 3)], "kinds")
        own = level.groupBy("model", "context").agg(F.sum("c").alias("total"), *[F.count_if(F.col("c") == k if k < 3 else F.col("c") >= k).alias(f"m{k}") for k in (1, 2, 3)])
        own = own.join(some, "model")
        rest = (F.col("d1") * F.col("m1") + F.col("d2") * F.col("m2") + F.col("d3") * F.col("m3")) / F.col("total")
        own = own.select("model", "context", "total", "d1", "d2", "d3", "kinds", rest.alias("weight"))
        joined = level.join(own, ["model", "context"])
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        if lower is None:
            below = 1 / (F.col("kinds") + 1)
            weights.append(own.select("model", F.col("context").alias("gram"), (F.col("weight") * below).alias("value")))
        else:
            joined = joined.withColumn("ending", F.substring("gram", 2, n - 1)).join(lower.select("model", F.col("gram").alias("ending"), F.col("p").alias("below")), ["model", "ending"])
            below = F.col("below")
            weights.append(own.select("model", F.col("context").alias("gram"), F.col("weight").alias("value")))
        lower = written(joined.select("model", "gram", ((F.col("c") - d) / F.col("total") + F.col("weight") * below).alias("p")), "grams")
        probabilities.append(lower.select("model", "gram", F.log("p").alias("value")))
    both = []
    for parts in (probabilities, weights):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        both.append(out)
    return both[0], both[1].withColumn("value", F.log(F.greatest("value", F.lit(1e-12))))


class Part:
    """What one pass broadcasts: the n-grams and contexts of some models, or one of `parts` shares of a model's."""

    def __init__(self, grams: Sorted, contexts: Sorted, unseen: dict[str, float], part: int = 0, parts: int = 1):
        self.grams, self.contexts, self.unseen, self.part, self.parts = grams, contexts, unseen, part, parts

    def score(self, s: Signs, models: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """By text: the sum of the negated log-probabilities of its n-grams, and how many there are."""
        ends, row = s.whole(ORDER)
        grams = s.grams()
        if self.parts > 1:
            own = (grams[1][ends - 1] % U64(self.parts)) == self.part
            ends, row = ends[own], row[own]
        salts = np.array([salt(m) for m in models], U64)
        key = mix(grams[-1][ends] ^ salts[row])
        order, starts, first = distinct(key)  # each n-gram of the block is looked up once
        key, at, of = key[first], ends[first], row[first]
        value, left = np.zeros(len(first), np.float32), np.arange(len(first))
        for n in range(ORDER, 0, -1):
            own = salts[of[left]]
            found, seen = self.grams.find(key if n == ORDER else mix(grams[n - 1][at[left]] ^ own))
            value[left] += seen
            left, own = left[~found], own[~found]
            if not len(left):
                break
            if n > 1:
                value[left] += self.contexts.find(mix(grams[n - 2][at[left] - 1] ^ own))[1]
            else:
                value[left] += np.array([self.unseen[m] for m in models], np.float32)[of[left]]
        total = np.empty(len(ends), np.float32)
        total[order] = np.repeat(value, np.diff(np.r_[starts, len(ends)]))
        return np.bincount(row, -total.astype(np.float64), minlength=len(models)), np.bincount(row, minlength=len(models))


def _lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\x0b\x0c\r"):
            again += line in seen
            seen.add(line)
    return again


def rules(b: Block) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    w = b.words()
    at, h = w.shingles(5)
    key = mix(h + w.doc[at].astype(U64) * _GOLD)
    _, index, times = np.unique(key, return_inverse=True, return_counts=True)
    again = at[times[index] > 1]
    cover = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    chars = np.r_[0, np.cumsum(NOT_SPACE[b.data] & ((b.data & 0xC0) != 0x80))]
    symbols = np.r_[0, np.cumsum(SYMBOL[b.data])]
    at = b.offsets
    data = b.data.tobytes()
    lines = [_lines(data[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
    return {
        "n_words": w.count, "word_chars": chars[at[1:]] - chars[at[:-1]], "n_symbols": symbols[at[1:]] - symbols[at[:-1]],
        "n_dup_lines": np.array(lines, np.int64), "n_repeat_words": np.bincount(w.doc[repeated], minlength=b.n)[: b.n],
    }


FACTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORED = "doc_id long, text_id long, model string, " + ", ".join(f"{f} long" for f in FACTS) + ", bits double, n long"


def _scores(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Part = shared.value
        for batch in batches:
            models = batch.column("model").to_pylist()
            for b in blocks(batch.column("text")):
                facts, (bits, n) = rules(b), part.score(Signs(b.data, b.offsets), models[b.lo : b.lo + b.n])
                rows = batch.slice(b.lo, b.n)
                columns = [*(rows.column(c) for c in ("doc_id", "text_id", "model")), *(pa.array(facts[f], pa.int64()) for f in FACTS), pa.array(bits), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "model", *FACTS, "bits", "n"])

    return score


def scored(docs: DataFrame, grams: DataFrame, contexts: DataFrame, max_entries: int) -> DataFrame:
    """SCORED for each row of docs (doc_id, text_id, model, text)."""
    spark = docs.sparkSession
    table = {}
    for name, df in (("grams", grams), ("contexts", contexts.filter("gram <> ''"))):
        table[name] = written(df.mapInArrow(_hashes(name == "contexts"), "model string, key long, deal long, value double"), name)
    unseen = {r.model: r.value for r in contexts.filter("gram = ''").collect()}  # a row a model
    sizes: dict[str, int] = {}
    for df in table.values():
        for r in df.groupBy("model").count().collect():
            sizes[r.model] = sizes.get(r.model, 0) + r["count"]
    passes: list[tuple[list[str], int]] = []  # models, parts
    for m in sorted(sizes, key=lambda m: (sizes[m], m)):
        if passes and passes[-1][1] == 1 and sum(sizes[x] for x in passes[-1][0]) + sizes[m] <= max_entries:
            passes[-1][0].append(m)
        else:
            passes.append(([m], -(-sizes[m] // max_entries)))

    def of(models: list[str], part: int, parts: int):
        arrays = []
        for df in table.values():
            some = df.filter(F.col("model").isin(models))
            if parts > 1:  # % of the unsigned value, which Spark has not: from its two halves
                high, low = F.shiftrightunsigned("deal", 32), F.col("deal").bitwiseAND(0xFFFFFFFF)
                some = some.filter(F.col("deal").isNull() | (((high % parts) * ((1 << 32) % parts) + low) % parts == part))
            rows = some.select("key", "value").toArrow()  # about max_entries rows
            arrays.append(Sorted(rows.column("key").to_numpy().view(U64), rows.column("value").to_numpy().astype(np.float32)))
        return spark.sparkContext.broadcast(Part(*arrays, {m: unseen[m] for m in models if m in unseen}, part, parts))

    out = docs.filter(~F.col("model").isin(list(sizes))).mapInArrow(_scores(spark.sparkContext.broadcast(Part(Sorted(np.zeros(0, U64), np.zeros(0, np.float32)), Sorted(np.zeros(0, U64), np.zeros(0, np.float32)), {}))), SCORED)
    for models, parts in passes:
        rows = docs.filter(F.col("model").isin(models))
        if parts == 1:
            out = out.unionByName(rows.mapInArrow(_scores(of(models, 0, 1)), SCORED))
            continue
        each = rows.dropDuplicates(["doc_id", "text_id"])
        sums = written(each.mapInArrow(_scores(of(models, 0, parts)), SCORED), "sums")
        for k in range(1, parts):
            sums = sums.unionByName(written(each.mapInArrow(_scores(of(models, k, parts)), SCORED), "sums"))
        sums = sums.groupBy("doc_id", "text_id", "model").agg(*[F.max(f).alias(f) for f in FACTS], F.sum("bits").alias("bits"), F.sum("n").alias("n"))
        own = rows.select(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text"))
        out = out.unionByName(own.join(sums, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text") == F.col("text_id"))).drop("_id", "_text"))
    return out


def quartiles(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """by, low, high, texts: the least values, in steps, at or below which a quarter and three quarters of the rows lie."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.round(F.col(value) * STEP).cast("long").alias("step")).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by)  # a row for each step
    counted = counted.withColumn("upto", F.sum("n").over(own.orderBy("step"))).withColumn("all", F.sum("n").over(own))
    least = [F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("step"))) / STEP for k in (1, 3)]
    return counted.groupBy(*by).agg(least[0].alias("low"), least[1].alias("high"), F.sum("n").alias("texts"))


def quality(docs: DataFrame, reach: float = 2.5, least: int = 64, least_texts: int = 50, max_entries: int = 3_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, the base counts, base_failed, log_perplexity, low, high, kept for each row.

    Each language of `least_texts` texts or more has a model and a band of its own; the texts of all others, and of
    null, share one. A text of fewer than `least` n-grams has no perplexity and is judged by the base rules alone.
    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike (and counted each); an
    empty table gives no rows; other columns are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    by_lang = docs.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= least_texts).collect()
    model = F.when(F.col("lang").isin([r["lang"] for r in by_lang]), F.concat(F.lit("="), "lang")).otherwise(REST)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_id"), model.alias("model"), "text")
    counts = docs.select("model", "text").mapInArrow(_counts(), "model string, gram binary, n long")
    counts = counts.groupBy("model", F.col("gram").cast("string").alias("gram")).agg(F.sum("n").alias("n"))
    grams, contexts = kneser_ney(written(counts, "grams"))
    rows = scored(docs, grams, contexts, max_entries)
    some = (F.col("n") >= least) & (F.col("n_words") > 0)
    rows = rows.withColumn("log_perplexity", F.when(some, F.col("bits") / F.col("n_words"))).withColumn("size", F.when(some, F.floor(F.log2("n")).cast("int")))
    rows = written(rows.drop("bits", "n", "text_id"), "scored")
    whole = quartiles(rows, "log_perplexity", "model").select("model", *[F.col(c).alias(f"all_{c}") for c in ("low", "high")])
    bands = quartiles(rows, "log_perplexity", "model", "size").join(whole, "model")
    low, high = [F.when(F.col("texts") >= least_texts, F.col(c)).otherwise(F.col(f"all_{c}")) for c in ("low", "high")]
    spread = F.greatest(high - low, F.lit(0.01)) * reach
    bands = bands.select("model", "size", (low - spread).alias("low"), (high + spread).alias("high"))
    judged = rows.join(bands, ["model", "size"], "left")
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select("doc_id", *FACTS, failed.alias("base_failed"), "log_perplexity", "low", "high", (~failed & inside).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir))
