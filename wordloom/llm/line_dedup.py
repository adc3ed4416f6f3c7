"""Operator 7, line dedup by a deletion-neighbourhood join; DataFrame functions only.

A line is its words. Equal lines are found by hash; the earliest keeps its place. Lines of `least` words or
more are also near if one word is inserted, deleted or substituted (an edit distance of one word):

1. All variants of a line with at most one word deleted are hashed by their word count and the half that the
   deletion leaves whole. All deletions in one half give one key, so a line of any length has four keys. Lines
   that share no key have no variant in common, and hence no near line.
2. The lines of shared keys emit their variants whole, for deletions in the halves that the keys leave open.
   Equal variants meet in an equi-join of minima, by which no pairs are made: each line meets the earliest line
   of each of its variants (at the same place for a substitution, whole for an insertion).
3. The word distance of each line and the one earliest line that it met is computed from their words (what is
   left between their common beginning and end); a line is near if it is one.

A line goes if an equal or near one stands earlier, by (id, place in the text), whether or not that one stays.
Lines that make up more than 1 / HOT of all lines, fewer than HOT of them, are marked by a broadcast; no task
gets all places of one line. All steps are linear in a text's lines. Texts are joined by merging at any size, as
the tables that they meet grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import discard, documents, written

SPACES = " \t\x0b\x0c\r"
HOT = 10_000
ADDED = ("_n_lines", "_n_exact", "_n_near")


def _words(line: Column) -> Column:
    odd = line.contains("  ")
    for c in SPACES[1:]:
        odd = odd | line.contains(c)
    return F.when(odd, F.split(F.btrim(line, F.lit(SPACES)), "[ \\t\\x0B\\f\\r]+")).otherwise(F.split(F.btrim(line, F.lit(" ")), " "))


def _keys(words: Column, n: Column) -> list[Column]:
    """Hashes of (count, left or right, that half) of the line itself, then of its variants."""
    keys = []
    for count in (n, n - 1):
        half = F.floor(count / 2).cast("int")
        keys.append(F.xxhash64(count, F.lit(0), F.slice(words, F.lit(1), half)))
        keys.append(F.xxhash64(count, F.lit(1), F.slice(words, n - count + half + 1, count - half)))
    return keys


def once(value: Column) -> Column:
    """As a generator of one row: what stands above it reads the value and does not work it out again by element."""
    return F.explode(F.array(value))


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether the word distance is one at most."""

    def common(x: Column, y: Column) -> Column:
        first = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(first == 0, F.size(x)).otherwise(first - 1)

    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def drops(docs: DataFrame, least: int = 4) -> DataFrame:
    """doc_id, text_id, exact, near: the places of the lines that go, for texts that lose some.

    docs has doc_id, text_id (a hash of the text) and text. `least` must be 2 or more.
    """
    lines = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text_id", F.posexplode(F.split("text", "\n")).alias("place", "line")).filter(F.btrim("line", F.lit(SPACES)) != "")
    lines = lines.select("doc_id", "text_id", "place", _words(F.col("line")).alias("words"))
    n = F.size("words")
    keys = [F.when(n >= least, k).alias(f"k{i}") for i, k in enumerate(_keys(F.col("words"), n))]
    lines = written(lines.select("doc_id", "text_id", "place", F.xxhash64("words").alias("line"), *keys), "lines")
    firsts = lines.groupBy("line").agg(F.min(F.struct("doc_id", "text_id", "place")).alias("first"), F.count("*").alias("n"), *[F.max(f"k{i}").alias(f"k{i}") for i in range(4)])
    firsts = written(firsts, "firsts")

    keyed = firsts.filter("k0 IS NOT NULL").select(F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("k", "key"), "line")
    shared = keyed.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("b")).filter("a < b")
    asked = keyed.join(shared.select("key"), "key").groupBy("line").agg(F.max(F.col("k") == 2).alias("right"), F.max(F.col("k") == 3).alias("left"))
    asked = asked.join(firsts.select("line", "first"), "line").groupBy("first.doc_id", "first.text_id").agg(F.collect_list(F.struct("first.place", "line", "left", "right")).alias("asked"))
    asked = written(asked, "asked")  # a text's own lines at most
    texts = docs.select("doc_id", "text_id", "text").hint("merge").join(asked, ["doc_id", "text_id"]).select("doc_id", "text_id", "asked", once(F.split("text", "\n")).alias("lines"))
    worded = texts.select("doc_id", "text_id", "lines", F.explode("asked").alias("p"))
    first = F.struct("doc_id", "text_id", F.col("p.place").alias("place")).alias("first")
    worded = written(worded.select("p.line", "p.left", "p.right", first, _words(F.get("lines", F.col("p.place"))).alias("words")).dropDuplicates(["line"]), "worded")
    discard(asked)

    n, half = F.size("words"), F.floor((F.size("words") - 1) / 2).cast("int")
    some = worded.withColumn("from", F.when(F.col("left"), 0).otherwise(half)).withColumn("to", F.when(F.col("right"), n - 1).otherwise(half))
    without = F.transform(F.sequence("from", "to"), lambda i: F.struct(F.xxhash64(F.concat(F.slice("words", F.lit(1), i), F.slice("words", i + 2, n))).alias("variant"), i.alias("at")))
    without = F.when(F.col("left") | F.col("right"), without).otherwise(F.array().cast("array<struct<variant:bigint,at:int>>"))
    whole = F.array(F.struct(F.xxhash64("words").alias("variant"), F.lit(-1).alias("at")))
    variants = written(some.select("line", "first", F.explode(F.concat(whole, without)).alias("v")).select("line", "first", "v.*"), "variants")
    by_place = variants.groupBy("variant", "at").agg(F.min("first").alias("same_place"))
    by_variant = by_place.groupBy("variant").agg(F.min(F.when(F.col("at") < 0, F.col("same_place"))).alias("whole"), F.min(F.when(F.col("at") >= 0, F.col("same_place"))).alias("longer"))
    met = variants.join(by_place, ["variant", "at"]).join(by_variant, "variant")
    other = F.when(F.col("at") < 0, F.col("longer")).otherwise(F.least("same_place", "whole"))
    met = met.withColumn("other", other).filter(F.col("other") < F.col("first")).groupBy("line").agg(F.min("other").alias("other"))
    pairs = met.join(worded.select("line", "words"), "line").join(worded.select(F.col("first").alias("other"), F.col("words").alias("others")), "other")
    near = written(pairs.filter(one_word_apart(F.col("words"), F.col("others"))).select("line"), "near")
    discard(variants, worded)

    total = lines.count()
    marks = firsts.select("line", "first", "n").join(near.withColumn("near", F.lit(True)), "line", "left").filter("n > 1 OR near")
    hot = F.broadcast(marks.filter(F.col("n") * HOT > total))
    places = lines.select("doc_id", "text_id", "place", "line")
    gone = places.join(hot, "line").unionByName(places.join(hot.select("line"), "line", "left_anti").join(marks.filter(F.col("n") * HOT <= total), "line"))
    exact = F.struct("doc_id", "text_id", "place") != F.col("first")
    gone = gone.withColumn("exact", exact).filter("exact OR near")
    place = F.col("place")
    gone = gone.groupBy("doc_id", "text_id").agg(F.collect_set(F.when(F.col("exact"), place)).alias("exact"), F.collect_set(F.when(~F.col("exact"), place)).alias("near"))
    gone = written(gone, "gone")
    discard(lines, firsts, near)
    return gone


def dedupe_lines(docs: DataFrame, least: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs with the text's repeated lines taken out, then _n_lines, _n_exact, _n_near.

    Blank lines stay. Null texts stay null, empty ones empty; a row without an id neither loses lines nor makes
    others lose any; rows of one id and text lose the same lines; an empty table gives no rows. Other columns
    are passed on whatever their names; one that has the name of an added column is replaced by it.
    """
    text = docs[text_col].cast("string")
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_id"), text.alias("text"))
    gone = drops(keyed.select("doc_id", "text_id", "text"), least).withColumnsRenamed({"doc_id": "own_id", "text_id": "own_text"})
    joined = keyed.select("row", "doc_id", "text_id").hint("merge").join(gone, (F.col("doc_id") == F.col("own_id")) & (F.col("text_id") == F.col("own_text")), "left")
    joined = joined.select("row", "exact", "near", once(F.split(F.col("row")[text_col].cast("string"), "\n")).alias("lines"))
    joined = joined.select("row", "exact", "near", "lines", once(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.concat("exact", "near"))).alias("kept"))
    left = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    count = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    own = F.when(F.col("exact").isNull(), F.col("row")[text_col]).otherwise(left).alias(text_col)
    counts = [F.when(F.col(c).isNull(), F.lit(0).cast("long")).otherwise(count(c)).alias(a) for c, a in zip(("lines", "exact", "near"), ADDED)]
    return joined.select(*[own if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ADDED], *counts)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedupe_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_exact").alias("n_exact"), F.col("_n_near").alias("n_near"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))
