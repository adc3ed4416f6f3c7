"""Operator 10, an n-gram Jaccard self-join by a token-group matrix, and the groups that it links.

1. A text is its set of word shingles (64-bit hashes); equal sets are one node, so copies cost nothing more.
2. Similar nodes are put into groups. Two linked sets differ in at most D elements, D by size class; the
   hash range is cut into more than D parts, so they agree on some whole part. Each set gives a signature for
   each part (its class and the next larger one), and the nodes of a signature join the group of its least
   node. A set of many parts signs only `parts` of them, of half its D elements' reach each: a linked pair
   then agrees on none with probability below 0.5 ** parts (2e-10 at 32), and fewer parts are all signed
   (a part that is empty signs nothing, so sets of few parts are cut anew, up to eight times: a link is lost only if
   every cut's untouched parts are empty).
   Signatures hold several shingles each, so common shingles alone gather nobody.
3. The matrix: a group's nodes are bit rows over its tokens, in blocks of similar size, with the union of
   each block. A query's overlap with the union bounds that with any member; only blocks whose bound reaches
   what the threshold needs are opened, and members already in the query's component are passed over.
4. Links are merged by distributed connected components.

A group of over `side` nodes is cut into sub-blocks by hash. First each sub-block is held against itself and against
the group's first one, whose nodes stand for the group: rows in proportion to the group. Nodes that are in the
component of most of the group need no more of each other; only the rest is then held against all sub-blocks. No
group, list of links or component is ever gathered whole; a task holds 2 * side sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import U64, Block, blocks, discard, documents, ids_and_text, mix, runs_hash, written
from wordloom.llm.components import components

BLOCK_ROWS = 16
_SECOND = 0xA24BAED4963EE407


@cache
def size_class(n: int, percent: int) -> int:
    """Classes such that a set's partners that are not smaller are in its own class or the next."""
    low, k = 1, 0
    while n >= (high := low * 100 // percent + 1):
        low, k = high, k + 1
    return k


@cache
def most_apart(k: int, percent: int) -> int:
    """The largest symmetric difference of a linked pair whose larger set is in class k."""
    low = 1
    for _ in range(k + 1):
        low = low * 100 // percent + 1
    return (100 - percent) * 2 * (low - 1) // (100 + percent)


def signatures(tokens: np.ndarray, percent: int, parts: int) -> np.ndarray:
    """Of a sorted set: a hash for each signed part of its range, in its own class and the next one."""
    out = []
    own = size_class(len(tokens), percent)
    for k in (own, own + 1):
        apart = most_apart(k, percent)
        if not apart:
            continue  # only equal sets are linked
        cut = apart + 1 if apart < parts else -(-3 * apart // 2)
        for again in range(max(1, min(8, parts // cut))):  # small sets: an empty part must not decide alone
            if again:
                t = np.sort(mix(tokens + U64(again * _SECOND % (1 << 64))))
            else:
                t = tokens
            if cut > parts:
                t = t[: np.searchsorted(t, U64(((parts << 64) // cut) & ~0xFFFFFFFF))]
            part = ((t >> U64(32)) * U64(cut)) >> U64(32)
            first = np.flatnonzero(np.r_[True, np.diff(part) != 0]) if len(t) else np.zeros(0, np.int64)
            if len(first):
                seed = mix(np.array([(k << 32) + (again << 24) + percent], U64))
                out.append(mix(np.add.reduceat(mix(t), first) ^ mix(part[first] + seed)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U64)


def shingle_sets(b: Block, shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted; a text with fewer words has one, all of them."""
    w = b.words(lower=True)
    at, hashes = w.shingles(shingle)
    bound = np.searchsorted(w.doc[at], np.arange(b.n + 1))
    out = []
    for k in range(b.n):
        n = w.count[k]
        if n >= shingle:
            out.append(np.unique(hashes[bound[k] : bound[k + 1]]))
        else:
            out.append(runs_hash(w.hash, w.first[k : k + 1], w.first[k + 1 : k + 2]) if n else np.zeros(0, U64))
    return out


def _sets(shingle: int, percent: int, parts: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, signs = [], [], []
            for b in blocks(batch.column("text")):
                for s in shingle_sets(b, shingle):
                    n.append(len(s))
                    node.append(int(mix(np.add.reduce(mix(s + U64(_SECOND)), keepdims=True) + U64(len(s))).view(np.int64)[0]))
                    signs.append(signatures(s, percent, parts).view(np.int64) if len(s) else [])
            names = ["doc_id", "text_id", "n_shingles", "node", "signs"]
            columns = [batch.column("doc_id"), batch.column("text_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(signs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return make


def _tokens(shingle: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                sets = pa.array([s.tobytes() for s in shingle_sets(b, shingle)], pa.binary())
                rows = batch.slice(b.lo, b.n)
                yield pa.RecordBatch.from_arrays([rows.column("node"), rows.column("places"), sets], names=["node", "places", "tokens"])

    return make


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x


def links_within(sets: list[np.ndarray], side: list[int], percent: int) -> list[tuple[int, int]]:
    """Links that connect what is linked (a spanning forest), between sets of side 0 and 1, or within side 0 if all are."""
    n = len(sets)
    order = sorted(range(n), key=lambda k: (len(sets[k]), int(sets[k][0])))
    size = np.array([len(sets[k]) for k in order])
    sides = np.array([side[k] for k in order])
    two = sides.any()
    vocabulary, index = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    width = -(-len(vocabulary) // 64)
    bits = np.zeros((n, width), U64)
    row = np.repeat(np.arange(n), size)
    np.bitwise_or.at(bits, (row, index >> 6), U64(1) << (index & 63).astype(U64))
    starts = np.arange(0, n, BLOCK_ROWS)
    union = np.bitwise_or.reduceat(bits, starts, axis=0)
    largest = np.maximum.reduceat(size, starts)
    forest, found = Forest(n), []
    label = np.arange(n)
    for q in range(n - 1, 0, -1):  # partners that are not larger stand before it
        blocks_before = q // BLOCK_ROWS + 1
        bound = np.bitwise_count(bits[q] & union[:blocks_before]).sum(1)
        opened = np.flatnonzero((100 * bound >= percent * size[q]) & (100 * largest[:blocks_before] >= percent * size[q]))
        if not len(opened):
            continue
        rows = (starts[opened][:, None] + np.arange(BLOCK_ROWS)).ravel()
        rows = rows[(rows < q)]
        rows = rows[(label[rows] != label[q]) & (100 * size[rows] >= percent * size[q])]
        if two:
            rows = rows[sides[rows] != sides[q]]
        if not len(rows):
            continue
        both = np.bitwise_count(bits[q] & bits[rows]).sum(1).astype(np.int64)
        for r in rows[100 * both >= percent * (size[q] + size[rows] - both)].tolist():
            a, b = forest.root(q), forest.root(r)
            if a != b:
                forest.up[max(a, b)] = min(a, b)
                found.append((order[q], order[r]))
                label[label == label[r]] = label[q]
    return found


def _links(percent: int):
    """Rows come by (group, i, j)."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("group", "i", "j", "side", "node", "tokens")))

        for _, members in groupby(rows(), key=lambda r: r[:3]):
            members = list(members)  # at most two sub-blocks
            if len(members) > 1:
                nodes = [m[4] for m in members]
                found = links_within([np.frombuffer(m[5], U64) for m in members], [m[3] for m in members], percent)
                a, b = [nodes[x] for x, _ in found], [nodes[y] for _, y in found]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return link


def _place(i, j, side):
    return F.struct(F.lit(i).cast("int").alias("i") if isinstance(i, int) else i.cast("int").alias("i"), F.lit(j).cast("int").alias("j") if isinstance(j, int) else j.cast("int").alias("j"), F.lit(side).cast("int").alias("side"))


def first_deal(places: DataFrame) -> DataFrame:
    """group, node, i, j, side of places (group, node, cuts, own): each sub-block with itself and with the first one."""
    upto = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: _place(0, k, 0))
    at = F.when(F.col("own") == 0, upto).otherwise(F.array(_place(0, F.col("own"), 1), _place(F.col("own"), F.col("own"), 0)))
    return places.select("group", "node", F.explode(at).alias("p")).select("group", "node", "p.*")


def second_deal(places: DataFrame, roots: DataFrame, side: int) -> DataFrame:
    """The same for what the first links have not joined to most of its group, held against the whole group."""
    rooted = places.filter("cuts > 1").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    most = rooted.groupBy("group", "root").agg(F.count("*").alias("n")).groupBy("group").agg(F.max(F.struct("n", "root"))["root"].alias("most"))
    rooted = rooted.join(most, "group").withColumn("rest", F.col("root") != F.col("most"))
    again = rooted.groupBy("group").agg(F.ceil(F.count_if("rest") / side).cast("int").alias("rows")).filter("rows > 0")
    rooted = rooted.join(again, "group").withColumn("row", F.pmod(F.xxhash64("node", "group"), "rows").cast("int"))
    each = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda k: _place(k, F.col("own"), 1))
    asks = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda k: _place(F.col("row"), k, 0))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    return rooted.select("group", "node", F.explode(F.concat(each, asks)).alias("p")).select("group", "node", "p.*")


def jaccard_rows(docs: DataFrame, shingle: int = 5, percent: int = 80, parts: int = 32, side: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_id (xxhash64 of the text), n_shingles, component_id for each row."""
    docs = ids_and_text(docs, id_col, text_col).withColumn("text_id", F.xxhash64("text"))
    schema = "doc_id long, text_id long, n_shingles long, node long, signs array<long>"
    sets = written(docs.select("doc_id", "text_id", "text").mapInArrow(_sets(shingle, percent, parts), schema), "sets")
    nodes = sets.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_id")).alias("rep"), F.min("doc_id").alias("least"))

    signed = sets.select("node", F.explode("signs").alias("sign"))
    shared = signed.groupBy("sign").agg(F.min("node").alias("group"), F.max("node").alias("last")).filter("`group` < last")
    places = written(signed.join(shared.select("sign", "group"), "sign").select("group", "node").distinct(), "places")
    counted = places.groupBy("group").agg(F.ceil(F.count("*") / side).cast("int").alias("cuts"))
    cut = places.join(counted, "group").withColumn("own", F.when(F.col("cuts") > 1, F.pmod(F.xxhash64("node"), "cuts")).otherwise(0).cast("int"))

    def links(deal: DataFrame, few: bool) -> DataFrame:
        asked = deal.groupBy("node").agg(F.collect_list(F.struct("group", "i", "j", "side")).alias("places"))
        asked = asked.join(nodes.select("node", F.col("rep.doc_id").alias("own_id"), F.col("rep.text_id").alias("own_text")), "node")
        asked = written(asked, "asked") if few else asked  # of known size: texts need not move to a few nodes
        wanted = docs.join(asked, (F.col("text_id") == F.col("own_text")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).select("node", "places", "text")
        tokens = wanted.mapInArrow(_tokens(shingle), "node long, places array<struct<group:long,i:int,j:int,side:int>>, tokens binary")
        dealt = tokens.select("node", "tokens", F.explode("places").alias("p")).select("node", "tokens", "p.*")
        dealt = dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "side", "node")
        out = written(dealt.mapInArrow(_links(percent), "a long, b long"), "links")
        discard(asked)
        return out

    found = links(first_deal(cut), False)
    roots = components(found)
    if counted.filter("cuts > 1").limit(1).count():
        more = links(second_deal(cut, roots, side), True)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
        discard(more)
    discard(places, found)

    rooted = nodes.select("node", "least").join(roots, "node")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(least, "root").select("node", "component_id")
    labelled = nodes.select("node", "least").join(rooted, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = sets.select("doc_id", "text_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node"))
    out = out.join(labelled, "node", "left")
    return out.select("doc_id", "text_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, parts: int = 32, side: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row: the least id that a row reaches through links.

    Rows are linked if 100 * common shingles >= percent * all shingles of the two. Null texts and texts without
    words have no shingles and their own id; a text with fewer words than `shingle` has one. Rows of equal sets
    are linked. A null id is passed over as the least, unless all are null. An empty table gives no rows.
    Other columns are not read. Sets are told apart by 64-bit hashes.
    """
    return jaccard_rows(docs, shingle, percent, parts, side, id_col, text_col).drop("text_id")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir), shingle=3, percent=90)
