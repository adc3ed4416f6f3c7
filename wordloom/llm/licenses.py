"""Operator 8, licence scans by a positional index of rare licence words.

The templates' words are indexed with their places. Document frequencies of these words over the whole corpus
rank them. A template counts where one of its mandatory phrases stands, so each template is looked up by its own
phrases' rarest (highest-IDF) words, however many other notices the file holds: each of their places names
where the template would begin, and the begin is kept if the whole phrase stands at its place. That finds
every such place. The score is the share of the template's IDF that the file has in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import ALNUM, Words, blocks, documents, ids_and_text
from wordloom.llm.license_notices import NOTICES as TEMPLATES

#: The phrases that count by themselves.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
def hashes(text: str) -> np.ndarray:
    return next(blocks(pa.array([text]))).words(ALNUM, lower=True).hash


class Index:
    def __init__(self, templates, idf: dict[int, float]):
        self.labels = [t[0] for t in templates]
        self.words = [hashes(t[1]) for t in templates]
        self.terms = np.unique(np.concatenate(self.words))
        self.idf = np.array([idf.get(int(x), 0.0) for x in self.terms.view(np.int64)])
        self.weight = [self.idf[self.rank(w)] for w in self.words]
        self.probes: list[list[tuple[int, int, int]]] = []  # by template: place and size of each phrase, its rarest word
        for t, w in enumerate(self.words):
            stand = [(k, len(p)) for p in (hashes(p) for p in templates[t][2]) for k in range(len(w) - len(p) + 1) if (w[k : k + len(p)] == p).all()]
            self.probes.append([(k, n, max(self.rank(w[k : k + n]).tolist(), key=lambda x: (self.idf[x], -x))) for k, n in stand])

    def rank(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.terms, words)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.terms, w.hash), len(self.terms) - 1)
        place = np.flatnonzero(self.terms[at] == w.hash)
        return place, at[place]


def places(w: Words, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after the other in one text."""
    at = w.windows(len(phrase))
    for k, h in enumerate(phrase):
        at = at[w.hash[at + k] == h]
    return at


def _frequencies(templates):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = Index(templates, {})
        n = np.zeros(len(x.terms), np.int64)
        for batch in batches:
            for b in blocks(batch.column("text")):
                w = b.words(ALNUM, lower=True)
                place, term = x.hits(w)
                n += np.bincount(np.unique(w.doc[place] * len(n) + term) % len(n), minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(x.terms.view(np.int64)), pa.array(n)], names=["term", "n"])

    return count


def matched(x: Index, w: Words) -> dict[tuple[int, str], float]:
    """(row, label) -> best score of the templates that begin where one of their mandatory phrases stands."""
    place, term = x.hits(w)
    by_term: dict[int, np.ndarray] = {}
    out: dict[tuple[int, str], float] = {}
    for template, own in enumerate(x.words):
        begins = [np.zeros((0, 2), np.int64)]
        for k, size, rare in x.probes[template]:
            if rare not in by_term:
                by_term[rare] = place[term == rare]
            first = by_term[rare] - (x.rank(own[k : k + size]).tolist().index(rare))
            first = first[(first >= 0) & (first + size <= len(w.hash))]
            first = first[w.doc[first] == w.doc[first + size - 1]]
            for j in range(size):
                first = first[w.hash[first + j] == own[k + j]]
            begins.append(np.stack([w.doc[first], first - k], 1))
        found = np.unique(np.concatenate(begins), axis=0)
        weight = x.weight[template] if x.weight[template].sum() else np.ones(len(own))
        for lo in range(0, len(found), 4096):  # bounds what is held at once
            doc, begin = found[lo : lo + 4096].T
            at = begin[:, None] + np.arange(len(own))
            inside = (at >= w.first[doc][:, None]) & (at < w.first[doc + 1][:, None])
            same = inside & (w.hash[np.where(inside, at, 0)] == own)
            for d, score in zip(doc.tolist(), (same @ weight / weight.sum()).tolist()):
                key = (d, x.labels[template])
                out[key] = max(out.get(key, 0.0), score)
    return out


def _scan(index, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = index.value
        base = [(hashes(p), label) for p, label in PHRASES]
        for batch in batches:
            for b in blocks(batch.column("text")):
                w = b.words(ALNUM, lower=True)
                n_base, first, last = np.zeros(b.n, np.int64), np.full(b.n, np.iinfo(np.int64).max), np.full(b.n, -1)
                base_labels: list[set] = [set() for _ in range(b.n)]
                for phrase, label in base:
                    at = places(w, phrase)
                    doc, word = w.doc[at], at - w.first[w.doc[at]]
                    n_base += np.bincount(doc, minlength=b.n)[: b.n]
                    np.minimum.at(first, doc, word)
                    np.maximum.at(last, doc, word)
                    for d in np.unique(doc).tolist():
                        base_labels[d].add(label)
                told, best = [set(s) for s in base_labels], [1.0 if s else 0.0 for s in base_labels]
                for (d, label), v in matched(x, w).items():
                    best[d] = max(best[d], v)
                    if v >= least:
                        told[d].add(label)
                labels = [",".join(sorted(s)) for s in told]
                none = n_base == 0
                columns = [batch.column("doc_id").slice(b.lo, b.n), pa.array(w.count, pa.int64()), pa.array(n_base, pa.int64()), pa.array(first, pa.int64(), mask=none), pa.array(last, pa.int64(), mask=none), pa.array([",".join(sorted(s)) for s in base_labels]), pa.array(labels), pa.array(best, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return scan


def license_scan(docs: DataFrame, templates=TEMPLATES, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    score is the best template's, 1 if a base phrase stands in the text. Null and empty texts have no words,
    empty labels and score 0; repeated rows come out alike; an empty table gives no rows; other columns are not
    read.
    """
    docs = ids_and_text(docs, id_col, text_col)
    counted = docs.select("text").mapInArrow(_frequencies(templates), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # the templates' words
    total = docs.count()
    idf = {r.term: float(np.log((1 + total) / (1 + r.n))) for r in counted}
    index = docs.sparkSession.sparkContext.broadcast(Index(templates, idf))
    return docs.mapInArrow(_scan(index, least), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))
