"""Operator 9, language identification by a linear-chain conditional random field over words.

Every word of a text is labelled with a language: its features (prefixes, suffixes, character n-grams, and
which languages' lexicons hold it) give scores by label, learned transitions tie neighbours together, and the
forward-backward algorithm gives each word's label probabilities, so that code-switched text is told apart
word by word. A text's language is the label with most probability mass, words weighing by their length.

The field is trained on the driver, on a bounded sample of the labelled rows (`per_label` different texts of every
label, of up to `max_bytes`); texts of one language are cut and spliced into code-switched sequences for the
transitions. Prediction covers all words of all texts. Blocks of `STEPS` words are worked on side by side: products
of their transition matrices carry the forward and backward messages over their borders, so the result is that of
the whole chain.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import documents

FEATURES, STEPS, MAX_WORDS = 1 << 16, 128, 500_000
#: Texts that are labelled together, in characters.
CHARS = 1 << 20
NONE, TEXT = "und", "__text"
_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; none if the text has no letter."""
    runs = _RUN.findall(text.lower()) if text else []
    return runs if any(c.isalpha() for w in runs for c in w) else []


def features(word: str, lexicons: dict[str, list[int]]) -> list[int]:
    """Hashed: affixes and n-grams of up to three characters, the word, and the labels whose lexicon has it."""
    w = f"<{word}>"
    parts = {w[i : i + n] for n in (1, 2, 3) for i in range(len(w) - n + 1)}
    parts |= {f"p{word[:n]}" for n in (1, 2, 3)} | {f"s{word[-n:]}" for n in (1, 2, 3)} | {f"w{word}"}
    parts |= {f"l{k}" for k in lexicons.get(word, ())}
    return sorted({zlib.crc32(p.encode("utf-8", "surrogatepass")) % FEATURES for p in parts})


class Field:
    """labels, weights by feature and label, transitions (log), lexicons: word -> labels."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, lexicons: dict[str, list[int]]):
        self.labels, self.weights, self.transitions, self.lexicons = labels, weights, transitions, lexicons

    def emissions(self, words: list[str]) -> np.ndarray:
        rows = [features(w, self.lexicons) for w in words]
        index = np.concatenate([np.array(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        starts = np.cumsum([0, *map(len, rows)])[:-1]
        return np.add.reduceat(self.weights[index], starts, axis=0) if rows else np.zeros((0, len(self.labels)), np.float32)


def forward_backward(scores: np.ndarray, transitions: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities [rows, steps, labels] of padded sequences, and expected transition counts."""
    rows, steps, labels = scores.shape
    live = np.arange(steps)[None, :] < length[:, None]
    e = np.exp(scores - scores.max(2, keepdims=True))
    e[~live] = 1
    t = np.exp(transitions - transitions.max())
    ahead, back = np.empty_like(e), np.empty_like(e)
    ahead[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for k in range(1, steps):
        a = (ahead[:, k - 1] @ t) * e[:, k]
        ahead[:, k] = a / a.sum(1, keepdims=True)
    back[:, -1] = 1 / labels
    for k in range(steps - 2, -1, -1):
        b = (e[:, k + 1] * back[:, k + 1]) @ t.T
        b = np.where(live[:, k + 1, None], b, 1)
        back[:, k] = b / b.sum(1, keepdims=True)
    p = ahead * back
    p /= p.sum(2, keepdims=True)
    pairs = np.zeros((labels, labels))
    for k in range(steps - 1):
        later = e[:, k + 1] * back[:, k + 1]
        each = live[:, k + 1] / ((ahead[:, k] @ t) * later).sum(1)
        pairs += t * ((ahead[:, k] * each[:, None]).T @ later)
    return p, pairs


def scaled(scores: np.ndarray, transitions: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Step by step: factors of the words' labels (1 beyond a row's end), which steps are live, and the transitions'."""
    e = np.ascontiguousarray(np.exp(scores - scores.max(2, keepdims=True)).transpose(1, 0, 2))
    live = np.arange(scores.shape[1])[:, None] < length[None, :]
    e[~live] = 1
    return e, live, np.exp(transitions - transitions.max()).astype(e.dtype)


def probabilities(scores: np.ndarray, transitions: np.ndarray, length: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities, without the counts. before: by row, what the words in front give to the first one's labels;
    after: what the words behind give to the last one's."""
    e, live, t = scaled(scores, transitions, length)
    steps, rows, labels = e.shape
    ahead = np.empty_like(e)
    ahead[0] = e[0] if before is None else e[0] * before
    for k in range(1, steps):
        a = (ahead[k - 1] @ t) * e[k]
        ahead[k] = a / a.sum(1, keepdims=True)
    back = np.full((rows, labels), 1 / labels, e.dtype) if after is None else after.astype(e.dtype)
    for k in range(steps - 1, -1, -1):
        if k < steps - 1:
            b = (e[k + 1] * back) @ t.T
            back = np.where(live[k + 1][:, None], b / b.sum(1, keepdims=True), back)
        ahead[k] *= back
    return (ahead / ahead.sum(2, keepdims=True)).transpose(1, 0, 2)


def transfer(scores: np.ndarray, transitions: np.ndarray, length: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """[rows, labels, labels]: what each row of words makes of the message in front of it; begins: rows without one."""
    e, live, t = scaled(scores, transitions, length)
    steps, rows, labels = e.shape
    out = np.broadcast_to(np.eye(labels, dtype=e.dtype), (rows, labels, labels))
    for k in range(steps):
        new = (out.reshape(-1, labels) @ t).reshape(rows, labels, labels)
        if k == 0:
            new = np.where(begins[:, None, None], out, new)
        new = new * e[k][:, None, :]
        new /= new.max((1, 2), keepdims=True)
        out = np.where(live[k][:, None, None], new, out)
    return out


def train(rows: list[tuple[str, str]], seed: int = 7, sequences: int = 1500, steps: int = 64, rounds: int = 40, rate: float = 0.3, lexicon: int = 1000) -> Field:
    """Of (text, label): regularised likelihood of code-switched sequences, by Adagrad."""
    labels = sorted({label for _, label in rows})
    texts: list[list[list[str]]] = [[w for t, x in rows if x == label and (w := words_of(t))] for label in labels]
    rng = np.random.default_rng(seed)
    lexicons: dict[str, list[int]] = {}
    for k, own in enumerate(texts):
        for w, _ in sorted(Counter(w for t in own for w in set(t)).items(), key=lambda x: (-x[1], x[0]))[:lexicon]:
            lexicons.setdefault(w, []).append(k)
    able = [k for k, own in enumerate(texts) if own]
    n = len(labels)
    field = Field(labels, np.zeros((FEATURES, n), np.float32), np.zeros((n, n)), lexicons)
    if len(able) < 2:
        return field
    words, gold = [], np.zeros((sequences, steps), np.int64)
    for s in range(sequences):
        row: list[str] = []
        while len(row) < steps:
            k = able[rng.integers(len(able))]
            text = texts[k][rng.integers(len(texts[k]))]
            size = min(int(rng.integers(4, steps + 1)), steps - len(row))
            at = int(rng.integers(max(1, len(text) - size + 1)))
            piece = text[at : at + size]
            gold[s, len(row) : len(row) + len(piece)] = k
            row += piece
        words += row
    kinds = {w: k for k, w in enumerate(dict.fromkeys(words))}
    index = np.array([kinds[w] for w in words]).reshape(sequences, steps)
    listed = [features(w, lexicons) for w in kinds]
    flat = np.concatenate([np.array(r, np.int64) for r in listed])
    per = np.array(list(map(len, listed)))
    starts = np.cumsum(np.r_[0, per])[:-1]
    full = np.full(sequences, steps)
    squares, squares_t = np.full_like(field.weights, 1e-6), np.full((n, n), 1e-6)
    hard = np.eye(n)[gold]
    hard_pairs = np.zeros((n, n))
    np.add.at(hard_pairs, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    for _ in range(rounds):
        emitted = np.add.reduceat(field.weights[flat], starts, axis=0)
        p, pairs = forward_backward(emitted[index].astype(float), field.transitions, full)
        off = (hard - p).reshape(-1, n)
        by_word = np.stack([np.bincount(index.ravel(), off[:, k], minlength=len(kinds)) for k in range(n)], 1)
        spread = np.repeat(by_word, per, axis=0)
        grad = np.stack([np.bincount(flat, spread[:, k], minlength=FEATURES) for k in range(n)], 1) - 0.01 * field.weights
        squares += grad**2
        field.weights += (rate * grad / np.sqrt(squares)).astype(np.float32)
        grad_t = hard_pairs - pairs - 0.01 * field.transitions
        squares_t += grad_t**2
        field.transitions += rate * grad_t / np.sqrt(squares_t)
    return field


class Emissions(dict):
    """word -> its row in `rows`, made when first asked for."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.new = field, []
        self.rows = np.zeros((1 << 12, len(field.labels)), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        self.new.append(word)
        return self[word]

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.clear()
        index = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            while len(self.rows) < len(self):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(self) - len(self.new) : len(self)] = self.field.emissions(self.new)
            self.new = []
        return self.rows[index]


_made: dict = {}


def emissions_of(field: Field) -> Emissions:
    """One for all tasks of a worker, as long as they share a field."""
    if _made.get("for") is not field:
        _made["for"], _made["kept"] = field, Emissions(field)
    return _made["kept"]


def label_words(emissions: Emissions, texts: list[list[str]], width: int = STEPS) -> list[np.ndarray]:
    """Each text's label probabilities by word."""
    sizes = [len(t) for t in texts]
    scores, transitions = emissions.of([w for t in texts for w in t]), emissions.field.transitions
    first, labels = np.cumsum([0, *sizes]), len(emissions.field.labels)
    per = np.array([-(-n // width) for n in sizes], np.int64)
    nth = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(first[:-1], per) + nth * width
    length = np.minimum(width, np.repeat(first[1:], per) - begin)
    before, after = np.ones((len(begin), labels), np.float32), np.full((len(begin), labels), 1 / labels, np.float32)

    def rows(some: np.ndarray) -> tuple[np.ndarray, int]:
        steps = int(length[some].max())
        return np.minimum(begin[some][:, None] + np.arange(steps), len(scores) - 1), steps

    def dealt(of: np.ndarray) -> Iterator[np.ndarray]:
        of = of[np.argsort(length[of], kind="stable")]
        yield from (some for some in np.array_split(of, max(1, len(of) // 2048)) if len(some))

    several = np.flatnonzero(np.repeat(per, per) > 1)
    if len(several):
        matrix = np.zeros((len(begin), labels, labels), np.float32)
        for some in dealt(several):
            matrix[some] = transfer(scores[rows(some)[0]], transitions, length[some], nth[some] == 0)
        t = np.exp(transitions - transitions.max()).astype(np.float32)
        message = np.ones((len(begin), labels), np.float32)
        by_nth = [np.flatnonzero(nth == 0)]
        while len(next_ := by_nth[-1][by_nth[-1] + 1 < len(nth)] + 1) and len(next_ := next_[nth[next_] > 0]):
            by_nth.append(next_)
        for now in by_nth[1:]:  # from a text's first block to its last
            m = np.einsum("bi,bij->bj", message[now - 1], matrix[now - 1])
            message[now] = m / m.sum(1, keepdims=True)
            before[now] = message[now] @ t
        for now in reversed(by_nth[1:]):  # and back
            m = np.einsum("bij,bj->bi", matrix[now], after[now])
            after[now - 1] = m / m.sum(1, keepdims=True)
    out = np.empty_like(scores)
    for some in dealt(np.arange(len(begin))):
        at, steps = rows(some)
        p = probabilities(scores[at], transitions, length[some], before[some], after[some])
        live = np.arange(steps)[None, :] < length[some][:, None]
        out[at[live]] = p[live]
    return [out[s:e] for s, e in zip(first[:-1], first[1:])]


def verdict(field: Field, words: list[str], p: np.ndarray) -> tuple[str, float]:
    if not words or not field.labels:
        return NONE, 0.0
    mass = np.array([min(len(w), 40) for w in words]) @ p
    best = int(mass.argmax())
    return field.labels[best], float(min(1.0, mass[best] / mass.sum()))


def _predict(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field: Field = shared.value
        emissions = emissions_of(field)
        for batch in batches:
            got: list[tuple[str, float]] = []
            waiting, chars = [], 0

            def flush() -> None:
                got.extend(verdict(field, w, p) for w, p in zip(waiting, label_words(emissions, waiting) if field.labels else waiting))
                waiting.clear()

            for text in batch.column(TEXT):
                waiting.append(words_of(text.as_py()))
                chars += len(waiting[-1])
                if chars > CHARS // 6:
                    flush()
                    chars = 0
            flush()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != TEXT), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*(c for c in batch.schema.names if c != TEXT), "lang_pred", "score"])

    return predict


def fit(docs: DataFrame, per_label: int = 250, max_bytes: int = 20_000, text_col: str = "text", lang_col: str = "lang", **training) -> Field:
    """A field of all labels, from `per_label` different texts of each at most, dealt by hash; training: of `train`."""
    rows = docs.select(docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    rows = rows.filter(F.octet_length("text") <= max_bytes).withColumn("nr", F.xxhash64("text", "lang"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("nr").alias("n")).collect()  # a row a label
    if not counts:
        return Field([], np.zeros((FEATURES, 0), np.float32), np.zeros((0, 0)), {})
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 1.5 * per_label / max(1, r["n"])))]), F.col("lang"))
    some = rows.filter(F.pmod("nr", F.lit(1 << 20)) < share * (1 << 20)).dropDuplicates(["nr"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("nr", "text"))  # of about 1.5 * per_label rows
    sample = some.withColumn("nth", nth).filter(F.col("nth") <= per_label).orderBy("nr", "text").collect()
    return train([(r["text"], r["lang"]) for r in sample], **({"sequences": max(1500, 60 * len(counts))} | training))


def predict(docs: DataFrame, field: Field, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but the text, by default), lang_pred and score.

    A null text or one without a letter is `und` with score 0, and so is any text if no label was learned.
    Nothing but the text is read for a prediction; equal texts get equal ones; an empty table gives no rows. Columns
    of the table that are named lang_pred, score or __text are replaced or left out.
    """
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    keep = [c for c in keep if c not in ("lang_pred", "score", TEXT)]
    chosen = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias(TEXT))
    schema = T.StructType([*(f for f in chosen.schema if f.name != TEXT), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return chosen.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(field)), schema)


def remainder(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 3


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = fit(docs.filter(remainder() != 1))
    rows = docs.select("doc_id", F.coalesce(remainder() == 1, F.lit(False)).alias("held_out"), "text")
    return predict(rows, field)
